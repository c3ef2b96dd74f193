"""Violations of what result tables must hold, as rows (check, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _found(df: DataFrame, check: str, *detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in detail)).alias("detail"))


def violations(results: DataFrame, keys: list[str], percents: list[str], monotone: str | None = None, expected: dict[str, int] | None = None, target: str = "k") -> DataFrame:
    """duplicates of keys, missing or out-of-range percentages, losses that fall as k grows, and wrong row counts per strategy."""
    out = [_found(results.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "duplicate", *keys)]
    for c in percents:
        out.append(_found(results.where(F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 100)), f"range:{c}", *keys))
    if monotone:
        rest = [k for k in keys if k != target]
        step = F.col(monotone) - F.lag(monotone).over(W.partitionBy(*rest).orderBy(target))
        out.append(_found(results.withColumn("step", step).where("step < 0"), f"monotone:{monotone}", *keys))
    for strategy, n in (expected or {}).items():
        out.append(_found(results.where(F.col("strategy") == strategy).agg(F.count("*").alias("n")).where(F.col("n") != n).withColumn("strategy", F.lit(strategy)), "rows", "strategy", "n"))
    return reduce(DataFrame.unionByName, out)


def matched_sizes(nulls: DataFrame, targets: DataFrame, keys: list[str], least: float = 0.95) -> DataFrame:
    return _found(nulls.join(targets, keys).where(F.col("removed") < least * F.col("target")), "size", *keys, "removed", "target")


def _told(df: DataFrame, check: str, *detail) -> DataFrame:
    return df.select("variant", F.lit(check).alias("check"), F.concat_ws(" ", *(F.coalesce(d.cast("string"), F.lit("-")) for d in detail)).alias("detail"))


def missing_files(files: DataFrame, variants: DataFrame, wanted: list[str]) -> DataFrame:
    """files (variant, file) that a variant should have and has not."""
    need = variants.select("variant", F.explode(F.array(*map(F.lit, wanted))).alias("file"))
    return _told(need.join(files.select("variant", "file").distinct(), ["variant", "file"], "left_anti"), "files", F.col("file"))


def settings(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Settings (variant, setting, value) that differ from the expected ones, or are missing."""
    rows = expected.join(found.select("variant", "setting", F.col("value").alias("got")), ["variant", "setting"], "left")
    return _told(rows.where(~F.col("got").eqNullSafe(F.col("value"))), "config", F.col("setting"), F.col("got"), F.col("value"))


def test_table(tests: DataFrame, verdict: DataFrame, n_tests: int, n_draws: int) -> DataFrame:
    """Of test rows (variant, semantics, k, p, p_holm, reject, n_null): wrong numbers of tests or draws, adjusted p below p, and
    counts of significant k other than the verdicts' (variant, semantics, k_significant)."""
    size = tests.groupBy("variant", "semantics").agg(F.count("*").alias("n")).where(F.col("n") != n_tests)
    k = tests.groupBy("variant", "semantics", "k").agg(F.bool_or("reject").alias("any")).groupBy("variant", "semantics").agg(F.count_if("any").alias("got"))
    k = k.join(verdict, ["variant", "semantics"]).where("got <> k_significant")
    out = [
        _told(size, "tests", F.col("semantics"), F.col("n")),
        _told(tests.where(F.col("p_holm") + 1e-12 < F.col("p")), "holm", F.col("semantics"), F.col("k")),
        _told(tests.where(F.col("n_null") != n_draws), "draws", F.col("semantics"), F.col("k"), F.col("n_null")),
        _told(k, "verdict", F.col("semantics"), F.col("got"), F.col("k_significant")),
    ]
    return reduce(DataFrame.unionByName, out)


def option_counts(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Of options (variant, option, n_root_lineages, _known, _arch): numbers other than the results' totals (variant, options_total),
    repeated options, and counts of narrower definitions above the plain one."""
    n = counts.groupBy("variant").agg(F.count_if(F.col("n_root_lineages") > 0).alias("n")).join(totals, "variant").where("n <> options_total")
    twice = counts.groupBy("variant", "option").agg(F.count("*").alias("n")).where("n > 1")
    out = [_told(n, "options", F.col("n"), F.col("options_total")), _told(twice, "option", F.col("option"))]
    for c in ("n_root_lineages_known", "n_root_lineages_arch"):
        out.append(_told(counts.where(F.col(c) > F.col("n_root_lineages")), c, F.col("option")))
    return reduce(DataFrame.unionByName, out)


def log_exits(lines: DataFrame, steps: int = 3) -> DataFrame:
    """Of log lines (variant, n, line): last runs (from the last line that names the first step on) whose exits aren't `steps` zeros."""
    last = lines.where(F.col("line").contains("removal")).groupBy("variant").agg(F.max("n").alias("from"))
    code = F.regexp_extract("line", r"exit (-?\d+)", 1)
    rows = lines.join(last, "variant", "left").where((F.col("n") >= F.coalesce("from", F.lit(0))) & (code != ""))
    got = rows.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("n", code.alias("code")))).alias("x"))  # a few lines a run
    got = lines.select("variant").distinct().join(got, "variant", "left").withColumn("exits", F.coalesce(F.concat_ws(",", "x.code"), F.lit("")))
    return _told(got.where(F.col("exits") != ",".join(["0"] * steps)), "exits", F.col("exits"))


def variant_direction(sizes: DataFrame, base: str, moves: dict[str, tuple[str, str]]) -> DataFrame:
    """sizes (variant, providers, edges, options) that don't move from the base as a variant must: variant -> (column, '<', '>' or '=')."""
    b = sizes.where(F.col("variant") == base)
    out = []
    for name, (column, sign) in moves.items():
        rows = sizes.where(F.col("variant") == name).select("variant", F.col(column).alias("got")).join(b.select(F.col(column).alias("was")), how="cross")  # one row
        fine = {"<": F.col("got") < F.col("was"), ">": F.col("got") > F.col("was"), "=": F.col("got") == F.col("was")}[sign]
        out.append(_told(rows.where(~fine), f"direction:{column}", F.col("got"), F.lit(sign), F.col("was")))
    return reduce(DataFrame.unionByName, out)
