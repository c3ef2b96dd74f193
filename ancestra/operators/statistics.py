"""Resampling statistics and agreement measures as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def empirical_p(null: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, observed, null_mean, null_p95, percentile_in_null, ratio_vs_matched, p, n_null: one-sided, (1 + #{null >= observed}) / (1 + n)."""
    rows = null.join(observed, keys).groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.avg(value).alias("null_mean"), F.percentile(value, F.lit(0.95)).alias("null_p95"),
        F.avg((F.col(value) < F.col("observed")).cast("int")).alias("percentile_in_null"),
        F.count(F.when(F.col(value) >= F.col("observed"), 1)).alias("at_least"), F.count(value).alias("n_null"),
    )
    inf = F.lit(float("inf"))
    ratio = F.when(F.col("null_mean") != 0, F.col("observed") / F.nullif(F.col("null_mean"), F.lit(0.0))).when(F.col("observed") > 0, inf).otherwise(1.0)
    return rows.withColumns({"p": (1 + F.col("at_least")) / (1 + F.col("n_null")), "ratio_vs_matched": ratio}).drop("at_least")


def holm(tests: DataFrame, family: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """tests (with p) with p_holm and reject, step-down within each family; order breaks ties."""
    w = W.partitionBy(*family).orderBy("p", *order)
    m = F.count("*").over(W.partitionBy(*family))
    rows = tests.withColumn("scaled", (m - F.row_number().over(w) + 1) * F.col("p"))
    p = F.least(F.lit(1.0), F.max("scaled").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("p_holm", p).withColumn("reject", F.col("p_holm") <= alpha).drop("scaled")


def cliffs_delta(null: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    above, below = (F.avg(c.cast("int")) for c in (F.col("observed") > F.col(value), F.col("observed") < F.col(value)))
    return null.join(observed, keys).groupBy(*keys).agg((above - below).alias("cliffs_delta"))


def detectable(null: DataFrame, keys: list[str], value: str = "value", alpha: float = 0.05, tests: int = 20) -> DataFrame:
    """keys, null_mean, critical, min_detectable_excess: the least integer loss that the strictest Holm step rejects."""
    w = W.partitionBy(*keys)
    rows = null.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(F.desc(value)))})
    m = F.floor(F.lit(alpha / tests) * (F.col("n") + 1) - 1)
    out = rows.groupBy(*keys).agg(F.avg(value).alias("null_mean"), F.max(F.when(F.col("rn") == m + 1, F.col(value) + 1)).alias("c"), F.max(m).alias("m"))
    critical = F.when(F.col("m") < 0, F.lit(float("inf"))).otherwise(F.col("c").cast("double"))
    return out.select(*keys, "null_mean", critical.alias("critical"), (critical - F.col("null_mean")).alias("min_detectable_excess"))


def kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa, by the confusion counts."""
    cells = ratings.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    rows, columns = cells.groupBy(F.col("a").alias("k")).agg(F.sum("c").alias("r")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("c").alias("s"))
    chance = rows.join(columns, "k").agg(F.sum(F.col("r") * F.col("s")).alias("rs"))
    one = total.join(chance, how="cross")  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("rs") / (F.col("n") * F.col("n"))
    return one.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the interval of a share."""
    p, z2 = hits / n, z * z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


def ratings(key: DataFrame, a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """key (item, stratum) with the labels A and B that two raters (item, label) gave; every item needs both, once."""
    rows = key.join(a.select(item, F.col("label").alias("A")), item).join(b.select(item, F.col("label").alias("B")), item)
    wanted, found = key.agg(F.count("*").alias("wanted")), rows.agg(F.count("*").alias("found"))
    fits = wanted.join(found, how="cross").select((F.col("wanted") == F.col("found")).alias("fits"))  # one row each
    return rows.join(fits, how="cross").where(F.coalesce(F.when(F.col("fits"), True).otherwise(F.raise_error("a label is missing or repeated").cast("boolean")), F.lit(False))).drop("fits")


def agreement(rows: DataFrame, undecided: int = 9) -> DataFrame:
    """One row for labels A, B: n, n_both_decidable, agreement and kappa on those, kappa of all labels, disagreements."""
    both = rows.where((F.col("A") != undecided) & (F.col("B") != undecided))
    two = kappa(both, "A", "B").select(F.col("n").alias("n_both_decidable"), "agreement", F.col("kappa").alias("kappa_binary"))
    three = kappa(rows, "A", "B").select("n", F.col("kappa").alias("kappa_3cat_all"))
    apart = rows.agg(F.count_if(F.col("A") != F.col("B")).alias("n_disagreements"))
    return three.join(two, how="cross").join(apart, how="cross")  # one row each


def stratum_precision(rows: DataFrame, genuine: tuple[str, ...], undecided: int = 9) -> DataFrame:
    """Of each stratum and rater (and of the labels both gave): n decided, hits, share, Wilson bounds; a genuine stratum wants the label 0, others 1."""
    want = F.when(F.col("stratum").isin(*genuine), 0).otherwise(1)
    consensus = F.when(F.col("A") == F.col("B"), F.col("A"))
    labels = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("A", "B", "consensus"))), F.array("A", "B", consensus))).alias("rater", "label")
    counted = rows.select("stratum", want.alias("want"), labels).where(F.col("label").isNotNull() & (F.col("label") != undecided))
    n = counted.groupBy("stratum", "rater").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("want")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return n.select("stratum", "rater", "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), low.alias("low"), high.alias("high"))


def bootstrap_share(rows: DataFrame, flag: str, replicates: int = 5000) -> DataFrame:
    """share, low, high: the 2.5 and 97.5 percentiles of a share over resamples with replacement.

    Each replicate draws as many rows as there are, by md5 of (replicate, draw) modulo their number: rows that agree in
    the flag are interchangeable, so a drawn number below the count of flagged rows is a flagged one. Draws are summed
    where they are made; what is shuffled is a row a replicate.
    """
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("h"))
    block, last = F.lit(4096), F.col("n") - 1  # draws that one row makes at a time
    draws = total.where("n > 0").select("n", "h", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.select("n", "h", "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block))).alias("b")).repartition("replicate", "b")
    draws = draws.select("n", "h", "replicate", F.explode(F.sequence(F.col("b") * block, F.least(last, F.col("b") * block + block - 1))).alias("draw"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", "replicate", "draw")), 1, 12), 16, 10).cast("long") % F.col("n")
    shares = draws.groupBy("replicate").agg((F.count_if(at < F.col("h")) / F.max("n")).alias("share"))
    bounds = shares.agg(F.percentile("share", F.lit(0.025)).alias("low"), F.percentile("share", F.lit(0.975)).alias("high"))
    return total.select((F.col("h") / F.nullif("n", F.lit(0))).alias("share")).join(bounds, how="cross")  # one row each


def h1(counts: DataFrame, column: str = "n_root_lineages") -> DataFrame:
    """share_single and whether most options hang on a single lineage."""
    share = F.avg((F.col(column) == 1).cast("int"))
    return counts.agg(F.count("*").alias("n_options"), share.alias("share_single"), (share > 0.5).alias("supported"))


def h3(losses: DataFrame, focus: list[str]) -> DataFrame:
    """cls, pct_models, pct_collateral_commercial_lost, ratio, supported (of the focus classes together: every ratio over 1)."""
    ratio = F.when(F.col("pct_models") > 0, F.col("pct_collateral_commercial_lost") / F.nullif(F.col("pct_models"), F.lit(0.0)))
    rows = losses.withColumn("ratio", ratio)
    ok = rows.where(F.col("cls").isin(focus)).agg((F.count(F.when(F.col("ratio") > 1, 1)) == len(focus)).alias("supported"))
    return rows.join(ok, how="cross")  # one row


def h1_planned(counts: DataFrame, column: str = "n_root_lineages", replicates: int = 5000) -> DataFrame:
    """share, low, high, n_options, supported: whether the bootstrap interval of the share of single lineages lies above a half."""
    some = counts.where(F.col(column) > 0).withColumn("__single", F.col(column) == 1)
    n = some.agg(F.count("*").alias("n_options"))
    return bootstrap_share(some, "__single", replicates).join(n, how="cross").withColumn("supported", F.col("low") > 0.5)  # one row each


def h2(results: DataFrame, keys: list[str], metric: str = "pct_options_lost") -> DataFrame:
    """A row for each shock (keys), k and targeted strategy: its loss against the draws matched to it, with Holm's step-down over the shock.

    results: keys, k, strategy, matched_to, removed_providers, the metric. Strategies 'random' and 'greedy' are
    references: ratio_vs_uniform_ref and greedy_ref.
    """
    by = [*keys, "k"]
    targeted = results.where(~F.col("strategy").isin("random", "random_matched", "greedy") & ~F.col("strategy").startswith("license:"))
    observed = targeted.select(*by, "strategy", F.col(metric).alias("observed"), "removed_providers")
    null = results.where("strategy = 'random_matched'").select(*by, F.col("matched_to").alias("strategy"), F.col(metric).alias("value"))
    rows = empirical_p(null, observed.drop("removed_providers"), [*by, "strategy"]).join(observed.drop("observed"), [*by, "strategy"])
    uniform = results.where("strategy = 'random'").groupBy(*by).agg(F.avg(metric).alias("uniform_mean"))
    greedy = results.where("strategy = 'greedy'").groupBy(*by).agg(F.max(metric).alias("greedy_ref"))
    rows = rows.join(uniform, by, "left").join(greedy, by, "left")
    ratio = F.when(F.col("uniform_mean") > 0, F.col("observed") / F.nullif("uniform_mean", F.lit(0.0)))
    return holm(rows.withColumn("ratio_vs_uniform_ref", ratio), keys, ["k", "strategy"])


def planned(results: DataFrame, metric: str = "pct_options_lost") -> DataFrame:
    """Tests of H2a (every strategy against uniform draws) and H2b (descendants against bin-matched ones), Holm within each, with
    Cliff's delta and the ratio of mean nodes lost in the null to those of the target."""
    out = None
    for hyp, draws, only in (("H2a", "random", None), ("H2b", "random_matched", "descendants")):
        observed = results.where(~F.col("strategy").isin("random", "random_matched") & ~F.col("strategy").startswith("license:"))
        observed = (observed.where(F.col("strategy") == only) if only else observed).select("k", "strategy", F.col(metric).alias("observed"), "models_lost")
        null = results.where(F.col("strategy") == draws).select("k", F.col(metric).alias("value"), F.col("models_lost").alias("null_lost"))
        each = null.join(observed.select("k", "strategy").distinct(), "k")
        p = empirical_p(each, observed.drop("models_lost"), ["k", "strategy"]).select("k", "strategy", "observed", "null_mean", "p")
        delta = cliffs_delta(each, observed.drop("models_lost"), ["k", "strategy"])
        size = null.groupBy("k").agg(F.avg("null_lost").alias("null_lost"))
        rows = p.join(delta, ["k", "strategy"]).join(observed.select("k", "strategy", "models_lost"), ["k", "strategy"]).join(size, "k")
        rows = rows.select(F.lit(hyp).alias("hyp"), "k", "strategy", "observed", "null_mean", "p", "cliffs_delta", (F.col("null_lost") / F.nullif("models_lost", F.lit(0))).alias("null_per_target"))
        out = rows if out is None else out.unionByName(rows)
    return holm(out, ["hyp"], ["k", "strategy"])


def h3_planned(losses: DataFrame) -> DataFrame:
    """cls, ratio of commercial options lost (the class's own included) to its share of nodes, supported: whether any ratio is over 1."""
    ratio = F.when(F.col("pct_models") > 0, F.col("pct_commercial_lost") / F.nullif("pct_models", F.lit(0.0)))
    rows = losses.select("cls", ratio.alias("ratio"))
    return rows.join(rows.agg(F.coalesce(F.bool_or(F.col("ratio") > 1), F.lit(False)).alias("supported")), how="cross")  # one row


def verdicts(tests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k_significant, k_total, supported: at which k any strategy rejects, and whether at more than half."""
    per = tests.groupBy(*keys, "k").agg(F.bool_or("reject").alias("any"))
    return per.groupBy(*keys).agg(F.count_if("any").alias("k_significant"), F.count("*").alias("k_total"), (F.count_if("any") * 2 > F.count("*")).alias("supported"))
