"""Rule-based flags and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.functions import names
from ancestra.operators.ingest import keep_first

LEAST_AUTHORS, MOST_CHILDREN = 50, 10


def flags(nodes: DataFrame, edges: DataFrame, edges_all: DataFrame, least_authors: int = LEAST_AUTHORS, most_children: int = MOST_CHILDREN, drop_rules: tuple[str, ...] = ()) -> DataFrame:
    """model_id, bot_*, f_*, tier, in_T1, in_T2. Names are joined to their number of authors by a hash join on the name."""
    n = nodes.withColumn("nm", names.repo_name(F.col("model_id")))
    shared = n.where("nm is not null").groupBy("nm").agg(F.count_distinct("author").alias("authors"))
    first = keep_first(n.where("nm is not null"), ["nm"], F.asc_nulls_last("created_at"), "model_id").select("model_id", F.lit(True).alias("is_first"))
    side = lambda df, column, flag: df.select(F.col(column).alias("model_id")).distinct().withColumn(flag, F.lit(True))
    rows = n.join(shared, "nm", "left").join(first, "model_id", "left")
    rows = rows.join(side(edges.where("relation = 'quantized'"), "child_id", "is_quant"), "model_id", "left").join(side(edges_all.where("source = 'inferred_mirror'"), "child_id", "is_mirror"), "model_id", "left")
    rows = rows.join(side(edges_all, "child_id", "is_child"), "model_id", "left").join(edges_all.groupBy(F.col("parent_id").alias("model_id")).agg(F.count("*").alias("children")), "model_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bots = {f"bot_{k}": names.matches(F.col("nm"), p) for k, p in names.BOT_PATTERNS.items()} | {"bot_author": F.coalesce(F.col("author").isin(names.BOT_AUTHORS), F.lit(False))}
    rl = F.coalesce(F.col("pipeline_tag") == "reinforcement-learning", F.lit(False))
    rules = {
        "f_bot": reduce(lambda a, b: a | b, bots.values()),
        "f_boilerplate": (F.coalesce("authors", F.lit(0)) >= least_authors) & ~yes("is_quant") & ~yes("is_first") & ~yes("is_mirror") & (F.coalesce("children", F.lit(0)) < most_children),
        "f_course": names.matches(F.col("nm"), names.COURSE_PATTERN) | (rl & F.coalesce(F.col("library_name").isin(names.RL_COURSE_LIBS), F.lit(True))),
        "f_test": names.matches(F.col("nm"), names.TEST_PATTERN),
        "f_empty": F.col("pipeline_tag").isNull() & F.col("library_name").isNull() & F.col("license").isNull() & ~((F.col("n_parents") > 0) | yes("is_child")),
        "f_zero_downloads": F.coalesce("downloads_all", F.lit(0)) == 0,
    }
    out = rows.select("model_id", *(c.alias(k) for k, c in (bots | rules).items()))
    bad = reduce(lambda a, b: a | b, [F.col(k) for k in rules if k not in ("f_zero_downloads", *drop_rules)])
    zero = F.col("f_zero_downloads")
    return out.withColumns({"tier": F.when(bad, "T0").when(zero, "T1").otherwise("T2"), "in_T1": ~bad, "in_T2": ~bad & ~zero})
