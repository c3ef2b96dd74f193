"""Reconnecting missing parents, and edges inferred from names.

nodes: model_id, author, created_at. edges: parent_id, child_id, relation, parent_id_declared, parent_in_snapshot, temporal_ok.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.functions import names
from ancestra.operators.ingest import keep_first

POPULAR = 20  # children from which on a name is looked for in copies
EMBEDDING_AUTHOR = "RichardErkhov"  # fixed value: writes owner_-_name


def lookup_missing(edges: DataFrame, lookup: DataFrame, nodes: DataFrame, least_children: int = 1) -> DataFrame:
    """parent_id, children, status, resolved_id, in_snapshot of absent parents, by a table (parent_id, code, found_id) of answers."""
    missing = edges.where("not parent_in_snapshot").groupBy("parent_id").agg(F.count("*").alias("children"))
    rows = missing.join(lookup, "parent_id", "left").withColumn("local", names.id_of_local_path(F.col("parent_id")))
    asked = F.col("children") >= least_children
    moved = F.col("found_id") != F.col("parent_id")
    status = (
        F.when(F.col("local").isNotNull(), "local_path").when(~asked, "not_checked").when(F.coalesce(F.col("code") != 200, F.lit(True)), "unavailable")
        .when(moved & (names.repo_name(F.col("found_id")) == names.repo_name(F.col("parent_id"))), "renamed").when(moved, "alias").otherwise("same")
    )
    rows = rows.select("parent_id", "children", status.alias("status"), F.coalesce("local", F.when(asked & (F.col("code") == 200), F.col("found_id"))).alias("resolved_id"))
    there = nodes.select(F.col("model_id").alias("resolved_id"), F.lit(True).alias("there"))
    return rows.join(there, "resolved_id", "left").select("parent_id", "children", "status", "resolved_id", F.coalesce("there", F.lit(False)).alias("in_snapshot"))


def fetched_names(wanted: DataFrame, done: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """key, license_name, answered: of the ids that were not asked for before, by a table of answers (key, license_name)."""
    rows = wanted.select(key).distinct().join(done.select(key), key, "left_anti")
    return rows.join(answers.select(key, "license_name", F.lit(True).alias("answered")), key, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def reconnect(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges whose absent parent is known under another id point there; loops and repeats go."""
    fixed = resolved.where(F.col("status").isin("renamed", "alias", "local_path") & F.col("in_snapshot")).select("parent_id", "resolved_id", "status")
    rows = edges.join(fixed, "parent_id", "left").withColumn("hit", ~F.col("parent_in_snapshot") & F.col("resolved_id").isNotNull())
    rows = rows.select(
        F.when(F.col("hit"), F.col("resolved_id")).otherwise(F.col("parent_id")).alias("parent_id"), "child_id", "relation", "parent_id_declared",
        (F.col("parent_in_snapshot") | F.col("hit")).alias("parent_in_snapshot"), F.when(~F.col("hit"), F.col("temporal_ok")).alias("temporal_ok"), F.when(F.col("hit"), F.col("status")).alias("parent_resolution"), "hit",
    ).where("parent_id <> child_id")
    return keep_first(rows, ["parent_id", "child_id", "relation"], "hit", "parent_id_declared").drop("hit")


def _orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("child_id").alias("model_id")).distinct(), "model_id", "left_anti")


def by_embedded_name(nodes: DataFrame, edges: DataFrame, author: str = EMBEDDING_AUTHOR) -> DataFrame:
    """parent_id, child_id: orphans of an author whose name embeds the parent's id."""
    rows = _orphans(nodes, edges).where(F.col("author") == author).select("model_id", F.lower(names.embedded_parent(F.get(F.split("model_id", "/", 2), F.lit(1)))).alias("low"))
    known = keep_first(nodes.select("model_id", F.lower("model_id").alias("low")), ["low"], "model_id").select(F.col("model_id").alias("parent_id"), "low")
    return rows.join(known, "low").select("parent_id", F.col("model_id").alias("child_id")).where("parent_id <> child_id")


def mirrors(nodes: DataFrame, edges: DataFrame, popular: int = POPULAR) -> DataFrame:
    """parent_id, child_id: orphans named like exactly one popular node, themselves not popular and not older."""
    top = edges.groupBy(F.col("parent_id").alias("model_id")).agg(F.count("*").alias("n")).where(F.col("n") >= popular).select("model_id")
    named = nodes.join(top, "model_id", "left_semi").select("model_id", "created_at", names.repo_name(F.col("model_id")).alias("nm"))
    unique = named.groupBy("nm").agg(F.count("*").alias("n"), F.first("model_id").alias("parent_id"), F.first("created_at").alias("parent_at")).where("n = 1 and nm is not null")
    rows = _orphans(nodes, edges).join(top, "model_id", "left_anti").withColumn("nm", names.repo_name(F.col("model_id")))
    return rows.join(unique, "nm").where("created_at >= parent_at and model_id <> parent_id").select("parent_id", F.col("model_id").alias("child_id"))


def quantised(nodes: DataFrame, edges: DataFrame, taken: DataFrame) -> DataFrame:
    """parent_id, child_id: orphans with a quantisation suffix whose stripped name is that of exactly one node, not older."""
    name = names.repo_name(F.col("model_id"))
    unique = nodes.groupBy(name.alias("base")).agg(F.count("*").alias("n"), F.first("model_id").alias("parent_id"), F.first("created_at").alias("parent_at")).where("n = 1 and base is not null")
    rows = _orphans(nodes, edges).join(taken.select(F.col("child_id").alias("model_id")), "model_id", "left_anti").where(names.matches(name, names.QUANT_SUFFIX))
    rows = rows.withColumn("base", names.without_quant_suffix(name))
    return rows.join(unique, "base").where("model_id <> parent_id and created_at >= parent_at").select("parent_id", F.col("model_id").alias("child_id"))


def with_inferred(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges with their source; declared ones first, then embedded names, mirrors, quantised ones; one row a pair."""
    name, mirror = by_embedded_name(nodes, edges), mirrors(nodes, edges)
    quant = quantised(nodes, edges, name.unionByName(mirror))
    at = lambda side: nodes.select(F.col("model_id").alias(f"{side}_id"), F.col("created_at").alias(f"{side}_at"))
    parts = [edges.withColumns({"source": F.lit("declared"), "rank": F.lit(0)})]
    for rank, (df, source, relation) in enumerate(((name, "inferred_name", "quantized"), (mirror, "inferred_mirror", "mirror"), (quant, "inferred_quant", "quantized")), 1):
        timed = df.join(at("parent"), "parent_id").join(at("child"), "child_id").select("parent_id", "child_id", F.lit(relation).alias("relation"), F.lit(True).alias("parent_in_snapshot"), (F.col("parent_at") <= F.col("child_at")).alias("temporal_ok"), F.lit(source).alias("source"), F.lit(rank).alias("rank"))
        parts.append(timed)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, ["parent_id", "child_id"], "rank", "relation").drop("rank")
