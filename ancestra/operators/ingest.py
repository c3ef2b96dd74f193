"""Raw records to node, edge and dataset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions import names

# Two-letter language codes.
LANGUAGES = """aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs
cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht
hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg
li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa
pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti
tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu""".split()  # fmt: skip
#: The day of a bulk migration: creation dates of that day are not known.
LEGACY_DAY = "2022-03-02"


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key: the first by an order that must be total."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def parse_tags(raw: DataFrame) -> DataFrame:
    """raw with parents (map parent -> relation), licenses, languages and datasets (arrays)."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    rest = F.transform(F.filter(tags, lambda t: t.startswith("base_model:")), lambda t: F.substring(t, 12, F.lit(1 << 30)))
    head, tail = (lambda r: F.substring_index(r, ":", 1)), (lambda r: F.substring(r, F.length(F.substring_index(r, ":", 1)) + 2, F.lit(1 << 30)))
    typed = lambda r: head(r).isin(names.RELATIONS) & (F.length(tail(r)) > 0)
    pairs = F.filter(F.transform(rest, lambda r: F.struct(tail(r).alias("parent"), head(r).alias("relation"), typed(r).alias("ok"))), lambda x: x["ok"])
    loose = F.array_distinct(F.filter(rest, lambda r: ~typed(r)))
    ids = F.array_distinct(F.transform(pairs, lambda x: x["parent"]))
    last = lambda p: F.element_at(F.filter(pairs, lambda x: x["parent"] == p), -1)["relation"]  # noqa: E731  the last typed tag of a parent counts
    all_ids = F.array_union(ids, loose)
    relation = F.transform(all_ids, lambda p: F.when(F.array_contains(ids, p), last(p)).otherwise(F.lit("unspecified")))
    after = lambda prefix: F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, F.lit(1 << 30)))
    return raw.withColumns({"parents": F.map_from_arrays(all_ids, relation), "licenses": after("license:"), "datasets": after("dataset:"), "languages": F.filter(tags, lambda t: t.isin(LANGUAGES))})


def build(raw: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and dataset_edges of raw records; of repeated ids (and edges) the first by `order` counts."""
    rows = parse_tags(keep_first(raw, ["id"], order))
    created = F.try_to_timestamp(F.col("createdAt"))
    languages = F.nullif(F.array_join(F.array_sort(F.array_distinct("languages")), ","), F.lit(""))
    legacy = F.coalesce(F.to_date(created) == F.lit(LEGACY_DAY).cast("date"), F.lit(False))
    nodes = rows.select(
        F.col("id").alias("model_id"), names.author(F.col("author"), F.col("id")).alias("author"), created.alias("created_at"), F.col("lastModified").alias("last_modified"), "pipeline_tag", "library_name",
        F.get("licenses", F.lit(0)).alias("license"), F.size("licenses").alias("n_licenses"), languages.alias("languages"),
        F.col("downloads").alias("downloads_30d"), F.col("downloadsAllTime").alias("downloads_all"), "likes", F.initcap(F.col("gated").cast("string")).alias("gated"),
        F.size("parents").alias("n_parents"), F.size("datasets").alias("n_datasets"), legacy.alias("created_at_legacy"),
    )
    nodes = nodes.withColumn("gated", F.when(F.col("gated").isin("True", "False"), F.col("gated")).otherwise(F.lower("gated")))
    edges = rows.select(F.col(order).alias("__o"), F.col("id").alias("child_id"), F.explode("parents").alias("parent_id_declared", "relation"))
    spelling = keep_first(rows.select(F.lower("id").alias("low"), "id", order), ["low"], order).select("low", F.col("id").alias("spelt"))
    edges = edges.join(spelling, F.lower("parent_id_declared") == F.col("low"), "left").withColumn("parent_id", F.coalesce("spelt", "parent_id_declared"))
    edges = keep_first(edges, ["parent_id", "child_id", "relation"], "__o", "parent_id_declared").where("parent_id <> child_id")
    when = lambda side: nodes.select(F.col("model_id").alias(f"{side}_id"), F.when(~F.col("created_at_legacy"), F.col("created_at")).alias(f"{side}_at"), F.lit(True).alias(f"{side}_there"))
    edges = edges.join(when("parent"), "parent_id", "left").join(when("child"), "child_id", "left")
    edges = edges.select("parent_id", "child_id", "relation", "parent_id_declared", F.coalesce("parent_there", F.lit(False)).alias("parent_in_snapshot"), (F.col("parent_at") <= F.col("child_at")).alias("temporal_ok"))
    return nodes, edges, rows.select(F.explode("datasets").alias("dataset_id"), F.col("id").alias("model_id"))


def architecture(raw: DataFrame, whitelist: list[str], order: str) -> DataFrame:
    """model_id, arch: the first tag that the whitelist (a parameter) has."""
    return keep_first(raw, ["id"], order).select(F.col("id").alias("model_id"), names.first_in(F.coalesce("tags", F.array().cast("array<string>")), whitelist).alias("arch")).where("arch is not null")
