"""Lineage tables over the star schema: a node per order, edges to orders with smaller keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.functions.licenses import license_class

#: The same tables in DuckDB's SQL, to be put in front of a query.
SQL = """
lic AS (SELECT * FROM (VALUES ('apache-2.0','permissive'),('cc-by-nc-4.0','noncommercial'),('llama3','vendor_custom'),('gpl-3.0','copyleft')) t(license, cls)),
nodes0 AS (
  SELECT o_orderkey AS node, 'acct' || o_custkey AS author, o_orderdate AS created_at, o_orderpriority || '#' || (o_custkey % 40) AS task,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'en,' || lower(o_orderstatus) ELSE lower(o_orderstatus) END AS languages,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'apache-2.0' WHEN 'MACHINERY' THEN 'cc-by-nc-4.0' WHEN 'HOUSEHOLD' THEN 'llama3' WHEN 'AUTOMOBILE' THEN 'gpl-3.0' END AS license,
    CAST(floor(o_totalprice) AS BIGINT) AS downloads, (o_orderkey % 13 <> 0) AS is_provider
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
nodes AS (SELECT n.*, coalesce(cls, 'unknown') AS cls FROM nodes0 n LEFT JOIN lic USING (license)),
edges AS (
  SELECT o_orderkey // (2 + o_custkey % 3) AS p, o_orderkey AS ch, CASE o_orderkey % 5 WHEN 0 THEN 'finetune' WHEN 1 THEN 'adapter' WHEN 2 THEN 'quantized' WHEN 3 THEN 'merge' ELSE 'mirror' END AS relation
  FROM orders WHERE o_orderkey >= 20 AND o_custkey % 11 <> 0
  UNION ALL SELECT o_orderkey // 5, o_orderkey, 'merge' FROM orders WHERE o_orderkey >= 20 AND o_custkey % 7 = 0 AND o_custkey % 11 <> 0)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    license_ = F.when(segment == "BUILDING", "apache-2.0").when(segment == "MACHINERY", "cc-by-nc-4.0").when(segment == "HOUSEHOLD", "llama3").when(segment == "AUTOMOBILE", "gpl-3.0")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.col("o_orderkey").alias("node"),
        F.concat(F.lit("acct"), F.col("o_custkey")).alias("author"),
        F.col("o_orderdate").alias("created_at"),
        F.concat("o_orderpriority", F.lit("#"), F.col("o_custkey") % 40).alias("task"),
        F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("en,"), F.lower("o_orderstatus"))).when(F.col("o_orderkey") % 4 != 0, F.lower("o_orderstatus")).alias("languages"),
        license_.alias("license"),
        F.floor("o_totalprice").cast("long").alias("downloads"),
        (F.col("o_orderkey") % 13 != 0).alias("is_provider"),
    )
    return rows.withColumn("cls", license_class(F.col("license")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey >= 20 and o_custkey % 11 <> 0")
    k = F.col("o_orderkey") % 5
    relation = F.when(k == 0, "finetune").when(k == 1, "adapter").when(k == 2, "quantized").when(k == 3, "merge").otherwise("mirror")
    one = o.select(F.expr("o_orderkey div (2 + o_custkey % 3)").alias("p"), F.col("o_orderkey").alias("ch"), relation.alias("relation"))
    two = o.where("o_custkey % 7 = 0").select(F.expr("o_orderkey div 5").alias("p"), F.col("o_orderkey").alias("ch"), F.lit("merge").alias("relation"))
    return one.unionByName(two)
