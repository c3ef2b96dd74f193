"""Documents to packed sequences: STAGES in order, each reading what the one before has written.

Rows may have null ids, and ids may repeat: a verdict goes back to the rows whose id and text it was made for. Of
rows that repeat both the id and the text, the near-duplicate stage leaves one. Column names that begin with two
underscores are the stages' own; other further columns go along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.llm import classifier, corpus, jaccard, packing, rules, suffix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = classifier.scored(docs, model, to="__score")
    return rows.where("__score >= 0.5").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, by learnt thresholds."""
    key = {"__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(corpus.NULL_ID)), "__h": F.xxhash64("text", "lang", "source")}
    rows = docs.withColumns(key)
    kept = rules.judged(rows, keep=tuple(key), learnt=True).where("kept").select(*key)
    return rows.join(kept, list(key), "left_semi").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least text of each class of n-gram Jaccard links."""
    return jaccard.distinct(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that earlier documents have; bytes left of a character that was cut go too."""
    rows = suffix.removals(docs, kept=True)
    cut = F.col("n_removed") > 0
    # a bad byte sequence reads as U+FFFD, which is then left out of texts that were cut
    text = F.when(cut, F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")).otherwise(F.col("row.text"))
    rows = rows.select("row", text.alias("text"), cut.alias("cut"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text")).otherwise(F.col("row.n_chars"))}
    return rows.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("packing", pack),
]

#: SQL has no form of the classifier, the suffix array or the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{corpus.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}
