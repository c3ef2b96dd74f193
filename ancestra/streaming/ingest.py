"""Records as they arrive: the same first-wins rule over a stream of page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.sources.tables import RAW


def records(spark: SparkSession, folder: str, schema: str = RAW, late: str = "1 day") -> DataFrame:
    """A stream of records, each id once within the watermark."""
    rows = spark.readStream.schema(schema).json(folder).withColumn("seen_at", F.coalesce(F.try_to_timestamp("createdAt"), F.current_timestamp()))
    return rows.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["id"])
