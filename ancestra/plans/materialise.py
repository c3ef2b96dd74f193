"""Cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, DataFrame] = {}


def settle(df: DataFrame) -> DataFrame:
    """df in the folder of spark.checkpoint.dir; a temporary one where none is set, with a local master only."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return bounded(df).checkpoint()


#: Estimates of more bits are forgotten, with the partitioning.
ESTIMATE_BITS = 200


def bounded(df: DataFrame) -> DataFrame:
    """df without its estimated size, if that is beyond reason: a checkpoint keeps it, and a join multiplies those of its sides, so
    after some rounds the number alone takes minutes and the driver's memory."""
    plan = df._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
        return df
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), df.sparkSession)


#: Settled tables that are kept at most; the oldest is forgotten first.
MOST = 16


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """When the tables were last written."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return tuple(path(p).getFileSystem(conf).getFileStatus(path(p)).getModificationTime() for p in paths)


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("orders", "customer")) -> DataFrame:
    """A settled table that several queries of an application share, such as a closure of the same edges; key: folder, name.
    It is made again when a table of the folder has been written since."""
    whole = (spark.sparkContext.applicationId, *key, stamp(spark, *(f"{key[0]}/{t}.parquet" for t in tables)))
    if whole not in _KEPT:
        while len(_KEPT) >= MOST:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[whole] = settle(make())
    return _KEPT[whole]


def forget() -> None:
    """Nothing that is kept is used again."""
    _KEPT.clear()
