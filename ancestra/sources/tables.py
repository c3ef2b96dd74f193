"""Readers and writers: Parquet, CSV, gzipped JSON lines, paged folders, optional inputs, reports, manifests."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = "id string, author string, createdAt string, lastModified string, pipeline_tag string, library_name string, tags array<string>, downloads long, downloadsAllTime long, likes long, gated string, private boolean"
EDGES = "parent_id string, child_id string, relation string, parent_id_declared string, parent_in_snapshot boolean, temporal_ok boolean"


def jsonl(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """JSON lines (gzip too, of several members); __order is the order of files by path, then of lines, however files are split."""
    rows = spark.read.schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("__order", at)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; a byte-order mark is skipped, only an empty field is null."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", nullValue="", enforceSchema=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(path) if exists(spark, path) else fallback()


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file: for result tables."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def block(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A block of results that is made once: a folder with _SUCCESS is whole and is read again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _small(df: DataFrame, most: int) -> list[list]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is not for reading: write it as a file")
    return [[str(v) if v is not None else "" for v in r] for r in rows]


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of a small result; an error if it has more than `most` rows."""
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *_small(df, most)])


def latex(df: DataFrame, most: int = 200) -> str:
    """The same as rows of a LaTeX table."""
    escape = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
    return "\n".join(" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *_small(df, most)])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of the files below a folder; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Pages:
    """A cursor crawl: fetch(url) -> (status, headers, body).

    Waits as told on 429, longer and longer on 5xx and where fetch fails; other answers end the crawl at once. After each
    page `save` gets the state, from which another crawl resumes.
    """

    def __init__(self, fetch: Callable, first: str, state: dict | None = None, tries: int = 8, sleep: Callable = time.sleep, save: Callable | None = None):
        self.fetch, self.tries, self.sleep, self.save = fetch, tries, sleep, save
        self.state = state or {"url": first, "pages": 0, "count": 0, "done": False}

    def _page(self, url: str):
        for k in range(self.tries):
            try:
                status, headers, body = self.fetch(url)
            except OSError:  # what the network does
                status, headers, body = 599, {}, None
            if status == 200:
                return headers, body
            if status == 429:
                told = [p.strip()[2:] for p in headers.get("RateLimit", "").replace(",", ";").split(";") if p.strip().startswith("t=")]
                self.sleep((int(told[0]) if told else 59) + 1)
            elif status >= 500:
                self.sleep(min(60, 2**k))
            else:
                raise ValueError(f"status {status}: {url}")
        raise OSError(f"no page after {self.tries} tries: {url}")

    def __iter__(self):
        while not self.state["done"]:
            headers, body = self._page(self.state["url"])
            rows = json.loads(body)
            following = [p.split(";")[0].strip(" <>") for p in headers.get("Link", "").split(",") if 'rel="next"' in p]
            yield rows
            self.state |= {"url": following[0] if following else None, "pages": self.state["pages"] + 1, "count": self.state["count"] + len(rows), "done": not following}
            if self.save:
                self.save(dict(self.state))


class PageSource(DataSource):
    """spark.read.format("pages").option("fetch", "module:function").option("url", first).load(): the records of a crawl.

    The pages of a cursor come one after the other, so there is one partition; the function must be importable where it runs.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options.get("schema", RAW)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(dict(self.options), schema)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        module, _, function = self.options["fetch"].partition(":")
        for page in Pages(getattr(importlib.import_module(module), function), self.options["url"]):
            for r in page:
                yield tuple(r.get(n) for n in self.names)


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
