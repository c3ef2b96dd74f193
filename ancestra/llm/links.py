"""Connected components of links between rows, by alternating star contractions; the driver ends them once few edges are left."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import corpus

#: Distinct edges that the driver contracts by itself, at most. A round has its stages and their tasks however few edges it has.
FEW = 50_000


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """edges: a, b (of one ordered type). A row (node, least) for every node of an edge: the least node of its component.

    Null ends and loops are left out. Each round joins to a neighbour's least neighbour; a star ends it, or `few` edges
    or less, whose components are those of all edges: the driver tells them. The
    number of rounds grows with the logarithm of the longest path. Least neighbours are counted before the shuffle and
    written, so that both sides of a join come from shuffles of their own: adaptive plans then split a node that a
    large part of all edges has.
    """
    settled = partial(corpus.settled, adaptive=True)
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] <= few:
            return _contracted(now)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = settled(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = settled(small)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("least"))).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """The components of edges that the driver can hold."""
    table = edges.toArrow()
    a, b = (table.column(c).to_pylist() for c in ("a", "b"))
    top = {x: x for x in sorted({*a, *b})}

    def least(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for p, q in zip(map(least, a), map(least, b)):
        top[max(p, q)] = min(p, q)
    kind = table.schema.field("a").type
    found = pa.table({"node": pa.array(top, kind), "least": pa.array(map(least, top), kind)})
    return edges.sparkSession.createDataFrame(found, edges.select(F.col("a").alias("node"), F.col("b").alias("least")).schema)


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())
