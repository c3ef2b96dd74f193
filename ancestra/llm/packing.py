"""Packing documents into sequences of at most `width` tokens, by the histogram of piece lengths.

Documents longer than `width` are cut into whole sequences and a rest. Only the histogram of lengths (at most
`width` rows) reaches the driver. Shortest-pack-first: lengths are placed longest first, each into the least full
packs that there are, a count of equal packs at a time, so the work depends on the histogram and not on the
number of documents. Pieces then find their place by rank among the pieces of their length; ranks are counted
in salted groups, so a length that a third of all pieces share is no hot spot.

Null texts are empty documents (the end id alone); null ids come back null; rows that repeat an id are documents of
their own. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.llm import corpus as C
from ancestra.llm import tokens


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack) and how many packs have each."""
    by_fill: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min((f for f, packs in by_fill.items() if packs), default=width)
            if fill + length > width:
                # one after the other they would fill a new pack before the next is opened
                each = width // length
                for size, count in ((each, left // each), (left % each, 1)):
                    if size and count:
                        by_fill.setdefault(size * length, []).append(((length,) * size, count))
                break
            pattern, count = by_fill[fill].pop()
            if not by_fill[fill]:
                del by_fill[fill]
            used = min(left, count)
            if count > used:
                by_fill.setdefault(fill, []).append((pattern, count - used))
            by_fill.setdefault(fill + length, []).append(((*pattern, length), used))
            left -= used
    return [p for f in sorted(by_fill, reverse=True) for p in by_fill[f]]


def encoded(docs: DataFrame, width: int, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, doc_key (tells rows of one id apart), start, length, ids_crc32, doc_tokens, and ids if wanted."""
    C.ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t"))

    def cut(batches):
        enc = tokens.encoder(tokens.public_path(tokenizer), "<u4", False)
        for b in batches:
            i, t = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            a = 0
            while a < len(t):
                z, size = a, 0
                while z < len(t) and (z == a or size < C.STEP_BYTES):
                    size += len(t[z])
                    z += 1
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for d, x in zip(i[a:z], enc.ids_of(t[a:z])):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(x), width):
                        piece = x[s : s + width]
                        for k, v in zip(out, (d, s, len(piece), zlib.crc32(piece.tobytes()), len(x), piece.tobytes() if with_ids else None)):
                            out[k].append(v)
                if not with_ids:
                    del out["ids"]
                yield pa.record_batch({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})
                a = z

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def packed(docs: DataFrame, width: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (32-bit, binary) if wanted."""
    pieces = C.settled(encoded(docs, width, tokenizer, end_id, id_col, text_col, with_ids))
    return placed(pieces, width)


def placed(pieces: DataFrame, width: int) -> DataFrame:
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = C.settled(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # width rows at most
    slots, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for pattern, count in shortest_pack_first(histogram, width):
        at = 0
        for length in pattern:
            slots.append((length, used[length], sequence, at))
            used[length] += count
            at += length
        sequence += count
    slots.sort()
    table = np.array(slots or np.zeros((0, 4)), np.int64)
    key = (table[:, 0] << 44) + table[:, 1]

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            b = b.drop_columns(["rank"])
            columns = {n: b.column(n) for n in b.schema.names}
            yield pa.record_batch(columns | {"sequence_id": pa.array(table[at, 2] + rank - table[at, 1]), "offset": pa.array(table[at, 3])})

    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    names = [c for c in pieces.columns if c != "salt"]
    ranked = ranked.select(*names, "rank")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.select(*names).dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
