"""Texts packed into chunks, and exchanges of per-chunk keys, shared by the Python-side operators.

A chunk holds the documents whose id and text hash to it, so it is the same whatever the order of the input, and
neither null ids nor an id of very many rows make a large one. Chunks are compressed, dealt out by chunk once and
checkpointed in the shared folder; the checkpoint keeps its partitioning, so every later step over a chunk (and what
comes back for it) reads it without another shuffle of the texts. What chunks have to tell each other travels as
binary columns: an entry has a 64-bit key, entries of a key meet in one bucket, and the answer goes back to the chunk.
A document longer than a chunk makes a chunk of its own size: a worker holds at least one whole text.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Stands for a null document id inside the operators; it sorts first.
NULL_ID = -(1 << 63)
#: Text bytes of a chunk, at most about this many on average; a session may set spark.ancestra.chunkBytes.
CHUNK_BYTES = 24 << 20
#: Text bytes that the vector code looks at together.
STEP_BYTES = 1 << 20

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        file = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}_package.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(file))
        _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where none is set, with a local master only, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def static_plans(spark: SparkSession) -> Iterator[None]:
    """Adaptive plans off, so that a checkpoint keeps the partitioning it was written with."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def settled(df: DataFrame, n: int | None = None, key: str | None = None, adaptive: bool = False) -> DataFrame:
    """df written to the shared folder (lineage cut); with key, dealt out over n partitions by it first.

    adaptive: the plan may be changed as it runs, so that joins with hot keys are split; for df without a key.
    """
    shared_folder(df.sparkSession)
    if adaptive:
        return df.checkpoint()
    with static_plans(df.sparkSession):
        return (df.repartition(n, key) if key else df).checkpoint()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


class Ragged:
    """Sequences of one dtype, end to end."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat = np.asarray(sizes, np.int64), flat

    @staticmethod
    def of(strings: list[bytes]) -> Ragged:
        return Ragged(np.fromiter(map(len, strings), np.int64, len(strings)), np.frombuffer(b"".join(strings), np.uint8))

    def take(self, index: np.ndarray) -> Ragged:
        start = (np.cumsum(self.sizes) - self.sizes)[index]
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        return Ragged(sizes, self.flat[np.repeat(start - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)])

    def strings(self) -> list[bytes]:
        data, ends = self.flat.tobytes(), np.cumsum(self.sizes).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _packed(a: np.ndarray | bytes) -> tuple[str, bytes]:
    """A column's kind and bytes: 32-bit numbers in ascending order as differences, bytes of one rank together."""
    if isinstance(a, (bytes, bytearray)):
        return "|b", bytes(a)
    if a.dtype == np.uint32 and len(a) > 1 and (a[1:] >= a[:-1]).all():
        return "asc", np.ascontiguousarray(np.diff(a, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()
    return a.dtype.str, np.ascontiguousarray(a).tobytes()


def to_blob(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings in one compressed byte string."""
    head, body = [], []
    for a in arrays:
        kind, raw = _packed(a)
        head.append(f"{kind}:{len(raw)}")
        body.append(raw)
    top = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(top).to_bytes(4, "little"), top, *body]))


def from_blob(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(","):
        kind, n = part.rsplit(":", 1)
        piece = memoryview(raw)[at : at + int(n)]
        if kind == "asc":
            out.append(np.cumsum(np.ascontiguousarray(np.frombuffer(piece, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32))
        else:
            out.append(bytes(piece) if kind == "|b" else np.frombuffer(piece, dtype=kind))
        at += int(n)
    return out


class Chunk:
    """Documents in ascending (id, text) order; rows: the columns that were kept, and whether the text is null."""

    def __init__(self, ids: list[int], texts: list[bytes], rows: pa.Table | None = None):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.rows = None if rows is None else rows.take(order)

    @staticmethod
    def of(table: pa.Table) -> Chunk:
        ids: list[int] = []
        texts: list[bytes] = []
        rows = []
        for blob in table.column("blob"):
            i, n, data, *other = from_blob(blob.as_py())
            ids += i.tolist()
            ends = np.cumsum(n).tolist()
            texts += [data[a:b] for a, b in zip([0, *ends], ends)]
            rows += [pa.ipc.open_stream(x).read_all() for x in other]
        return Chunk(ids, texts, pa.concat_tables(rows) if rows else None)

    def text_hashes(self) -> np.ndarray:
        return text_hashes(self.texts)

    def whole_rows(self, texts: list[bytes], which: np.ndarray) -> dict:
        """Of some documents, what `whole` makes their rows of: the columns kept, and other texts (null where the text was)."""
        rows = self.rows.take(np.flatnonzero(which))
        null = rows.column("null").to_pylist()
        text = [None if x else t for x, t in zip(null, (texts[i] for i in np.flatnonzero(which).tolist()))]
        return {c: rows.column(c) for c in rows.column_names if c != "null"} | {"text_bytes": pa.array(text, pa.binary())}

    def steps(self, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about `most` bytes each."""
        start = size = 0
        for i, t in enumerate(self.texts):
            if i > start and size + len(t) > most:
                yield start, i
                start, size = i, 0
            size += len(t)
        if start < len(self.texts):
            yield start, len(self.texts)


def text_hashes(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), U, len(texts))


class Corpus:
    """Chunks of a table's documents: df has chunk and blob. kept: names and fields of the columns that go along."""

    def __init__(self, df: DataFrame, n: int, decode: Callable | None = None, kept: tuple = ()):
        self.df, self.n, self.decode, self.kept = df, n, decode or Chunk.of, kept

    @staticmethod
    def of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> Corpus:
        """keep: all other columns travel with the texts, so that `whole` can give rows back without a join."""
        spark = docs.sparkSession
        ship(spark)
        rows = [F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t")]
        names = [c for c in docs.columns if c != text_col] if keep else []
        if keep:
            rows += [*(docs[c].alias(f"k{j}") for j, c in enumerate(names)), docs[text_col].isNull().alias("null")]
        rows = docs.select(*rows)
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        chunk_bytes = int(spark.conf.get("spark.ancestra.chunkBytes", str(CHUNK_BYTES)))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))

        def pack(batches):
            ids, texts, others, size = [], [], [], 0

            def flush():
                where = (mix(mix(np.array(ids, np.int64).view(U)) ^ text_hashes(texts)) % U(n)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.diff(where[order])) + 1
                table = pa.Table.from_batches(others) if keep else None
                for part in np.split(order, cuts):
                    own = [texts[i] for i in part]
                    blob = [np.array([ids[i] for i in part], np.int64), np.array([len(x) for x in own], np.int64), b"".join(own)]
                    if keep:
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, table.schema) as out:
                            out.write_table(table.take(part))
                        blob.append(sink.getvalue().to_pybytes())
                    yield pa.record_batch({"chunk": pa.array([int(where[part[0]])], pa.int32()), "blob": pa.array([to_blob(*blob)], pa.binary())})

            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    size += len(t) + 64
                if keep:
                    others.append(b.select(range(2, b.num_columns)))
                if size > CHUNK_BYTES * 2:
                    yield from flush()
                    ids, texts, others, size = [], [], [], 0
            if ids:
                yield from flush()

        kept = tuple((c, rows.schema[f"k{j}"]) for j, c in enumerate(names))
        return Corpus(settled(rows.mapInArrow(pack, "chunk int, blob binary"), n, "chunk"), n, kept=kept)

    def whole_schema(self, more: str = "") -> StructType:
        """Schema of Chunk.whole_rows, with more columns behind."""
        out = StructType([f for _, f in self.kept] + [StructField("text_bytes", BinaryType())])
        return StructType([*out.fields, *(StructType.fromDDL(more).fields if more else [])])

    def whole(self, rows: DataFrame, columns: list[str], text_col: str = "text") -> list:
        """The kept columns and the text, under their names and in their order."""
        at = {c: F.col(f.name).alias(c) for c, f in self.kept} | {text_col: F.col("text_bytes").cast("string").alias(text_col)}
        return [at[c] for c in columns]

    def each(self, function: Callable, schema: str | StructType, prior: DataFrame | None = None) -> DataFrame:
        """function(chunk number, Chunk, answers) -> pa.Table; answers: of prior's rows of the chunk, by bucket."""
        decode = self.decode
        if prior is None:
            return self.df.groupBy("chunk").applyInArrow(lambda k, t: function(k[0].as_py(), decode(t), {}), schema)

        def both(k, t, p):
            return function(k[0].as_py(), decode(t), {(s, b): from_blob(x) for s, b, x in zip(p.column("step").to_pylist(), p.column("bucket").to_pylist(), p.column("blob").to_pylist())})

        return self.df.groupBy("chunk").cogroup(prior.groupBy("chunk")).applyInArrow(both, schema)

    def exchange(self, step: str, emit: Callable, answer: Callable, prior: DataFrame | None = None, summary: Callable | None = None, short: bool = False):
        """emit(Chunk, answers) -> (keys, columns) per chunk; answer(sources, keys, columns) -> columns per bucket.

        A column is an array as long as keys, or Ragged; sources has the number of the chunk that sent an entry, and
        answers are as long as keys too. The result, settled by chunk, has the answers of this step alone (`together`
        joins those of several): `answered` puts them back in the order of emit's keys. An answer (mask, columns) goes
        back for the entries of the mask only; `collected` has those. short: only the upper half of a key is sent, so
        keys that differ in the lower half may meet. summary(keys, columns) -> a blob for each bucket: with it, the
        result is the pair of the answers and the blobs, a row each.
        """
        n = self.n

        def send(number, chunk, answers):
            keys, columns = emit(chunk, answers)
            order, cuts = dealt(keys, n)
            if short:
                keys = (keys >> U(32)).astype(np.uint32)
            rows = {"bucket": [], "chunk": [], "blob": []}
            for b in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[b] : cuts[b + 1]]
                rows["bucket"].append(int(b))
                rows["chunk"].append(number)
                rows["blob"].append(to_blob(keys[part], *(y for c in columns for y in split_column(c, part))))
            return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary())})

        def reply(k, t):
            numbers = t.column("chunk").to_pylist()
            parts = [from_blob(x) for x in t.column("blob").to_pylist()]
            sizes = [len(p[0]) for p in parts]
            sources = np.repeat(np.array(numbers, np.int32), sizes)
            columns = unfolded([np.concatenate([p[j] for p in parts]) for j in range(len(parts[0]))])
            del parts
            found = answer(sources, columns[0], columns[1:])
            ends = np.cumsum(sizes)
            if isinstance(found, tuple):
                mask, found = found
                ends = np.concatenate(([0], np.cumsum(mask)))[ends]
                chosen = np.flatnonzero(mask)
                found = [c.take(chosen) if isinstance(c, Ragged) else c[chosen] for c in found]
            ends = ends.tolist()
            out = [to_blob(*(y for c in found for y in split_column(c, np.arange(a, b)))) for a, b in zip([0, *ends], ends)]
            if summary is not None:
                out.append(summary(columns[0], columns[1:]))
                numbers.append(-1 - k[0].as_py())  # dealt out like chunks
            return pa.table({"step": pa.array([step] * len(out)), "chunk": pa.array(numbers, pa.int32()), "bucket": pa.array([k[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

        sent = self.each(send, "bucket int, chunk int, blob binary", prior)
        back = sent.groupBy("bucket").applyInArrow(reply, "step string, chunk int, bucket int, blob binary")
        back = settled(back, n, "chunk")
        return back if summary is None else (back.where("chunk >= 0"), back.where("chunk < 0").select("bucket", "blob"))


def together(*steps: DataFrame) -> DataFrame:
    """Answers of several steps; they are all dealt out by chunk, and so is their union, without a shuffle."""
    out = steps[0]
    for x in steps[1:]:
        out = out.unionByName(x)
    return out


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of their bucket, and where each bucket begins."""
    where = (mix(keys ^ _GOLD) % U(n)).astype(np.uint16 if n < 1 << 16 else np.int32)
    return np.argsort(where, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(where, minlength=n))))


def split_column(c, part: np.ndarray) -> list:
    if isinstance(c, Ragged):
        own = c.take(part)
        return [own.sizes.view("V8"), own.flat]
    return [c[part]]


def unfolded(columns: list) -> list:
    """Columns of a blob, sizes (marked by their type) and flat values put together."""
    out, j = [], 0
    while j < len(columns):
        if columns[j].dtype.kind == "V":
            out.append(Ragged(columns[j].view(np.int64), columns[j + 1]))
            j += 1
        else:
            out.append(columns[j])
        j += 1
    return out


def answered(answers: dict, step: str, keys: np.ndarray, n: int) -> list:
    """What exchange() brought back for these keys, in their order."""
    order, cuts = dealt(keys, n)
    parts = [answers[step, int(b)] for b in np.flatnonzero(np.diff(cuts))]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [c.take(back) if isinstance(c, Ragged) else c[back] for c in unfolded([np.concatenate(c) for c in zip(*parts)])]


def collected(answers: dict, step: str) -> list:
    """The columns that came back for some of the entries, of all buckets in order; the number of the bucket last."""
    parts = [(b, x) for (s, b), x in sorted(answers.items(), key=lambda x: x[0]) if s == step]
    out = unfolded([np.concatenate(c) for c in zip(*(x for _, x in parts))])
    return [*out, np.repeat(np.array([b for b, _ in parts], np.int32), [len(x[0]) for _, x in parts])] if parts else []


# ---- words ----

#: Bytes of [\x20\x09-\x0D]; in UTF-8 these bytes stand for nothing else.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
#: Longer spans are hashed one by one.
_LONG = 64


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of buf[start:end], eight bytes at a time, each step mixed whole; lanes are independent of one another."""
    sizes = ends - starts
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    first, later = U(0xD6E8FEB86659FD93 + 2 * lane), U(0xA0761D6478BD642F + 4 * lane)
    out = mix((eight[starts] & _MASK[np.minimum(sizes, 8)]) ^ (sizes.astype(U) * first))
    rest, at = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(rest):
        out[rest] = mix(out[rest] * later ^ (eight[starts[rest] + at] & _MASK[np.minimum(sizes[rest] - at, 8)]))
        at += 8
        rest = rest[sizes[rest] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: the buffer, their starts and ends in it, and how many each text has."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, np.diff(np.searchsorted(starts, begins))
