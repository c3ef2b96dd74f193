"""Token ids in flat files of unsigned integers, with 64-bit document offsets, to be memory-mapped.

A file set is a folder: part-N.bin holds ids end to end (16 bits if the vocabulary allows, else 32), part-N.idx
holds the number of documents, their ids, and the offsets (in ids) at which they start, with the end: all 64-bit
little-endian. manifest.json has the type and, per part, documents, ids and the base: the ids of the parts before
it, a prefix sum. Documents are in ascending id order, by range partitioning. Parts are written under another
name and renamed, so a repeated task leaves a whole file.

Null texts are empty documents (the end id alone); null ids come first and come back null; rows that repeat an
id keep their own entries, in the order of a hash of their texts, by which very many of them are dealt to several parts.
An empty table gives a manifest without parts. Other columns are ignored. A worker holds one whole text at least.
"""

from __future__ import annotations

import json
import mmap
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.llm import corpus as C
from ancestra.llm import tokens


#: Text bytes of a part, about.
PART_BYTES = 128 << 20


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> dict:
    """Writes the file set and returns its manifest. tokenizer: a file of tokenizers known to public_path(); part_bytes: text bytes of a part, about."""
    spark = docs.sparkSession
    C.ship(spark)
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokens.public_path(tokenizer)).get_vocab_size()
    dtype = "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(C.NULL_ID)).alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t"), F.xxhash64(docs[text_col]).alias("h"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    store, base = _store(folder)
    store.create_dir(base)

    def save(batches):
        enc = tokens.encoder(tokens.public_path(tokenizer), dtype, True)
        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        name = f"{base}/part-{part:06d}"
        trial = f"{name}.{uuid.uuid4().hex}"
        ids, counts, total = [], [], 0
        end = np.array([end_id], dtype).tobytes()
        with store.open_output_stream(f"{trial}.bin") as out:
            for b in batches:
                i, t = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
                a = 0
                while a < len(t):
                    z, size = a, 0
                    while z < len(t) and (z == a or size < C.STEP_BYTES):
                        size += len(t[z])
                        z += 1
                    for x in enc.ids_of(t[a:z]):
                        out.write(x.tobytes() + end)
                        counts.append(len(x) + 1)
                        total += len(x) + 1
                    a = z
                ids += i
        if not ids:
            store.delete_file(f"{trial}.bin")
            return
        with store.open_output_stream(f"{trial}.idx") as out:
            out.write(np.array([len(ids), *ids, 0, *np.cumsum(counts)], "<i8").tobytes())
        for kind in ("bin", "idx"):
            store.move(f"{trial}.{kind}", f"{name}.{kind}")
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "documents": pa.array([len(ids)], pa.int64()), "ids": pa.array([total], pa.int64())})

    done = rows.repartitionByRange(n, "i", "h").sortWithinPartitions("i", "h", "t").mapInArrow(save, "part int, documents long, ids long")
    parts = sorted((r.part, r.documents, r.ids) for r in done.collect())  # one row a partition
    bases = np.cumsum([0, *(p[2] for p in parts)]).tolist()
    manifest = {"dtype": dtype, "parts": [{"part": p, "documents": d, "ids": k, "base": b} for (p, d, k), b in zip(parts, bases)]}
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """A row per document: doc_id, start (ids before it), n_tokens, ids_crc32, and ids (array<int>) if wanted."""
    C.ship(spark)
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = np.dtype(manifest["dtype"])
    parts = [(p["part"], p["base"]) for p in manifest["parts"]]
    rows = spark.createDataFrame(parts, "part int, base long").repartition(max(1, len(parts)), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def load(batches):
        store, base = _store(folder)
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index, data = (_mapped(store, f"{base}/part-{part:06d}.{k}") for k in ("idx", "bin"))
                index, data = np.frombuffer(index, "<i8"), np.frombuffer(data, kind)
                n = int(index[0])
                docs, offsets = index[1 : n + 1].tolist(), index[n + 1 :].tolist()
                for a in range(0, n, 4096):
                    z = min(n, a + 4096)
                    own = [data[s:e].astype("<u4") for s, e in zip(offsets[a:z], offsets[a + 1 : z + 1])]
                    out = {
                        "doc_id": pa.array([None if d == C.NULL_ID else d for d in docs[a:z]], pa.int64()),
                        "start": pa.array([first + s for s in offsets[a:z]], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in own], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    }
                    if ids:
                        out["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
                    yield pa.record_batch(out)

    return rows.mapInArrow(load, schema)


def _mapped(store: fs.FileSystem, path: str):
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with store.open_input_file(path) as f:
        return f.read()
