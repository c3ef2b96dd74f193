"""N-gram Jaccard join: all links of similarity `threshold` or more between the sets of word n-grams of documents.

1. Documents with the same set of n-grams are one text from here on (its least document stands for it).
2. An n-gram's frequency is counted over all texts; the texts in which too few n-grams occur elsewhere have no link
   and go. The rarest n-grams of each (all but threshold * size - 1) are its prefix: linked texts share one of it.
   Texts joined by shared prefixes form families.
3. A family is dealt into blocks by size of the set; a task takes two blocks whose sizes a link could have, compares
   MinHash values 20 at a time and drops a pair as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold is below `tolerance`. What is left is verified exactly on the n-grams.
4. Tasks return the number of links of each text and a spanning forest of them, never all pairs; the forests
   are joined to classes.

Words are [^\\x20\\x09-\\x0D]+; a text of 1 to n - 1 words has one n-gram, all its words; one without words (or
null) has none, and links with nothing. n-grams are compared by 64-bit hashes, and texts are known by one of their
set; frequencies go by 32 bits within a bucket, so they may be too high, which keeps more texts. A class is known by its
least document. Null ids count as the least id and come back null; rows that repeat an id are documents of their own.
Very long texts are one set each, held whole by a worker. Other columns are ignored, or kept in whole rows by
`distinct`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import corpus as C
from ancestra.llm.links import components

U = np.uint64
#: MinHash values of a text.
VALUES = 200
_SEEDS = C.mix(np.arange(1, VALUES + 1, dtype=U) * C._GOLD) | U(1)
_ODD = _SEEDS * U(2) + U(1)
#: Texts of a family that a task compares with as many others.
BLOCK = 512
#: MinHash values that are compared at a time.
STRIDE = 20


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text, ascending."""
    buf, starts, ends, counts = C.words(texts)
    h = C.span_hashes(buf, starts, ends)
    grams = np.zeros(len(h), U)
    for k in range(n):
        grams[: len(h) - k] += h[k:] * _ODD[k : k + 1]
    grams = C.mix(grams)
    out, at = [], 0
    for c in counts.tolist():
        if 0 < c < n:
            out.append(C.mix(np.array([(h[at : at + c] * _SEEDS[:c]).sum()], U) + U(c)))
        else:
            out.append(np.unique(grams[at : at + max(0, c - n + 1)]))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The upper 32 bits of each MinHash value, a row for each set (none of them empty)."""
    out = np.empty((len(sets), len(_SEEDS)), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 32768):
            size += len(sets[j])
            j += 1
        h = np.concatenate(sets[i:j])
        begin = np.cumsum([0, *(len(x) for x in sets[i : j - 1])])
        for k, seed in enumerate(_SEEDS):
            out[i:j, k] = np.minimum.reduceat(h * seed, begin) >> U(32)
        i = j
    return out


def fewest(k: int, threshold: float, tolerance: float) -> int:
    """Least m for which m equal values of k leave similarity >= threshold a posterior of tolerance or more."""
    total = 0.0
    for m in range(k + 1):
        total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        if total >= tolerance:
            return m
    return k


def compare(sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all linked pairs; side: only pairs of the two sides (None: of all)."""
    n = len(sets)
    if side is None:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(~side), np.flatnonzero(side), indexing="ij"))
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[near], j[near]
    same = np.zeros(len(i), np.int32)
    for k in range(0, sigs.shape[1], STRIDE):
        for a in range(0, len(i), 1 << 18):
            p = slice(a, a + (1 << 18))
            same[p] += (sigs[i[p], k : k + STRIDE] == sigs[j[p], k : k + STRIDE]).sum(1, dtype=np.int32)
        left = same >= fewest(k + STRIDE, threshold, tolerance)
        i, j, same = i[left], j[left], same[left]
        if not len(i):
            return i, j
    if len(i) <= 200:
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())])
    else:
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = df[column] > 1
        _, column = np.unique(column[shared], return_inverse=True)
        row = row[shared]
        product = np.zeros((n, n), np.float32)
        width = max(256, (32 << 20) // (4 * n))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            p = slice(*np.searchsorted(column, [a, a + width]))
            m = np.zeros((n, width), np.float32)
            m[row[p], column[p] - a] = 1
            product += m @ m.T
        inter = product[i, j].astype(np.int64)
    linked = inter >= threshold * (sizes[i] + sizes[j] - inter) - 1e-9
    return i[linked], j[linked]


class _Sets:
    """Texts of a chunk that may have links: hash of the set, representative document, copies, signature, n-grams, prefix."""

    def __init__(self, ids, docs, copies, sigs, sets, prefixes):
        self.ids, self.docs, self.copies, self.sigs, self.sets, self.prefixes = ids, docs, copies, sigs, sets, prefixes
        self.sizes = np.array([len(s) for s in sets], np.int64)

    @staticmethod
    def of(table: pa.Table) -> _Sets:
        ids, docs, copies, sizes, sigs, grams, wide, prefixes = (np.concatenate(x) for x in zip(*(C.from_blob(b.as_py()) for b in table.column("blob"))))
        return _Sets(ids, docs, copies, sigs.reshape(-1, len(_SEEDS)), np.split(grams, np.cumsum(sizes)[:-1]), C.Ragged(wide, prefixes))


def rarest(grams: np.ndarray, frequency: np.ndarray, threshold: float) -> np.ndarray:
    """The prefix of a set, without n-grams that no other text has; empty if it has no link."""
    need = math.ceil(threshold * len(grams) - 1e-9)
    if (frequency > 1).sum() < need:
        return grams[:0]
    order = np.lexsort((grams, frequency))[: len(grams) - need + 1]
    return grams[order[frequency[order] > 1]]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = top(a), top(b)
        if p != q:
            parent[p] = q
            out.append((a, b))
    return out


def _names(docs: np.ndarray, ids: np.ndarray, chunk: np.ndarray) -> list[bytes]:
    """Names of texts that sort by document, then by hash of the set; at the end the chunk of the document."""
    return [d.to_bytes(8, "big") + i.to_bytes(8, "big") + c.to_bytes(4, "big") for d, i, c in zip((docs.view(U) ^ U(1 << 63)).tolist(), ids.view(U).tolist(), chunk.tolist())]


class _Reader:
    """Sets of a chunk's documents, in workers."""

    def __init__(self, n_words: int):
        self.n_words = n_words

    def digests(self, chunk):
        """Place of the first document of each distinct set, the digests, and each document's place among them (-1: no words)."""
        first, keys, of, known = [], [], np.full(len(chunk.ids), -1, np.int64), {}
        for a, b in chunk.steps():
            for d, s in enumerate(shingles(chunk.texts[a:b], self.n_words), a):
                if len(s):
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    at = known.get(key)
                    if at is None:
                        at = known[key] = len(first)
                        first.append(d)
                        keys.append(key)
                    of[d] = at
        return np.array(first, np.int64), np.frombuffer(b"".join(keys), U).reshape(-1, 2), of

    def representatives(self, answers):
        """Places of the documents that stand for a text, ascending, how many documents have it, and its hash."""
        got = C.collected(answers, "sets")
        if not got:
            return (np.zeros(0, np.int64),) * 3
        leads, _, _, total, first, key, _ = got
        order = np.argsort(first[leads])
        return first[leads][order], total[leads][order], key[leads][order]

    def each_set(self, chunk, places):
        """(places, sets) of the documents at places, in steps."""
        i = 0
        while i < len(places):
            j, size = i, 0
            while j < len(places) and (j == i or size < C.STEP_BYTES):
                size += len(chunk.texts[places[j]])
                j += 1
            yield places[i:j], shingles([chunk.texts[d] for d in places[i:j]], self.n_words)
            i = j


class _Join:
    """The steps up to the links between texts."""

    def __init__(self, source: C.Corpus, n_words: int, threshold: float, tolerance: float, block: int):
        self.source, self.n, self.read, self.threshold, self.tolerance, self.block = source, source.n, _Reader(n_words), threshold, tolerance, block

    def sets(self):
        """The exchange that tells each set its representative (the least id, then hash of the text), its chunk and how many documents have it."""
        read = self.read

        def emit(chunk, _):
            first, keys, of = read.digests(chunk)
            texts = C.text_hashes([chunk.texts[d] for d in first.tolist()])
            return keys[:, 0].copy(), [keys[:, 1].copy(), chunk.ids[first], texts, np.bincount(of[of >= 0], minlength=len(first)).astype(np.int64), first]

        def answer(sources, keys, columns):
            low, ids, texts, copies, first = columns
            order = np.lexsort((texts, ids, low, keys))
            new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (low[order][1:] != low[order][:-1])))
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            leads, owner, home, total = np.zeros(len(keys), bool), np.empty_like(ids), np.empty_like(sources), np.empty_like(copies)
            leads[order[begin]] = True
            owner[order], home[order] = ids[order][begin][group], sources[order][begin][group]
            total[order] = np.add.reduceat(copies[order], begin)[group]
            return [leads, owner, home, total, first, keys.view(np.int64)]

        return self.source.exchange("sets", emit, answer)

    def candidates(self, sets_back: DataFrame) -> C.Corpus:
        """The texts that may have links, in the chunks of their representatives."""
        n, threshold, read = self.n, self.threshold, self.read

        def grams(chunk, answers):
            parts = [s for _, sets in read.each_set(chunk, read.representatives(answers)[0]) for s in sets]
            return np.unique(np.concatenate([*parts, np.zeros(0, U)]), return_counts=True)

        def emit(chunk, answers):
            keys, count = grams(chunk, answers)
            return keys, [count.astype(np.uint32)]

        def answer(_, keys, columns):
            found, place = np.unique(keys, return_inverse=True)
            return [np.minimum(np.bincount(place, weights=columns[0], minlength=len(found)), 2**32 - 1).astype(np.uint32)[place]]

        def keep(number, chunk, answers):
            places, copies, hashes = read.representatives(answers)
            keys, _ = grams(chunk, answers)
            (frequency,) = C.answered(answers, "frequency", keys, n) if len(keys) else (np.zeros(0, np.uint32),)
            rows, at = [], 0
            for part, sets in read.each_set(chunk, places):
                found = [(k, s, rarest(s, frequency[np.searchsorted(keys, s)], threshold)) for k, s in enumerate(sets, at)]
                at += len(sets)
                found = [x for x in found if len(x[2])]
                if found:
                    k, own, prefixes = zip(*found)
                    k = list(k)
                    rows.append(C.to_blob(hashes[k], chunk.ids[places[k]], copies[k], np.array([len(s) for s in own], np.int64), signatures(list(own)).ravel(), np.concatenate(own), np.array([len(x) for x in prefixes], np.int64), np.concatenate(prefixes)))
            return pa.table({"chunk": pa.array([number] * len(rows), pa.int32()), "blob": pa.array(rows, pa.binary())})

        frequency = self.source.exchange("frequency", emit, answer, sets_back, short=True)
        return C.Corpus(C.settled(self.source.each(keep, "chunk int, blob binary", C.together(sets_back, frequency)), n, "chunk"), n, _Sets.of)

    def links(self, texts: C.Corpus) -> DataFrame:
        """Rows (a, null, w): w links of text a; and rows (a, b, null): a spanning forest of each task's links."""
        n, threshold, tolerance = self.n, self.threshold, self.tolerance

        def emit_prefixes(sets, _):
            return sets.prefixes.flat, [np.repeat(sets.ids, sets.prefixes.sizes)]

        def answer_prefixes(_, keys, columns):
            order = np.lexsort((columns[0], keys))
            k, d = keys[order], columns[0][order]
            new = np.concatenate(([True], k[1:] != k[:-1]))
            least = np.empty_like(d)
            least[order] = d[new][np.cumsum(new) - 1]
            return np.ones(len(keys), bool), [columns[0], least]

        def emit_edges(number, sets, answers):
            got = C.collected(answers, "prefixes")[:2]
            pairs = np.unique(np.stack(got), axis=1) if got else np.zeros((2, 0), np.int64)
            order = np.argsort(sets.ids)
            size = sets.sizes[order[np.searchsorted(sets.ids[order], pairs[0])]] if pairs.shape[1] else pairs[0]
            return pa.table({"chunk": pa.array([number] * pairs.shape[1], pa.int32()), "a": pairs[0], "b": pairs[1], "size": size})

        prior = texts.exchange("prefixes", emit_prefixes, answer_prefixes)
        edges = C.settled(texts.each(emit_edges, "chunk int, a long, b long, size long", prior))
        family = components(edges.select("a", "b"))

        # blocks of families by size, told to the chunks that have the texts; sizes of linked texts are in one class or two next to each other
        ratio = math.log(1.01 / threshold)
        member = edges.select("chunk", F.col("a").alias("node"), F.floor(F.log("size") / ratio).cast("int").alias("class")).distinct()
        member = C.settled(member.join(family, "node"), adaptive=True)
        blocks = member.groupBy("least", "class").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        near = F.explode(F.array(*(F.struct((F.col("class") + k).alias("class"), F.lit(-k).alias("side"), "blocks") for k in (-1, 0, 1)))).alias("x")
        count = lambda k, name: F.coalesce(F.max(F.when(F.col("side") == k, F.col("blocks"))), F.lit(0)).alias(name)
        blocks = C.settled(blocks.select("least", near).select("least", "x.*").groupBy("least", "class").agg(count(-1, "before"), count(0, "blocks"), count(1, "after")).where("blocks > 0"), adaptive=True)
        member = member.join(blocks, ["least", "class"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        member = C.settled(member.select("chunk", "node", "least", "class", "before", "blocks", "after", "own"), adaptive=True)

        def told(k, t):
            columns = [t.column(c).to_numpy() for c in t.column_names[1:]]
            return pa.table({"step": ["blocks"], "chunk": pa.array([k[0].as_py()], pa.int32()), "bucket": pa.array([0], pa.int32()), "blob": pa.array([C.to_blob(*columns)], pa.binary())})

        told_rows = member.groupBy("chunk").applyInArrow(told, "step string, chunk int, bucket int, blob binary")
        schema = "task int, pair binary, cross boolean, blob binary"
        fields = pa.schema([("task", pa.int32()), ("pair", pa.binary()), ("cross", pa.bool_()), ("blob", pa.binary())])

        def emit_pairs(number, sets, answers):
            groups: dict = {}
            if ("blocks", 0) in answers:
                at = {d: i for i, d in enumerate(sets.ids.tolist())}
                for d, f, c, before, own_blocks, after, b in zip(*(x.tolist() for x in answers["blocks", 0])):
                    mine = (c, b)
                    for other in [(c - 1, k) for k in range(before)] + [(c, k) for k in range(own_blocks)] + [(c + 1, k) for k in range(after)]:
                        p, q = min(mine, other), max(mine, other)
                        groups.setdefault((f, *p, *q), []).append((at[d], mine == q))
            rows: dict = {c: [] for c in fields.names}
            for key, found in groups.items():
                i = [x for x, _ in found]
                pair = np.array(key, np.int64).tobytes()
                rows["task"].append(zlib.crc32(pair) % (4 * n))
                rows["pair"].append(pair)
                rows["cross"].append(key[1:3] != key[3:5])
                rows["blob"].append(C.to_blob(sets.ids[i], sets.docs[i], np.array([b for _, b in found]), sets.copies[i], np.full(len(i), number, np.int32), sets.sizes[i], sets.sigs[i].ravel(), np.concatenate([sets.sets[x] for x in i])))
            return pa.table(rows, schema=fields)

        def verify(_, t):
            out: list[tuple] = []
            groups: dict = {}
            for i, key in enumerate(zip(t.column("pair").to_pylist(), t.column("cross").to_pylist())):
                groups.setdefault(key, []).append(i)
            blobs = t.column("blob")
            for (_, cross), rows in groups.items():
                ids, owners, side, copies, home, sizes, sigs, grams = (np.concatenate(x) for x in zip(*(C.from_blob(blobs[i].as_py()) for i in rows)))
                sets = np.split(grams, np.cumsum(sizes)[:-1])
                i, j = compare(sigs.reshape(len(ids), -1), sets, side if cross else None, threshold, tolerance)
                weight = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                names = _names(owners, ids, home)
                out += [(d, None, int(w)) for d, w in zip(names, weight.tolist()) if w]
                out += [(names[a], names[b], None) for a, b in _forest(i, j, len(ids))]
            a, b, w = zip(*out) if out else ((), (), ())
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "w": pa.array(w, pa.int64())})

        return C.settled(texts.each(emit_pairs, schema, told_rows).groupBy("task").applyInArrow(verify, "a binary, b binary, w long"))


def classes(docs: DataFrame, n_words: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, class_id (least document of its class), n_links (documents linked to it), representative."""
    source = C.Corpus.of(docs, id_col, text_col)
    join = _Join(source, n_words, threshold, tolerance, block)
    read, n = join.read, source.n
    sets_back = join.sets()
    found = join.links(join.candidates(sets_back))
    joined = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("name"), "least")
    links = found.where("w is not null").groupBy(F.col("a").alias("name")).agg(F.sum("w").alias("links"))
    known = C.settled(joined.join(links, "name"), adaptive=True)

    def finish(_, chunk, answers):
        _, keys, of = read.digests(chunk)
        _, owner, home, total, _, _ = C.answered(answers, "sets", keys[:, 0].copy(), n) if len(keys) else [np.zeros(0, np.int64)] * 6
        some = of >= 0
        rep, copies, ids, chunks = chunk.ids.copy(), np.ones(len(chunk.ids), np.int64), np.zeros(len(chunk.ids), U), np.zeros(len(chunk.ids), np.int32)
        rep[some], copies[some], ids[some], chunks[some] = owner[of[some]], total[of[some]], keys[of[some], 0], home[of[some]]
        return pa.table({"doc_id": chunk.ids, "representative": rep, "copies": copies, "some": some, "name": pa.array(_names(rep, ids, chunks), pa.binary())})

    rows = source.each(finish, "doc_id long, representative long, copies long, some boolean, name binary", sets_back)
    rows = rows.join(known, "name", "left")
    null = lambda c: F.nullif(c, F.lit(C.NULL_ID))
    mine = F.col("some")
    class_id = (F.conv(F.hex(F.substring("least", 1, 8)), 16, 10).cast("decimal(20,0)") - F.expr("9223372036854775808BD")).cast("long")
    return rows.select(
        null(F.col("doc_id")).alias("doc_id"),
        null(F.when(mine, F.coalesce(class_id, "representative")).otherwise(F.col("doc_id"))).alias("class_id"),
        (F.col("copies") - 1 + F.when(mine, F.coalesce("links", F.lit(0))).otherwise(0)).alias("n_links"),
        null(F.col("representative")).alias("representative"),
    )


def distinct(docs: DataFrame, n_words: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs whose text stands for its class, and those without words, with all of their columns."""
    source = C.Corpus.of(docs, id_col, text_col, keep=True)
    join = _Join(source, n_words, threshold, tolerance, block)
    read, n = join.read, source.n
    sets_back = join.sets()
    found = join.links(join.candidates(sets_back))
    joined = components(found.where("b is not null").select("a", "b")).where("node <> least")
    lost = joined.select(F.conv(F.hex(F.substring("node", 17, 4)), 16, 10).cast("int").alias("chunk"), F.substring("node", 9, 8).alias("key"))

    def told(k, t):
        keys = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u8").astype(U)
        return pa.table({"step": ["lost"], "chunk": pa.array([k[0].as_py()], pa.int32()), "bucket": pa.array([0], pa.int32()), "blob": pa.array([C.to_blob(keys)], pa.binary())})

    lost = C.settled(lost.groupBy("chunk").applyInArrow(told, "step string, chunk int, bucket int, blob binary"), source.n, "chunk")

    def finish(_, chunk, answers):
        places, _, hashes = read.representatives(answers)
        stands = np.zeros(len(chunk.ids), bool)
        stands[places[~np.isin(hashes.view(U), answers["lost", 0][0])] if ("lost", 0) in answers else places] = True
        stands[[i for i, t in enumerate(chunk.texts) if not t.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]] = True
        return pa.table(chunk.whole_rows(chunk.texts, stands))

    rows = source.each(finish, source.whole_schema(), C.together(sets_back, lost))
    return rows.select(*source.whole(rows, docs.columns, text_col))
