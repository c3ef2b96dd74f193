"""Language-model scores of whole documents, learnt from the documents that aren't held out.

Token counts are gathered from all training documents. The most frequent tokens are the model's vocabulary, in
classes of about equal share; a token outside it belongs to an open class by its last two bytes, in which its
probability is its smoothed share of the class's training tokens. The recurrent model (gru.py) starts as the unigram
model of these counts. The training documents of each chunk are dealt into `rounds` parts; in each round every chunk
goes on from the common parameters with truncated backpropagation over all of its part, and the chunks' parameters
are averaged, weighted by tokens. So both the counts and the training cover all training documents at every size.

A-Z are lower-cased; tokens are the words [^\\x20\\x09-\\x0D]+ and one end per document; they are told apart by 64-bit
hashes. Null and empty texts have the end alone. Rows with a null id are never held out. Rows that repeat an
id are scored each. An empty table gives no rows. A very long text is one stream, of which the state goes on to its
end; a worker holds the tokens of a chunk. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import corpus as C
from ancestra.llm import gru

U = np.uint64
VOCABULARY, WORD_CLASSES, OPEN = 2000, 32, 32
#: Parts of a chunk's training documents, with an average after each, and the rate of the optimiser in each.
ROUNDS, RATES = 3, (8e-3, 4e-3, 2e-3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = U(0xE0D)


class _Tokens:
    """Tokens of a chunk: hashes end to end, where each document starts, open class of each token, documents held out."""

    def __init__(self, chunk: C.Chunk, folds: int):
        hashes, opens, counts = [np.zeros(0, U)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for a, b in chunk.steps():
            buf, starts, ends, n = C.words(chunk.texts[a:b])
            buf = _LOWER[buf]
            h = C.span_hashes(buf, starts, ends)
            last = buf[ends - 1].astype(np.int64) + 31 * np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0)
            at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
            full, cls = np.full(len(h) + len(n), _END, U), np.zeros(len(h) + len(n), np.uint8)
            full[at], cls[at] = h, last % OPEN
            hashes.append(full)
            opens.append(cls)
            counts.append(n + 1)
        self.h, self.open, n = np.concatenate(hashes), np.concatenate(opens), np.concatenate(counts)
        self.starts = np.concatenate(([0], np.cumsum(n)))
        self.n = n
        crc = np.array([0 if i == C.NULL_ID else zlib.crc32(str(i).encode()) for i in chunk.ids.tolist()], np.int64)
        self.held = (crc % folds == 1) if len(crc) else np.zeros(0, bool)

    def distinct(self):
        """Distinct hashes, training counts and open classes, and the place of each token among them."""
        keys, first, place = np.unique(self.h, return_index=True, return_inverse=True)
        training = np.repeat(~self.held, self.n)
        return keys, np.bincount(place[training], minlength=len(keys)).astype(np.int64), self.open[first], place


class _Vocabulary:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, bounds: tuple[int, ...]):
        """keys in order of class."""
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], counts
        self.shape = gru.Shape(bounds, OPEN, int(np.flatnonzero(keys == _END)[0]))

    def symbols(self, h: np.ndarray, opens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.order[at], self.shape.words + opens.astype(np.int32)).astype(np.int32)


def _classes(counts: np.ndarray, n: int) -> tuple[int, ...]:
    """Bounds of classes of words, most frequent first, of about equal shares of the square roots of the counts."""
    share = np.cumsum(np.sqrt(counts))
    at = np.searchsorted(share, share[-1] * np.arange(1, n) / n)
    return tuple(sorted({0, *(at + 1).tolist(), len(counts)} - {len(counts) + 1}))


class _Read:
    """Documents of a chunk as symbols of the model, with what counts alone tell of them."""

    def __init__(self, ids, held, n, known, base, inside, symbols):
        self.ids, self.held, self.n, self.known, self.base, self.inside, self.symbols = ids, held, n, known, base, inside, symbols
        self.starts = np.concatenate(([0], np.cumsum(n)))

    @staticmethod
    def of(table: pa.Table) -> _Read:
        return _Read(*C.from_blob(table.column("blob")[0].as_py()))

    def part(self, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of every so-manieth training document, end to end, and their starts."""
        training = np.flatnonzero(self.held == 0)
        which = np.zeros(len(self.n), bool)
        which[training[k::parts]] = True
        return self.symbols[np.repeat(which, self.n)].astype(np.int32), np.concatenate(([0], np.cumsum(self.n[which])))


def _average(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    total = sum(w for w, _ in parts)
    return total, (sum(w * x.astype(np.float64) for w, x in parts) / total).astype(np.float32)


def scores(docs: DataFrame, folds: int = 5, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    source = C.Corpus.of(docs, id_col, text_col)
    n = source.n

    def emit(chunk, _):
        keys, counts, opens, _ = _Tokens(chunk, folds).distinct()
        return keys, [counts, opens]

    def totals(keys, columns):
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        return found, np.bincount(place, columns[0], len(found)).astype(np.int64), columns[1][first], place

    def answer(_, keys, columns):
        _, counts, _, place = totals(keys, columns)
        return [counts[place]]

    def summary(keys, columns):
        """Of a bucket: its most frequent tokens (as many as the vocabulary has) and the end, tokens and kinds by open class."""
        found, counts, opens, _ = totals(keys, columns)
        best = np.lexsort((found.view(np.int64), -counts))[:vocabulary]
        best = np.union1d(best, np.flatnonzero(found == _END))
        seen = counts > 0
        return C.to_blob(found[best].view(np.int64), counts[best], opens[best].astype(np.int32), np.bincount(opens, counts, OPEN).astype(np.int64), np.bincount(opens[seen], minlength=OPEN).astype(np.int64))

    back, summaries = source.exchange("counts", emit, answer, summary=summary)

    def merged(k, t):
        """One summary of several: buckets share no token."""
        parts = [C.from_blob(x) for x in t.column("blob").to_pylist()]
        keys, counts, opens = (np.concatenate([p[i] for p in parts]) for i in range(3))
        best = np.lexsort((keys, -counts, keys != end))[:vocabulary]
        blob = C.to_blob(keys[best], counts[best], opens[best], *(np.sum([p[i] for p in parts], 0) for i in (3, 4)))
        return pa.table({"part": pa.array([0], pa.int32()), "blob": pa.array([blob], pa.binary())})

    # in two levels to one row: what reaches the driver doesn't grow with the input
    end = int(np.array([_END]).view(np.int64)[0])
    groups = max(1, round(n**0.5))
    level = summaries.select((F.col("bucket") % groups).cast("int").alias("part"), "blob").groupBy("part").applyInArrow(merged, "part int, blob binary")
    top = level.groupBy("part").applyInArrow(merged, "part int, blob binary").collect()
    if not top:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    keys, counts, opens, in_class, kinds = (x.copy() for x in C.from_blob(top[0].blob))
    best = np.lexsort((keys, -counts))
    best = best[(counts[best] > 0) | (keys[best] == end)]
    keys, counts, opens = keys[best].view(U), counts[best], opens[best]
    total, distinct = int(in_class.sum()), int(kinds.sum())
    np.subtract.at(in_class, opens, counts)
    np.subtract.at(kinds, opens, (counts > 0).astype(np.int64))
    words = _Vocabulary(keys, counts, _classes(counts + 1, WORD_CLASSES))
    shape = words.shape

    def read(number, chunk, answers):
        t = _Tokens(chunk, folds)
        keys, _, _, place = t.distinct()
        (c,) = C.answered(answers, "counts", keys, n)
        c = c[place]
        doc = np.repeat(np.arange(len(t.n)), t.n)
        symbols = words.symbols(t.h, t.open)
        inside = np.where(symbols < shape.words, 0.0, np.log10((c + 0.5) / (in_class[t.open] + 0.5 * (kinds[t.open] + 1))))
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        by_doc = lambda x: np.bincount(doc, x, len(t.n))
        blob = C.to_blob(chunk.ids, t.held.astype(np.uint8), t.n.astype(np.int64), by_doc(c > 0).astype(np.int64), by_doc(base), by_doc(inside), symbols.astype(np.uint16 if shape.words + OPEN < 1 << 16 else np.int32))
        return pa.table({"chunk": pa.array([number], pa.int32()), "blob": pa.array([blob], pa.binary())})

    texts = C.Corpus(C.settled(source.each(read, "chunk int, blob binary", back), n, "chunk"), n, _Read.of)
    slices = 16
    schema = "slice int, part int, weight long, blob binary"
    table = lambda slice_, part, weight, blobs: pa.table({"slice": pa.array(slice_, pa.int32()), "part": pa.array(part, pa.int32()), "weight": pa.array(weight, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def average(k, t):
        weight, mean = _average([(w, C.from_blob(b)[0]) for w, b in zip(t.column("weight").to_pylist(), t.column("blob").to_pylist())])
        return table([k[0].as_py()], [0], [weight], [C.to_blob(mean)])

    model = gru.initial(shape, np.concatenate((counts, in_class)))
    for k in range(rounds):

        def go_on(number, chunk, _, model=model, k=k):
            s, starts = chunk.part(k, rounds)
            if not len(s):
                return table([], [], [], [])
            moved = gru.train(shape, model, s, starts, RATES[min(k, len(RATES) - 1)])
            return table(range(slices), [number % groups] * slices, [len(s)] * slices, [C.to_blob(x) for x in np.array_split(moved, slices)])

        parts = texts.each(go_on, schema).groupBy("slice", "part").applyInArrow(average, schema).groupBy("slice").applyInArrow(average, schema)
        with C.static_plans(docs.sparkSession):
            got = sorted((r.slice, r.blob) for r in parts.collect())  # 16 rows
        model = np.concatenate([C.from_blob(b)[0] for _, b in got]) if got else model

    def finish(_, chunk, __):
        found = gru.score(shape, model, chunk.symbols.astype(np.int32), chunk.starts) / np.log(10) + chunk.inside
        return pa.table(
            {
                "doc_id": pa.array([None if i == C.NULL_ID else i for i in chunk.ids.tolist()], pa.int64()),
                "held_out": pa.array(chunk.held == 1),
                "n_tokens": chunk.n,
                "n_known": chunk.known,
                "train_tokens": np.full(len(chunk.n), total, np.int64),
                "base_score": chunk.base,
                "score": found,
            }
        )

    return texts.each(finish, _SCHEMA)


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
