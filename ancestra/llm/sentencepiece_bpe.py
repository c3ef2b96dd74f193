"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

The model's rule is to merge, again and again, the neighbouring symbols whose joint piece has the best score.
Its result is the one sequence of pieces in which every two neighbours are compatible: merging their joint text
gives these two again. `MergeEncoder.encode` finds it without merging: from the left it takes the longest piece
(an Aho-Corasick automaton lists those that match at each place), checks it against the piece before by re-merging
the two (remembered), tries shorter ones, and steps back where none fits; a bitfield has the places from which
the rest is known to fail, so each is tried once. Runs of spaces, in which pieces of equal score meet, are merged.

Texts are cut where no piece of the vocabulary reaches across (before a space, around characters that are in no
longer piece), and cut pieces that a worker has seen are looked up (tokens.Pieces).

Null texts are empty and have no ids. Rows that repeat an id keep a row each; other columns are ignored. The work grows
with the length of a text (runs of spaces: with a heap's logarithm more). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import corpus as C
from ancestra.llm import tokens

SPACE = "▁"


class MergeEncoder:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space behind other characters")
        self.agreed: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and not p.startswith(SPACE * 2) and self.merge(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: characters that no longer piece has: nothing is joined to them
        self.lone = set(self.ids) - {c for p in self.ids if len(p) > 1 for c in p}
        joint = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.marks = {m for m in ".,;:!?" if not any(j[1] == m and (j[0].isalnum()) for j in joint)}

    def merge(self, text: str) -> list[str]:
        """The model's own rule: the best-scored joint piece first, the leftmost of equals; a heap has the neighbours that join."""
        n = len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                s = self.score.get(text[a : end[b]])
                if s is not None:
                    heapq.heappush(heap, (-s, a, b, end[b]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue  # one of the two has been joined to another
            end[a], end[b] = c, -1
            if c < n:
                before[c] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(text[a : end[a]])
            a = end[a]
        return out

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) > 2_000_000:
                self.agreed.clear()
            known = self.agreed[key] = self.merge(a + b) == [a, b]
        return known

    def encode(self, text: str) -> list[str]:
        """Pieces (and characters that are none) of a text without two spaces in a row."""
        n = len(text)
        at: list[list[str]] = [[c] for c in text]  # what matches from each place, shortest first
        for end, p in self.automaton.iter(text):
            at[end - len(p) + 1].append(p)
        for x in at:
            if len(x) > 2:
                x.sort(key=len)
        failed = bytearray(n // 8 + 1)  # bit i: nothing fits from place i on
        out: list[str] = []
        choice: list[int] = []
        pos, k = 0, len(at[0]) - 1 if n else -1
        while pos < n:
            last = out[-1] if out else None
            while k >= 0:
                p = at[pos][k]
                end = pos + len(p)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.fits(last, p)):
                    break
                k -= 1
            if k >= 0:
                out.append(p)
                choice.append(k)
                pos = end
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    return self.merge(text)  # cannot be: the merged pieces fit
                pos -= len(out.pop())
                k = choice.pop() - 1
        return out

    def ids_of_piece(self, text: str) -> list[int]:
        parts = self.merge(text) if SPACE * 2 in text else self.encode(text)
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes_at[b] for b in p.encode()]
        return out


class Model:
    """A worker's encoder with its table of pieces: ids, ids in decimal with commas, decoded bytes."""

    def __init__(self, path: str):
        self.encoder = MergeEncoder(path)
        self.table = tokens.Pieces(self._new, [np.int32, np.uint8, np.uint8])
        self.mark = np.isin(np.arange(256), [ord(m) for m in self.encoder.marks])
        self.line = "\n" not in self.encoder.ids and not any("\n" in p for p in self.encoder.ids)

    def _new(self, strings: list[bytes]):
        ids = [self.encoder.ids_of_piece(s.decode().replace(" ", SPACE)) for s in strings]
        raw = self.encoder.raw
        decimal = [b"".join(b"%d," % i for i in x) for x in ids]
        plain = [b"".join(raw[i] for i in x) for x in ids]
        yield np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], np.int32)
        for x in (decimal, plain):
            yield np.array([len(y) for y in x]), np.frombuffer(b"".join(x), np.uint8)

    def cut(self, texts: list[bytes]):
        """Buffer, starts and ends of pieces, pieces of each text. A text that isn't empty gets a space in front."""
        parts = [b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts]
        buf = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum([0, *(len(p) for p in parts)])
        space = buf == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begin[:-1][np.diff(begin) > 0]] = True
        if self.line:
            line = buf == 10
            start |= line
            start[1:] |= line[:-1]
        if len(buf) > 1:
            start[1:] |= self.mark[buf[1:]] & tokens._ALNUM[buf[:-1]]
        starts = np.flatnonzero(start)
        return buf, starts, np.concatenate((starts[1:], [len(buf)])), np.diff(np.searchsorted(starts, begin))

    def look_up(self, texts: list[bytes]) -> list[tuple[np.ndarray, bytes, bytes]]:
        """Of each text: ids, ids in decimal joined by commas, decoded bytes."""
        buf, starts, ends, counts = self.cut(texts)
        if not len(starts):
            return [(np.zeros(0, np.int32), b"", b"")] * len(texts)
        entry = self.table.look_up(buf, starts, ends)
        edges = np.concatenate(([0], np.cumsum(counts)))
        flat = [p.of(entry) for p in self.table.pools]
        cuts = [ends[edges].tolist() for _, ends in flat]
        text, plain = flat[1][0].tobytes(), flat[2][0].tobytes()
        return [
            (flat[0][0][a0:b0], text[a1 : max(a1, b1 - 1)], plain[min(a2 + 1, b2) : b2])
            for a0, b0, a1, b1, a2, b2 in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], cuts[2], cuts[2][1:])
        ]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def round_trip(docs: DataFrame, name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded if full."""
    C.ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t"))

    def convert(batches):
        m = model(tokens.public_path(name))
        for b in batches:
            i, t = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            a = 0
            while a < len(t):
                z, size = a, 0
                while z < len(t) and (z == a or size < C.STEP_BYTES):
                    size += len(t[z])
                    z += 1
                found = m.look_up(t[a:z])
                out = {
                    "doc_id": pa.array(i[a:z], pa.int64()),
                    "n_tokens": pa.array([len(x) for x, _, _ in found], pa.int64()),
                    "ids_sha256": [hashlib.sha256(d).hexdigest() for _, d, _ in found],
                    "decoded_sha256": [hashlib.sha256(p).hexdigest() for _, _, p in found],
                }
                if full:
                    out |= {"ids": pa.array([x for x, _, _ in found], pa.list_(pa.int32())), "decoded": [p.decode() for _, _, p in found]}
                yield pa.record_batch(out)
                a = z

    return rows.mapInArrow(convert, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)
