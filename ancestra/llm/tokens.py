"""Token ids of whole texts by way of their pieces.

A piece is what a tokenizer never joins to its neighbours: here a word with the space before it, the mark
behind it, or a run of white space. Texts are cut into pieces with vector operations, pieces are looked up by
two independent 64-bit hashes in a table that a worker keeps, and only new ones go through the tokenizer: most pieces
come again. The table starts anew when it has MOST pieces or its values take MOST_BYTES; a very long piece is one entry.
"""

from __future__ import annotations

import os
import re

import numpy as np

from ancestra.llm import corpus as C

U = np.uint64
#: Slots of the table, and pieces in it at most; then it starts anew.
SLOTS, MOST, MOST_BYTES = 1 << 22, 1_600_000, 256 << 20
#: White space beyond [\x20\x09-\x0D]: such texts go through the tokenizer whole.
_RARE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


class Pool:
    """Sequences of one dtype, end to end."""

    def __init__(self, dtype):
        self.data, self.used = np.empty(1 << 16, dtype), 0
        self.start, self.size, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.data):
            self.data = np.concatenate((self.data, np.empty_like(self.data)))
        while self.count + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.size))
        self.start[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + len(sizes)] = sizes
        self.data[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.count += len(sizes)

    def of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of these entries, end to end, and where each begins (with the end of the last)."""
        sizes = self.size[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.data[np.repeat(self.start[index] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Pieces:
    """A table of pieces. encode(list of byte strings) -> for each pool: sizes and flat values."""

    def __init__(self, encode, dtypes):
        self.encode, self.dtypes = encode, dtypes
        self.clear()

    def clear(self):
        self.keys, self.checks, self.slot = np.zeros(SLOTS, U), np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32)
        self.pools = [Pool(d) for d in self.dtypes]

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entries, or -1."""
        out = np.full(len(h), -1, np.int32)
        at = (h & U(SLOTS - 1)).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            got = self.keys[at]
            hit = (got == h[rest]) & (self.checks[at] == check[rest])
            out[rest[hit]] = self.slot[at[hit]]
            more = ~hit & (got != 0)
            rest, at = rest[more], (at[more] + 1) & (SLOTS - 1)
        return out

    def insert(self, h: np.ndarray, check: np.ndarray, first: int) -> None:
        at = (h & U(SLOTS - 1)).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.checks[at[won]] = h[rest[won]], check[rest[won]]
            self.slot[at[won]] = first + rest[won]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], at[left]
            at = np.where(self.keys[at] != 0, (at + 1) & (SLOTS - 1), at)

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece buf[start:end]; new pieces are encoded."""
        if self.pools[0].count > MOST or sum(p.data.nbytes for p in self.pools) > MOST_BYTES:
            self.clear()
        h, check = C.span_hashes(buf, starts, ends) | U(1), C.span_hashes(buf, starts, ends, 1)
        index = self.find(h, check)
        missed = np.flatnonzero(index < 0)
        if len(missed):
            order = missed[np.lexsort((check[missed], h[missed]))]
            new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])))
            where = order[new]
            data = buf.tobytes()
            strings = [data[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            first = self.pools[0].count
            for pool, (sizes, flat) in zip(self.pools, self.encode(strings)):
                pool.add(sizes, flat)
            self.insert(h[where], check[where], first)
            index[order] = first + np.cumsum(new) - 1
        return index


def cut(texts: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and ends of the pieces in it, and how many each text has. spaced: white space counts."""
    buf, starts, ends, counts = C.words(texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    last = buf[np.maximum(ends - 2, 0)]
    # a mark behind a letter or digit: an ASCII one, or a two-byte letter of Latin-1
    letter = _ALNUM[last] | ((buf[np.maximum(ends - 3, 0)] == 0xC3) & (last != 0x97) & (last != 0xB7) & (ends - starts >= 3))
    split = _MARK[buf[ends - 1]] & (ends - starts >= 2) & letter
    first, until = starts.copy(), ends - split
    parts = [(first, until), (until[split], ends[split])]
    if spaced:
        text_of = np.repeat(np.arange(len(texts)), counts)
        before = np.concatenate(([0], ends[:-1]))
        new = np.concatenate(([True], text_of[1:] != text_of[:-1])) if len(starts) else np.zeros(0, bool)
        before[new] = begin[text_of[new]]
        gap = starts - before
        own = (gap > 0) & (buf[np.maximum(starts - 1, 0)] == 32)
        first[own] -= 1
        single = (gap > 0) & ~own
        parts.append((starts[single] - 1, starts[single]))
        long = gap > 1
        parts.append((before[long], starts[long] - 1))
        # white space at the end of a text
        tail = begin[:-1].copy()
        some = counts > 0
        tail[some] = ends[np.cumsum(counts)[some] - 1]
        stop = begin[1:] - 1
        parts.append((tail[stop > tail], stop[stop > tail]))
    a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return buf, a, b, np.diff(np.searchsorted(a, begin))


class Encoder:
    """Ids by the tokenizers library, of texts in UTF-8."""

    def __init__(self, path: str, dtype: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.spaced = Tokenizer.from_file(path), np.dtype(dtype), spaced
        specials = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = max(specials)
        self.sign = specials[self.between]
        self.table = Pieces(self._new, [self.dtype])

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _new(self, strings: list[bytes]):
        """Many pieces in one call, with a special token between them: it keeps them apart."""
        out: list = []
        group = 2000
        parts = [[s.decode("utf-8", "replace") for s in strings[i : i + group]] for i in range(0, len(strings), group)]
        for part in parts:
            if any("<|" in s for s in part):
                out += [self._one(s) for s in part]
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.sign.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(ids == self.between)
            begins, ends = np.concatenate(([0], at + 1)), np.concatenate((at, [len(ids)]))
            out += [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        yield np.array([len(x) for x in out], np.int64), np.concatenate(out)

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        rare = [i for i, t in enumerate(texts) if _RARE.search(t)]
        if rare:
            plain = list(texts)
            for i in rare:
                plain[i] = b""
        else:
            plain = texts
        buf, starts, ends, counts = cut(plain, self.spaced)
        flat, at = self.table.pools[0].of(self.table.look_up(buf, starts, ends)) if len(starts) else (np.zeros(0, self.dtype), np.zeros(1, np.int64))
        edges = at[np.concatenate(([0], np.cumsum(counts)))].tolist()
        out = [flat[a:b] for a, b in zip(edges, edges[1:])]
        for i in rare:
            out[i] = self._one(texts[i].decode())
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str, spaced: bool) -> Encoder:
    """One for each file in a worker process."""
    key = (path, dtype, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
