"""Suffix-array deduplication: bytes covered by a string of `length` bytes that also starts in an earlier document.

The corpus is cut twice by content. First into blocks at places that a hash of 16 bytes picks: equal blocks
are counted once, in their earliest document, and go whole from the others. Then every window of `length`
bytes of the remaining blocks has an anchor, the 26-byte piece of least hash in it: equal windows have equal
anchors, so windows whose anchor occurs once need no more work. Neighbouring windows with the
same anchor form a segment. The distinct segments of an anchor meet in one task, where a Burrows-Wheeler
transform over them is searched breadth-first (`earliest`): intervals of longer and longer strings settle the
common prefixes by increasing value, up to `length` - 1; suffixes between which none is settled share
`length` bytes or more, and the least document among them holds the original.

Blocks and segments are found once; their places travel with their keys, and come back for those that matter. An
anchor of over `hot` segments has its windows dealt out one by one, so that a transform takes about TRANSFORM_BYTES.

Null texts count as empty, null ids as the least id; rows that repeat an id are documents of their own that
are not earlier than one another. Texts shorter than `length` stay as they are; of very long ones the work is in
steps of STEP_BYTES. Extra columns are ignored, or kept in whole rows if wanted. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import corpus as C

U = np.uint64
#: Bytes of an anchor; a window holds length - ANCHOR + 1 of them.
ANCHOR = 26
#: A block ends where the low bits of a hash are zero.
BLOCK_BITS = U(511)
#: Windows of a segment, at most.
SEGMENT = 64
#: Bytes that one transform takes.
TRANSFORM_BYTES = 1 << 19
#: Symbols that the first sort of suffixes looks at; the search goes on from intervals of strings this long.
SEED = 7
#: Segments of an anchor that one transform takes together, at most.
HOT = 4096
_A = [int(x) | 1 for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xF1357AEA2E62A9C5)]
_TABLE = C.mix(np.arange(1, 257, dtype=U) * C._GOLD)


def earliest(contents: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each start of a window of `length` bytes in each content, the least doc of a content with that window."""
    found, count = _earliest(contents, docs, length)
    return np.split(found, np.cumsum(count)[:-1])


def _earliest(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What `earliest` finds, end to end, and how many windows each content has."""
    sizes = np.array([len(x) for x in contents], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    text = np.zeros(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(contents), np.uint8)
    text[inside] += 1
    which = np.repeat(np.arange(len(contents)), sizes + 1)
    left = ends[which] - np.arange(n)  # symbols up to the separator

    # suffixes in order, each ending at its separator, ties by place: prefix doubling from SEED symbols on
    padded = np.concatenate((text, np.zeros(SEED, np.uint16))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(SEED):
        key = (key << 9) | np.where(j < left, padded[j : j + n], 0)
    suffixes = np.argsort(key)
    ordered = key[suffixes]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))  # rows that differ from the one before
    seeds = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.repeat(seeds, np.diff(np.concatenate((seeds, [n]))))
    depth, longest = SEED, int(sizes.max())
    open_ = ~(first & np.concatenate((first[1:], [True])))  # rows that share their rank
    while open_.any():
        rows = np.flatnonzero(open_)
        some = suffixes[rows]
        if depth >= longest:  # equal to the end: by place
            suffixes[rows] = some[np.argsort(rank[some] * n + some)]
            break
        after = np.where(left[some] > depth, rank[np.minimum(some + depth, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        order = np.argsort(key)
        some, key = some[order], key[order]
        suffixes[rows] = some
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        first[rows[new]] = True
        rank[some] = np.repeat(rows[new], np.diff(np.concatenate((new, [len(rows)]))))
        open_[rows] = ~(first[rows] & np.concatenate((first, [True]))[rows + 1])
        depth *= 2

    bwt = text[suffixes - 1]
    step = np.empty(n, np.int64)  # from a row to the row of the suffix one symbol longer
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    settled = np.zeros(n + 1, bool)  # before row i, a common prefix under `length` is known
    settled[n] = True
    settled[seeds] = True  # the first sort has settled the strings of SEED symbols
    low, high = seeds, np.concatenate((seeds[1:], [n]))
    whole = left[suffixes[low]] >= SEED
    low, high = low[whole], high[whole]
    for _ in range(length - SEED):
        wide = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(wide)[:-1])), wide) + np.arange(wide.sum())
        owner = np.repeat(np.arange(len(low)), wide)
        symbol = bwt[rows]
        keep = symbol > 0
        rows, tag = rows[keep], owner[keep] * 512 + symbol[keep]
        to = step[rows]
        if len(to) > n // 8:
            at = np.full(n, -1, np.int64)
            at[to] = tag
            to = np.flatnonzero(at >= 0)
            tag = at[to]
        else:
            order = np.argsort(to)
            to, tag = to[order], tag[order]
        if not len(to):
            break
        begin = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
        low, high = to[begin], to[np.concatenate((begin[1:], [len(to)])) - 1] + 1
        fresh = ~settled[high] | ~settled[low]
        settled[high] = True
        settled[low] = True
        low, high = low[fresh], high[fresh]
        if not len(low):
            break

    groups = np.flatnonzero(settled[:n])
    least = np.minimum.reduceat(docs[which[suffixes]], groups)
    found = np.empty(n, np.int64)
    found[suffixes] = np.repeat(least, np.diff(np.concatenate((groups, [n]))))
    return found[left >= length], np.maximum(0, sizes - length + 1)


def _hashes(buf: np.ndarray, anchors: bool) -> np.ndarray:
    """Of 16 (or ANCHOR) bytes from each place on; what runs over the end is left out."""
    h = _TABLE[buf]
    saved = {}
    for width, a in zip((2, 4, 8, 16), _A):
        h = h[: -(width // 2)] * U(a) + h[width // 2 :]
        saved[width] = h
    if not anchors:
        return h
    n = max(0, len(buf) - ANCHOR + 1)
    both = h[:n] * U(_A[4]) + saved[8][16 : 16 + n]
    return C.mix(both * U(_A[0]) + saved[2][24 : 24 + n])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over h[i : i + width]."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


class _Text:
    """The bytes of a chunk's documents, end to end; windows are known by the place of their first byte."""

    def __init__(self, chunk: C.Chunk, length: int):
        self.chunk, self.length = chunk, length
        self.data = b"".join(chunk.texts)
        self.buf = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, chunk.texts), np.int64, len(chunk.texts))
        self.ends = np.cumsum(sizes)
        self.begins, self.windows = self.ends - sizes, np.maximum(0, sizes - length + 1)

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        return self.chunk.ids[np.searchsorted(self.ends, places, "right")]

    def steps(self):
        """Ranges of places, and the bytes that windows in them reach."""
        for a in range(0, len(self.buf), C.STEP_BYTES):
            b = min(len(self.buf), a + C.STEP_BYTES)
            yield a, b, self.buf[a : b + self.length - 1]

    def is_window(self) -> np.ndarray:
        ok = np.zeros(len(self.buf) + 1, np.int8)
        some = self.windows > 0
        ok[self.begins[some]] += 1
        ok[self.begins[some] + self.windows[some]] -= 1
        return np.cumsum(ok[:-1], dtype=np.int8).view(bool)

    def blocks(self):
        """Distinct blocks: upper and lower half of their keys, least ids, windows, how many of their places are of the least id, places."""
        ok = self.is_window()
        cuts = [self.begins[self.windows > 0]]
        for a, b, buf in self.steps():
            found = a + np.flatnonzero((C.mix(_hashes(buf, False)[: b - a]) & BLOCK_BITS) == 0)
            cuts.append(found[ok[found]])
        start = np.unique(np.concatenate(cuts))
        if not len(start):
            return [np.zeros(0, U)] * 2 + [np.zeros(0, np.int64)] + [np.zeros(0, np.uint32)] * 2 + [C.Ragged(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        doc = np.searchsorted(self.ends, start, "right")
        end = np.minimum(np.append(start[1:], len(self.buf)), (self.begins + self.windows)[doc])
        reach = self.length - 1
        keys = np.frombuffer(b"".join([hashlib.blake2b(self.data[a : b + reach], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]), U).reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: places ascend, and so do ids
        keys, start, ids, wide = keys[order], start[order], self.chunk.ids[doc[order]], (end - start)[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        sizes = np.diff(np.append(first, len(start)))
        least = np.add.reduceat((ids == np.repeat(ids[first], sizes)).astype(np.int64), first)
        return [keys[first, 0], keys[first, 1], ids[first], wide[first].astype(np.uint32), least.astype(np.uint32), C.Ragged(sizes, start.astype(np.uint32))]

    def segments(self, gone: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that are not gone: segments' places, numbers of windows, anchors."""
        ok = self.is_window()
        edge = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(edge, gone[0], 1)
        np.add.at(edge, gone[0] + gone[1], -1)
        ok &= np.cumsum(edge[:-1], dtype=np.int32) == 0
        del edge
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))]
        for a, b, buf in self.steps():
            own = ok[a:b]
            least = _least(_hashes(buf, True), self.length - ANCHOR + 1)
            own = own[: len(least)]
            new = own.copy()
            new[1:] &= ~own[:-1] | (least[1:] != least[: len(least) - 1])[: max(0, len(own) - 1)]
            start = np.flatnonzero(new)
            stop = np.flatnonzero(own & ~np.append(own[1:], False)) + 1  # ends of runs of windows
            end = np.append(start[1:], len(own))
            end = np.minimum(end, stop[np.searchsorted(stop, start, "right")]) if len(start) else end[:0]
            parts = -(-(end - start) // SEGMENT)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(start, parts) + k * SEGMENT
            out.append((a + first, np.minimum(np.repeat(end, parts) - first, SEGMENT), least[first]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def contents(self, found: list):
        """What came back of the segments: keys, contents and least ids of the distinct ones; then places of all, and their place among those."""
        if not found:
            return np.zeros(0, U), [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        anchor, place, wide, single, bucket = found
        place, wide, anchor = place.astype(np.int64), wide.astype(np.int64), (bucket.astype(U) << U(32)) | anchor.astype(U)
        one = single > 0
        at = np.repeat(place[one], wide[one])
        at += np.arange(len(at)) - np.repeat(np.cumsum(wide[one]) - wide[one], wide[one])
        place, wide = np.concatenate((place[~one], at)), np.concatenate((wide[~one], np.ones_like(at)))
        keys = np.concatenate((anchor[~one], C.span_hashes(self.buf, at, at + self.length)))
        order = np.argsort(place, kind="stable")  # ids ascend, so the first of equal contents has the least
        place, wide, keys = place[order], wide[order], keys[order]
        known: dict[bytes, int] = {}
        reach, data = self.length - 1, self.data
        which = np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip(place.tolist(), (place + wide + reach).tolist())), np.int64, len(place))
        first = np.unique(which, return_index=True)[1]
        return keys[first], list(known), self.ids_at(place[first]), place, which


def _gone(answers: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of windows of the blocks that an earlier document has."""
    got = C.collected(answers, "blocks")
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide, skip, places, _ = got
    keep = np.arange(len(places.flat)) - np.repeat(np.cumsum(places.sizes) - places.sizes, places.sizes) >= np.repeat(skip, places.sizes)
    return places.flat[keep].astype(np.int64), np.repeat(wide, places.sizes)[keep].astype(np.int64)


def answer_contents(length: int):
    """What a bucket of contents answers: of each, the runs of windows that have the same least document, as their first windows and documents, and its number of windows."""

    def answer(_, keys, columns):
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(t, len(known)) for t in columns[0].strings()), np.int64, len(keys))
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, which, columns[1])
        key = np.empty(len(known), U)
        key[which] = keys
        texts = list(known)
        order = np.argsort(key, kind="stable")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))[order] + 1
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))  # windows of different keys differ
        ends, cuts, at = np.append(np.cumsum(sizes), 0)[np.append(first[1:], len(order)) - 1], [], 0
        while at < len(first):
            begin = ends[at - 1] if at else 0
            at = max(at + 1, int(np.searchsorted(ends, begin + TRANSFORM_BYTES, "right")))
            cuts.append(int(first[at]) if at < len(first) else len(order))
        found, windows = [], np.maximum(0, sizes - length)
        for a, b in zip([0, *cuts], cuts):
            found.append(_earliest([texts[i] for i in order[a:b].tolist()], least[order[a:b]], length)[0])
        found = np.concatenate(found)
        begin = np.cumsum(windows) - windows
        new = np.concatenate(([True], found[1:] != found[:-1]))
        new[begin] = True
        run = np.flatnonzero(new)
        owner = np.searchsorted(begin, run, "right") - 1
        runs = np.bincount(owner, minlength=len(order))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        which = back[which]
        return [C.Ragged(runs, (run - begin[owner]).astype(np.uint8)).take(which), C.Ragged(runs, found[run]).take(which), windows[which].astype(np.uint8)]

    return answer


def removals(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, kept: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with kept, the document's own row, with n_removed as
    the struct column `row` and the remaining bytes as the binary column `kept` beside it."""
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    source = C.Corpus.of(docs, id_col, text_col, keep=kept)
    n = source.n

    def emit_blocks(chunk, _):
        keys, *columns = _Text(chunk, length).blocks()
        return keys, columns

    def answer_blocks(_, keys, columns):
        low, ids, wide, least, places = columns
        order = np.lexsort((ids, low, keys))
        k1, k2 = keys[order], low[order]
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        owner = np.empty_like(ids)
        owner[order] = ids[order][new][np.cumsum(new) - 1]
        skip = np.where(owner == ids, least, 0).astype(np.uint32)  # places of the first document that has it
        return places.sizes > skip, [wide, skip, places]

    def emit_anchors(chunk, answers):
        place, wide, anchor = _Text(chunk, length).segments(_gone(answers))
        return anchor, [place.astype(np.uint32), wide.astype(np.uint8)]

    def answer_anchors(_, keys, columns):
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        count = np.empty(len(keys), np.int64)
        count[order] = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
        return count > 1, [keys, *columns, (count > hot).astype(np.uint8)]

    def emit_contents(chunk, answers):
        keys, texts, ids, _, _ = _Text(chunk, length).contents(C.collected(answers, "anchors"))
        return keys, [C.Ragged.of(texts), ids]

    def finish(_, chunk, answers):
        text = _Text(chunk, length)
        edge = np.zeros(len(text.buf) + 1, np.int32)
        place, wide = _gone(answers)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + wide + length - 1, -1)
        keys, _, _, place, which = text.contents(C.collected(answers, "anchors"))
        if len(keys):
            starts, docs, windows = C.answered(answers, "contents", keys, n)
            starts, docs, windows = starts.take(which), docs.take(which), windows[which].astype(np.int64)
            use = np.repeat(np.arange(len(which)), starts.sizes)
            start = starts.flat.astype(np.int64)
            end = np.append(start[1:], 0)
            last = np.cumsum(starts.sizes) - 1
            end[last] = windows
            gone = docs.flat < text.ids_at(place)[use]
            at = place[use[gone]]
            np.add.at(edge, at + start[gone], 1)
            np.add.at(edge, at + end[gone] + length - 1, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del edge
        # spans begin where a covered byte follows one that is not, or another document's
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        some = text.begins[text.begins < len(gone)]
        begin[some] = gone[some]

        def total(x):
            sums = np.zeros(len(x) + 1, np.int32)
            np.cumsum(x, dtype=np.int32, out=sums[1:])
            return (sums[text.ends] - sums[text.begins]).astype(np.int64)

        removed, spans = total(gone), total(begin)
        rest = text.buf[~gone].tobytes()
        ends = np.cumsum(text.ends - text.begins - removed).tolist()
        rest = [rest[a:b] for a, b in zip([0, *ends], ends)]
        if kept:
            every = np.ones(len(rest), bool)
            return pa.table(chunk.whole_rows(chunk.texts, every) | {"n_removed": removed, "kept": pa.array(rest, pa.binary())})
        ids = pa.array([None if i == C.NULL_ID else i for i in chunk.ids.tolist()], pa.int64())
        return pa.table({"doc_id": ids, "n_bytes": text.ends - text.begins, "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in rest], pa.string())})

    blocks = source.exchange("blocks", emit_blocks, answer_blocks)
    anchors = source.exchange("anchors", emit_anchors, answer_anchors, blocks, short=True)
    contents = source.exchange("contents", emit_contents, answer_contents(length), anchors)
    answers = C.together(blocks, anchors, contents)
    if not kept:
        return source.each(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", answers)
    rows = source.each(finish, source.whole_schema("n_removed long, kept binary"), answers)
    return rows.select(F.struct(*source.whole(rows, docs.columns, text_col)).alias("row"), "n_removed", "kept")
