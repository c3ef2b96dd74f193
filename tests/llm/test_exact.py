"""Cases that hashes, ranks and repeated rows could get wrong, against plain versions."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ancestra.llm import chat, classifier, corpus, fingerprints, jaccard, packing, scoring, sentencepiece_bpe, suffix, tokens
from tests.llm.test_operators import WORD, _repeats, _sets, _texts, docs, none  # noqa: F401

TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "calculate": {"expression": ("string", True)}}


def _morse(n, a="a", b="b"):
    """The Thue-Morse word of n letters, and the one with its letters changed: polynomial hashes modulo 2**64 don't tell them apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(a if x == 0 else b for x in bits), "".join(b if x == 0 else a for x in bits)


@pytest.mark.parametrize("n", [1 << 10, 1 << 11, 1 << 12])
def test_words_that_weak_hashes_mix_up(n):
    import sentencepiece

    one, two = _morse(n)
    buf, starts, ends, _ = corpus.words([one.encode(), two.encode()])
    assert len(set(corpus.span_hashes(buf, starts, ends).tolist())) == 2
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = tokens.Encoder(tokens.public_path(name), "<u4", spaced)
        for t, got in zip((one, two), e.ids_of([one.encode(), two.encode()])):
            assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    m = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path("piece_bpe_32k.model"))
    for t, (ids, _, _) in zip((one, two), sentencepiece_bpe.model(tokens.public_path("piece_bpe_32k.model")).look_up([one.encode(), two.encode()])):
        assert ids.tolist() == m.encode(t)
    assert jaccard.shingles([one.encode()], 5)[0].tolist() != jaccard.shingles([two.encode()], 5)[0].tolist()


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    real = corpus.span_hashes
    monkeypatch.setattr(corpus, "span_hashes", lambda b, s, e, lane=0: real(b, s, e, lane) if lane else real(b, s, e) % np.uint64(3))
    table = tokens.Pieces(lambda strings: [(np.array([len(s) for s in strings]), np.frombuffer(b"".join(strings), np.uint8))], [np.uint8])
    words = [f"w{k}".encode() for k in range(50)]
    for _ in range(2):
        buf, starts, ends, _ = corpus.words(words)
        flat, at = table.pools[0].of(table.look_up(buf, starts, ends))
        assert [flat[a:b].tobytes() for a, b in zip(at, at[1:])] == words


def test_spans_of_all_lengths_hash_by_their_bytes():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 400)
    ends = starts + rng.integers(0, 300, 400)
    for lane in (0, 1):
        h = corpus.span_hashes(buf, starts, ends, lane)
        again = np.concatenate((buf[::-1], buf))
        assert (corpus.span_hashes(again, starts + 5000, ends + 5000, lane) == h).all()
        assert len(set(h.tolist())) == len({buf[a:b].tobytes() for a, b in zip(starts, ends)})


def _random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    voc = [f"v{k}" for k in range(120)]
    base = [[voc[i] for i in rng.integers(0, 120, rng.integers(8, 60))] for _ in range(8)]
    rows = []
    for _ in range(n):
        w = list(base[rng.integers(8)])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = voc[rng.integers(120)]
        i = int(rng.integers(0, 12))
        rows.append((None if i == 0 else i, None if rng.random() < 0.03 else " ".join(w)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, chunk string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_repeats_of_random_rows_with_repeated_and_null_ids(spark, seed):
    rows = _random_rows(seed)
    df = _frame(spark, rows)
    sets = [_sets(t) for _, t in rows]
    linked = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
    links = [[b for b in range(len(rows)) if b != a and linked(sets[a], sets[b])] for a in range(len(rows))]
    known, want = {}, Counter()
    for a in range(len(rows)):
        if a not in known:
            reach, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()]:
                    if b not in reach:
                        reach.add(b)
                        todo.append(b)
            key = min((rows[b][0] is not None, rows[b][0] or 0) for b in reach)
            known |= dict.fromkeys(reach, (key[1] if key[0] else None, len(reach)))
        want[rows[a][0], known[a][0], len(links[a])] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(df, block=8).collect()) == want
    stands = jaccard.distinct(df).collect()
    groups = len({frozenset([a, *links[a]]) if False else min(b for b in range(len(rows)) if b == a or known[b] is known[a]) for a in range(len(rows)) if sets[a]})
    assert sum(bool(_sets(r.text)) for r in stands) == groups and sum(not _sets(r.text) for r in stands) == sum(not s for s in sets)
    assert Counter(tuple(r) for r in suffix.removals(df, length=30).collect()) == _repeats(rows, 30)


def test_one_anchor_in_very_many_segments(spark):
    # a phrase in every text, with other words around it: all its segments have one anchor
    phrase = "a phrase of some fifty bytes that all the texts have in common"
    rows = [(k, f"{k * 7919 % 10007:05d}{k:x} {phrase} {k * 104729 % 99991:x} tail {k}") for k in range(3000)]
    got = Counter(tuple(r) for r in suffix.removals(_frame(spark, rows), hot=64).collect())
    assert got == Counter(tuple(r) for r in suffix.removals(_frame(spark, rows)).collect()) == _repeats(rows, 50)


def test_transforms_are_bounded(monkeypatch):
    sizes = []
    real = suffix._earliest
    monkeypatch.setattr(suffix, "_earliest", lambda c, d, n: sizes.append(sum(map(len, c))) or real(c, d, n))
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 100).astype(np.uint8)) for _ in range(20_000)]
    answer = suffix.answer_contents(50)
    keys = np.repeat(np.arange(20_000 // suffix.HOT + 1, dtype=np.uint64), suffix.HOT)[:20_000]
    runs, docs, windows = answer(None, keys, [corpus.Ragged.of(texts), np.arange(20_000)])
    assert max(sizes) < 2 * suffix.TRANSFORM_BYTES and sum(sizes) == 2_000_000 and (windows == 51).all()
    assert docs.flat.tolist() == list(range(20_000)) and (runs.sizes == 1).all()


def test_whole_rows_come_back(spark, docs):  # noqa: F811
    for f in (jaccard.distinct, lambda d: suffix.removals(d, kept=True).select("row.*")):
        out = f(docs)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert not Counter(map(tuple, out.collect())) - Counter(map(tuple, docs.collect()))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))


# ---- fingerprints ----


def _mix(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _murmur(values, seed=42):
    """32-bit murmur3 over (value, bytes) pairs, each hashed with the hash so far as its seed; signed."""
    rotate = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = seed
    for v, size in values:
        raw = v & (1 << 8 * size) - 1
        for k in range(0, size, 4):
            h ^= rotate((raw >> 8 * k & 0xFFFFFFFF) * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (rotate(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h = _mix(h ^ size)
    return h - (1 << 32) if h >> 31 else h


def _print(text):
    w = WORD.findall(text)
    chain = lambda g: __import__("functools").reduce(lambda s, x: xxhash.xxh64_intdigest(x.encode(), seed=s), g, 42)
    hashes = [chain(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [chain([" ".join(w)])] if w else []
    if not hashes:
        return "0" * 256
    bins: dict = {}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for h in hashes:
        b = ((h >> 56) + 128) % 256
        bins[b] = min(bins.get(b, 1 << 70), signed(h))
    out = []
    for i in range(256):
        v = bins.get(i)
        for t in range(1, fingerprints.ROUNDS + 1):
            v = bins.get(_murmur([(i, 4), (t, 4)]) % 256) if v is None else v
        if v is None:
            v = bins[min(sorted(bins), key=lambda b: _murmur([(b, 4), (i, 4), (0, 4)]))]
        out.append("0123456789abcdef"[_murmur([(v, 8), (i, 4)]) & 15])
    return "".join(out)


def _like(a, b):
    p = sum(x == y for x, y in zip(a, b)) / 256
    return max(0.0, min(1.0, (p - 1 / 16) / (1 - 1 / 16)))


def test_fingerprints_equal_plain_ones(spark, docs):  # noqa: F811
    rows = [*_texts(), (1, "A b c"), (2, "Z y x w v"), (2, "A b c"), (2, "q r s t u v w x"), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int").repartition(3)
    key = lambda i: -(1 << 63) if i is None else i
    ids = sorted({key(i) for i, _ in rows})
    # of rows that repeat an id, the text of least hash follows
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    lead = {k: min((t or "" for i, t in rows if key(i) == k), key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))) for k in ids}
    want = Counter()
    for i, t in rows:
        t, after = t or "", lead[ids[(ids.index(key(i)) + 1) % len(ids)]]
        m = len(t) // 4
        e = t[: len(t) - m] + after[:m]
        f, g = _print(t), _print(e)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(_like(f, g), 9), round(_like(f, _print(after)), 9)] += 1
    got = fingerprints.edited(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want


# ---- classifier ----


def test_scores_equal_the_rules_by_hand(spark, docs, none):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    model = classifier.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules

    def score(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n, count = max(1, len(w)), lambda chars: sum(t.count(c) for c in chars)
        x = [len(w), sum(map(len, w)) / n, count("#*$%&<>") / n, count("|") / n, count("0123456789") / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, count(".,;:!?") / n]
        x += [len(set(w)) / n, len(w) / max(1, len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines))]
        total = model.intercept + sum(weight for rule, weight in model.rules if all((x[f] > b) if above else (x[f] <= b) for f, above, b in rule))
        return 1 / (1 + math.exp(-total))

    got = classifier.scored(docs, model).collect()
    assert sorted(round(r.score, 9) for r in got) == sorted(round(score(t), 9) for _, t in _texts())
    tie = classifier.Model(0.0, ())
    assert all(r.score == 0.5 for r in classifier.scored(docs, tie).collect()) and classifier.scored(none, model).count() == 0


def test_classifier_takes_a_bounded_sample_where_ids_repeat(spark):
    docs_ = spark.createDataFrame([(k % 7, f"word{k} " * (1 + k % 5)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)], "doc_id long, quality int, toxic int")
    assert isinstance(classifier.fit(docs_, labels, sample=50), classifier.Model)


# ---- packing ----


def _one_by_one(lengths, width):
    """Shortest-pack-first, an item at a time."""
    fills: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = min((k for k in range(len(fills)) if fills[k] + n <= width), key=lambda k: fills[k], default=None)
        # the least full pack decides: where it has no room, none has
        if at is None:
            fills.append(n)
        else:
            fills[at] += n
    return sorted(fills)


def test_packing_equals_placing_one_by_one():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(1, 300)).tolist()
        packs = packing.shortest_pack_first(Counter(lengths), 64)
        assert sorted(sum(p) for p, n in packs for _ in range(n)) == _one_by_one(lengths, 64)


def test_packing_leaves_little_room(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed(df).collect()
    total, sequences = sum(r.length for r in rows), {r.sequence_id for r in rows}
    assert len(sequences) <= math.ceil(total / 4096) * 1.01 + 1
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 4096 and all(r.doc_tokens > 4096 or r.length == r.doc_tokens for r in rows)


# ---- chat ----


def _linked(spark, texts):
    rows = [(1, k, role, t) for k, (role, t) in enumerate(texts)]
    return chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()


def test_chat_keeps_what_it_cannot_read_and_numbers_as_written(spark):
    call = '{"tool_calls":[{"id":"a","name":"calculate","arguments":%s}]}'
    numbers = '{"z":-0.10,"y":[1e400,123456789012345678901234567890123456789012345,0],"x":{"b":1E+2,"a":"1 \\"2\\" -3"}}'
    texts = [
        ("assistant", call % "1" + " trailing"), ("assistant", call % "1" + "]"), ("assistant", call % "1" + "}"), ("assistant", call % "1" + ',{"a":1}'), ("assistant", call % "1" + ',"w":2'),
        ("assistant", call % '{"a":1,"a":2}'), ("assistant", '{"a":01}'), ("assistant", "{" * 5), ("tool", '{"content":"no id"}'), ("assistant", '{"tool_calls":{"id":1}}'),
        ("assistant", call % numbers), ("assistant", '{"content":7,"tool_calls":[{"id":12,"name":"search","arguments":{"query":"q","limit":2.5},"after":[3]},{"id":13,"name":"search","arguments":{"query":"q","limit":-2}},null,"odd"]}'),
        ("tool", '{"tool_call_id":12,"content":null}'), ("assistant", call % ('{"expression":"' + "long \\n text " * 20000 + '"}')),
    ]
    got = _linked(spark, texts)
    by = {(r.turn, r.step): r for r in got}
    for k in range(10):
        assert by[k, 0].kind == "message" and json.loads(by[k, 0].json)["content"] == texts[k][1] and (k, 1) not in by
    assert by[10, 1].json == '{"arguments":{"x":{"a":"1 \\"2\\" -3","b":1E+2},"y":[1e400,123456789012345678901234567890123456789012345,0],"z":-0.10},"id":"a","name":"calculate","type":"tool_call"}'
    assert json.loads(by[11, 0].json)["content"] == "7" and [by[11, k].call_id for k in (1, 2, 3)] == ["12", "13", None] and [by[11, k].valid for k in (1, 2, 3)] == [False, True, False]
    assert by[12, 0].kind == "result" and by[12, 0].linked and by[11, 1].linked and json.loads(by[11, 3].json)["arguments"] == "odd"
    assert by[13, 1].valid and len(json.loads(by[13, 1].json)["arguments"]["expression"]) == len("long \n text ") * 20000


def test_chat_orders_random_calls_as_a_plain_version_does(spark):
    rng = np.random.default_rng(11)
    texts, calls, results = [], {}, {}
    for turn in range(40):
        if rng.random() < 0.6:
            own = []
            for step in range(1, int(rng.integers(2, 4))):
                i, waits = f"c{rng.integers(30)}", [f"c{x}" for x in rng.integers(0, 30, rng.integers(0, 3))]
                own.append({"id": i, "name": "calculate", "arguments": {"expression": "x"}, "after": waits})
                calls.setdefault(i, (turn, waits))
            texts.append(("assistant", json.dumps({"content": "", "tool_calls": own})))
        else:
            i = f"c{rng.integers(30)}"
            results.setdefault(i, turn)
            texts.append(("tool", json.dumps({"tool_call_id": i, "content": "r"})))
    level, at = {}, {}
    while True:
        ready = [i for i, (_, w) in calls.items() if i not in level and all(x in level for x in w if x in calls)]
        if not ready:
            break
        for i, (l, t) in {i: (max([level[x] + 2 for x in calls[i][1] if x in calls], default=0), max([calls[i][0], *(max(at[x], results.get(x, -1)) for x in calls[i][1] if x in calls)])) for i in ready}.items():
            level[i], at[i] = l, t
    for r in _linked(spark, texts):
        if r.kind == "call":
            assert r.level == level.get(r.call_id, -1) and r.linked == (r.call_id in results) and r.order_turn == max(r.turn, at.get(r.call_id, calls[r.call_id][0]))
        if r.kind == "result":
            assert r.linked == (r.call_id in calls) and r.level == (0 if r.call_id not in calls else level[r.call_id] + 1 if r.call_id in level else -1)


def test_scores_of_tokens_outside_the_vocabulary_sum_with_their_class(spark):
    rows = [(k, " ".join(f"t{j}" for j in range(k % 9 + 1))) for k in range(60)]
    got = scoring.scores(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary=4).collect()
    assert len(got) == 60 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    assert [r.held_out for r in sorted(got, key=lambda r: r.doc_id)] == held and re.match("t", rows[0][1])
