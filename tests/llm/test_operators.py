"""Every operator over rows with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import re
import types
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ancestra.llm import chat, classifier, fingerprints, jaccard, packing, rules, scoring, sentencepiece_bpe, suffix, tokenfile, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, i int, t string, w string, blob string, node long, rank int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _texts():
    voc = [f"w{k}x{k * k % 97}" for k in range(400)]
    say = lambda a, n: " ".join(voc[(a * 7919 + k * k * (a + 3) + k * 31) % 400] for k in range(n))
    base = say(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = say(9, 30)
    return [
        (5, base), (3, base), (8, near), (9, say(2, 80) + "\n" + passage), (10, passage + " " + say(3, 40)), (11, None), (12, ""), (13, " \n\t "), (14, "one two"), (15, "one  two"),
        (16, "a b c d e " * 30), (17, say(4, 3000)), (18, "line one is here\n" * 6 + "é ñ 我 🙂 tail"), (20, "x"), (20, "x"), (21, base), (None, say(5, 50)), (22, "### $$$ %%% &&& " * 10), (-4, say(6, 200)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s1", 1, 2, 3, "t", "w", "b", 4, 5) for k, (i, t) in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_links_equal_brute_force(docs, block):
    rows = [(i, _sets(t)) for i, t in _texts()]
    want = Counter()
    for k, (i, a) in enumerate(rows):
        want[i, sum(1 for m, (_, b) in enumerate(rows) if m != k and a and len(a & b) >= 0.8 * len(a | b))] += 1
    got = jaccard.classes(docs, block=block).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == want
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[5] == classes[3] == classes[8] == classes[21] == 3
    assert classes[14] == classes[15] == 14 and classes[12] == 12 and classes[13] == 13 and classes[None] is None


def test_jaccard_pruning_bound():
    assert jaccard.fewest(200, 0.8, 1e-9) < 0.7 * 200 < jaccard.fewest(200, 0.8, 0.05)


def _repeats(rows, length):
    first: dict = {}
    key = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            first[x] = min(key(i), first.get(x, key(i)))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < key(i):
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_removed_bytes_equal_brute_force(docs, hot):
    got = suffix.removals(docs, hot=hot).collect()
    assert Counter(tuple(r) for r in got) == _repeats(_texts(), 50)


def test_interval_search_equals_dictionary():
    rng = np.random.default_rng(4)
    for _ in range(40):
        alphabet = [b"a", b"ab", bytes(range(256))][rng.integers(3)]
        base = bytes(rng.choice(list(alphabet), 300).tolist())
        contents = list(dict.fromkeys(base[a : a + int(n)] for a, n in zip(rng.integers(0, 250, 20).tolist(), rng.integers(1, 130, 20))))
        ids = rng.integers(-5, 9, len(contents))
        least: dict = {}
        for c, d in zip(contents, ids.tolist()):
            for s in range(len(c) - 29):
                least[c[s : s + 30]] = min(d, least.get(c[s : s + 30], d))
        for c, found in zip(contents, suffix.earliest(contents, ids, 30)):
            assert found.tolist() == [least[c[s : s + 30]] for s in range(len(c) - 29)]


def test_rules_count_and_judge(docs):
    got = Counter()
    for r in rules.judged(docs).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] += 1
        assert r.kept == (not r.failed)
    want = Counter()
    for i, t in _texts():
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want[i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n] += 1
    assert got == want


def test_scores_follow_their_formula(docs):
    low = lambda t: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in _texts() if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in low(t)), 6)) for i, t in _texts())
    rows = scoring.scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_every_training_document_is_learnt_from():
    texts = [(f"alpha beta {i}" * (1 + i % 3)).encode() for i in range(40)]
    chunk = types.SimpleNamespace(ids=np.arange(40), texts=texts, steps=lambda: [(0, 25), (25, 40)])
    t = scoring._Tokens(chunk, 5)
    read = scoring._Read(chunk.ids, t.held.astype(np.uint8), t.n, None, None, None, np.arange(len(t.h)))
    want = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    got = []
    for k in range(3):
        s, starts = read.part(k, 3)
        assert starts[-1] == len(s) and len(starts) > 1
        got += s.tolist()
    assert sorted(got) == [k for i in want for k in range(t.starts[i], t.starts[i + 1])]


def test_model_gradients_and_whole_probability():
    from ancestra.llm import gru

    shape = gru.Shape((0, 3, 7), 2, 0)
    counts = np.array([20, 9, 8, 7, 6, 5, 4, 10, 3])
    flat = gru.initial(shape, counts, 3)
    start = np.array([0, 40, 60])
    symbols = (np.arange(60) * 7 % 9).astype(np.int32)
    symbols[[39, 59]] = 0
    unigram = np.log((counts + 0.5) / (counts + 0.5).sum())
    first = {k: gru.score(shape, flat, np.array([k], np.int32), np.array([0, 1]))[0] for k in range(9)}
    assert abs(sum(map(math.exp, first.values())) - 1) < 1e-4 and max(abs(first[k] - unigram[k]) for k in range(9)) < 0.2
    before = gru.score(shape, flat, symbols, start)
    after = gru.score(shape, gru.train(shape, flat, symbols, start, 2e-2, 30), symbols, start)
    assert after.sum() > before.sum() + 20
    total = sum(math.exp(gru.score(shape, flat, np.array([4, k], np.int32), np.array([0, 2]))[0] - first[4]) for k in range(9))
    assert abs(total - 1) < 1e-4
    # the gradient of a window by differences, in double precision
    flat = flat.astype(np.float64)
    source, target, text, begin = gru.streams(symbols, start, 2, 0)
    w = slice(0, 24)
    h = np.random.default_rng(5).standard_normal((2, gru.HIDDEN)) * 0.3
    args = (source[w], target[w], text[w] >= 0, begin[w])
    _, found, _ = gru.gradient(shape, flat, h, *args)
    for i in np.random.default_rng(6).choice(len(flat), 60, replace=False).tolist() + np.flatnonzero(np.abs(found) > np.quantile(np.abs(found), 0.99)).tolist()[:20]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (gru.gradient(shape, up, h, *args)[0] - gru.gradient(shape, down, h, *args)[0]) / 2e-5
        assert abs(slope - found[i]) < 1e-6 + 1e-4 * abs(slope)


def test_model_beats_the_counts_on_held_out_documents(spark):
    rows = scoring.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.02 * sum(r.n_tokens for r in rows)


def test_token_files_round_trip(docs, none, tmp_path, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    manifest = tokenfile.write(docs, str(tmp_path / "a"))
    assert manifest["dtype"] == "<u2"
    rows = tokenfile.read(spark, str(tmp_path / "a")).collect()
    want = Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 0) for i, x in _texts())
    assert Counter((r.doc_id, *r.ids) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in _texts()), key=lambda i: -(1 << 63) if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    tokenfile.write(none, str(tmp_path / "b"))
    assert tokenfile.read(spark, str(tmp_path / "b")).count() == 0


ODD = ["", " ", "  a  b ", "a\tb\n\nc", "é①ﬁ", "\x00a", "<s>hi</s>", "▁x", "　x y", " " * 20 + "z", "it's we'll", "<|endoftext|> a<|endoftext|>", "…. a.b ,c", "\x1c x", "a \n b", "Σας İ"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_tokenizers_library(name, spaced):
    e = tokens.Encoder(tokens.public_path(name), "<u4", spaced)
    texts = [*ODD, *(t or "" for _, t in _texts())]
    for x, got in zip(texts, e.ids_of([t.encode() for t in texts])):
        assert got.tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path("piece_bpe_32k.model"))
    mine = sentencepiece_bpe.model(tokens.public_path("piece_bpe_32k.model"))
    for x, (ids, decimal, plain) in zip(ODD, mine.look_up([t.encode() for t in ODD])):
        want = m.encode(x)
        assert ids.tolist() == want and decimal.decode() == ",".join(map(str, want)) and plain.decode() == m.decode(want)
    long = " " * 1_000_000 + "x" + " " * 4099
    (ids, _, plain), want = mine.look_up([long.encode()])[0], m.encode(long)
    assert ids.tolist() == want and plain.decode() == m.decode(want)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in sentencepiece_bpe.round_trip(docs).collect())
    assert got == Counter((i, tuple(m.encode(t or "")), m.decode(m.encode(t or ""))) for i, t in _texts())


def test_fingerprints(docs):
    rows = fingerprints.fingerprinted(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    of = {r.text or "": r.fingerprint for r in rows}
    assert all(len(f) == 256 for f in of.values()) and of[""] == of[" \n\t "] and of["one two"] == of["one  two"]
    texts = list(of)
    pairs = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if _sets(a) or _sets(b)]
    same = lambda a, b: max(0.0, min(1.0, (sum(x == y for x, y in zip(of[a], of[b])) / 256 - 1 / 16) / (15 / 16)))
    off = [same(a, b) - len(_sets(a) & _sets(b)) / len(_sets(a) | _sets(b)) for a, b in pairs]
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.03
    got = {r.doc_id: r for r in fingerprints.edited(docs).collect()}
    order = sorted({(-(1 << 63) if i is None else i): t or "" for i, t in _texts()}.items())
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        m = len(t) // 4
        r = got[None if i == -(1 << 63) else i]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest() and r.n_chars == len(t)
        assert r.near_edited == 1.0 or m


def test_classifier_learns_and_scores(spark, docs):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.fit(d, labels)
    assert 0 < len(model.rules) < 200
    rows = classifier.scored(d, model).join(labels, "doc_id").where(classifier.held_out(F.col("doc_id"))).select("score", "quality").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    odd = classifier.scored(docs, model)
    assert odd.columns == [*docs.columns, "score"] and odd.where("score between 0 and 1").count() == len(_texts())
    blank = classifier.fit(d, labels.limit(0))
    assert classifier.scored(docs, blank).where("abs(score - 0.5) < 1e-9").count() == len(_texts())


def test_packing_covers_every_token_once(docs):
    rows = packing.packed(docs, width=64).collect()
    t = tokens.Encoder(tokens.public_path("word_bpe_49k.json"), "<u4", False)
    want = Counter()
    for i, x in _texts():
        ids = np.append(t.ids_of([(x or "").encode()])[0], 2).astype("<u4")
        for s in range(0, len(ids), 64):
            want[i, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    fill: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))


def test_shortest_pack_first_keeps_the_histogram():
    h = {1: 1000, 7: 300, 30: 50, 63: 5, 64: 9}
    packs = packing.shortest_pack_first(h, 64)
    assert Counter({k: sum(p.count(k) * n for p, n in packs) for k in h}) == Counter(h)
    assert all(sum(p) <= 64 for p, _ in packs) and sum(n for _, n in packs) <= -(-sum(k * n for k, n in h.items()) // 64) + 2


def test_empty_tables(none):
    for f in (jaccard.classes, suffix.removals, rules.judged, scoring.scores, sentencepiece_bpe.round_trip, fingerprints.edited, packing.packed):
        assert f(none).count() == 0


def test_chat_keeps_calls_without_an_identifier(spark):
    call = lambda i, args: {"id": i, "name": "calculate", "arguments": args}
    rows = [
        (1, 0, "assistant", json.dumps({"content": "c", "tool_calls": [call("a", {"expression": "1"}), {"name": "calculate", "arguments": {"expression": "2"}}, call(None, {"other": 3})]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "1"})), (2, 0, "assistant", json.dumps({"content": "d", "tool_calls": [call(None, {"expression": "4"})]})),
    ]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"calculate": {"expression": ("string", True)}}).collect()
    calls = sorted((r.conv_id, r.step, r.call_id, r.linked, r.valid, r.order_turn, r.level, json.dumps(json.loads(r.json)["arguments"])) for r in got if r.kind == "call")
    assert calls == [(1, 1, "a", True, True, 0, 0, '{"expression": "1"}'), (1, 2, None, False, True, 0, 0, '{"expression": "2"}'), (1, 3, None, False, False, 0, 0, '{"other": 3}'), (2, 1, None, False, True, 0, 0, '{"expression": "4"}')]
    assert sorted(json.loads(r.json)["content"] for r in got if r.kind == "message") == ["c", "d"] and len(got) == 7


def test_chat_links_orders_and_validates(spark):
    call = lambda i, name, args, **k: {"id": i, "name": name, "arguments": args, **k}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"content": "", "tool_calls": [call("a", "search", {"query": "x", "limit": 3}), call("b", "search", {"limit": "3"}, after=["a"])]})),
        (1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "early"})), (1, 5, "tool", json.dumps({"tool_call_id": "b", "content": "B"})), (1, 6, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", "calculate", {"expression": "1"}, after=["q"]), call("q", "nope", {}, after=["p"])]})),
        (None, None, None, None), (3, 0, "assistant", "{not json"), (3, 0, "assistant", "{not json"),
    ]
    m = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = chat.linked(m, {"search": {"query": ("string", True), "limit": ("integer", False)}, "calculate": {"expression": ("string", True)}}).collect()
    by = {(r.conv_id, r.kind, r.call_id): r for r in got if r.kind != "message"}
    assert by[1, "call", "a"].valid and not by[1, "call", "b"].valid and not by[2, "call", "q"].valid and by[2, "call", "p"].valid
    assert by[1, "call", "a"].linked and not by[1, "result", "zz"].linked and not by[2, "call", "p"].linked
    order = lambda r: (r.order_turn, r.level, r.turn, r.step)
    assert order(by[1, "call", "a"]) < order(by[1, "result", "a"]) < order(by[1, "call", "b"]) < order(by[1, "result", "b"])
    assert by[2, "call", "p"].level == -1
    assert json.loads(by[1, "call", "a"].json) == {"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search", "type": "tool_call"}
    assert by[1, "call", "a"].json.startswith('{"arguments":{"limit":3,"query":"x"},')
    assert sum(r.kind == "message" for r in got) == 6 and chat.linked(m.limit(0), {}).count() == 0


def test_chat_order_parses_texts_once(spark, monkeypatch):
    """Of the tables settled for the order only the first comes from the texts, and long chains of waits keep estimates small."""
    from ancestra.llm import chat

    plans, kept = [], chat.settled

    def settled(df):
        plan = df._jdf.queryExecution().optimizedPlan()
        plans.append(("parsejson" in plan.toString().lower().replace("_", ""), plan.stats().sizeInBytes().bit_length()))
        return kept(df)

    monkeypatch.setattr(chat, "settled", settled)
    calls = [f'{{"id":"c{k}","name":"f","arguments":{{}},"after":["c{k - 1}"]}}' for k in range(12)]
    rows = [(1, 0, "assistant", '{"content":"x","tool_calls":[' + ",".join(calls) + "]}"), (1, 1, "tool", '{"tool_call_id":"c3","content":"y"}')]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {}}).collect()
    assert {r.call_id: r.level for r in got if r.kind == "call"} == {f"c{k}": 2 * k for k in range(12)}
    assert sum(parsed for parsed, _ in plans) == 1 and max(bits for _, bits in plans) < 1000
