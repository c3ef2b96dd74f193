"""The pipeline against plain versions of its stages."""

import corpus_pipeline as p
from tests.llm.test_operators import _repeats, _sets, docs, none  # noqa: F401


def test_stages_on_small_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after and set(after) <= {i for i, _ in before}
        if name == "ngram_jaccard_join":
            sets = {i: _sets(t) for i, t in before}
            linked = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
            assert not any(linked(sets[i], sets[j]) for i in after for j in after if i < j)
            assert all(any(linked(sets[i], sets[j]) for j in sets if j != i) for i in sets if i not in after)
        if name == "suffix_array_dedup":
            removed = {k[0]: k for k in _repeats(before, 50)}
            assert len(after) == len(before)
            assert all(after[i] == t for i, t in before if removed[i][2] == 0)
            assert all(len(after[i].encode()) <= removed[i][1] - removed[i][2] for i, _ in before)
    rows = p.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == set(after)


def test_stages_keep_null_ids_and_single_rows_of_repeated_ones(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    n = docs.count()
    ruled = p.quality_rules(spark, docs, sf).collect()
    assert sum(r.doc_id is None for r in ruled) == 1 and {12, 13, 16}.isdisjoint(r.doc_id for r in ruled)
    near = p.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id for r in near if r.doc_id is not None)) == [-4, 3, 9, 10, 11, 12, 13, 14, 16, 17, 18, 20, 22] and len(near) == 14
    cut = p.repeated_strings(spark, docs, sf)
    assert cut.columns == docs.columns and cut.count() == n
    assert sum(r.doc_id == 20 and r.text == "x" for r in cut.collect()) == 2
    for stage in (p.quality_rules, p.near_duplicates, p.repeated_strings):
        assert stage(spark, none, sf).collect() == []


def test_rules_learn_that_symbols_are_rare(spark):
    clean = [(k, " ".join(f"wort{k * j % 89}{chr(97 + j % 7)}" for j in range(40 + k)), "en", f"s{k % 2}", 1) for k in range(1, 81)]
    piped = [(100 + k, " | ".join(f"a{k * j % 83}bcd" for j in range(1, 25)), "en", f"s{k % 2}", 1) for k in range(4)]
    docs = spark.createDataFrame(clean + piped, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.quality_rules(spark, docs, "").collect()) == list(range(1, 81))


def test_near_duplicates_know_texts_of_repeated_and_null_ids(spark):
    say = lambda a: [f"w{a}x{k}" for k in range(60)]
    near = lambda a: " ".join([*say(a)[:-1], "other"])
    text = lambda a: " ".join(say(a))
    rows = [(None, text(1)), (None, near(1)), (None, text(2)), (7, text(3)), (7, near(3)), (7, text(4)), (5, near(4)), (9, text(5)), (9, text(6)), (8, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.n_links) for r in p.jaccard.classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (None, 1), (None, 0), (7, 1), (7, 1), (7, 1), (5, 1), (9, 1), (9, 0), (8, 1)], key=str)
    kept = [(r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 6 and {(None, text(2)), (5, near(4)), (8, text(5)), (9, text(6))} <= set(kept)
    assert sum(t in (text(1), near(1)) for _, t in kept) == 1 and sum(t in (text(3), near(3)) for _, t in kept) == 1
