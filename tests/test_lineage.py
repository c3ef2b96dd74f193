"""Toy graphs and rule fixtures with results worked out by hand."""

from __future__ import annotations

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ancestra import queries
from ancestra.functions import licenses, names
from ancestra.operators import audit, cleaning, graph, inference, ingest, options, scenarios, statistics
from ancestra.plans.materialise import settle
from ancestra.sources import tables

ONE = [("A", "tg", "en", "apache-2.0", 100), ("A1", "tg", "en", "mit", 10), ("A11", "tc", "ko", "mit", 5), ("A2", "tg", "en", "cc-by-nc-4.0", 3), ("B", "tg", "en", "llama3", 50), ("B1", "asr", "en", "apache-2.0", 2), ("M", "tg", "en,ko", "mit", 1), ("C", "tg", "en", "apache-2.0", 7)]
AUTHORS = dict(zip("A A1 A11 A2 B B1 M C".split(), "a a x y b b z c".split()))


def _nodes(spark, rows, off=()):
    df = spark.createDataFrame([(*r, AUTHORS.get(r[0], r[0]), r[0] not in off) for r in rows], "node string, task string, languages string, license string, downloads long, author string, is_provider boolean")
    return df.withColumn("cls", licenses.license_class(F.col("license")))


def _edges(spark, pairs):
    return spark.createDataFrame([(p, c, r) for p, c, r in pairs], "p string, ch string, relation string")


@pytest.fixture(scope="module")
def first(spark):
    return _nodes(spark, ONE), _edges(spark, [(p, c, "finetune") for p, c in (("A", "A1"), ("A1", "A11"), ("A", "A2"), ("A2", "M"), ("B", "M"), ("B", "B1"))])


@pytest.fixture(scope="module")
def second(spark):
    n = _nodes(spark, [(k, "tg", l, "mit", 1) for k, l in zip("B L1 L2 F Bm D L3 U".split(), ["en"] * 5 + ["ko", "ko", None])])  # noqa: E741
    return n, _edges(spark, [("B", "L1", "adapter"), ("L1", "L2", "adapter"), ("B", "F", "finetune"), ("B", "Bm", "mirror"), ("D", "L3", "adapter")])


def _seeds(spark, *ids):
    return spark.createDataFrame([("s", i) for i in ids], "scenario_id string, node string")


def _set(df):
    return {r.node for r in df.select("node").collect()}


def test_closure_and_loss(spark, first):
    n, e = first
    removed = graph.removed_legal(graph.closure(e), _seeds(spark, "B"))
    assert _set(removed) == {"B", "B1", "M"}
    assert _set(graph.reach(e, _seeds(spark, "A"))) == {"A", "A1", "A11", "A2", "M"}
    p = options.pairs(n, "strict")
    o = options.with_loss(options.survivors(p, removed, removed), "strict")
    assert {(r.task, r.lang, r.cls) for r in o.where("lost").collect()} == {("tg", "en", "vendor_custom"), ("asr", "en", "permissive"), ("tg", "ko", "permissive")}


def test_descendants_and_providers(spark, first):
    n, e = first
    got = {r.node: (r.descendants, r.descendant_authors) for r in graph.descendant_stats(graph.closure(e), n).collect()}
    assert got["A"] == (4, 3) and got["B"] == (2, 1)
    fewer = {r.node: r.descendants for r in graph.descendant_stats(graph.closure(e), _nodes(spark, ONE, off=("A1", "A11"))).collect()}
    assert fewer["A"] == 2
    o = options.survivors(options.pairs(n), graph.removed_legal(graph.closure(e), _seeds(spark, "A2")), _seeds(spark, "x")).withColumn("removed_class", F.lit("noncommercial"))
    r = options.loss(o, "full", removed_class=True).first()
    assert (r.options_lost, r.collateral_options_lost) == (2, 1)


def test_availability_spares_mirrored(spark, second):
    n, e = second
    hard = graph.closure(e.where("relation = 'adapter'"))
    of = lambda *s: _set(graph.removed_availability(e, hard, _seeds(spark, *s)))
    assert of("B") == {"B"} and of("B", "Bm") == {"B", "Bm", "L1", "L2"} and of("D") == {"D", "L3"}
    closed = graph.closure(e)
    assert _set(graph.removed_legal(closed, _seeds(spark, "B"))) == {"B", "L1", "L2", "F", "Bm"}

    def lost(definition, *s):
        removed = graph.removed_legal(closed, _seeds(spark, *s))
        return options.loss(options.survivors(options.pairs(n, definition), removed, removed), definition).first().options_lost

    assert lost("full", "D") == 0 and lost("strict", "D") == 1 and lost("full", "D", "U") == 2 - 1


def test_degradation(spark, first):
    n, e = first
    removed = graph.removed_legal(graph.closure(e), _seeds(spark, "A"))
    o = options.survivors(options.pairs(n, "strict"), removed, removed).where("task = 'tg' and lang = 'en' and cls = 'permissive'").first()
    assert (o.best, o.best_after) == (100, 7)


def test_cycles_and_inheritance(spark):
    e = _edges(spark, [("a", "b", "mirror"), ("b", "c", "mirror"), ("c", "a", "mirror"), ("c", "d", "quantized"), ("x", "x", "mirror"), ("d", "e", "mirror")])
    got = {(r.p, r.ch): r.in_cycle for r in graph.cycle_edges(e).collect()}
    assert {k for k, v in got.items() if v} == {("a", "b"), ("b", "c"), ("c", "a")}
    n = spark.createDataFrame([("c", "mit", None), ("d", None, "en"), ("e", None, None)], "node string, license string, languages string")
    rows = {r.node: r for r in graph.inherit(n, e.where("p in ('c', 'd')"), ["license", "languages"]).collect()}
    assert rows["e"].license == "mit" and rows["e"].inherited_license and rows["d"].languages == "en" and not rows["d"].inherited_languages


def test_first_rank_curve_reaches_target(spark):
    d = "/root/testdata/sf0.001"
    n = queries.fixtures.nodes(spark, d)
    target = queries._target(spark, d)
    for r in scenarios.matched(queries._curve(spark, d), target).collect():
        assert r.removed >= 0.95 * target
    order = scenarios.ranked(queries._cand(spark, d), "matched", 20).where("draw = 3")
    m = scenarios.matched(queries._curve(spark, d), target).where("draw = 3").first()
    seeds = order.where(F.col("rank") <= m.m).select(F.lit("s").alias("scenario_id"), "node")
    assert graph.removed_legal(queries._closed(spark, d), seeds).join(n.where("is_provider"), "node", "left_semi").count() == m.removed


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("given,want", [("apache-2.0", "permissive"), ("cc-by-nc-4.0", "noncommercial"), ("gpl-3.0", "copyleft"), ("llama3.1", "vendor_custom"), ("openrail++", "responsible_ai"), (None, "unknown"), ("other", "other"), ("cc-by-nd-4.0", "no_derivatives"), ("apple-amlr", "noncommercial"), ("ncsa", "permissive"), ("some-new-nc-license", "noncommercial"), ("override:noncommercial", "noncommercial")])
def test_license_class(spark, given, want):
    assert _one(spark, given, licenses.license_class) == want


def test_name_rules(spark):
    hit = lambda s, p: _one(spark, s.lower(), lambda c: names.matches(c, p))
    assert hit("qwen-qwen1.5-0.5b-1725623935", names.BOT_PATTERNS["timestamp_suffix"]) and hit("cma5k9d0900tinegayi6a5ksk_cma5ke6kz00tpnegaicrpsprk", names.BOT_PATTERNS["cuid_name"])
    assert not hit("candycarpetcleaningirving", names.BOT_PATTERNS["cuid_name"])
    assert hit("ppo-LunarLander-v2", names.COURSE_PATTERN) and hit("my-model-tmp", names.TEST_PATTERN) and not hit("latest-llama", names.TEST_PATTERN)
    strip = lambda s: _one(spark, s, names.without_quant_suffix)
    assert strip("EXAONE-4.5-33B-i1-GGUF") == "EXAONE-4.5-33B" and strip("Llama-3.1-8B-Instruct") == "Llama-3.1-8B-Instruct" and strip("gemma-4-26B-uncensored-mlx-q8") == "gemma-4-26B-uncensored"
    assert _one(spark, "/data/models--Org--Name/x", names.id_of_local_path) == "Org/Name" and _one(spark, "a/b", names.id_of_local_path) is None
    assert _one(spark, "see `bob/x` and `ok/y`", lambda c: names.pseudonymised(c, ["ok"])).startswith("see `user-") and _one(spark, "facebook", names.company) == "Meta"


def test_holm_p_and_kappa(spark):
    t = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03])], "family string, k int, p double")
    assert [(round(r.p_holm, 9), r.reject) for r in statistics.holm(t, ["family"], ["k"]).orderBy("k").collect()] == [(0.03, True), (0.06, False), (0.06, False)]
    null, obs = spark.createDataFrame([(1, 0.0)] * 99, "g int, value double"), spark.createDataFrame([(1, 10.0)], "g int, observed double")
    r = statistics.empirical_p(null, obs, ["g"]).first()
    assert r.p == 0.01 and math.isinf(r.ratio_vs_matched)
    cells = [(0, 0)] * 113 + [(1, 0)] + [(0, 1)] * 3 + [(1, 1)] * 169
    assert round(statistics.kappa(spark.createDataFrame(cells, "a int, b int"), "a", "b").first().kappa, 3) == 0.971
    low, high = statistics.wilson(F.lit(32.0), F.lit(50.0))
    got = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(got.l, 2), round(got.h, 2)) == (0.5, 0.76)


def test_build_clean_and_infer(spark, tmp_path):
    rec = lambda i, **k: {"id": i, "createdAt": "2024-01-02T00:00:00Z", "tags": [], "downloads": 1, **k}
    rows = [
        rec("Big/Base", tags=["license:mit", "en", "fr", "dataset:d"]), rec("Big/Base", tags=["license:other"]),
        *(rec(f"u{k}/ft", tags=["base_model:big/base", "base_model:finetune:big/base"], createdAt="2024-02-01T00:00:00Z") for k in range(20)),
        rec("z/base", createdAt="2024-03-01T00:00:00Z"), rec("q/base-GGUF"), rec("q/Other"), rec("q/other-4bit", createdAt="2024-05-01T00:00:00Z"),
        rec("RichardErkhov/Big_-_Base-gguf"), rec("l/x", tags=["base_model:gone/Base"]), rec("noslash"),
    ]
    path = tmp_path / "raw.jsonl.gz"
    path.write_bytes(b"".join(gzip.compress((json.dumps(r) + "\n").encode()) for r in rows))
    raw = tables.jsonl(spark, str(path))
    nodes, edges, sets = ingest.build(raw, "__order")
    base = nodes.where("model_id = 'Big/Base'").first()
    assert (base.license, base.languages, base.author, nodes.count(), sets.count()) == ("mit", "en,fr", "Big", len(rows) - 1, 1)
    e = edges.where("child_id = 'u3/ft'").first()
    assert (e.parent_id, e.relation, e.parent_in_snapshot, e.temporal_ok, edges.count()) == ("Big/Base", "finetune", True, True, 21)
    every = inference.with_inferred(nodes, edges)
    got = {(r.parent_id, r.child_id, r.source) for r in every.where("source <> 'declared'").collect()}
    assert got == {("Big/Base", "RichardErkhov/Big_-_Base-gguf", "inferred_name"), ("Big/Base", "z/base", "inferred_mirror"), ("q/Other", "q/other-4bit", "inferred_quant")}
    lookup = spark.createDataFrame([("gone/Base", 200, "Big/Base")], "parent_id string, code int, found_id string")
    resolved = inference.lookup_missing(edges, lookup, nodes)
    assert resolved.first().status == "renamed"
    assert inference.reconnect(edges, resolved).where("child_id = 'l/x' and parent_id = 'Big/Base' and parent_in_snapshot").count() == 1
    f = {r.model_id: r for r in cleaning.flags(nodes, edges, every, least_authors=20).collect()}
    assert f["u3/ft"].f_boilerplate and not f["u0/ft"].f_boilerplate and f["q/Other"].f_empty and f["u3/ft"].tier == "T0" and len(f) == len(rows) - 1


def test_audit_finds_faults(spark):
    r = spark.createDataFrame([("a", 1, 5.0), ("a", 5, 4.0), ("a", 5, 4.0), ("b", 1, 101.0), ("b", 5, None)], "strategy string, k int, pct double")
    checks = {x.check for x in audit.violations(r, ["strategy", "k"], ["pct"], "pct", {"a": 3, "b": 3}).collect()}
    assert checks == {"duplicate", "range:pct", "monotone:pct", "rows"}
    good = spark.createDataFrame([("a", 1, 5.0), ("a", 5, 6.0)], "strategy string, k int, pct double")
    assert audit.violations(good, ["strategy", "k"], ["pct"], "pct", {"a": 2}).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_b"), (2, None)], "k int, v string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.csv(spark, str(tmp_path / "c"), "k int, v string").count() == 2
    assert tables.block(spark, str(tmp_path / "b"), lambda: df).count() == tables.block(spark, str(tmp_path / "b"), lambda: 1 / 0).count() == 2
    assert "| 1 | a_b |" in tables.markdown(df) and r"a\_b" in tables.latex(df)
    assert tables.manifest(spark, str(tmp_path / "b")).where("length(sha256) = 64").count() >= 1
    pages = {"p1": (200, {"Link": '<p2>; rel="next"'}, "[1, 2]"), "p2": (200, {}, "[3]")}
    hits, waits = [], []

    def fetch(url):
        hits.append(url)
        return (429, {"RateLimit": "r=0;t=7"}, "") if len(hits) == 1 else (503, {}, "") if len(hits) == 2 else pages[url]

    crawl = tables.Pages(fetch, "p1", sleep=waits.append)
    assert list(crawl) == [[1, 2], [3]] and waits == [8, 2] and crawl.state["done"] and crawl.state["count"] == 3
    assert tables.optional(spark, str(tmp_path / "nothing"), lambda: df).count() == 2


def test_stream_keeps_first_record(spark, tmp_path):
    from ancestra.streaming.ingest import records

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "x", "createdAt": "2024-01-01T00:00:00Z"}\n{"id": "x", "createdAt": "2024-01-01T00:00:00Z"}\n{"id": "y", "createdAt": "2024-01-01T00:00:00Z"}\n')
    q = records(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_variant_losses_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    nodes = {r.node: r for r in queries.fixtures.nodes(spark, d).collect()}
    edges = {(r.p, r.ch, r.relation) for r in queries.fixtures.edges(spark, d).collect()}
    outdegree: dict = {}
    for r in queries.fixtures.edges(spark, d).collect():
        outdegree[r.p] = outdegree.get(r.p, 0) + 1
    quantized = {c for _, c, rel in edges if rel == "quantized"}
    provider = {i for i, r in nodes.items() if r.is_provider and i not in quantized}

    def below(starts, relations=None):
        seen, todo = set(starts), list(starts)
        while todo:
            for c in children.get(todo.pop(), ()):
                if (relations is None or c[1] in relations) and c[0] not in seen:
                    seen.add(c[0])
                    todo.append(c[0])
        return seen

    children: dict = {}
    for p, c, rel in edges:
        children.setdefault(p, []).append((c, rel))
    measures: dict = {}
    for i in provider & set(outdegree):
        under = (below([i]) - {i}) & provider
        measures[i] = {"descendants": len(under), "descendant_authors": len({nodes[u].author for u in under} - {nodes[i].author}), "downloads": nodes[i].downloads, "outdegree": outdegree[i]}
    pairs = [(i, (nodes[i].task or "unk", lang, nodes[i].cls)) for i in provider for lang in (nodes[i].languages or "unk").split(",")]
    options_ = {o for _, o in pairs}
    want = {}
    for s in ("descendants", "descendant_authors", "downloads", "outdegree"):
        order = sorted(measures, key=lambda i: (-measures[i][s], i))
        for k in (1, 5, 10, 50, 100):
            top = set(order[:k])
            spared = {i for i in top if any(rel == "mirror" and c not in top for c, rel in children.get(i, ()))}
            removed = top | below(top - spared, {"adapter"})
            left = {o for i, o in pairs if i not in removed}
            lost = sum(not any(o[0] == t and o[2] == c and (o[1] in (lang, "unk") or lang == "unk") for o in left) for t, lang, c in options_)
            want[s, k] = (len(options_), lost, len(removed & provider))
    got = {(r.strategy, r.k): (r.options_total, r.options_lost, r.removed_providers) for r in queries.variant_losses(spark, d).collect()}
    assert got == want


def test_touched_losses_equal_those_of_all_options(spark, first, second):
    for (n, e), seeds in ((first, ("A", "B", "A2")), (second, ("B", "D", "U"))):
        closed = graph.closure(e)
        every = spark.createDataFrame([(s, s) for s in seeds] + [("all", s) for s in seeds], "scenario_id string, node string")
        removed = graph.removed_legal(closed, every)
        for definition in ("full", "strict", "coarse"):
            p = options.pairs(n, definition)
            want = sorted(map(tuple, options.loss(options.survivors(p, removed, every), definition).collect()))
            assert sorted(map(tuple, options.touched_loss(p, removed, every, definition).collect())) == want
    n, e = first
    got = options.node_losses(graph.removed_legal(graph.closure(e), _seeds(spark, "A2")), _nodes(spark, ONE, off=("M",))).collect()
    assert [(r.models_lost, r.models_lost_incl_flagged, round(r.pct_downloads_lost, 6)) for r in got] == [(1, 2, round(100 * 4 / 178, 6))]


def test_closure_of_cycles_and_long_paths(spark):
    pairs = [(f"n{k:02d}", f"n{k + 1:02d}", "finetune") for k in range(37)] + [("n20", "n15", "merge"), ("n05", "n05", "merge"), ("x", "y", "merge")]
    e = _edges(spark, pairs)
    below: dict = {}
    for p, c, _ in pairs:
        below.setdefault(p, set()).add(c)
    want = set()
    for p in below:
        seen, todo = {p}, [p]
        while todo:
            for c in below.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        want |= {(p, c) for c in seen}
    assert {(r.anc, r.de) for r in graph.closure(e).collect()} == want
    some = spark.createDataFrame([("n10",), ("x",)], "anc string")
    assert {(r.anc, r.de) for r in graph.closure(e, some).collect()} == {(p, c) for p, c in want if p in ("n10", "x")}
    cyclic = {(r.p, r.ch) for r in graph.cycle_edges(e).where("in_cycle").collect()}
    assert cyclic == {(f"n{k:02d}", f"n{k + 1:02d}") for k in range(15, 20)} | {("n20", "n15")}


def test_greedy_takes_what_loses_most(spark, first):
    n, e = first
    closed = graph.closure(e)
    cand = scenarios.candidates(n, e, closed)
    ids = sorted(r.node for r in cand.collect())
    down: dict = {}
    for r in closed.collect():
        down.setdefault(r.anc, set()).add(r.de)
    pairs = [(r.node, r.task, r.lang, r.cls) for r in options.pairs(n, "strict").collect()]
    chosen, gone = [], set()
    for _ in ids:
        lost = lambda s: len({p[1:] for p in pairs}) - len({p[1:] for p in pairs if p[0] not in s})
        best = min((c for c in ids if c not in chosen), key=lambda c: (-lost(gone | down[c]), c))
        chosen.append(best)
        gone |= down[best]
    assert scenarios.greedy(cand, closed, n, len(ids)) == chosen


def test_bins_with_too_few_nodes_draw_from_wider_ones(spark):
    rows = [(k, d) for k, d in enumerate([0, 0, 0, 1, 1, 3, 3, 7, 40, 41, 42, 43])]
    cand = spark.createDataFrame(rows, "node long, descendants long")
    target = cand.where("node in (5, 6, 8)")
    for draw in range(5):
        got = {r.node for r in scenarios.bin_matched(cand, target, 5).where(f"draw = {draw}").collect()}
        # both of the bin of 3 are targets: two others come from the bins from 1 on; the bin of 40 has three others
        assert not got & {5, 6, 8, 0, 1, 2} and 2 <= len(got) <= 3 and got & {9, 10, 11}


def test_a_matched_prefix_grows_by_its_factor(spark):
    points = spark.createDataFrame([(0, m, m * 2) for m in range(1, 101)], "draw int, m int, removed long")
    sizes = spark.createDataFrame([(0, k, 1 + k % 3) for k in range(1, 101)], "draw int, rank int, size long")
    sums, m = 0, 0
    while sums < 90:
        m += 1
        sums += 1 + m % 3
    while m < 100 and 2 * m < 0.95 * 90:
        m = min(100, int(m * 1.15) + 1)
    got = scenarios.growing_prefix(points, sizes, 90).collect()
    assert [(r.m, r.removed) for r in got] == [(m, 2 * m)]


def test_holm_rejects_at_the_level_itself(spark):
    t = spark.createDataFrame([("f", 1, 0.025), ("f", 2, 0.05)], "family string, k int, p double")
    assert [r.reject for r in statistics.holm(t, ["family"], ["k"]).collect()] == [True, True]


def test_bootstrap_resamples(spark):
    rows = spark.range(400).withColumn("hit", F.col("id") % 4 == 0)
    r = statistics.bootstrap_share(rows, "hit", 800).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / 400)
    assert r.share == 0.25 and abs(r.low - (0.25 - half)) < 0.01 and abs(r.high - (0.25 + half)) < 0.01
    assert statistics.bootstrap_share(rows.limit(0), "hit", 10).first().low is None


def test_raters_agree_as_published(spark):
    cells = {(0, 0): 113, (0, 1): 3, (1, 0): 1, (1, 1): 169, (9, 1): 0, (1, 9): 0, (0, 9): 0, (9, 0): 0, (9, 9): 11}
    cells[1, 9] = 3  # one rater could not decide
    flat = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    items = spark.createDataFrame([(i, "kept" if i % 3 else "bot", a, b) for i, (a, b) in enumerate(flat)], "item int, stratum string, a int, b int")
    side = lambda c: items.select("item", F.col(c).alias("label"))
    rows = statistics.ratings(items.select("item", "stratum"), side("a"), side("b"), "item")
    r = statistics.agreement(rows).first()
    assert (r.n, r.n_both_decidable, round(100 * r.agreement, 1), round(r.kappa_binary, 3), round(r.kappa_3cat_all, 3), r.n_disagreements) == (300, 286, 98.6, 0.971, 0.955, 7)
    p = {(x.stratum, x.rater): x for x in statistics.stratum_precision(rows, ("kept",)).collect()}
    both = [(a, b) for i, (a, b) in enumerate(flat) if i % 3 and a == b != 9]
    assert (p["kept", "consensus"].n, p["kept", "consensus"].hits) == (len(both), sum(a == 0 for a, _ in both))
    with pytest.raises(Exception, match="label is missing"):
        statistics.ratings(items.select("item", "stratum"), side("a").limit(5), side("b"), "item").collect()


def test_variant_settings_are_read(spark, first):
    from ancestra.config import VariantConfig
    from ancestra.plans import variant

    n, e = first
    e = e.withColumns({"temporal_ok": F.col("ch") != "M", "parent_in_snapshot": F.lit(True), "in_cycle": F.lit(False), "source": F.when(F.col("ch") == "B1", "inferred_name").otherwise("declared")})
    flags = n.select("node", (F.col("node") == "A1").alias("f_test"), (F.col("node") == "A2").alias("f_empty"), (F.col("node") == "C").alias("f_zero_downloads"))
    over = spark.createDataFrame([("B", "copyleft"), ("C", "other")], "node string, cls string")
    of = lambda **k: variant.prepared(n, e, VariantConfig(**k), flags, over)
    off = lambda x: {r.node for r in x[0].where("not is_provider").collect()}
    count = lambda x: x[1].count()
    assert off(of(tier="T0")) == set() and off(of()) == {"A1", "A2"} and off(of(tier="T2")) == {"A1", "A2", "C"} and off(of(drop_rules=("f_test",))) == {"A2"}
    assert count(of()) == 4 and count(of(keep_temporal_violations=True)) == 6 and count(of(declared_only=True)) == 3
    cls = lambda x: {r.node: r.cls for r in x[0].collect()}
    assert cls(of())["B"] == "copyleft" and cls(of(license_overrides=False))["B"] == "vendor_custom" and cls(of())["C"] == "permissive"
    assert cls(of(inherit=False))["B"] == "copyleft"


def test_a_whole_variant(spark, first):
    from ancestra.config import VariantConfig
    from ancestra.plans import variant

    n, e = first
    n, e = (df.withColumns({c: F.ascii(c).cast("long") * 1000 + F.length(c) * 100 + F.ascii(F.substring(c, -1, 1)) for c in cols}) for df, cols in ((n, ["node"]), (e, ["p", "ch"])))
    results, tests = variant.tested(n, e, VariantConfig(ks=(1, 2), draws=9, tolerance=0.9))
    rows = results.collect()
    kinds = {(r.strategy, r.k) for r in rows}
    assert len([r for r in rows if r.strategy == "random"]) == 18 and len([r for r in rows if r.strategy == "random_matched"]) == 72 and ("greedy", 2) in kinds
    size = {(r.strategy, r.k): r.removed_providers for r in rows if r.draw is None}
    assert all(r.removed_providers >= 0.9 * size[r.matched_to, r.k] for r in rows if r.strategy == "random_matched")
    t = tests.collect()
    assert len(t) == 8 and all(r.n_null == 9 and 0.1 <= r.p <= 1 and r.p_holm >= r.p and r.greedy_ref >= r.observed for r in t)


def test_crawl_waits_resumes_and_gives_up(spark):
    waits, saved, calls = [], [], []

    def fetch(url):
        calls.append(url)
        if len(calls) == 1:
            raise ConnectionError("reset")
        return (503, {}, "") if len(calls) == 2 else (200, {"Link": '<p2>; rel="next"'} if url == "p1" else {}, json.dumps([{"id": url}]))

    assert [p[0]["id"] for p in tables.Pages(fetch, "p1", sleep=waits.append, save=saved.append)] == ["p1", "p2"]
    assert waits == [1, 2] and [s["url"] for s in saved] == ["p2", None] and saved[-1]["done"]
    assert [p[0]["id"] for p in tables.Pages(fetch, "p1", state=saved[0], sleep=waits.append)] == ["p2"]
    with pytest.raises(ValueError):
        list(tables.Pages(lambda u: (404, {}, ""), "p1", sleep=waits.append))
    spark.dataSource.register(tables.PageSource)
    rows = spark.read.format("pages").option("fetch", "tests.pages:fetch").option("url", "a").load().select("id", "downloads").collect()
    assert [(r.id, r.downloads) for r in rows] == [("x", 1), ("y", None), ("z", 3)]


def test_lines_of_several_files_keep_the_order_of_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"k","downloads":1}\n')
    (tmp_path / "b.json").write_text("".join(json.dumps({"id": "k", "downloads": n, "tags": ["x" * 500]}) + "\n" for n in range(2, 400)))
    raw = tables.jsonl(spark, str(tmp_path))
    assert ingest.keep_first(raw, ["id"], "__order").first().downloads == 1
    with pytest.raises(ValueError):
        tables.markdown(raw.select("id"), most=10)
    assert spark.range(1).select(names.thousands(F.lit(1234567)), names.percent(F.lit(0.1234))).first() == ("1,234,567", "12.3%")


def test_kept_tables_are_made_again_after_a_write(spark, tmp_path):
    from ancestra.plans import materialise

    path, made = str(tmp_path / "orders.parquet"), []
    make = lambda: made.append(1) or spark.range(len(made))
    for n, write in ((1, True), (1, False), (2, True)):
        if write:
            spark.range(n).write.mode("overwrite").parquet(path)
        assert materialise.once(spark, (str(tmp_path), "t"), make, ("orders",)).count() == n


def test_cycle_edges_in_a_long_row_of_cycles(spark, monkeypatch):
    """Cycles one behind another, opposite edges, a long cycle; before, all pairs of the core were made for that."""
    pairs = [(f"r{k:02d}{a}", f"r{k:02d}{b}", "merge") for k in range(12) for a, b in ("xy", "yz", "zx")]
    pairs += [(f"r{k:02d}y", f"r{k + 1:02d}x", "merge") for k in range(11)]
    pairs += [("m1", "m2", "mirror"), ("m2", "m1", "mirror"), ("m2", "m3", "merge"), ("m3", "m4", "merge"), ("m4", "m1", "merge"), ("m3", "m3", "merge"), ("m4", "r00x", "merge")]
    pairs += [(f"l{k:02d}", f"l{(k + 1) % 40:02d}", "merge") for k in range(40)] + [("l07", "t1", "merge"), ("t1", "t2", "merge"), ("t2", None, "merge")]
    monkeypatch.setattr(graph, "closure", None)
    got = {(r.p, r.ch): r.in_cycle for r in graph.cycle_edges(_edges(spark, pairs)).collect()}
    out = {(f"r{k:02d}y", f"r{k + 1:02d}x") for k in range(11)} | {("m3", "m3"), ("m4", "r00x"), ("l07", "t1"), ("t1", "t2"), ("t2", None)}
    assert len(got) == len(pairs) and {k for k, v in got.items() if not v} == out


def test_settle_forgets_estimates_that_joins_have_multiplied(spark):
    """The estimate of a table joined with itself twelve times would have thousands of bits."""
    rows = settle(spark.range(9).withColumn("v", F.col("id") % 3))
    for _ in range(12):
        rows = settle(rows.join(rows.select("id", F.col("v").alias("w")), "id").select("id", ((F.col("v") + F.col("w")) % 3).alias("v")))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 500
    assert sorted((r.id, r.v) for r in rows.collect()) == [(k, k % 3 * 2**12 % 3) for k in range(9)]


@pytest.mark.parametrize("digits", [15, 1])
def test_drawn_curve_is_the_curve_of_ranked(spark, monkeypatch, digits):
    """Also where order keys coincide (one digit), with shared leaves, more draws than a block has, loops and unknown nodes."""
    pairs = [(f"n{k // 2:02d}", f"n{k:02d}", "merge") for k in range(2, 60)] + [(f"n{k // 3:02d}", f"n{k:02d}", "merge") for k in range(9, 60, 4)]
    pairs += [("n05", "n05", "merge"), ("n40", "n02", "mirror"), ("n07", "gone", "merge"), ("lost", "n33", "merge")]
    n, e = _nodes(spark, [(f"n{k:02d}", "tg", "en", "mit", k) for k in range(60)], off={"n03", "n04", "n45", "n58"}), _edges(spark, pairs)
    closed = graph.closure(e)
    cand = scenarios.candidates(n, e, closed)
    parts = graph.parent_closure(e), *graph.counted_by_parents(e, n)
    told = {r.node: r.descendants for r in graph.descendant_counts(*parts).collect()}
    assert {r.node: r.descendants for r in cand.collect()}.items() <= told.items()
    monkeypatch.setattr(scenarios, "DIGITS", digits)
    monkeypatch.setattr(scenarios, "BLOCK", 2)
    want = {tuple(r) for r in scenarios.curve(scenarios.ranked(cand, "x", 3), closed, n).select("draw", "m", "removed").collect()}
    assert {tuple(r) for r in scenarios.drawn_curve(cand, e, n, *parts, "x", 3).select("draw", "m", "removed").collect()} == want


@pytest.mark.parametrize("name", ["null_matched_90", "null_matched_95", "null_matched_99", "null_nearest", "null_growing_prefix"])
def test_nulls_make_no_closure_of_all_nodes(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("closure of all nodes")

    monkeypatch.setattr(queries, "_closed", never)
    monkeypatch.setattr(queries, "_cand", never)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 20


@pytest.mark.parametrize("target", [0, 1, 57, 4949, 4950, 5000])
def test_growing_start_is_where_ranked_sizes_add_up(spark, monkeypatch, target):
    cand = spark.range(100).select(F.col("id").alias("node"), F.col("id").alias("size"))
    rows = scenarios.ranked(cand, "x", 3, "size").withColumn("sum", F.sum("size").over(scenarios.W.partitionBy("draw").orderBy("rank")))
    want = {tuple(r) for r in rows.groupBy("draw").agg((F.count_if(F.col("sum") < target) + 1).alias("m"), F.max("rank").alias("all")).collect()}
    monkeypatch.setattr(scenarios, "ranked", None)
    assert {tuple(r) for r in scenarios.growing_start(cand, target, "x", 3).collect()} == want
