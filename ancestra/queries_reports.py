"""Named queries of the tables that tell a run's result: tests, losses, agreement, cases, cleaning, audits; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.config import VariantConfig
from ancestra.functions.licenses import COMMERCIAL, commercial
from ancestra.operators import audit, cleaning, graph, inference, ingest, options, reports, scenarios, statistics
from ancestra.plans import fixtures, variant
from ancestra.plans.materialise import once, settle
from ancestra.queries import _HARD, _LEGAL, _LINES, _NE, _PAIRS, _STATS, _cand, _closed, _lines, _named, _ne, _removed, lineage, query

# ---- losses and graph views ----


@query(lineage("SELECT strategy, k, count(*) FILTER (is_provider) AS models_lost, count(*) AS models_lost_incl_flagged, 100.0 * sum(downloads) / greatest((SELECT sum(downloads) FROM nodes), 1) AS pct_downloads_lost FROM removed JOIN nodes USING (node) GROUP BY 1, 2", _LEGAL))
def loss_nodes_topk(spark, d):
    seeds, removed = _removed(spark, d, "legal")
    rows = options.node_losses(removed, fixtures.nodes(spark, d))
    return seeds.select("scenario_id", "strategy", "k").distinct().join(rows, "scenario_id").drop("scenario_id")


@query(lineage("SELECT c.node, count(*) AS availability_size FROM cand c JOIN reach1 r ON r.seed = c.node JOIN nodes n ON n.node = r.node AND n.is_provider GROUP BY 1", _HARD + ", one AS (SELECT node FROM cand WHERE node NOT IN (SELECT p FROM edges WHERE relation = 'mirror' AND ch <> p)), reach1 AS (SELECT node AS seed, node FROM cand UNION SELECT o.node, h.de FROM one o JOIN hclo h ON h.anc = o.node)"))
def single_availability_size(spark, d):
    n, e = _ne(spark, d)
    hard = once(spark, (d, "hard"), lambda: graph.closure(e.where("relation = 'adapter'")))
    return scenarios.availability_size(n, e, hard, _cand(spark, d))


_OVER = """, over_ AS (SELECT o_orderkey AS node, CASE o_orderkey % 3 WHEN 0 THEN 'copyleft' WHEN 1 THEN 'other' ELSE 'permissive' END AS cls FROM orders WHERE o_orderpriority LIKE '1%'),
n2 AS (SELECT n.* REPLACE (coalesce('override:' || o.cls, n.license) AS license) FROM nodes n LEFT JOIN over_ o ON o.node = n.node AND o.cls <> 'other'),
only_ AS (SELECT ch, min(p) AS p FROM edges WHERE relation IN ('quantized', 'mirror') GROUP BY 1 HAVING count(*) = 1),
up(node, a, hop) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT u.node, o.p, hop + 1 FROM up u JOIN only_ o ON o.ch = u.a WHERE hop < 10),
val AS (SELECT u.node, arg_min(n.license, hop) FILTER (n.license IS NOT NULL) AS license, arg_min(n.languages, hop) FILTER (n.languages IS NOT NULL) AS languages, arg_min(o.license, hop) FILTER (o.license IS NOT NULL) AS license_no_override
  FROM up u JOIN n2 n ON n.node = u.a JOIN nodes o ON o.node = u.a GROUP BY 1)"""


def _overridden(spark, d):
    n, e = _ne(spark, d)
    k = F.col("o_orderkey") % 3
    told = fixtures.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("node"), F.when(k == 0, "copyleft").when(k == 1, "other").otherwise("permissive").alias("cls"))
    return n, graph.enriched(n, e, told, ["license", "languages"])


@query(lineage("SELECT v.node, v.license, v.languages, v.license_no_override, n.license IS NULL AND v.license IS NOT NULL AS inherited_license, n.languages IS NULL AND v.languages IS NOT NULL AS inherited_languages FROM val v JOIN n2 n USING (node)", _OVER))
def license_overrides(spark, d):
    return _overridden(spark, d)[1]


@query(lineage("SELECT field, missing_before, missing_after, filled FROM (SELECT 'license' AS field, count(*) FILTER (n.license IS NULL) AS missing_before, count(*) FILTER (v.license IS NULL) AS missing_after, count(*) FILTER (m.license IS NULL AND v.license IS NOT NULL) AS filled FROM nodes n JOIN val v USING (node) JOIN n2 m USING (node) UNION ALL SELECT 'languages', count(*) FILTER (n.languages IS NULL), count(*) FILTER (v.languages IS NULL), count(*) FILTER (n.languages IS NULL AND v.languages IS NOT NULL) FROM nodes n JOIN val v USING (node))", _OVER))
def enrich_report(spark, d):
    n, after = _overridden(spark, d)
    return reports.filled(n, after, ["license", "languages"])


_NODES = _OVER + """, own AS (SELECT v.node, v.license, v.languages, n.task, n.is_provider FROM val v JOIN nodes n USING (node))"""


@query(lineage("SELECT node, task, languages, license, CASE WHEN license IS NULL THEN 'unknown' WHEN license LIKE 'override:%' THEN split_part(license, ':', 2) ELSE (SELECT cls FROM lic WHERE lic.license = own.license) END AS cls, is_provider AND node % 7 <> 0 AND node % 11 <> 0 AS is_provider FROM own", _NODES))
def variant_nodes(spark, d):
    n, e = _ne(spark, d)
    k = F.col("o_orderkey") % 3
    told = fixtures.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("node"), F.when(k == 0, "copyleft").when(k == 1, "other").otherwise("permissive").alias("cls"))
    flags = n.select("node", (F.col("node") % 7 == 0).alias("f_empty"), (F.col("node") % 11 == 0).alias("f_zero_downloads"), (F.col("node") % 5 == 0).alias("f_test"))
    nodes, _ = variant.prepared(n, e, VariantConfig(tier="T2", drop_rules=("f_test",)), flags, told)
    return nodes.select("node", "task", "languages", "license", "cls", "is_provider")


_VIEW = _STATS + """, kids AS (SELECT e.p, e.ch AS node, min(relation) AS relation, any_value(coalesce(s.descendants, 0)) AS descendants FROM edges e LEFT JOIN stats s ON s.node = e.ch GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY descendants DESC, node) AS rank FROM kids),
rest AS (SELECT r.p, count(DISTINCT r.node) AS n, count(DISTINCT coalesce(c.de, r.node)) AS descendants FROM ranked r LEFT JOIN clo c ON c.anc = r.node WHERE rank > 3 GROUP BY 1)"""


@query(lineage("SELECT p, rank::INT AS rank, node, relation, descendants FROM ranked WHERE rank <= 3 UNION ALL SELECT p, 4, NULL, n || ' others', descendants FROM rest", _VIEW))
def lineage_example(spark, d):
    n, e = _ne(spark, d)
    return graph.lineage_view(e, graph.descendant_stats(_closed(spark, d), n), _closed(spark, d), e.select("p"), 3)


_CASES = _PAIRS + """, named AS (SELECT *, 'name' || (node // 3) AS nm FROM nodes), gone AS (SELECT p, ch FROM edges WHERE p % 17 = 0), big AS (SELECT p, count(*) AS children FROM gone GROUP BY 1 HAVING count(*) >= 2),
kid AS (SELECT DISTINCT g.p, g.ch, n.created_at, n.downloads, n.is_provider FROM gone g JOIN big USING (p) JOIN nodes n ON n.node = g.ch),
told AS (SELECT p, count(*) FILTER (is_provider) AS provider_children, min(created_at) AS first_child, max(created_at) AS last_child, sum(downloads)::BIGINT AS children_downloads FROM kid GROUP BY 1),
copies AS (SELECT a.node AS p, b.node AS copy, b.downloads, b.created_at FROM named a JOIN big ON big.p = a.node JOIN named b ON b.nm = a.nm AND b.node <> a.node),
best AS (SELECT p, any_value(n) AS same_name_copies, arg_min(copy, rn) AS top_copy, arg_min(created_at, rn) AS top_copy_created FROM (SELECT *, count(*) OVER (PARTITION BY p) AS n, row_number() OVER (PARTITION BY p ORDER BY downloads DESC, copy) AS rn FROM copies) WHERE rn = 1 GROUP BY 1),
whole AS (SELECT task, lang, cls, count(DISTINCT node) AS providers FROM pairs GROUP BY 1, 2, 3),
own AS (SELECT k.p, pr.task, pr.lang, pr.cls, count(DISTINCT pr.node) AS own FROM kid k JOIN pairs pr ON pr.node = k.ch GROUP BY 1, 2, 3, 4),
opt AS (SELECT p, count(*) AS options_of_children, round_even(100.0 * avg((providers > own)::INT), 4) AS pct_options_elsewhere FROM own JOIN whole USING (task, lang, cls) GROUP BY 1)"""


@query(lineage("SELECT p, children, coalesce(provider_children, 0) AS provider_children, first_child, last_child, coalesce(children_downloads, 0) AS children_downloads, coalesce(same_name_copies, 0) AS same_name_copies, top_copy, top_copy_created, coalesce(cc, 0) AS copy_children, coalesce(options_of_children, 0) AS options_of_children, pct_options_elsewhere FROM big LEFT JOIN told USING (p) LEFT JOIN best USING (p) LEFT JOIN opt USING (p) LEFT JOIN (SELECT p AS top_copy, count(*) AS cc FROM edges WHERE p % 17 <> 0 GROUP BY 1) USING (top_copy)", _CASES))
def missing_parent_cases(spark, d):
    n, e = _ne(spark, d)
    n = n.withColumn("nm", F.concat(F.lit("name"), F.expr("node div 3")))
    return reports.missing_parents(e, n, options.pairs(n), F.col("p") % 17 == 0, least_children=2)


# ---- tests over a table of results ----

_RES = """WITH base AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'legal' ELSE 'availability' END AS semantics, (1 + l_linenumber % 3 * 4)::INT AS k, CASE WHEN l_suppkey % 2 = 0 THEN 'descendants' ELSE 'downloads' END AS s, l_quantity::DOUBLE AS v, (l_partkey % 90 + 10) AS removed, l_orderkey % 4 AS part FROM lineitem),
res AS (
  SELECT semantics, k, 'random_matched' AS strategy, s AS matched_to, removed AS removed_providers, removed AS models_lost, v AS pct_options_lost FROM base WHERE part <> 0
  UNION ALL SELECT semantics, k, 'random', NULL, removed, removed, v FROM base WHERE part = 0
  UNION ALL SELECT semantics, k, s, NULL, 50 + k, 50 + k, avg(v) + 20 + k / 2 FROM base GROUP BY semantics, k, s
  UNION ALL SELECT semantics, k, 'greedy', NULL, 60 + k, 60 + k, max(v) + 1 FROM base GROUP BY semantics, k),
obs AS (SELECT semantics, k, strategy, pct_options_lost AS observed, removed_providers, models_lost FROM res WHERE strategy IN ('descendants', 'downloads')),
nul AS (SELECT semantics, k, matched_to AS strategy, pct_options_lost AS value, removed_providers AS removed FROM res WHERE strategy = 'random_matched'),
h0 AS (SELECT semantics, k, strategy, any_value(observed) AS observed, any_value(removed_providers) AS removed_providers, avg(value) AS null_mean, quantile_cont(value, 0.95) AS null_p95, avg((value < observed)::INT) AS percentile_in_null,
  count(*) AS n_null, (1 + count(*) FILTER (value >= observed)) / (1 + count(*)) AS p, any_value(observed) / avg(value) AS ratio_vs_matched FROM nul JOIN obs USING (semantics, k, strategy) GROUP BY 1, 2, 3),
h1_ AS (SELECT h0.*, uniform_mean, observed / uniform_mean AS ratio_vs_uniform_ref, greedy_ref FROM h0 LEFT JOIN (SELECT semantics, k, avg(pct_options_lost) AS uniform_mean FROM res WHERE strategy = 'random' GROUP BY 1, 2) USING (semantics, k) LEFT JOIN (SELECT semantics, k, max(pct_options_lost) AS greedy_ref FROM res WHERE strategy = 'greedy' GROUP BY 1, 2) USING (semantics, k)),
h2_ AS (SELECT *, (count(*) OVER (PARTITION BY semantics) - row_number() OVER (PARTITION BY semantics ORDER BY p, k, strategy) + 1) * p AS x FROM h1_),
h2 AS (SELECT * EXCLUDE (x), least(1.0, max(x) OVER (PARTITION BY semantics ORDER BY p, k, strategy)) AS p_holm FROM h2_),
tests AS (SELECT *, p_holm <= 0.05 AS reject FROM h2)"""
_KEYS = ["semantics"]


def _results(spark, d) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    b = fixtures.table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "legal").otherwise("availability").alias("semantics"), (1 + F.col("l_linenumber") % 3 * 4).cast("int").alias("k"),
        F.when(F.col("l_suppkey") % 2 == 0, "descendants").otherwise("downloads").alias("s"), q.alias("v"), (F.col("l_partkey") % 90 + 10).alias("removed"), (F.col("l_orderkey") % 4).alias("part"),
    )
    row = lambda df, strategy, matched, removed, v: df.select("semantics", "k", strategy.alias("strategy"), matched.alias("matched_to"), removed.cast("long").alias("removed_providers"), removed.cast("long").alias("models_lost"), v.alias("pct_options_lost"))
    none = F.lit(None).cast("string")
    parts = [
        row(b.where("part <> 0"), F.lit("random_matched"), F.col("s"), F.col("removed"), F.col("v")),
        row(b.where("part = 0"), F.lit("random"), none, F.col("removed"), F.col("v")),
        row(b.groupBy("semantics", "k", "s").agg((F.avg("v") + 20 + F.col("k") / 2).alias("v")), F.col("s"), none, 50 + F.col("k"), F.col("v")),
        row(b.groupBy("semantics", "k").agg((F.max("v") + 1).alias("v")), F.lit("greedy"), none, 60 + F.col("k"), F.col("v")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(_RES + " SELECT * FROM tests")
def h2_table(spark, d):
    return statistics.h2(_results(spark, d), _KEYS)


_CELL = "CASE WHEN null_mean = 0 AND observed = 0 THEN '--' ELSE printf('%.2f', ratio_vs_matched) || ' (' || printf('%.0f', 100 * percentile_in_null) || ')' || CASE WHEN reject THEN '*' ELSE '' END END"
_WIDE = ", ".join(f"max(loss) FILTER (k = {k}) AS loss_{k}, max(ratio) FILTER (k = {k}) AS ratio_{k}" for k in (1, 5, 9))


@query(_RES + f", cells AS (SELECT semantics, strategy, k, round_even(observed, 6) AS loss, {_CELL} AS ratio FROM tests UNION ALL SELECT DISTINCT semantics, 'greedy', k, round_even(greedy_ref, 6), NULL FROM tests UNION ALL SELECT DISTINCT semantics, 'random', k, round_even(uniform_mean, 6), NULL FROM tests) SELECT semantics, strategy, {_WIDE} FROM cells GROUP BY 1, 2")
def rq2_table(spark, d):
    return reports.rq2_table(settle(statistics.h2(_results(spark, d), _KEYS)), _KEYS, [1, 5, 9])


_PLAN = _RES + """, lr AS (SELECT * FROM res WHERE semantics = 'legal'), lo AS (SELECT k, strategy, pct_options_lost AS observed, models_lost FROM lr WHERE strategy IN ('descendants', 'downloads')),
pt AS (SELECT CASE WHEN n.strategy = 'random' THEN 'H2a' ELSE 'H2b' END AS hyp, k, o.strategy, any_value(observed) AS observed, avg(n.pct_options_lost) AS null_mean, (1 + count(*) FILTER (n.pct_options_lost >= observed)) / (1 + count(*)) AS p,
  avg((observed > n.pct_options_lost)::INT) - avg((observed < n.pct_options_lost)::INT) AS cliffs_delta, avg(n.models_lost) / any_value(o.models_lost) AS null_per_target
  FROM lr n JOIN lo o USING (k) WHERE n.strategy = 'random' OR (n.strategy = 'random_matched' AND o.strategy = 'descendants') GROUP BY 1, 2, 3),
ps AS (SELECT *, (count(*) OVER (PARTITION BY hyp) - row_number() OVER (PARTITION BY hyp ORDER BY p, k, strategy) + 1) * p AS x FROM pt),
planned AS (SELECT * EXCLUDE (x), least(1.0, max(x) OVER (PARTITION BY hyp ORDER BY p, k, strategy)) AS p_holm, least(1.0, max(x) OVER (PARTITION BY hyp ORDER BY p, k, strategy)) <= 0.05 AS reject FROM ps)"""


def _planned(spark, d):
    return statistics.planned(_results(spark, d).where("semantics = 'legal' and strategy <> 'greedy'"))


@query(_PLAN + " SELECT * FROM planned")
def planned_table(spark, d):
    return _planned(spark, d)


@query(_PLAN + " SELECT hyp, count(*) FILTER (any_) AS k_significant, count(*) AS k_total, count(*) FILTER (any_) * 2 > count(*) AS supported FROM (SELECT hyp, k, bool_or(reject) AS any_ FROM planned GROUP BY 1, 2) GROUP BY 1")
def planned_verdicts(spark, d):
    return statistics.verdicts(_planned(spark, d), ["hyp"])


@query(_RES + " SELECT semantics, k, min(null_mean) AS null_mean_low, max(null_mean) AS null_mean_high, min(e) AS excess_low, max(e) AS excess_high, max(o) AS observed_minus_null FROM (SELECT semantics, k, strategy, avg(value) AS null_mean, CASE WHEN any_value(m) < 0 THEN 'inf'::DOUBLE ELSE max(value + 1) FILTER (rn = m + 1) END - avg(value) AS e, any_value(observed) - avg(value) AS o FROM (SELECT *, row_number() OVER (PARTITION BY semantics, k, strategy ORDER BY value DESC) AS rn, floor(0.05 / 20 * (count(*) OVER (PARTITION BY semantics, k, strategy) + 1) - 1) AS m FROM nul) JOIN obs USING (semantics, k, strategy) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def mde_table(spark, d):
    r = _results(spark, d)
    null = r.where("strategy = 'random_matched'").select("semantics", "k", F.col("matched_to").alias("strategy"), F.col("pct_options_lost").alias("value"))
    effects = statistics.detectable(null, ["semantics", "k", "strategy"])
    seen = r.select("semantics", "k", "strategy", F.col("pct_options_lost").alias("observed")).where("strategy in ('descendants', 'downloads')")
    return reports.detectable_ranges(effects.join(seen, ["semantics", "k", "strategy"]).withColumn("observed_minus_null", F.col("observed") - F.col("null_mean")), ["semantics", "k"])


def _null_and_target(spark, d):
    r = _results(spark, d)
    null = r.where("strategy = 'random_matched'").select("semantics", "k", F.col("matched_to").alias("strategy"), F.col("pct_options_lost").alias("value"), F.col("removed_providers").alias("removed"))
    return null, r.where("strategy in ('descendants', 'downloads')").select("semantics", "k", "strategy", F.col("pct_options_lost").alias("observed"), F.col("removed_providers").alias("target"))


@query(_RES + " SELECT semantics, round_even(quantile_cont(r, 0.5), 6) AS median, round_even(quantile_cont(r, 0.05), 6) AS p05, round_even(quantile_cont(r, 0.95), 6) AS p95, round_even(max(r), 6) AS largest FROM (SELECT semantics, removed / removed_providers AS r FROM nul JOIN obs USING (semantics, k, strategy)) GROUP BY 1")
def null_size_ratios(spark, d):
    null, target = _null_and_target(spark, d)
    return reports.size_ratios(null, target, ["semantics", "k", "strategy"], ["semantics"])


@query(_RES + " SELECT semantics, k, strategy, any_value(observed) AS observed, round_even(avg(value), 6) AS null_mean, round_even(any_value(observed) - avg(value), 6) AS difference, round_even(quantile_cont(value, 0.025), 6) AS p025, round_even(quantile_cont(value, 0.975), 6) AS p975, round_even(quantile_cont(removed / removed_providers, 0.5), 6) AS median_size_ratio FROM nul JOIN obs USING (semantics, k, strategy) GROUP BY 1, 2, 3")
def difference_table(spark, d):
    null, target = _null_and_target(spark, d)
    return reports.differences(null, target, ["semantics", "k", "strategy"])


@query(_RES + " SELECT semantics, strategy, k, CASE WHEN ratio_vs_matched <= 0 THEN 0.01 ELSE ratio_vs_matched END AS ratio FROM tests")
def ratio_curve(spark, d):
    return statistics.h2(_results(spark, d), _KEYS).select("semantics", "strategy", "k", reports.clamped(F.col("ratio_vs_matched"), 0.01, 1000.0).alias("ratio"))


@query(_RES + " SELECT semantics, strategy, k, 100.0 * removed_providers / 1000 AS pct_providers, observed, greatest(p05, 0.01) AS low, greatest(null_p95, 0.01) AS high FROM tests JOIN (SELECT semantics, k, strategy, quantile_cont(value, 0.05) AS p05 FROM nul GROUP BY 1, 2, 3) USING (semantics, k, strategy)")
def contrast_bands(spark, d):
    null, _ = _null_and_target(spark, d)
    low = null.groupBy("semantics", "k", "strategy").agg(F.percentile("value", F.lit(0.05)).alias("p05"))
    return reports.contrast(statistics.h2(_results(spark, d), _KEYS).join(low, ["semantics", "k", "strategy"]), _KEYS, 1000, 0.01)


@query(_RES + ", v AS (SELECT CASE WHEN k = 5 THEN 'main' ELSE 'k' || k END AS variant, 'H2_' || semantics AS hypothesis, count(*) FILTER (reject)::DOUBLE AS value, count(*) FILTER (reject) * 2 > count(*) AS supported FROM tests GROUP BY 1, 2) SELECT v.*, coalesce(v.supported <> b.supported, FALSE) AS flips FROM v LEFT JOIN (SELECT hypothesis, supported FROM v WHERE variant = 'main') b USING (hypothesis)")
def robustness_matrix(spark, d):
    t = statistics.h2(_results(spark, d), _KEYS).groupBy(F.when(F.col("k") == 5, "main").otherwise(F.concat(F.lit("k"), "k")).alias("variant"), F.concat(F.lit("H2_"), "semantics").alias("hypothesis"))
    return reports.robustness(t.agg(F.count_if("reject").cast("double").alias("value"), (F.count_if("reject") * 2 > F.count("*")).alias("supported")), "main")


@query("WITH c AS (SELECT c_mktsegment AS cls, count(*) AS n, avg(c_acctbal) / 100 AS v FROM customer GROUP BY 1) SELECT cls, list_position(['MACHINERY', 'HOUSEHOLD', 'BUILDING'], cls)::INT AS place, round_even(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct_models, round_even(v, 4) AS lost, round_even(v / (100.0 * n / (SELECT sum(n) FROM c)), 4) AS ratio FROM c WHERE cls IN ('MACHINERY', 'HOUSEHOLD', 'BUILDING')")
def rq3_table(spark, d):
    c = fixtures.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cls")).agg(F.count("*").alias("n"), (F.avg("c_acctbal") / 100).alias("v"))
    t = c.join(c.agg(F.sum("n").alias("t")), how="cross")  # one row
    share = 100.0 * F.col("n") / F.col("t")
    rows = t.select("cls", F.bround(share, 4).alias("pct_models"), F.bround("v", 4).alias("lost"), F.bround(F.col("v") / share, 4).alias("ratio"))
    return reports.in_order(rows, "cls", ["MACHINERY", "HOUSEHOLD", "BUILDING"])


@query("WITH c AS (SELECT c_mktsegment AS cls, 100.0 * count(*) / (SELECT count(*) FROM customer) AS s, avg(c_acctbal) / 250 AS v FROM customer GROUP BY 1) SELECT cls, v / s AS ratio, (SELECT bool_or(v / s > 1) FROM c) AS supported FROM c")
def h3_planned(spark, d):
    c = fixtures.table(spark, d, "customer")
    t = c.groupBy(F.col("c_mktsegment").alias("cls")).agg(F.count("*").alias("n"), (F.avg("c_acctbal") / 250).alias("pct_commercial_lost")).join(c.agg(F.count("*").alias("t")), how="cross")  # one row
    return statistics.h3_planned(t.withColumn("pct_models", 100.0 * F.col("n") / F.col("t")))


_BOOT = _LINES + """, c AS (SELECT task, lang, cls, count(DISTINCT root) AS c FROM wide GROUP BY 1, 2, 3), t AS (SELECT count(*) AS n, count(*) FILTER (c = 1) AS h FROM c),
s AS (SELECT r, count(*) FILTER (('0x' || substr(md5(r || ':' || d), 1, 12))::BIGINT % n < h) / any_value(n) AS share FROM (SELECT n, h, r, unnest(range(n)) AS d FROM t, (SELECT unnest(range(5000)) AS r)) GROUP BY r)"""


@query(lineage("SELECT h / n AS share, quantile_cont(share, 0.025) AS low, quantile_cont(share, 0.975) AS high FROM s, t GROUP BY h, n", _BOOT))
def bootstrap_share(spark, d):
    return statistics.bootstrap_share(_lines(spark, d, "full").withColumn("single", F.col("n_root_lineages") == 1), "single")


@query(lineage("SELECT h / n AS share, quantile_cont(share, 0.025) AS low, quantile_cont(share, 0.975) AS high, n AS n_options, quantile_cont(share, 0.025) > 0.5 AS supported FROM s, t GROUP BY h, n", _BOOT))
def h1_planned(spark, d):
    return statistics.h1_planned(_lines(spark, d, "full"))


def _three(spark, d) -> DataFrame:
    """Counts of each option by three definitions: all roots, roots that have children, roots grouped by family."""
    n, e = _ne(spark, d)
    r = graph.roots(e, n, _closed(spark, d))
    p = options.pairs(n, "strict")
    arch = F.when(F.col("root") % 3 == 0, F.concat(F.lit("fam"), F.col("root") % 7))
    known = r.join(e.select(F.col("p").alias("root")).distinct().withColumn("is_known", F.lit(True)), "root", "left")
    rows = p.join(known, "node").groupBy(*options.OPTION).agg(
        F.count_distinct("root").alias("n_root_lineages"), F.count_distinct(F.when(F.col("is_known"), F.col("root"))).alias("n_root_lineages_known"),
        F.count_distinct(F.coalesce(arch, F.col("root").cast("string"))).alias("n_root_lineages_arch"),
    )
    return rows


_THREE = _LINES + """, three AS (SELECT task, lang, cls, count(DISTINCT root) AS a, count(DISTINCT CASE WHEN root IN (SELECT p FROM edges) THEN root END) AS k, count(DISTINCT CASE WHEN root % 3 = 0 THEN 'fam' || (root % 7) ELSE root::VARCHAR END) AS f FROM pr GROUP BY 1, 2, 3)"""


@query(lineage("SELECT view, round_even(100.0 * avg((n = 1)::INT), 6) AS share, count(*) AS n_options FROM (SELECT 'main' AS view, a AS n FROM three UNION ALL SELECT 'known roots', k FROM three UNION ALL SELECT 'families', f FROM three UNION ALL SELECT 'known license', a FROM three WHERE cls <> 'unknown' UNION ALL SELECT 'commercial', a FROM three WHERE cls IN ('permissive', 'copyleft', 'responsible_ai', 'vendor_custom') UNION ALL SELECT 'tagged language', a FROM three WHERE lang <> 'unk') WHERE n > 0 GROUP BY 1", _THREE))
def rq1_sensitivity(spark, d):
    yes = F.lit(True)
    views = {
        "main": ("n_root_lineages", yes), "known roots": ("n_root_lineages_known", yes), "families": ("n_root_lineages_arch", yes), "known license": ("n_root_lineages", F.col("cls") != "unknown"),
        "commercial": ("n_root_lineages", commercial(F.col("cls"), False)), "tagged language": ("n_root_lineages", F.col("lang") != "unk"),
    }
    return reports.single_shares(_three(spark, d), views)


_SHARES = ", ".join(f"round_even(100.0 * avg((n {c})::INT), 4) AS {a}" for c, a in (("= 1", "one"), ("BETWEEN 2 AND 5", "two_to_five"), ("BETWEEN 6 AND 20", "six_to_twenty"), ("> 20", "over_twenty")))


@query(lineage(f"SELECT definition, {_SHARES}, count(*) AS options FROM (SELECT 'wildcard' AS definition, count(DISTINCT root) AS n FROM wide GROUP BY task, lang, cls UNION ALL SELECT 'strict', a FROM three UNION ALL SELECT 'known', k FROM three UNION ALL SELECT 'families', f FROM three) WHERE n > 0 GROUP BY 1", _THREE))
def rq1_buckets(spark, d):
    three = settle(_three(spark, d))
    one = lambda c: three.select(F.col(c).alias("n_root_lineages"))
    return reports.bucket_table({"wildcard": _lines(spark, d, "full").select("n_root_lineages"), "strict": one("n_root_lineages"), "known": one("n_root_lineages_known"), "families": one("n_root_lineages_arch")})


# ---- raters ----

_RATE = "WITH d AS (SELECT doc_id, source AS stratum, CASE WHEN doc_id % 23 = 0 THEN 9 ELSE quality END AS \"A\", CASE WHEN doc_id % 29 = 0 THEN 9 WHEN toxic = 1 THEN 1 - quality ELSE quality END AS \"B\" FROM labels JOIN documents USING (doc_id))"
_KAPPA = "(SELECT CASE WHEN rs / (n * n) < 1 THEN (s / n - rs / (n * n)) / (1 - rs / (n * n)) ELSE 1.0 END FROM (SELECT sum(c) AS n, sum(c) FILTER (a = b) AS s FROM {c}), (SELECT sum(r * s) AS rs FROM (SELECT a AS k, sum(c) AS r FROM {c} GROUP BY 1) JOIN (SELECT b AS k, sum(c) AS s FROM {c} GROUP BY 1) USING (k)))"


def _rated(spark, d):
    l = fixtures.table(spark, d, "labels")  # noqa: E741
    key = l.select("doc_id").join(fixtures.table(spark, d, "documents").select("doc_id", F.col("source").alias("stratum")), "doc_id")
    a = l.select("doc_id", F.when(F.col("doc_id") % 23 == 0, 9).otherwise(F.col("quality")).alias("label"))
    b = l.select("doc_id", F.when(F.col("doc_id") % 29 == 0, 9).when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"))
    return statistics.ratings(key, a, b, "doc_id")


@query(_RATE + ", c3 AS (SELECT \"A\" AS a, \"B\" AS b, count(*) AS c FROM d GROUP BY 1, 2), c2 AS (SELECT * FROM c3 WHERE a <> 9 AND b <> 9) SELECT (SELECT count(*) FROM d) AS n, (SELECT sum(c)::BIGINT FROM c2) AS n_both_decidable, (SELECT sum(c) FILTER (a = b) / sum(c) FROM c2) AS agreement, " + _KAPPA.format(c="c2") + " AS kappa_binary, " + _KAPPA.format(c="c3") + " AS kappa_3cat_all, (SELECT count(*) FROM d WHERE \"A\" <> \"B\") AS n_disagreements")
def rater_agreement(spark, d):
    return statistics.agreement(settle(_rated(spark, d)))


@query(_RATE + ", x AS (SELECT stratum, 'A' AS rater, \"A\" AS label FROM d UNION ALL SELECT stratum, 'B', \"B\" FROM d UNION ALL SELECT stratum, 'consensus', \"A\" FROM d WHERE \"A\" = \"B\"), s AS (SELECT stratum, rater, count(*) AS n, count(*) FILTER (label = CASE WHEN stratum = 'web' THEN 0 ELSE 1 END) AS hits FROM x WHERE label <> 9 GROUP BY 1, 2) SELECT stratum, rater, n, hits, hits / n AS precision, (hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS low, (hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS high FROM s")
def rater_precision(spark, d):
    return statistics.stratum_precision(_rated(spark, d), ("web",))


# ---- cleaning, inference, companies ----

_FLAGS = _NE + r", f AS (SELECT model_id, regexp_matches(nm, '(?:^|[-_.])(?:test|tmp|temp|dummy|debug|placeholder)(?:[-_.\d]|$)') AS f_test, pipeline_tag IS NULL AND library_name IS NULL AND license IS NULL AND model_id NOT IN (SELECT child_id FROM e) AS f_empty, downloads_all = 0 AS f_zero_downloads, authors >= 20 AND rn > 1 AND (SELECT count(*) FROM e WHERE parent_id = model_id) < 10 AS f_boilerplate FROM (SELECT *, lower(split_part(model_id, '/', 2)) AS nm, count(DISTINCT author) OVER (PARTITION BY lower(split_part(model_id, '/', 2))) AS authors, row_number() OVER (PARTITION BY lower(split_part(model_id, '/', 2)) ORDER BY created_at, model_id) AS rn FROM (SELECT DISTINCT ON (model_id) * FROM n ORDER BY model_id, k))), t AS (SELECT *, NOT (f_test OR f_empty OR f_boilerplate) AS t1, NOT (f_test OR f_empty OR f_boilerplate OR f_zero_downloads) AS t2 FROM f)"


def _flagged(spark, d):
    n, e = _named(spark, d)
    e = e.withColumns({"relation": F.lit("finetune"), "source": F.lit("declared")})
    return cleaning.flags(ingest.keep_first(n, ["model_id"], "k"), e, e, least_authors=20), e


@query(_FLAGS + " SELECT 'f_' || reason AS reason, sum(hit::INT)::BIGINT AS nodes, round_even(100.0 * avg(hit::INT), 4) AS share FROM (SELECT unnest(['test', 'empty', 'zero_downloads', 'boilerplate']) AS reason, unnest([f_test, f_empty, f_zero_downloads, f_boilerplate]) AS hit FROM t) GROUP BY 1")
def cleaning_reasons(spark, d):
    return reports.cleaning_reasons(_flagged(spark, d)[0], ["f_test", "f_empty", "f_zero_downloads", "f_boilerplate"])


@query(_FLAGS + " SELECT tier, count(*) FILTER (i) AS nodes, round_even(100.0 * avg(i::INT), 4) AS share, coalesce(sum(c) FILTER (i), 0)::BIGINT AS edges, count(*) FILTER (NOT i AND model_id IN (SELECT parent_id FROM e)) AS excluded_with_children FROM (SELECT model_id, unnest(['T0', 'T1', 'T2']) AS tier, unnest([TRUE, t1, t2]) AS i, (SELECT count(*) FROM e WHERE child_id = model_id) AS c FROM t) GROUP BY 1")
def tier_sizes(spark, d):
    return reports.tier_sizes(*_flagged(spark, d))


@query(_FLAGS + " SELECT model_id, CASE WHEN NOT t1 THEN 'T0' WHEN f_zero_downloads THEN 'T1' ELSE 'T2' END AS tier, t1 AS \"in_T1\", t2 AS \"in_T2\" FROM t")
def tiers(spark, d):
    return _flagged(spark, d)[0].select("model_id", "tier", "in_T1", "in_T2")


@query(_FLAGS + " SELECT parent_id, count(*) AS children, round_even(100.0 * count(*) FILTER (NOT t1) / count(*), 4) AS pct_excluded, count(*) - count(*) FILTER (NOT t1) AS \"children_T1\" FROM e JOIN t ON t.model_id = child_id GROUP BY 1 ORDER BY children DESC, parent_id LIMIT 10")
def top_parents(spark, d):
    return reports.top_parents(*_flagged(spark, d))


_INF = _NE + ", ea AS (SELECT e.*, CASE WHEN a.k % 7 = 0 THEN 'inferred_name' WHEN a.k % 5 = 0 THEN 'inferred_mirror' ELSE 'declared' END AS source, b.created_at >= a.created_at AS temporal_ok, a.k % 11 = 0 AS in_cycle, CASE WHEN b.k % 9 = 0 THEN 'renamed' END AS parent_resolution FROM e JOIN (SELECT DISTINCT ON (model_id) * FROM n ORDER BY model_id, k) a ON a.model_id = parent_id JOIN (SELECT DISTINCT ON (model_id) * FROM n ORDER BY model_id, k) b ON b.model_id = child_id)"


def _sourced(spark, d):
    n, e = _named(spark, d)
    n = ingest.keep_first(n, ["model_id"], "k")
    side = lambda c: n.select(F.col("model_id").alias(f"{c}_id"), F.col("k").alias(f"{c}_k"), F.col("created_at").alias(f"{c}_at"))
    rows = e.join(side("parent"), "parent_id").join(side("child"), "child_id")
    source = F.when(F.col("parent_k") % 7 == 0, "inferred_name").when(F.col("parent_k") % 5 == 0, "inferred_mirror").otherwise("declared")
    return rows.select("parent_id", "child_id", source.alias("source"), (F.col("child_at") >= F.col("parent_at")).alias("temporal_ok"), (F.col("parent_k") % 11 == 0).alias("in_cycle"), F.when(F.col("child_k") % 9 == 0, "renamed").alias("parent_resolution"))


@query(_INF + " SELECT source, count(*) AS edges, count(*) FILTER (NOT temporal_ok) AS violations, count(DISTINCT child_id) AS children, count(*) FILTER (in_cycle) AS in_cycles, count(*) FILTER (parent_resolution IS NOT NULL) AS reconnected FROM ea GROUP BY 1")
def inference_report(spark, d):
    return reports.inference_summary(_sourced(spark, d))


@query(_INF + " SELECT source, rn::INT AS rn, parent_id, child_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY parent_id, child_id) AS rn FROM ea WHERE source <> 'declared') WHERE rn <= 5")
def inference_examples(spark, d):
    return reports.inference_examples(_sourced(spark, d))


@query("WITH m AS (SELECT n_name AS member, r_name AS company FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')), c AS (SELECT coalesce(company, n_name) AS account, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN m ON member = n_name GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY n DESC, account) AS rank, account, n FROM c) SELECT rank::INT AS rank, account AS company, coalesce((SELECT string_agg(DISTINCT member, ', ' ORDER BY member) FROM m WHERE company = account), account) AS accounts, 100.0 * n / (SELECT sum(n) FROM c) AS share, 100.0 * sum(n) OVER (ORDER BY rank) / (SELECT sum(n) FROM c) AS union_share FROM r")
def company_table(spark, d):
    from pyspark.sql import Window as W

    t = lambda name: fixtures.table(spark, d, name)
    mapping = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name in ('ASIA', 'EUROPE')").select(F.col("n_name").alias("member"), F.col("r_name").alias("company"))
    c = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(mapping, F.col("member") == F.col("n_name"), "left").groupBy(F.coalesce("company", "n_name").alias("account")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    w = W.orderBy(F.desc("n"), "account")  # a row an account of a report
    rows = c.join(total, how="cross").select(F.row_number().over(w).alias("rank"), "account", (100.0 * F.col("n") / F.col("t")).alias("share"), (100.0 * F.sum("n").over(w) / F.col("t")).alias("union_share"))
    return reports.companies(rows, mapping)


@query("SELECT DISTINCT c_mktsegment AS license, CASE WHEN c_mktsegment = 'BUILDING' THEN 'permissive' WHEN c_mktsegment = 'MACHINERY' THEN 'noncommercial' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'vendor_custom' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'copyleft' ELSE 'other' END AS cls, c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'AUTOMOBILE') AS commercial FROM customer")
def license_map(spark, d):
    s = F.col("license")
    cls = F.when(s == "BUILDING", "permissive").when(s == "MACHINERY", "noncommercial").when(s == "HOUSEHOLD", "vendor_custom").when(s == "AUTOMOBILE", "copyleft").otherwise("other")
    return fixtures.table(spark, d, "customer").select(F.col("c_mktsegment").alias("license")).distinct().withColumn("cls", cls).withColumn("commercial", F.col("cls").isin(sorted(COMMERCIAL)))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'apache-2.0' WHEN page_id % 3 = 1 THEN NULL END AS license_name, page_id % 3 <> 2 AS answered FROM pages WHERE page_id % 4 <> 0")
def license_names(spark, d):
    k = F.col("page_id")
    pages = fixtures.table(spark, d, "pages").select("page_id")
    answers = pages.where(k % 3 != 2).select("page_id", F.when(k % 3 == 0, "apache-2.0").alias("license_name"))
    return inference.fetched_names(pages, pages.where(k % 4 == 0), answers, "page_id")


# ---- audits ----

_VARIANTS = "v AS (SELECT 'v' || n_nationkey AS variant, n_nationkey AS i FROM nation)"


def _variants(spark, d):
    return fixtures.table(spark, d, "nation").select(F.concat(F.lit("v"), "n_nationkey").alias("variant"), F.col("n_nationkey").alias("i"))


@query(f"WITH {_VARIANTS} SELECT variant, 'files' AS \"check\", f AS detail FROM v, (SELECT unnest(['results.csv', 'tests.csv', 'verdicts.json']) AS f) WHERE (i + length(f)) % 4 = 0")
def audit_files(spark, d):
    v = _variants(spark, d)
    wanted = ["results.csv", "tests.csv", "verdicts.json"]
    files = v.withColumn("file", F.explode(F.array(*map(F.lit, wanted)))).where((F.col("i") + F.length("file")) % 4 != 0)
    return audit.missing_files(files, v, wanted)


@query(f"WITH {_VARIANTS} SELECT variant, 'config' AS \"check\", s || ' ' || CASE WHEN i % 5 = 0 THEN '-' ELSE 'x' || i % 3 END || ' x1' AS detail FROM v, (SELECT unnest(['tier', 'option']) AS s) WHERE i % 5 = 0 OR i % 3 <> 1")
def audit_config(spark, d):
    v = _variants(spark, d).withColumn("setting", F.explode(F.array(F.lit("tier"), F.lit("option"))))
    return audit.settings(v.where("i % 5 <> 0").withColumn("value", F.concat(F.lit("x"), F.col("i") % 3)), v.withColumn("value", F.lit("x1")))


_AT = "tt AS (SELECT 'v' || (l_suppkey % 10) AS variant, CASE WHEN l_linestatus = 'F' THEN 'legal' ELSE 'availability' END AS semantics, l_linenumber AS k, l_partkey % 4 AS s, (l_orderkey % 20) / 20 AS p, (l_orderkey % 20) / 20 + CASE WHEN l_suppkey % 97 = 3 THEN -0.5 ELSE 0.1 END AS p_holm, l_orderkey % 50 = 0 AS reject, CASE WHEN l_partkey % 301 = 7 THEN 9 ELSE 10 END AS n_null FROM lineitem), vv AS (SELECT 'v' || n_nationkey AS variant, s AS semantics, n_nationkey % 8 AS k_significant FROM nation, (SELECT unnest(['legal', 'availability']) AS s))"


@query(f"WITH {_AT} SELECT variant, 'tests' AS \"check\", semantics || ' ' || count(*) AS detail FROM tt GROUP BY variant, semantics HAVING count(*) <> 20 UNION ALL SELECT variant, 'holm', semantics || ' ' || k FROM tt WHERE p_holm + 1e-12 < p UNION ALL SELECT variant, 'draws', semantics || ' ' || k || ' ' || n_null FROM tt WHERE n_null <> 10 UNION ALL SELECT variant, 'verdict', semantics || ' ' || got || ' ' || k_significant FROM (SELECT variant, semantics, count(*) FILTER (a) AS got FROM (SELECT variant, semantics, k, bool_or(reject) AS a FROM tt GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN vv USING (variant, semantics) WHERE got <> k_significant")
def audit_tests(spark, d):
    o = F.col("l_orderkey") % 20 / 20
    t = fixtures.table(spark, d, "lineitem").select(
        F.concat(F.lit("v"), F.col("l_suppkey") % 10).alias("variant"), F.when(F.col("l_linestatus") == "F", "legal").otherwise("availability").alias("semantics"), F.col("l_linenumber").alias("k"), o.alias("p"),
        (o + F.when(F.col("l_suppkey") % 97 == 3, -0.5).otherwise(0.1)).alias("p_holm"), (F.col("l_orderkey") % 50 == 0).alias("reject"), F.when(F.col("l_partkey") % 301 == 7, 9).otherwise(10).alias("n_null"),
    )
    verdict = _variants(spark, d).select("variant", F.explode(F.array(F.lit("legal"), F.lit("availability"))).alias("semantics"), (F.col("i") % 8).alias("k_significant"))
    return audit.test_table(t, verdict, 20, 10)


_AO = "oc AS (SELECT 'v' || (p_partkey % 5) AS variant, p_name AS option, p_size % 4 AS n, p_size % 5 AS known, p_size % 3 AS arch FROM part)"


@query(f"WITH {_AO} SELECT variant, 'options' AS \"check\", count(*) FILTER (n > 0) || ' 100' AS detail FROM oc GROUP BY 1 HAVING count(*) FILTER (n > 0) <> 100 UNION ALL SELECT variant, 'option', option FROM oc GROUP BY variant, option HAVING count(*) > 1 UNION ALL SELECT variant, 'n_root_lineages_known', option FROM oc WHERE known > n UNION ALL SELECT variant, 'n_root_lineages_arch', option FROM oc WHERE arch > n")
def audit_options(spark, d):
    s = F.col("p_size")
    c = fixtures.table(spark, d, "part").select(F.concat(F.lit("v"), F.col("p_partkey") % 5).alias("variant"), F.col("p_name").alias("option"), (s % 4).alias("n_root_lineages"), (s % 5).alias("n_root_lineages_known"), (s % 3).alias("n_root_lineages_arch"))
    return audit.option_counts(c, c.select("variant").distinct().withColumn("options_total", F.lit(100)))


@query("WITH l AS (SELECT 'v' || (event_id % 50) AS variant, event_id AS n, CASE user_id % 5 WHEN 0 THEN 'start removal' WHEN 1 THEN 'exit 0' WHEN 2 THEN 'exit ' || (user_id % 3 - 1) ELSE 'note' END AS line FROM events), f AS (SELECT variant, max(n) AS a FROM l WHERE contains(line, 'removal') GROUP BY 1), g AS (SELECT variant, string_agg(regexp_extract(line, 'exit (-?\\d+)', 1), ',' ORDER BY n) AS x FROM l LEFT JOIN f USING (variant) WHERE n >= coalesce(a, 0) AND starts_with(line, 'exit') GROUP BY 1) SELECT variant, 'exits' AS \"check\", coalesce(x, '') AS detail FROM (SELECT DISTINCT variant FROM l) LEFT JOIN g USING (variant) WHERE coalesce(x, '') <> '0,0,0'")
def audit_logs(spark, d):
    u = F.col("user_id")
    line = F.when(u % 5 == 0, "start removal").when(u % 5 == 1, "exit 0").when(u % 5 == 2, F.concat(F.lit("exit "), u % 3 - 1)).otherwise("note")
    return audit.log_exits(fixtures.table(spark, d, "events").select(F.concat(F.lit("v"), F.col("event_id") % 50).alias("variant"), F.col("event_id").alias("n"), line.alias("line")))


@query("WITH s AS (SELECT 'v' || n_regionkey AS variant, count(*) AS providers, sum(n_nationkey) AS edges FROM nation GROUP BY 1), b AS (SELECT * FROM s WHERE variant = 'v0') SELECT s.variant, 'direction:' || c AS \"check\", g || ' ' || o || ' ' || w AS detail FROM (SELECT s.variant, 'edges' AS c, s.edges AS g, CASE s.variant WHEN 'v1' THEN '<' WHEN 'v2' THEN '>' ELSE '=' END AS o, b.edges AS w FROM s, b WHERE s.variant IN ('v1', 'v2', 'v3')) s WHERE NOT CASE o WHEN '<' THEN g < w WHEN '>' THEN g > w ELSE g = w END")
def audit_direction(spark, d):
    s = fixtures.table(spark, d, "nation").groupBy(F.concat(F.lit("v"), "n_regionkey").alias("variant")).agg(F.count("*").alias("providers"), F.sum("n_nationkey").alias("edges"))
    return audit.variant_direction(s, "v0", {"v1": ("edges", "<"), "v2": ("edges", ">"), "v3": ("edges", "=")})


@query("WITH r AS (SELECT l_suppkey, l_linenumber AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT 'monotone:q' AS \"check\", l_suppkey || ' ' || k AS detail FROM (SELECT *, q - lag(q) OVER (PARTITION BY l_suppkey ORDER BY k) AS step FROM r) WHERE step < 0")
def audit_monotone(spark, d):
    r = fixtures.table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").alias("q"))
    return audit.violations(r, ["l_suppkey", "k"], [], monotone="q")


@query("SELECT 'rows' AS \"check\", f || ' ' || n AS detail FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1) WHERE n <> 15000")
def audit_rows(spark, d):
    r = fixtures.table(spark, d, "lineitem").withColumn("strategy", F.col("l_returnflag")).select("strategy", F.monotonically_increasing_id().alias("id"))
    return audit.violations(r, ["id"], [], expected={"A": 15000, "N": 15000})


@query("SELECT 'size' AS \"check\", l_orderkey || ' ' || l_linenumber || ' ' || l_partkey || ' ' || 1500 AS detail FROM lineitem WHERE l_partkey < 0.95 * 1500")
def audit_null_size(spark, d):
    r = fixtures.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("removed"))
    return audit.matched_sizes(r, r.select("l_orderkey", "l_linenumber").distinct().withColumn("target", F.lit(1500)), ["l_orderkey", "l_linenumber"])
