"""A named query per operator family over the driver tables, and the SQL that tells its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.config import VariantConfig
from ancestra.functions import names
from ancestra.functions.licenses import commercial, license_class
from ancestra.operators import audit, cleaning, graph, inference, ingest, options, reports, scenarios, statistics
from ancestra.plans import fixtures, variant
from ancestra.plans.materialise import once, settle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lineage(text: str, recursive: str = "") -> str:
    return f"WITH RECURSIVE {fixtures.SQL}{recursive}\n{text}"


_CLOSE = """, clo(anc, de) AS (SELECT p, p FROM edges UNION SELECT c.anc, e.ch FROM clo c JOIN edges e ON c.de = e.p)"""
_STATS = _CLOSE + """, stats AS (SELECT anc AS node, count(*) AS descendants, count(DISTINCT CASE WHEN n.author <> o.author THEN n.author END) AS descendant_authors
  FROM clo JOIN nodes n ON n.node = de JOIN nodes o ON o.node = anc WHERE anc <> de AND n.is_provider GROUP BY 1),
cand AS (SELECT n.node, n.downloads, coalesce(s.descendants, 0) AS descendants, coalesce(s.descendant_authors, 0) AS descendant_authors, o.outdegree, coalesce(s.descendants, 0) + 1 AS closure_size
  FROM nodes n JOIN (SELECT p, count(*) AS outdegree FROM edges GROUP BY 1) o ON o.p = n.node LEFT JOIN stats s ON s.node = n.node WHERE n.is_provider)"""
_PAIRS = """, pairs AS (SELECT node, coalesce(task, 'unk') AS task, unnest(string_split(coalesce(languages, 'unk'), ',')) AS lang, cls, downloads FROM nodes WHERE is_provider)"""
_ROOTS = _CLOSE + """, tops AS (SELECT node FROM nodes WHERE node NOT IN (SELECT ch FROM edges)), roots AS (SELECT node, node AS root FROM tops UNION ALL SELECT de, anc FROM clo JOIN tops ON anc = node WHERE anc <> de)"""
KS = [1, 10, 100]


def _ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.nodes(spark, d), fixtures.edges(spark, d)


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, (d, "closure"), lambda: graph.closure(fixtures.edges(spark, d)))


def _cand(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, (d, "candidates"), lambda: scenarios.candidates(*_ne(spark, d), _closed(spark, d)))


# ---- graph ----


@query(lineage("SELECT p, ch, relation FROM edges JOIN nodes a ON a.node = p JOIN nodes b ON b.node = ch WHERE coalesce(CASE WHEN a.created_at::DATE <> DATE '1995-06-17' AND b.created_at::DATE <> DATE '1995-06-17' THEN a.created_at <= b.created_at END, TRUE)"))
def edge_filter(spark, d):
    n, e = _ne(spark, d)
    at = lambda c: n.select(F.col("node").alias(c), F.when(F.to_date("created_at") != F.lit("1995-06-17").cast("date"), F.col("created_at")).alias(f"{c}_at"))
    rows = e.join(at("p"), "p").join(at("ch"), "ch").select("p", "ch", "relation", (F.col("p_at") <= F.col("ch_at")).alias("temporal_ok"), F.lit(True).alias("parent_in_snapshot"), F.lit(False).alias("in_cycle"))
    return graph.analysis_edges(rows).select("p", "ch", "relation")


@query("SELECT l_suppkey AS p, l_partkey AS ch, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def self_loop_removed(spark, d):
    e = fixtures.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("p"), F.col("l_partkey").alias("ch"))
    return graph.without_self_loops(e).groupBy("p", "ch").agg(F.count("*").alias("n"))


@query(lineage("SELECT node, sum(o)::BIGINT AS n_children, sum(i)::BIGINT AS n_parents FROM (SELECT p AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT ch, 0, 1 FROM edges) GROUP BY 1"))
def degree_in_out(spark, d):
    return graph.degrees(fixtures.edges(spark, d))


@query(lineage("SELECT anc, de FROM clo", _CLOSE))
def closure_pairs(spark, d):
    return _closed(spark, d)


@query(lineage("SELECT node, descendants, descendant_authors FROM stats", _STATS))
def descendant_stats(spark, d):
    return graph.descendant_stats(_closed(spark, d), fixtures.nodes(spark, d))


@query(lineage("SELECT * FROM cand", _STATS))
def single_closure_size(spark, d):
    return _cand(spark, d)


_TARGETS = _STATS + """, ks AS (SELECT unnest([1, 10, 100]) AS k), ranked AS (
  SELECT 'descendants' AS strategy, node, row_number() OVER (ORDER BY descendants DESC, node) AS rn FROM cand UNION ALL
  SELECT 'descendant_authors', node, row_number() OVER (ORDER BY descendant_authors DESC, node) FROM cand UNION ALL
  SELECT 'downloads', node, row_number() OVER (ORDER BY downloads DESC, node) FROM cand UNION ALL
  SELECT 'outdegree', node, row_number() OVER (ORDER BY outdegree DESC, node) FROM cand),
targets AS (SELECT strategy, k, node FROM ranked, ks WHERE rn <= k)"""


@query(lineage("SELECT strategy, k, node FROM targets", _TARGETS))
def candidate_rankings(spark, d):
    return scenarios.targeted(_cand(spark, d), KS).select("strategy", "k", "node")


_LEGAL = _TARGETS + """, removed AS (SELECT DISTINCT strategy, k, de AS node FROM targets JOIN clo ON anc = node)"""
_HARD = _TARGETS + """, hclo(anc, de) AS (SELECT p, p FROM edges WHERE relation = 'adapter' UNION SELECT c.anc, e.ch FROM hclo c JOIN edges e ON c.de = e.p AND e.relation = 'adapter'),
saved AS (SELECT DISTINCT t.strategy, t.k, t.node FROM targets t JOIN edges e ON e.p = t.node AND e.relation = 'mirror' WHERE NOT EXISTS (SELECT 1 FROM targets u WHERE u.strategy = t.strategy AND u.k = t.k AND u.node = e.ch)),
removed AS (SELECT strategy, k, node FROM targets UNION SELECT t.strategy, t.k, h.de FROM (SELECT * FROM targets EXCEPT SELECT * FROM saved) t JOIN hclo h ON h.anc = t.node)"""


def _removed(spark, d, semantics):
    seeds = scenarios.targeted(_cand(spark, d), KS)
    if semantics == "legal":
        return seeds, graph.removed_legal(_closed(spark, d), seeds)
    e = fixtures.edges(spark, d)
    hard = once(spark, (d, "hard"), lambda: graph.closure(e.where("relation = 'adapter'")))
    return seeds, graph.removed_availability(e, hard, seeds)


@query(lineage("SELECT strategy, k, count(*) AS removed, count(*) FILTER (is_provider) AS removed_providers FROM removed JOIN nodes USING (node) GROUP BY 1, 2", _LEGAL))
def closure_legal_topk(spark, d):
    return _sizes(spark, d, "legal")


@query(lineage("SELECT strategy, k, count(*) AS removed, count(*) FILTER (is_provider) AS removed_providers FROM removed JOIN nodes USING (node) GROUP BY 1, 2", _HARD))
def closure_availability_topk(spark, d):
    return _sizes(spark, d, "availability")


def _sizes(spark, d, semantics):
    seeds, removed = _removed(spark, d, semantics)
    rows = removed.join(fixtures.nodes(spark, d).select("node", "is_provider"), "node").groupBy("scenario_id").agg(F.count("*").alias("removed"), F.count_if("is_provider").alias("removed_providers"))
    return seeds.select("scenario_id", "strategy", "k").distinct().join(rows, "scenario_id").drop("scenario_id")


@query(lineage("SELECT scenario_id, node FROM r", """, r(scenario_id, node) AS (SELECT o_custkey % 40, o_orderkey FROM orders UNION SELECT r.scenario_id, e.ch FROM r JOIN edges e ON e.p = r.node)"""))
def reach_from_seeds(spark, d):
    seeds = fixtures.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("scenario_id"), F.col("o_orderkey").alias("node"))
    return graph.reach(fixtures.edges(spark, d), seeds)


@query(lineage("SELECT node, root FROM roots", _ROOTS))
def roots_per_node(spark, d):
    n, e = _ne(spark, d)
    return graph.roots(e, n, _closed(spark, d))


_CYCLE = """, e AS (SELECT DISTINCT p, ch FROM edges UNION SELECT ch, p FROM edges WHERE relation = 'mirror'), loop(anc, de) AS (SELECT p, ch FROM e UNION SELECT c.anc, e.ch FROM loop c JOIN e ON c.de = e.p)"""


@query(lineage("SELECT e.p, e.ch, e.p <> e.ch AND l.anc IS NOT NULL AS in_cycle FROM e LEFT JOIN loop l ON l.anc = e.ch AND l.de = e.p", _CYCLE))
def cycle_edges(spark, d):
    e = fixtures.edges(spark, d)
    back = e.where("relation = 'mirror'").select(F.col("ch").alias("p"), F.col("p").alias("ch"))
    return graph.cycle_edges(e.select("p", "ch").unionByName(back).distinct())


_INHERIT = """, only_ AS (SELECT ch, min(p) AS p FROM edges WHERE relation IN ('quantized', 'mirror') GROUP BY 1 HAVING count(*) = 1),
up(node, a, hop) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT u.node, o.p, hop + 1 FROM up u JOIN only_ o ON o.ch = u.a WHERE hop < 10),
val AS (SELECT u.node, arg_min(n.license, hop) FILTER (n.license IS NOT NULL) AS license, arg_min(n.languages, hop) FILTER (n.languages IS NOT NULL) AS languages FROM up u JOIN nodes n ON n.node = u.a GROUP BY 1)"""


@query(lineage("SELECT v.node, v.license, v.languages, n.license IS NULL AND v.license IS NOT NULL AS inherited_license, n.languages IS NULL AND v.languages IS NOT NULL AS inherited_languages FROM val v JOIN nodes n USING (node)", _INHERIT))
def inherit_attributes(spark, d):
    n, e = _ne(spark, d)
    return graph.inherit(n, e, ["license", "languages"])


# ---- options ----


@query(lineage("SELECT task, lang, cls, count(*) AS providers, sum(downloads)::BIGINT AS downloads, max(downloads) AS best FROM pairs GROUP BY 1, 2, 3", _PAIRS))
def option_pairs(spark, d):
    return options.providers(options.pairs(fixtures.nodes(spark, d)))


_REMAIN = """, total AS (SELECT task, lang, cls, count(*) AS providers, sum(downloads) AS downloads, max(downloads) AS best FROM pairs GROUP BY 1, 2, 3),
sc AS (SELECT DISTINCT strategy, k FROM targets),
alive AS (SELECT s.strategy, s.k, t.*, (SELECT 1) AS one FROM sc s, total t),
gone AS (SELECT strategy, k, task, lang, cls, count(*) AS gone FROM removed JOIN pairs USING (node) GROUP BY ALL),
opt AS (SELECT a.*, a.providers - coalesce(g.gone, 0) AS remaining FROM alive a LEFT JOIN gone g USING (strategy, k, task, lang, cls))"""
_LOST = _REMAIN + """, lossrow AS (SELECT *, CASE WHEN lang = 'unk' THEN sum(remaining) OVER w = 0 ELSE remaining = 0 AND coalesce(sum(remaining) FILTER (lang = 'unk') OVER w, 0) = 0 END AS lost, remaining = 0 AS lost_strict FROM opt WINDOW w AS (PARTITION BY strategy, k, task, cls))"""
_LOSSES = "SELECT strategy, k, count(*) AS options_total, count(*) FILTER ({l}) AS options_lost, 100.0 * count(*) FILTER ({l}) / count(*) AS pct_options_lost, 100.0 * sum(CASE WHEN {l} THEN downloads ELSE 0 END) / greatest(sum(downloads), 1) AS pct_demand_lost, 100.0 * count(*) FILTER ({l} AND {c}) / greatest(count(*) FILTER ({c}), 1) AS pct_commercial_lost FROM lossrow GROUP BY 1, 2"
_COM = "cls IN ('permissive', 'copyleft', 'responsible_ai', 'vendor_custom')"


def _losses(spark, d, semantics, definition):
    seeds, removed = _removed(spark, d, semantics)
    seeds, removed = settle(seeds), settle(removed)
    p = options.pairs(fixtures.nodes(spark, d), definition)
    return seeds.select("scenario_id", "strategy", "k").distinct().join(options.touched_loss(p, removed, seeds, definition), "scenario_id").drop("scenario_id")


@query(lineage(_LOSSES.format(l="lost", c=_COM), _LEGAL + _PAIRS + _LOST))
def loss_full_topk(spark, d):
    return _losses(spark, d, "legal", "full")


@query(lineage(_LOSSES.format(l="lost_strict", c=_COM), _LEGAL + _PAIRS + _LOST))
def loss_strict_topk(spark, d):
    return _losses(spark, d, "legal", "strict")


@query(lineage(_LOSSES.format(l="lost_strict", c=_COM), _LEGAL + _PAIRS.replace("unnest(string_split(coalesce(languages, 'unk'), ',')) AS lang", "unnest(list_transform(string_split(coalesce(languages, 'unk'), ','), lambda x: '*')) AS lang") + _LOST))
def loss_coarse_topk(spark, d):
    return _losses(spark, d, "legal", "coarse")


@query(lineage(_LOSSES.format(l="lost", c=_COM), _HARD + _PAIRS + _LOST))
def loss_availability_topk(spark, d):
    return _losses(spark, d, "availability", "full")


_DEGRADE = _REMAIN + """, leftbest AS (SELECT a.strategy, a.k, p.task, p.lang, p.cls, max(p.downloads) AS best_left FROM sc a CROSS JOIN pairs p LEFT JOIN removed r ON r.strategy = a.strategy AND r.k = a.k AND r.node = p.node WHERE r.node IS NULL GROUP BY ALL),
deg0 AS (SELECT o.*, coalesce(best_left, 0) AS best_after FROM opt o LEFT JOIN leftbest USING (strategy, k, task, lang, cls)),
deg AS (SELECT *, CASE WHEN lang = 'unk' THEN max(best) OVER w ELSE greatest(best, coalesce(max(best) FILTER (lang = 'unk') OVER w, best)) END AS bw, CASE WHEN lang = 'unk' THEN max(best_after) OVER w ELSE greatest(best_after, coalesce(max(best_after) FILTER (lang = 'unk') OVER w, best_after)) END AS aw FROM deg0 WINDOW w AS (PARTITION BY strategy, k, task, cls))"""


@query(lineage("SELECT strategy, k, round_even(100.0 * avg((aw / bw < 0.1)::INT), 6) AS pct_options_degraded90, round_even(100.0 * sum(downloads * (1 - aw / bw)) / greatest(sum(downloads), 1), 6) AS pct_demand_degraded FROM deg WHERE bw > 0 GROUP BY 1, 2", _LEGAL + _PAIRS + _DEGRADE))
def degradation_topk(spark, d):
    seeds, removed = (settle(x) for x in _removed(spark, d, "legal"))
    o = options.survivors(options.pairs(fixtures.nodes(spark, d)), removed, seeds)
    return seeds.select("scenario_id", "strategy", "k").distinct().join(options.degradation(o), "scenario_id").drop("scenario_id")


CLASSES = ["permissive", "copyleft", "vendor_custom", "noncommercial", "unknown"]
_LICENSE = _CLOSE + _PAIRS + f""", targets AS (SELECT cls AS strategy, 0 AS k, node FROM nodes WHERE is_provider), removed AS (SELECT strategy, k, node FROM targets UNION SELECT strategy, k, de FROM targets JOIN clo ON anc = node) {_LOST}"""


@query(lineage(f"SELECT strategy AS cls, count(*) AS options_total, count(*) FILTER (lost) AS options_lost, count(*) FILTER (lost AND cls <> strategy) AS collateral_options_lost, 100.0 * count(*) FILTER (lost AND cls <> strategy AND {_COM}) / greatest(count(*) FILTER (cls <> strategy AND {_COM}), 1) AS pct_collateral_commercial_lost FROM lossrow GROUP BY 1", _LICENSE))
def loss_license_scenarios(spark, d):
    rows = _license_losses(spark, d)
    return rows.select("cls", "options_total", "options_lost", "collateral_options_lost", "pct_collateral_commercial_lost")


def _license_losses(spark, d):
    n = fixtures.nodes(spark, d)
    removed = settle(scenarios.license_removals(n, _closed(spark, d), CLASSES))
    which = removed.select("scenario_id", "removed_class").distinct()
    o = options.survivors(options.pairs(n), removed.select("scenario_id", "node"), which).join(which, "scenario_id")
    return options.loss(o, removed_class=True).withColumn("cls", F.substring("scenario_id", 9, 99))


@query(lineage(f"SELECT cls, 100.0 * m.n / t.n AS pct_models, v AS pct_collateral_commercial_lost, v / (100.0 * m.n / t.n) AS ratio, (SELECT count(*) FROM (SELECT strategy AS c2, 100.0 * count(*) FILTER (lost AND cls <> strategy AND {_COM}) / greatest(count(*) FILTER (cls <> strategy AND {_COM}), 1) AS v2 FROM lossrow GROUP BY 1) JOIN (SELECT cls AS c2, count(*) AS n2 FROM nodes WHERE is_provider GROUP BY 1) USING (c2), (SELECT count(*) AS t2 FROM nodes WHERE is_provider) WHERE c2 IN ('noncommercial', 'vendor_custom') AND v2 / (100.0 * n2 / t2) > 1) = 2 AS supported FROM (SELECT strategy AS cls, 100.0 * count(*) FILTER (lost AND cls <> strategy AND {_COM}) / greatest(count(*) FILTER (cls <> strategy AND {_COM}), 1) AS v FROM lossrow GROUP BY 1) JOIN (SELECT cls, count(*) AS n FROM nodes WHERE is_provider GROUP BY 1) m USING (cls), (SELECT count(*) AS n FROM nodes WHERE is_provider) t", _LICENSE))
def h3_table(spark, d):
    n = fixtures.nodes(spark, d).where("is_provider")
    share = n.groupBy("cls").agg(F.count("*").alias("n")).join(n.agg(F.count("*").alias("t")), how="cross").select("cls", (100.0 * F.col("n") / F.col("t")).alias("pct_models"))
    return statistics.h3(_license_losses(spark, d).select("cls", "pct_collateral_commercial_lost").join(share, "cls"), ["noncommercial", "vendor_custom"])


_LINES = _ROOTS + _PAIRS + """, pr AS (SELECT DISTINCT task, lang, cls, root FROM pairs JOIN roots USING (node)), op AS (SELECT DISTINCT task, lang, cls FROM pr),
wide AS (SELECT * FROM pr UNION SELECT o.task, o.lang, o.cls, u.root FROM op o JOIN pr u ON u.lang = 'unk' AND u.task = o.task AND u.cls = o.cls WHERE o.lang <> 'unk'
UNION SELECT o.task, o.lang, o.cls, u.root FROM op o JOIN pr u ON u.task = o.task AND u.cls = o.cls WHERE o.lang = 'unk')"""


def _lines(spark, d, definition, known=False):
    n, e = _ne(spark, d)
    r = graph.roots(e, n, _closed(spark, d))
    if known:
        r = r.join(e.select(F.col("p").alias("root")).distinct(), "root", "left_semi")
    return options.lineage_counts(options.pairs(n, definition), r, definition)


@query(lineage("SELECT task, lang, cls, count(DISTINCT root) AS n_root_lineages FROM wide GROUP BY 1, 2, 3", _LINES))
def lineage_counts_full(spark, d):
    return _lines(spark, d, "full")


@query(lineage("SELECT task, lang, cls, count(DISTINCT root) AS n_root_lineages FROM pr GROUP BY 1, 2, 3", _LINES))
def lineage_counts_strict(spark, d):
    return _lines(spark, d, "strict")


@query(lineage("SELECT task, '*' AS lang, cls, count(DISTINCT root) AS n_root_lineages FROM pr GROUP BY 1, 3", _LINES))
def lineage_counts_coarse(spark, d):
    return _lines(spark, d, "coarse")


@query(lineage("SELECT task, lang, cls, count(DISTINCT root) AS n_root_lineages FROM pr WHERE root IN (SELECT p FROM edges) GROUP BY 1, 2, 3", _LINES))
def lineage_counts_known(spark, d):
    return _lines(spark, d, "strict", known=True)


@query(lineage("SELECT task, lang, cls, count(DISTINCT CASE WHEN root % 3 = 0 THEN 'fam' || (root % 7) ELSE root::VARCHAR END) AS n_root_lineages FROM pr GROUP BY 1, 2, 3", _LINES))
def lineage_counts_arch(spark, d):
    n, e = _ne(spark, d)
    r = graph.roots(e, n, _closed(spark, d))
    arch = F.when(F.col("root") % 3 == 0, F.concat(F.lit("fam"), F.col("root") % 7))
    return options.lineage_counts(options.pairs(n, "strict"), r.withColumn("root", F.coalesce(arch, F.col("root").cast("string"))), "strict")


@query(lineage("SELECT count(*) AS n_options, avg((c = 1)::INT) AS share_single, avg((c = 1)::INT) > 0.5 AS supported FROM (SELECT count(DISTINCT root) AS c FROM wide GROUP BY task, lang, cls)", _LINES))
def h1(spark, d):
    return statistics.h1(_lines(spark, d, "full"))


@query(lineage("SELECT round_even(100.0 * avg((c = 1)::INT), 4) AS one, round_even(100.0 * avg((c BETWEEN 2 AND 5)::INT), 4) AS two_to_five, round_even(100.0 * avg((c BETWEEN 6 AND 20)::INT), 4) AS six_to_twenty, round_even(100.0 * avg((c > 20)::INT), 4) AS over_twenty FROM (SELECT count(DISTINCT root) AS c FROM wide GROUP BY task, lang, cls)", _LINES))
def bucket_shares(spark, d):
    return reports.bucket_shares(_lines(spark, d, "full"))


# ---- scenarios ----

_DRAWS = 20
_RANKED = _STATS + f""", ranked AS (SELECT d.draw, node, row_number() OVER (PARTITION BY draw ORDER BY md5('matched:' || draw || ':' || node), node) AS rank FROM cand, (SELECT unnest(range({_DRAWS})) AS draw) d),
first_ AS (SELECT draw, de, min(rank) AS m FROM ranked JOIN clo ON anc = node GROUP BY 1, 2), pts AS (SELECT draw, m, count(*) AS n FROM first_ JOIN nodes ON node = de WHERE is_provider GROUP BY 1, 2),
curve AS (SELECT draw, m, (sum(n) OVER (PARTITION BY draw ORDER BY m))::BIGINT AS removed FROM pts),
target AS (SELECT count(DISTINCT de) AS t FROM (SELECT node FROM cand ORDER BY descendants DESC, node LIMIT 10) s JOIN clo ON anc = s.node JOIN nodes n ON n.node = de WHERE n.is_provider)"""


def _parents(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The closure of parents, and what they stand for."""
    closed = once(spark, (d, "parents"), lambda: graph.parent_closure(fixtures.edges(spark, d)))
    n, e = _ne(spark, d)
    return closed, *(once(spark, (d, "counted", k), lambda k=k: graph.counted_by_parents(e, n)[k]) for k in (0, 1))


def _sized(spark, d) -> DataFrame:
    """The candidates with their descendants alone: no closure of all nodes is made for them."""
    n = fixtures.nodes(spark, d).where("is_provider").select("node")
    return once(spark, (d, "sized"), lambda: graph.descendant_counts(*_parents(spark, d)).join(n, "node", "left_semi"))


def _curve(spark, d):
    n, e = _ne(spark, d)
    return once(spark, (d, "curve"), lambda: scenarios.drawn_curve(_sized(spark, d), e, n, *_parents(spark, d), "matched", _DRAWS))


def _target(spark, d) -> int:
    n, e = _ne(spark, d)
    top = _sized(spark, d).orderBy(F.desc("descendants"), "node").limit(10).select("node")
    gone = _parents(spark, d)[0].join(top, F.col("anc") == F.col("node"), "left_semi").select(F.col("de").alias("node")).distinct()
    below = e.join(gone, F.col("p") == F.col("node"), "left_semi").select(F.col("ch").alias("node"))
    return n.where("is_provider").join(gone.unionByName(below), "node", "left_semi").count()


@query(lineage(f"SELECT draw, node FROM (SELECT d.draw, node, row_number() OVER (PARTITION BY draw ORDER BY md5('uniform:10:' || draw || ':' || node), node) AS rn FROM cand, (SELECT unnest(range({_DRAWS})) AS draw) d) WHERE rn <= 10", _STATS))
def null_uniform(spark, d):
    return scenarios.uniform(_cand(spark, d), 10, _DRAWS)


def _matched(tol):
    sql = lineage(f"SELECT draw, min(m) FILTER (removed >= {tol} * t) AS m, min(removed) FILTER (removed >= {tol} * t) AS removed FROM curve, target GROUP BY 1", _RANKED)

    def f(spark, d):
        return scenarios.matched(_curve(spark, d), _target(spark, d), tol)

    f.__name__ = f"null_matched_{round(tol * 100)}"
    return query(sql)(f)


for _tol in (0.95, 0.90, 0.99):
    _matched(_tol)


@query(lineage("SELECT draw, CASE WHEN removed - t > t - before THEN m - 1 ELSE m END AS m, CASE WHEN removed - t > t - before THEN before ELSE removed END AS removed FROM (SELECT draw, arg_min(m, m) AS m, arg_min(removed, m) AS removed, arg_min(before, m) AS before, any_value(t) AS t FROM (SELECT *, lag(removed) OVER (PARTITION BY draw ORDER BY m) AS before FROM curve), target WHERE removed >= t GROUP BY 1)", _RANKED))
def null_nearest(spark, d):
    return scenarios.matched(_curve(spark, d), _target(spark, d), nearest=True)


_BINS = _STATS + f""", t10 AS (SELECT * FROM cand ORDER BY downloads DESC, node LIMIT 40), b AS (SELECT node, floor(log2(descendants + 1))::INT AS b FROM cand WHERE node NOT IN (SELECT node FROM t10)),
w AS (SELECT t.b, n, coalesce(m, 0) >= n AS own FROM (SELECT floor(log2(descendants + 1))::INT AS b, count(*) AS n FROM t10 GROUP BY 1) t LEFT JOIN (SELECT b, count(*) AS m FROM b GROUP BY 1) USING (b)),
pool AS (SELECT draw, w.b AS for_, n, node, row_number() OVER (PARTITION BY draw, w.b ORDER BY md5('bin:' || draw || ':' || node), node) AS rn FROM b JOIN w ON (w.own AND b.b = w.b) OR (NOT w.own AND b.b >= w.b - 1), (SELECT unnest(range({_DRAWS})) AS draw)),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY for_, rn) AS place FROM pool WHERE rn <= n)"""


@query(lineage("SELECT DISTINCT draw, node FROM rows_ WHERE place <= (SELECT sum(n) FROM w)", _BINS))
def null_bin_matched(spark, d):
    c = _cand(spark, d)
    return scenarios.bin_matched(c, c.orderBy(F.desc("downloads"), "node").limit(40), _DRAWS)


@query(lineage("SELECT draw, arg_min(m, m) AS m, arg_min(removed, m) AS removed FROM (SELECT s.draw, s.m, s.n, coalesce((SELECT max(c.removed) FROM curve c WHERE c.draw = s.draw AND c.m <= s.m), 0)::BIGINT AS removed FROM steps s), target WHERE removed >= 0.95 * t OR m >= n GROUP BY 1", _RANKED + """, sums AS (SELECT draw, rank, sum(closure_size) OVER (PARTITION BY draw ORDER BY rank) AS s FROM ranked JOIN cand USING (node)),
start AS (SELECT draw, least(count(*) FILTER (s < t) + 1, max(rank)) AS m, max(rank) AS n FROM sums, target GROUP BY draw, t), steps(draw, m, n) AS (SELECT draw, m, n FROM start UNION ALL SELECT draw, least(n, floor(m * 1.15::DOUBLE)::BIGINT + 1), n FROM steps WHERE m < n)"""))
def null_growing_prefix(spark, d):
    c = _sized(spark, d).select("node", (F.col("descendants") + 1).alias("size"))
    target = _target(spark, d)
    return scenarios.growing_prefix(_curve(spark, d), None, target, start=scenarios.growing_start(c, target, "matched", _DRAWS))


@query()
def greedy_topk(spark, d):
    chosen = scenarios.greedy(_cand(spark, d), _closed(spark, d), fixtures.nodes(spark, d), 10)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(chosen)], "k int, node long")


# ---- statistics ----

_NULLS = "WITH v AS (SELECT l_suppkey % 10 AS g, l_quantity::DOUBLE AS value FROM lineitem), o AS (SELECT g, quantile_cont(value, 0.9) + (g % 3) * 3 AS observed FROM v GROUP BY 1)"


def _null(spark, d):
    v = fixtures.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_quantity").cast("double").alias("value"))
    return v, v.groupBy("g").agg((F.percentile("value", F.lit(0.9)) + (F.first("g") % 3) * 3).alias("observed"))


@query(_NULLS + " SELECT g, observed, avg(value) AS null_mean, quantile_cont(value, 0.95) AS null_p95, avg((value < observed)::INT) AS percentile_in_null, (1 + count(*) FILTER (value >= observed)) / (1 + count(*)) AS p, observed / avg(value) AS ratio_vs_matched, count(*) AS n_null FROM v JOIN o USING (g) GROUP BY g, observed")
def empirical_p(spark, d):
    return statistics.empirical_p(*_null(spark, d), ["g"])


@query(_NULLS + ", t AS (SELECT g, g % 2 AS family, (1 + count(*) FILTER (value >= observed)) / (1 + count(*)) AS p FROM v JOIN o USING (g) GROUP BY g, observed), s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, g) + 1) * p AS x FROM t), h AS (SELECT *, least(1.0, max(x) OVER (PARTITION BY family ORDER BY p, g)) AS p_holm FROM s) SELECT g, family, p, p_holm, p_holm <= 0.05 AS reject FROM h")
def holm(spark, d):
    t = statistics.empirical_p(*_null(spark, d), ["g"]).select("g", (F.col("g") % 2).alias("family"), "p")
    return statistics.holm(t, ["family"], ["g"])


@query(_NULLS + " SELECT g, avg((observed > value)::INT) - avg((observed < value)::INT) AS cliffs_delta FROM v JOIN o USING (g) GROUP BY 1")
def cliffs_delta(spark, d):
    return statistics.cliffs_delta(*_null(spark, d), ["g"])


@query(_NULLS + ", r AS (SELECT g, value, row_number() OVER (PARTITION BY g ORDER BY value DESC) AS rn, floor(0.05 / 20 * (count(*) OVER (PARTITION BY g) + 1) - 1) AS m FROM v) SELECT g, avg(value) AS null_mean, CASE WHEN max(m) < 0 THEN 'inf'::DOUBLE ELSE max(value + 1) FILTER (rn = m + 1) END AS critical, CASE WHEN max(m) < 0 THEN 'inf'::DOUBLE ELSE max(value + 1) FILTER (rn = m + 1) END - avg(value) AS min_detectable_excess FROM r GROUP BY 1")
def mde(spark, d):
    return statistics.detectable(_null(spark, d)[0], ["g"])


@query("WITH t AS (SELECT l_suppkey % 2 AS family, l_linenumber AS k, l_suppkey % 4 AS strategy, avg(l_quantity) > 25.7 AS reject FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT family, k, bool_or(reject) AS any_ FROM t GROUP BY 1, 2) SELECT family, count(*) FILTER (any_) AS k_significant, count(*) AS k_total, count(*) FILTER (any_) * 2 > count(*) AS supported FROM p GROUP BY 1")
def h2_verdicts(spark, d):
    t = fixtures.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 2).alias("family"), F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 4).alias("strategy")).agg((F.avg("l_quantity") > 25.7).alias("reject"))
    return statistics.verdicts(t, ["family"])


@query("WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY 1, 2), t AS (SELECT sum(c) AS n, sum(c) FILTER (a = b) AS s FROM c), e AS (SELECT sum(r * s) AS rs FROM (SELECT a AS k, sum(c) AS r FROM c GROUP BY 1) JOIN (SELECT b AS k, sum(c) AS s FROM c GROUP BY 1) USING (k)) SELECT n::BIGINT AS n, s / n AS agreement, (s / n - rs / (n * n)) / (1 - rs / (n * n)) AS kappa FROM t, e")
def kappa(spark, d):
    return statistics.kappa(fixtures.table(spark, d, "labels"), "quality", "toxic")


_STRATA = "WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY 1)"


@query(_STRATA + " SELECT lang, n, hits, hits / n AS precision, (hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS low, (hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS high FROM s")
def precision_by_stratum(spark, d):
    rows = fixtures.table(spark, d, "labels").join(fixtures.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("hits"))
    low, high = statistics.wilson(F.col("hits"), F.col("n"))
    return rows.select("lang", "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), low.alias("low"), high.alias("high"))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY 1")
def confusion_pivot(spark, d):
    return fixtures.table(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


# ---- names, cleaning, inference ----

_NAMED = "n AS (SELECT p_partkey AS k, 'acct' || (p_partkey % 60) || '/' || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 6 = 0 THEN '-' || ['GGUF','test','4bit','q4_k_m'][(p_partkey // 6 % 4) + 1] ELSE '' END AS model_id, 'acct' || (p_partkey % 60) AS author, make_timestamp(2024, 1, 1 + (p_partkey % 28), 0, 0, 0) AS created_at, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS pipeline_tag, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS library_name, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'mit' END AS license, p_size % 7 AS downloads_all FROM part)"
_NE = f"WITH {_NAMED}, e AS (SELECT DISTINCT a.model_id AS parent_id, b.model_id AS child_id FROM n a JOIN n b ON a.k = b.k // 40 WHERE a.model_id <> b.model_id AND b.k % 3 = 0)"


def _named(spark, d):
    k = F.col("p_partkey")
    suffix = F.when(k % 6 == 0, F.concat(F.lit("-"), F.get(F.array(*map(F.lit, ("GGUF", "test", "4bit", "q4_k_m"))), (F.expr("p_partkey div 6") % 4).cast("int")))).otherwise("")
    n = fixtures.table(spark, d, "part").select(
        k.alias("k"), F.concat(F.lit("acct"), k % 60, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), suffix).alias("model_id"), F.concat(F.lit("acct"), k % 60).alias("author"),
        F.expr("make_timestamp_ntz(2024, 1, cast(1 + (p_partkey % 28) as int), 0, 0, 0)").alias("created_at"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("pipeline_tag"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("library_name"),
        F.when(F.col("p_size") % 2 != 0, "mit").alias("license"), (F.col("p_size") % 7).cast("long").alias("downloads_all"), F.lit(0).alias("n_parents"),
    )
    a, b = n.select(F.col("k").alias("ak"), F.col("model_id").alias("parent_id")), n.where("k % 3 = 0").select(F.expr("k div 40").alias("ak"), F.col("model_id").alias("child_id"))
    return n, a.join(b, "ak").where("parent_id <> child_id").select("parent_id", "child_id").distinct()


@query(_NE + r" SELECT model_id, regexp_matches(nm, '(?:^|[-_.])(?:test|tmp|temp|dummy|debug|placeholder)(?:[-_.\d]|$)') AS f_test, author = 'gradients-io-tournaments' OR regexp_matches(nm, '[-_]1[67]\d{8}$') AS f_bot, pipeline_tag IS NULL AND library_name IS NULL AND license IS NULL AND model_id NOT IN (SELECT child_id FROM e) AS f_empty, downloads_all = 0 AS f_zero_downloads, authors >= 20 AND rn > 1 AND (SELECT count(*) FROM e WHERE parent_id = model_id) < 10 AS f_boilerplate FROM (SELECT *, lower(split_part(model_id, '/', 2)) AS nm, count(DISTINCT author) OVER (PARTITION BY lower(split_part(model_id, '/', 2))) AS authors, row_number() OVER (PARTITION BY lower(split_part(model_id, '/', 2)) ORDER BY created_at, model_id) AS rn FROM (SELECT DISTINCT ON (model_id) * FROM n ORDER BY model_id, k))")
def clean_flags(spark, d):
    n, e = _named(spark, d)
    n = ingest.keep_first(n, ["model_id"], "k")
    e = e.withColumns({"relation": F.lit("finetune"), "source": F.lit("declared")})
    return cleaning.flags(n, e, e, least_authors=20).select("model_id", "f_test", "f_bot", "f_empty", "f_zero_downloads", "f_boilerplate")


@query(_NE + ", u AS (SELECT DISTINCT ON (model_id) * FROM n ORDER BY model_id, k), x AS (SELECT *, lower(split_part(model_id, '/', 2)) AS nm FROM u), pop AS (SELECT parent_id FROM e GROUP BY 1 HAVING count(*) >= 5), q AS (SELECT nm, any_value(model_id) AS parent_id, any_value(created_at) AS at FROM x WHERE model_id IN (SELECT parent_id FROM pop) GROUP BY 1 HAVING count(*) = 1) SELECT q.parent_id, x.model_id AS child_id FROM x JOIN q USING (nm) WHERE x.model_id NOT IN (SELECT child_id FROM e) AND x.model_id NOT IN (SELECT parent_id FROM pop) AND x.created_at >= q.at AND x.model_id <> q.parent_id")
def infer_mirror(spark, d):
    n, e = _named(spark, d)
    return inference.mirrors(ingest.keep_first(n, ["model_id"], "k"), e, popular=5)


@query("WITH n AS (SELECT 'a' || (p_partkey % 9) || '/M' || (p_partkey // 2) || CASE WHEN p_partkey % 2 = 1 THEN '-Q4_K_M' ELSE '' END AS id, p_partkey // 2 AS m, p_partkey % 2 AS q, (p_partkey * 3) % 28 AS tm FROM part), b AS (SELECT m, any_value(id) AS parent_id, any_value(tm) AS tm FROM n WHERE q = 0 GROUP BY 1 HAVING count(*) = 1) SELECT parent_id, id AS child_id FROM n JOIN b USING (m) WHERE q = 1 AND n.tm >= b.tm")
def infer_quant(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("a"), k % 9, F.lit("/M"), F.expr("p_partkey div 2"), F.when(k % 2 == 1, "-Q4_K_M").otherwise(""))
    n = fixtures.table(spark, d, "part").select(name.alias("model_id"), F.concat(F.lit("a"), k % 9).alias("author"), ((k * 3) % 28).alias("created_at"))
    none = spark.createDataFrame([], "parent_id string, child_id string")
    return inference.quantised(n, none, none)


@query("WITH r AS (SELECT p_partkey AS k, 'o' || (p_partkey % 9) AS o, replace(p_name, ' ', '-') AS nm FROM part), known AS (SELECT DISTINCT o || '/' || nm AS id FROM r WHERE k % 2 = 0), x AS (SELECT DISTINCT 'RichardErkhov/' || o || '_-_' || nm || '-gguf' AS child_id, o || '/' || nm AS p FROM r) SELECT p AS parent_id, child_id FROM x JOIN known ON id = p")
def infer_name(spark, d):
    r = fixtures.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("o"), F.col("p_partkey") % 9).alias("o"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("nm"))
    known = r.where("k % 2 = 0").select(F.concat("o", F.lit("/"), "nm").alias("model_id"), F.col("o").alias("author"))
    odd = r.select(F.concat(F.lit("RichardErkhov/"), "o", F.lit("_-_"), "nm", F.lit("-gguf")).alias("model_id"), F.lit("RichardErkhov").alias("author"))
    return inference.by_embedded_name(known.unionByName(odd).distinct(), spark.createDataFrame([], "parent_id string, child_id string"))


@query(lineage("SELECT parent, child, relation, min(moved) AS moved FROM (SELECT CASE WHEN p % 17 = 0 THEN p + 1 ELSE p END AS parent, ch AS child, relation, p % 17 = 0 AS moved FROM edges) WHERE parent <> child GROUP BY 1, 2, 3"))
def reconnect_parents(spark, d):
    e = fixtures.edges(spark, d)
    text = lambda c: F.col(c).cast("string")
    rows = e.select(text("p").alias("parent_id"), text("ch").alias("child_id"), "relation", text("p").alias("parent_id_declared"), (F.col("p") % 17 != 0).alias("parent_in_snapshot"), F.lit(True).alias("temporal_ok"))
    resolved = e.where("p % 17 = 0").select(text("p").alias("parent_id"), (F.col("p") + 1).cast("string").alias("resolved_id"), F.lit("renamed").alias("status"), F.lit(True).alias("in_snapshot")).distinct()
    out = inference.reconnect(rows, resolved)
    return out.select(F.col("parent_id").cast("long").alias("parent"), F.col("child_id").cast("long").alias("child"), "relation", F.col("parent_resolution").isNotNull().alias("moved"))


@query(lineage("SELECT cls, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM nodes), 4) AS share, coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (license IS NOT NULL)), ','), '') AS licenses FROM nodes GROUP BY 1"))
def license_summary(spark, d):
    return reports.license_summary(fixtures.nodes(spark, d))


@query("SELECT c_custkey, CASE WHEN l IS NULL THEN 'unknown' WHEN l = 'apache-2.0' THEN 'permissive' WHEN l LIKE '%nc%' THEN 'noncommercial' WHEN l LIKE 'override:%' THEN split_part(l, ':', 2) WHEN l LIKE 'my-llama%' THEN 'vendor_custom' ELSE 'other' END AS cls, coalesce(l IN ('apache-2.0') OR l LIKE 'my-llama%' OR l = 'override:copyleft', FALSE) AS commercial FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'apache-2.0' WHEN 'MACHINERY' THEN 'some-new-nc-license' WHEN 'HOUSEHOLD' THEN 'override:copyleft' WHEN 'AUTOMOBILE' THEN 'my-llama-terms' END AS l FROM customer)")
def license_classes(spark, d):
    s = F.col("c_mktsegment")
    l = F.when(s == "BUILDING", "Apache-2.0").when(s == "MACHINERY", "some-new-nc-license").when(s == "HOUSEHOLD", "override:copyleft").when(s == "AUTOMOBILE", "my-llama-terms")  # noqa: E741
    return fixtures.table(spark, d, "customer").select("c_custkey", license_class(l).alias("cls")).withColumn("commercial", commercial(F.col("cls")))


@query("SELECT event_id, CASE WHEN t % 3 = 0 THEN 'adapter' WHEN t % 3 = 1 THEN 'unspecified' ELSE 'merge' END AS relation, 'p' || (t % 11) || '/m' AS parent, CASE WHEN t % 2 = 0 THEN 'en,fr' ELSE 'de' END AS languages, 'mit' AS license, (1 + t % 2)::INT AS n_licenses FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS t FROM events)")
def json_tags_parse(spark, d):
    t = F.get_json_object("props", "$.k").cast("long")
    e = fixtures.table(spark, d, "events").select("event_id", t.alias("t"))
    parent = F.concat(F.lit("p"), F.col("t") % 11, F.lit("/m"))
    typed = lambda r: F.concat(F.lit(f"base_model:{r}:"), parent)
    tags = F.array(
        F.concat(F.lit("base_model:"), parent), F.when(F.col("t") % 3 == 0, typed("adapter")).when(F.col("t") % 3 == 2, typed("finetune")).otherwise(F.lit("x")),
        F.when(F.col("t") % 3 == 2, typed("merge")).otherwise(F.lit("y")), F.when(F.col("t") % 2 == 0, "fr").otherwise("de"), F.when(F.col("t") % 2 == 0, "en").otherwise("de"),
        F.lit("license:mit"), F.when(F.col("t") % 2 == 1, "license:gpl").otherwise("z"), F.lit("dataset:d"),
    )
    rows = ingest.parse_tags(e.withColumn("tags", tags))
    return rows.select("event_id", F.explode("parents").alias("parent", "relation"), F.array_join(F.array_sort(F.array_distinct("languages")), ",").alias("languages"), F.get("licenses", F.lit(0)).alias("license"), F.size("licenses").alias("n_licenses"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS owner, lower(substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2)) AS name, 'user-' || substr(sha1(split_part(split_part(url, '://', 2), '/', 1)), 1, 6) AS pseudonym FROM pages")
def id_parts(spark, d):
    i = F.get(F.split("url", "://", 2), F.lit(1))
    return fixtures.table(spark, d, "pages").select("page_id", names.owner(i).alias("owner"), F.coalesce(names.repo_name(i), F.lit("")).alias("name"), names.pseudonym(names.owner(i)).alias("pseudonym"))


# ---- reports ----


@query(lineage("SELECT children, n, round_even(1 - (sum(n) OVER (ORDER BY children) - n) / sum(n) OVER (), 9) AS ccdf FROM g", ", g AS (SELECT c AS children, count(*) AS n FROM (SELECT count(*) AS c FROM edges GROUP BY p) GROUP BY 1)"))
def degree_ccdf(spark, d):
    return reports.degree_ccdf(fixtures.edges(spark, d))


@query(lineage("SELECT year(created_at)::INT AS year, count(*) FILTER (relation = 'finetune') AS finetune, count(*) FILTER (relation = 'adapter') AS adapter, count(*) FILTER (relation = 'quantized') AS quantized, count(*) FILTER (relation = 'merge') AS merge, count(*) FILTER (relation NOT IN ('finetune', 'adapter', 'quantized', 'merge')) AS other FROM edges JOIN nodes ON node = ch WHERE year(created_at) >= 1993 GROUP BY 1"))
def relations_by_year(spark, d):
    n, e = _ne(spark, d)
    return reports.relations_by_year(e, n, names.RELATIONS, 1993)


@query(lineage("SELECT rank, account, derived, round_even(100.0 * derived / total, 6) AS share, round_even(100.0 * sum(coalesce(new_, 0)) OVER (ORDER BY rank) / total, 6) AS union_share FROM (SELECT k.rank, k.account, k.derived, f.new_, (SELECT count(DISTINCT node) FROM da) AS total FROM top k LEFT JOIN (SELECT rank, count(*) AS new_ FROM (SELECT node, min(rank) AS rank FROM da JOIN top USING (account) GROUP BY 1) GROUP BY 1) f USING (rank))", _ROOTS + ", da AS (SELECT DISTINCT r.node, a.author AS account FROM roots r JOIN nodes n ON n.node = r.node AND n.is_provider JOIN nodes a ON a.node = r.root WHERE r.node <> r.root), top AS (SELECT row_number() OVER (ORDER BY count(*) DESC, account) AS rank, account, count(*) AS derived FROM da GROUP BY account ORDER BY derived DESC, account LIMIT 10)"))
def upstream_concentration(spark, d):
    n, e = _ne(spark, d)
    return reports.concentration(graph.roots(e, n, _closed(spark, d)), n, 10)


@query(lineage("SELECT p, before, after, rank() OVER (ORDER BY before DESC) AS rank_before, rank() OVER (ORDER BY after DESC) AS rank_after, round_even(100.0 * (before - after) / greatest(before, 1), 4) AS pct_removed FROM a ORDER BY before DESC, p LIMIT 8", ", a AS (SELECT p, count(*) AS before, count(*) FILTER (is_provider) AS after FROM edges JOIN nodes ON node = ch GROUP BY 1)"))
def cleaning_effect(spark, d):
    n, e = _ne(spark, d)
    return reports.cleaning_effect(e, n.where("is_provider"))


@query(lineage("""SELECT * FROM (SELECT count(*) AS nodes, count(*) FILTER (is_provider) AS providers, count(DISTINCT author) AS authors, count(*) FILTER (license IS NULL) AS without_license, count(*) FILTER (languages IS NULL) AS without_languages,
  count(*) FILTER (task IS NULL) AS without_task, count(*) FILTER (created_at IS NULL) AS without_date, sum(downloads)::BIGINT AS downloads, count(*) FILTER (coalesce(downloads, 0) = 0) AS without_downloads, min(created_at) AS first_created, max(created_at) AS last_created FROM nodes),
  (SELECT count(*) AS edges, count(DISTINCT p) AS parents, count(DISTINCT ch) AS children, count(*) FILTER (relation = 'finetune') AS finetune_edges, count(*) FILTER (relation = 'adapter') AS adapter_edges, count(*) FILTER (relation = 'quantized') AS quantized_edges,
  count(*) FILTER (relation = 'merge') AS merge_edges, count(*) FILTER (relation = 'mirror') AS mirror_edges FROM edges),
  (SELECT max(d) AS most_children, round_even(avg(d), 6) AS mean_children, count(*) FILTER (d >= 10) AS parents_of_10 FROM (SELECT count(*) AS d FROM edges GROUP BY p)), (SELECT count(*) FILTER (d > 1) AS with_several_parents FROM (SELECT count(*) AS d FROM edges GROUP BY ch))"""))
def build_summary(spark, d):
    return reports.graph_summary(*_ne(spark, d))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round_even(avg(l_quantity), 6) AS mean, round_even(quantile_cont(l_quantity, 0.025), 6) AS p025, round_even(quantile_cont(l_quantity, 0.05), 6) AS p05, round_even(quantile_cont(l_quantity, 0.5), 6) AS median, round_even(quantile_cont(l_quantity, 0.95), 6) AS p95, round_even(quantile_cont(l_quantity, 0.975), 6) AS p975, max(l_quantity) AS largest FROM lineitem GROUP BY 1, 2")
def quantile_bands(spark, d):
    return reports.null_bands(fixtures.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_mktsegment END AS segment, count(*) AS n, round_even(avg(c_acctbal), 3) AS mean, round_even(stddev_samp(c_acctbal), 3) AS sd FROM customer GROUP BY 1")
def null_aware_summary(spark, d):
    return fixtures.table(spark, d, "customer").groupBy(F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment")).agg(F.count("*").alias("n"), F.bround(F.avg("c_acctbal"), 3).alias("mean"), F.bround(F.stddev_samp("c_acctbal"), 3).alias("sd"))


@query("SELECT p_name, p_partkey, n_names FROM (SELECT p_name, p_partkey, count(*) OVER (PARTITION BY p_name) AS n_names, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS rn FROM part) WHERE rn = 1")
def earliest_per_name(spark, d):
    p = fixtures.table(spark, d, "part")
    first = ingest.keep_first(p, ["p_name"], "p_size", "p_partkey").select("p_name", "p_partkey")
    return first.join(p.groupBy("p_name").agg(F.count("*").alias("n_names")), "p_name")


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def topn_common(spark, d):
    return fixtures.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("SELECT coalesce(a.k, b.k) AS custkey, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS urgent FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) b ON a.k = b.k")
def full_outer_counts(spark, d):
    o = fixtures.table(spark, d, "orders")
    n = lambda c, name: o.where(c).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias(name))
    return n(F.col("o_orderstatus") == "F", "orders").join(n(F.col("o_orderpriority").startswith("1"), "urgent"), "custkey", "full_outer").na.fill(0)


_SAMPLE = "WITH seen AS (SELECT doc_id FROM labels), a AS (SELECT 1 AS s, 'long' AS stratum, 20 AS n, doc_id FROM documents WHERE n_chars > 2000 UNION ALL SELECT 2, 'first', 20, doc_id FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 3, 'rest', 50, doc_id FROM documents), b AS (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM seen)), "


@query(_SAMPLE + "r AS (SELECT *, md5('sample:' || doc_id) AS h FROM b), s1 AS (SELECT doc_id, stratum FROM r WHERE s = 1 ORDER BY h, doc_id LIMIT 20), s2 AS (SELECT doc_id, stratum FROM r WHERE s = 2 AND doc_id NOT IN (SELECT doc_id FROM s1) ORDER BY h, doc_id LIMIT 20), s3 AS (SELECT doc_id, stratum FROM r WHERE s = 3 AND doc_id NOT IN (SELECT doc_id FROM s1 UNION SELECT doc_id FROM s2) ORDER BY h, doc_id LIMIT 50) SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3")
def stratified_sample(spark, d):
    docs = fixtures.table(spark, d, "documents").select("doc_id", "n_chars")
    strata = {"long": (F.col("n_chars") > 2000, 20), "first": (F.col("doc_id") % 7 == 0, 20), "rest": (F.lit(True), 50)}
    return scenarios.stratified_sample(docs, "doc_id", strata, fixtures.table(spark, d, "labels"))


@query(lineage("SELECT node, author FROM nodes WHERE ('0x' || substr(md5(author), 1, 8))::BIGINT % 4 = 0"))
def account_sample(spark, d):
    return variant.sampled_accounts(fixtures.nodes(spark, d), 4).select("node", "author")


@query("SELECT 'duplicate' AS \"check\", l_orderkey || ' ' || l_suppkey AS detail FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1 UNION ALL SELECT 'range:l_pct', l_orderkey || ' ' || l_suppkey FROM lineitem WHERE NOT (l_quantity * 2.2 BETWEEN 0 AND 100)")
def audit_violations(spark, d):
    r = fixtures.table(spark, d, "lineitem").withColumn("l_pct", F.col("l_quantity") * 2.2)
    return audit.violations(r, ["l_orderkey", "l_suppkey"], ["l_pct"])


_VARIANT = lineage("SELECT 'availability' AS semantics, l.*, z.n AS removed_providers FROM (" + _LOSSES.format(l="lost", c=_COM) + ") l LEFT JOIN (SELECT strategy, k, count(*) AS n FROM removed JOIN nodes USING (node) WHERE is_provider GROUP BY 1, 2) z USING (strategy, k)", _HARD + _PAIRS + _LOST)
_VARIANT = _VARIANT.replace("(o_orderkey % 13 <> 0) AS is_provider", "(o_orderkey % 13 <> 0 AND NOT (o_orderkey % 5 = 2 AND o_orderkey >= 20 AND o_custkey % 11 <> 0)) AS is_provider").replace("unnest([1, 10, 100]) AS k", "unnest([1, 5, 10, 50, 100]) AS k")


@query(_VARIANT)
def variant_losses(spark, d):
    return variant.targeted_losses(*_ne(spark, d), VariantConfig(exclude_quantized=True, inherit=False), semantics="availability")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return loss_full_topk(spark, d)
