"""Graph operators over edge tables (p, ch, relation): fixpoints of joins, never a graph in memory.

A fixpoint is semi-naive: each round joins only the pairs found in the round before, and settles what is new in
the shared folder, so plans stay small and a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.plans.materialise import settle


def analysis_edges(edges: DataFrame, keep_violations: bool = False) -> DataFrame:
    """Edges whose parent is there, that are on no cycle, and (unless kept) not known to run against time."""
    fine = F.col("parent_in_snapshot") & ~F.col("in_cycle")
    return edges.where(fine if keep_violations else fine & F.coalesce("temporal_ok", F.lit(True)))


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("p <> ch")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_children, n_parents, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("p").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("ch").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("o").alias("n_children"), F.sum("i").alias("n_parents"))


def closure(edges: DataFrame, seeds: DataFrame | None = None, include_self: bool = True) -> DataFrame:
    """Pairs (anc, de): every seed (all parents if None: a column anc) with itself and all it reaches.

    All parents: the length of the paths doubles each round, as pairs found in the last round are joined with all pairs found.
    Some seeds: a round adds an edge, so that work follows what the seeds reach.
    """
    links = settle(edges.select("p", "ch").where("p <> ch").distinct())
    if seeds is None:
        found = front = links.select(F.col("p").alias("anc"), F.col("ch").alias("de"))
        while True:
            ends = found.select(F.col("anc").alias("mid"), F.col("de").alias("far"))
            # a path that is longer than those found has its first half among the newest or its last half
            step = front.join(ends, F.col("de") == F.col("mid")).select("anc", F.col("far").alias("de")).where("anc <> de")
            fresh = step.select("anc", "de", F.lit(1).alias("new")).unionByName(found.select("anc", "de", F.lit(0).alias("new")))
            every = settle(fresh.groupBy("anc", "de").agg(F.min("new").alias("new")))
            front = every.where("new = 1").select("anc", "de")
            found = every.select("anc", "de")
            if front.isEmpty():
                break
        seeds = edges.select(F.col("p").alias("anc")).distinct()
    else:
        seeds = seeds.select("anc").distinct()
        front = settle(links.join(seeds, F.col("p") == F.col("anc")).select("anc", F.col("ch").alias("de")).where("anc <> de"))
        found = front
        while not front.isEmpty():
            step = front.join(links, F.col("de") == F.col("p")).select("anc", F.col("ch").alias("de")).where("anc <> de").distinct()
            front = settle(step.join(found, ["anc", "de"], "left_anti"))
            found = found.unionByName(front)
    return seeds.select("anc", F.col("anc").alias("de")).unionByName(found) if include_self else found


def parent_closure(edges: DataFrame) -> DataFrame:
    """Pairs (anc, de) of the closure whose de has children itself: every parent with itself and the parents it reaches."""
    parents = edges.select("p").distinct()
    between = edges.select("p", "ch").join(parents.select(F.col("p").alias("ch")), "ch", "left_semi")
    return parents.select(F.col("p").alias("anc"), F.col("p").alias("de")).unionByName(closure(between, include_self=False))


def counted_by_parents(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a parent stands for: (de, own, n): whether it is a provider, and that with its childless providers of no other parent;
    and (leaf, de): the parents of the childless providers that have several."""
    parents = edges.select(F.col("p").alias("de")).distinct()
    providers = nodes.where("is_provider").select(F.col("node").alias("leaf"))
    leaves = edges.select(F.col("ch").alias("leaf"), F.col("p").alias("de")).join(parents.select(F.col("de").alias("leaf")), "leaf", "left_anti").join(providers, "leaf", "left_semi")
    leaves = settle(leaves.groupBy("leaf").agg(F.collect_set("de").alias("of")))
    own = parents.join(providers.select(F.col("leaf").alias("de"), F.lit(1).alias("own")), "de", "left").select("de", F.coalesce("own", F.lit(0)).alias("own"))
    single = leaves.where(F.size("of") == 1).groupBy(F.col("of")[0].alias("de")).agg(F.count("*").alias("below"))
    weights = own.join(single, "de", "left").select("de", "own", (F.col("own") + F.coalesce("below", F.lit(0))).alias("n"))
    return weights, leaves.where(F.size("of") > 1).select("leaf", F.explode("of").alias("de"))


def descendant_counts(closed: DataFrame, weights: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, descendants) of all parents, as `descendant_stats` counts them, by the closure of parents and what these stand for."""
    alone = closed.join(weights, "de").groupBy("anc").agg((F.sum("n") - F.max(F.when(F.col("anc") == F.col("de"), F.col("own")))).alias("alone"))
    common = shared.join(closed, "de").select("anc", "leaf").distinct().groupBy("anc").agg(F.count("*").alias("common"))
    return alone.join(common, "anc", "left").select(F.col("anc").alias("node"), (F.col("alone") + F.coalesce("common", F.lit(0))).alias("descendants"))


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scenario_id, node): the seeds (scenario_id, node) of each scenario and all their descendants."""
    links = settle(edges.select("p", "ch").distinct())
    front = settle(seeds.select("scenario_id", "node").distinct())
    found = front
    while not front.isEmpty():
        step = front.join(links, F.col("node") == F.col("p")).select("scenario_id", F.col("ch").alias("node")).distinct()
        front = settle(step.join(found, ["scenario_id", "node"], "left_anti"))
        found = found.unionByName(front)
    return found


def removed_legal(closed: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scenario_id, node) by a closure computed before; seeds without children are their own closure."""
    got = seeds.join(closed, F.col("node") == F.col("anc")).select("scenario_id", F.col("de").alias("node"))
    return got.unionByName(seeds.select("scenario_id", "node")).distinct()


def removed_availability(edges: DataFrame, hard_closed: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scenario_id, node): the seeds, and the adapter descendants of seeds that have no mirror outside the seeds."""
    mirrors = edges.where("relation = 'mirror'").select(F.col("p").alias("node"), F.col("ch").alias("mirror"))
    others = seeds.select("scenario_id", F.col("node").alias("mirror"))
    saved = seeds.join(mirrors, "node").join(others, ["scenario_id", "mirror"], "left_anti").select("scenario_id", "node").distinct()
    lost = seeds.join(saved, ["scenario_id", "node"], "left_anti")
    spread = lost.join(hard_closed, F.col("node") == F.col("anc")).select("scenario_id", F.col("de").alias("node"))
    return seeds.select("scenario_id", "node").unionByName(spread).distinct()


def descendant_stats(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, descendants (providers, without itself), descendant_authors (theirs, without its own author)."""
    own = nodes.select(F.col("node").alias("anc"), F.col("author").alias("own"))
    of = nodes.where("is_provider").select(F.col("node").alias("de"), "author")
    rows = closed.where("anc <> de").join(of, "de").join(own, "anc")
    return rows.groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("descendants"), F.count_distinct(F.when(~F.col("author").eqNullSafe(F.col("own")), F.col("author"))).alias("descendant_authors"))


def roots(edges: DataFrame, nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, root): the nodes without parents that reach it; such a node is its own."""
    children = edges.select(F.col("ch").alias("node")).distinct()
    tops = nodes.select("node").join(children, "node", "left_anti")
    below = closed.where("anc <> de").join(tops, F.col("anc") == F.col("node"), "left_semi").select(F.col("de").alias("node"), F.col("anc").alias("root"))
    return tops.select("node", F.col("node").alias("root")).unionByName(below)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that lack parents or children, as long as a round takes a tenth or more of them."""
    core, was = edges, edges.count()
    while was:
        both = core.select(F.col("p").alias("n")).intersect(core.select(F.col("ch").alias("n")))
        core = settle(core.join(both, F.col("p") == F.col("n"), "left_semi").join(both, F.col("ch") == F.col("n"), "left_semi"))
        left = core.count()
        if 10 * left > 9 * was:
            break
        was = left
    return core


def _highest(edges: DataFrame) -> DataFrame:
    """(n, top): of the nodes that reach n, itself included, the one that is first by hash.

    A round asks the parents and the top found so far, which reaches n too: on a path the reach grows by a factor a round.
    """
    by_hash = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    ends = edges.select(F.explode(F.array("p", "ch")).alias("n")).distinct()
    now = settle(ends.select("n", by_hash("n").alias("top")))
    while True:
        top = now.select(F.col("n").alias("of"), F.col("top").alias("via"))
        asked = edges.select(F.col("ch").alias("n"), F.col("p").alias("ask")).unionByName(now.select("n", F.col("top.n").alias("ask")).where("n <> ask"))
        told = asked.join(top, F.col("ask") == F.col("of")).select("n", "via", F.lit(None).cast(now.schema["top"].dataType).alias("was"))
        step = told.unionByName(now.select("n", F.col("top").alias("via"), F.col("top").alias("was"))).groupBy("n").agg(F.max("via").alias("top"), F.max("was").alias("was"))
        step = settle(step.select("n", "top", (F.col("top") > F.col("was")).alias("grew")))
        now = step.select("n", "top")
        if step.where("grew").isEmpty():
            return now.select("n", F.col("top.n").alias("top"))


def _contracted(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Distinct edges with their ends replaced as told (n, top); those within one node fall out."""
    for end in ("p", "ch"):
        edges = edges.join(to.select(F.col("n").alias(end), "top"), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    return edges.where("p <> ch").distinct()


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """(n, top): the strongly connected component, named by one of its nodes, of every node of a component of two or more.

    Pairs of opposite edges are contracted first. Then every node takes the first node by hash that reaches it: a component has one
    such node, so edges between different ones are cut, and what reaches its own node is that node's component and done. Hashes
    make the number of such steps grow with the logarithm of the components in a row; no pairs of a closure are made.
    """
    core = _trimmed(settle(edges.where("p <> ch").select("p", "ch").distinct()))
    groups = settle(core.select(F.col("p").alias("n"), F.col("p").alias("top")).distinct())

    def told(to: DataFrame) -> DataFrame:
        to = to.select(F.col("n").alias("top"), F.col("top").alias("next"))
        return settle(groups.join(to, "top", "left").select("n", F.coalesce("next", "top").alias("top")))

    while not core.isEmpty():
        back = core.select(F.col("ch").alias("p"), F.col("p").alias("ch"))
        mutual = settle(core.intersect(back))
        if not mutual.isEmpty():
            to = _highest(mutual)
            core, groups = _trimmed(settle(_contracted(core, to))), told(to)
            if core.isEmpty():
                break
        above = _highest(core).withColumnRenamed("top", "color")
        one = lambda end: above.select(F.col("n").alias(end), F.col("color").alias(f"{end}_color"))
        within = settle(core.join(one("p"), "p").join(one("ch"), "ch").where("p_color = ch_color").select("p", "ch"))
        below = _highest(within.select(F.col("ch").alias("p"), F.col("p").alias("ch")))
        done = settle(below.join(above, "n").where("top = color").select("n", "top"))
        groups = told(done)
        core = _trimmed(settle(within.join(done, F.col("p") == F.col("n"), "left_anti").join(done, F.col("ch") == F.col("n"), "left_anti")))
    size = groups.groupBy("top").agg(F.count("*").alias("size")).where("size > 1").select("top")
    return groups.join(size, "top", "left_semi").select("n", "top")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """edges with in_cycle: whether both ends lie on a common cycle, that is, in one strongly connected component."""
    groups = settle(cyclic_groups(edges))
    for end in ("p", "ch"):
        edges = edges.join(groups.select(F.col("n").alias(end), F.col("top").alias(f"__{end}")), end, "left")
    same = F.coalesce(F.col("__p") == F.col("__ch"), F.lit(False))
    return edges.withColumn("in_cycle", same & (F.col("p") != F.col("ch"))).drop("__p", "__ch")


def inherit(nodes: DataFrame, edges: DataFrame, fields: list[str], rounds: int = 10) -> DataFrame:
    """nodes with null fields filled from their single quantized or mirror parent, round by round, and inherited_<field>.

    Eligible: edges of nodes that occur once as a child among them. All fields are filled in step: a round uses the
    values of the round before, and the loop ends when a round fills nothing.
    """
    only = edges.where("relation in ('quantized', 'mirror')").groupBy("ch").agg(F.count("*").alias("n"), F.first("p").alias("p")).where("n = 1").select(F.col("ch").alias("node"), "p")
    now = settle(nodes.select("node", *fields).join(only, "node", "left"))
    for _ in range(rounds):
        up = now.select(F.col("node").alias("p"), *(F.col(f).alias(f"up_{f}") for f in fields))
        gain = F.lit(False)
        for f in fields:
            gain |= F.col(f).isNull() & F.col(f"up_{f}").isNotNull()
        step = settle(now.join(up, "p", "left").withColumn("gain", gain).select("node", "p", *(F.coalesce(f, f"up_{f}").alias(f) for f in fields), "gain"))
        if step.where("gain").isEmpty():
            break
        now = step.drop("gain")
    before = nodes.select("node", *(F.col(f).alias(f"was_{f}") for f in fields))
    rows = now.drop("p").join(before, "node")
    return rows.select("node", *fields, *((F.col(f"was_{f}").isNull() & F.col(f).isNotNull()).alias(f"inherited_{f}") for f in fields))


def enriched(nodes: DataFrame, edges: DataFrame, overrides: DataFrame, fields: list[str], rounds: int = 10) -> DataFrame:
    """`inherit` with the license classes of overrides (node, cls) written as override:<cls> first, so that copies inherit them;
    license_no_override is the license without them. Overrides to 'other' and of unknown nodes do nothing."""
    plain = inherit(nodes, edges, fields, rounds).select("node", F.col("license").alias("license_no_override"))
    told = overrides.where("cls <> 'other'").groupBy("node").agg(F.min("cls").alias("to"))
    rows = nodes.join(told, "node", "left").withColumn("license", F.coalesce(F.concat(F.lit("override:"), F.col("to")), F.col("license"))).drop("to")
    return inherit(rows, edges, fields, rounds).join(plain, "node")


def children_with_descendants(edges: DataFrame, stats: DataFrame, parents: DataFrame) -> DataFrame:
    """p, node, relation, descendants: of the children of some parents (p), one row a child."""
    rows = edges.join(parents.select("p").distinct(), "p", "left_semi").groupBy("p", F.col("ch").alias("node")).agg(F.min("relation").alias("relation"))
    return rows.join(stats.select("node", "descendants"), "node", "left").select("p", "node", "relation", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def lineage_view(edges: DataFrame, stats: DataFrame, closed: DataFrame, parents: DataFrame, top: int) -> DataFrame:
    """p, rank, node, relation, descendants: of some parents the `top` children by descendants, and a row (rank top + 1, node null) for
    the rest: how many they are (relation) and how many nodes they reach together, themselves included. Subtrees overlap, so
    their union is counted, not their sum."""
    w = W.partitionBy("p").orderBy(F.desc("descendants"), "node")
    rows = children_with_descendants(edges, stats, parents).withColumn("rank", F.row_number().over(w))
    rest = rows.where(F.col("rank") > top)
    below = rest.select("p", "node").join(closed, F.col("node") == F.col("anc"), "left").select("p", F.coalesce("de", "node").alias("de"))
    union = below.groupBy("p").agg(F.count_distinct("de").alias("descendants"))
    others = rest.groupBy("p").agg(F.concat(F.count("*"), F.lit(" others")).alias("relation")).join(union, "p")
    others = others.select("p", F.lit(top + 1).alias("rank"), F.lit(None).cast("long").alias("node"), "relation", "descendants")
    return rows.where(F.col("rank") <= top).select("p", "rank", "node", "relation", "descendants").unionByName(others)
