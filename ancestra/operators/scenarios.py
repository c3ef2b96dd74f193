"""Removal scenarios: targeted, random, size-matched, by license class, and greedy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions import names
from ancestra.operators import graph, options

STRATEGIES = ["descendants", "descendant_authors", "downloads", "outdegree"]


def candidates(nodes: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Providers with children: node, the four measures that strategies rank by, and the size of their closure."""
    out = edges.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("outdegree"))
    stats = graph.descendant_stats(closed, nodes)
    rows = nodes.where("is_provider").select("node", "downloads").join(out, "node").join(stats, "node", "left")
    return rows.select("node", F.coalesce("descendants", F.lit(0)).alias("descendants"), F.coalesce("descendant_authors", F.lit(0)).alias("descendant_authors"), "downloads", "outdegree", (F.coalesce("descendants", F.lit(0)) + 1).alias("closure_size"))


def availability_size(nodes: DataFrame, edges: DataFrame, hard_closed: DataFrame, cand: DataFrame) -> DataFrame:
    """(node, availability_size): providers that a candidate's removal alone makes unavailable, itself included."""
    alone = cand.select(F.col("node").alias("scenario_id"), "node")
    removed = graph.removed_availability(edges, hard_closed, alone).join(nodes.where("is_provider").select("node"), "node", "left_semi")
    return removed.groupBy(F.col("scenario_id").alias("node")).agg(F.count("*").alias("availability_size"))


def targeted(cand: DataFrame, ks: list[int], strategies: list[str] = STRATEGIES) -> DataFrame:
    """(scenario_id, strategy, k, node): the k first of each ranking, ties by node. Only the largest k rows are ranked on."""
    out = None
    for s in strategies:
        top = cand.orderBy(F.desc(s), "node").limit(max(ks)).select("node", s)
        rank = top.withColumn("rn", F.row_number().over(W.orderBy(F.desc(s), "node")))  # max(ks) rows
        rows = rank.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rn <= k").select(F.concat(F.lit(f"{s}:"), F.col("k")).alias("scenario_id"), F.lit(s).alias("strategy"), "k", "node")
        out = rows if out is None else out.unionByName(rows)
    return out


def draw_key(*parts) -> "F.Column":
    """A pseudo-random order that any engine repeats: md5 of the parts."""
    return F.md5(F.concat_ws(":", *parts))


def draws(cand: DataFrame, n: int, *keep: str) -> DataFrame:
    return cand.select("node", *keep).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def uniform(cand: DataFrame, k: int, n: int) -> DataFrame:
    """(draw, node): k candidates at random in each draw."""
    w = W.partitionBy("draw").orderBy(draw_key(F.lit("uniform"), F.lit(k), "draw", "node"), "node")
    return draws(cand, n).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("draw", "node")


def ranked(cand: DataFrame, name: str, n: int, *keep: str) -> DataFrame:
    """(draw, node, rank, and columns to keep): a random order of all candidates in each draw."""
    w = W.partitionBy("draw").orderBy(F.unhex(draw_key(F.lit(name), "draw", "node")), "node")
    return draws(cand, n, *keep).withColumn("rank", F.row_number().over(w))


def curve(order: DataFrame, closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(draw, m, removed): providers removed by the first m candidates, for every m at which the number grows.

    A node goes with the first candidate that reaches it, so its least rank tells every prefix at once.
    """
    first = order.join(closed, F.col("node") == F.col("anc")).groupBy("draw", "de").agg(F.min("rank").alias("m"))
    first = first.join(nodes.where("is_provider").select(F.col("node").alias("de")), "de", "left_semi")
    return first.groupBy("draw", "m").agg(F.count("*").alias("n")).select("draw", "m", F.sum("n").over(W.partitionBy("draw").orderBy("m")).alias("removed"))


#: Draws that share a row of `drawn_curve`, and hex digits of a draw's order that are compared there (15 at most).
BLOCK, DIGITS = 20, 15


def drawn_curve(cand: DataFrame, edges: DataFrame, nodes: DataFrame, closed: DataFrame, weights: DataFrame, shared: DataFrame, name: str, n: int) -> DataFrame:
    """`curve` of `ranked`, by `graph.parent_closure` and `graph.counted_by_parents`.

    A row has a block of draws and the least order key of each among the candidates that reach a node, and childless nodes of one
    parent go with it. Keys are the first digits of the order; if two candidates of a draw share one, `curve` itself is taken.
    """
    from ancestra.plans.materialise import settle

    key = lambda draw: F.conv(F.substring(draw_key(F.lit(name), draw, "node"), 1, DIGITS), 16, 10).cast("long")
    blocks = cand.select("node").withColumn("block", F.explode(F.array(*map(F.lit, range(0, n, BLOCK)))))
    width = min(n, BLOCK)
    ks = [f"k{i}" for i in range(width)]
    keys = blocks.select("node", "block", *(F.when(F.col("block") + i < n, key(F.col("block") + i)).alias(k) for i, k in enumerate(ks)))
    least = [F.min(k).alias(k) for k in ks]
    first = settle(closed.join(keys.withColumnRenamed("node", "anc"), "anc").groupBy("de", "block").agg(*least))
    leaves = shared.join(first, "de").groupBy("leaf", "block").agg(*least).select("block", F.lit(1).cast("long").alias("n"), F.lit(0).alias("c"), *ks)
    rows = first.join(weights.where("n > 0"), "de").select("block", F.col("n").cast("long").alias("n"), F.lit(0).alias("c"), *ks)
    # a row of weight 0 for every candidate, so that places are counted too
    rows = rows.unionByName(leaves).unionByName(keys.select("block", F.lit(0).cast("long").alias("n"), F.lit(1).alias("c"), *ks))
    each = rows.select("block", "n", "c", F.posexplode(F.array(*ks)).alias("i", "k")).where("k is not null")
    each = each.groupBy((F.col("block") + F.col("i")).alias("draw"), "k").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    w = W.partitionBy("draw").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    points = each.select("draw", "n", F.row_number().over(W.partitionBy("draw").orderBy("k")).alias("m"), F.sum("n").over(w).alias("removed"), F.max("c").over(w).alias("c")).where("n > 0")
    points = settle(points.select("draw", "m", "removed", "c"))
    if not points.where("c > 1").isEmpty():
        return curve(ranked(cand, name, n), graph.closure(edges), nodes)
    return points.drop("c")


def matched(points: DataFrame, target: int, tolerance: float = 0.95, nearest: bool = False) -> DataFrame:
    """(draw, m, removed): the first prefix that removes tolerance * target providers, or the one nearest to target."""
    w = W.partitionBy("draw").orderBy("m")
    rows = points.withColumns({"before": F.lag("removed").over(w), "before_m": F.lag("m").over(w)})
    goal = target if nearest else tolerance * target
    hit = rows.where(F.col("removed") >= goal).groupBy("draw").agg(F.min(F.struct("m", "removed", "before", "before_m")).alias("x")).select("draw", "x.*")
    whole = points.groupBy("draw").agg(F.max(F.struct("m", "removed")).alias("x")).select("draw", F.col("x.m").alias("all_m"), F.col("x.removed").alias("all_removed"))
    rows = whole.join(hit, "draw", "left")
    back = (F.col("removed") - target > target - F.col("before")) if nearest else F.lit(False)
    back = F.coalesce(back, F.lit(False))
    # one step back is the whole prefix before the step that grew: its last candidate is m - 1
    return rows.select("draw", F.when(F.col("m").isNull(), F.col("all_m")).when(back, F.col("m") - 1).otherwise(F.col("m")).alias("m"), F.when(F.col("m").isNull(), F.col("all_removed")).when(back, F.col("before")).otherwise(F.col("removed")).alias("removed"))


def bin_matched(cand: DataFrame, target: DataFrame, n: int) -> DataFrame:
    """(draw, node): at random, as many of each log2 size bin as the targets (node) have, targets left out.

    A bin with too few others draws from all bins from the one below it on, targets left out (so a node may be drawn for two
    bins of a draw: it counts once); of each draw at most as many rows as there are targets are kept, smallest bins first.
    """
    binned = cand.withColumn("bin", names.log2_bin(F.col("descendants")))
    chosen = target.select("node").distinct()
    wanted = binned.join(chosen, "node", "left_semi").groupBy("bin").agg(F.count("*").alias("wanted"))
    rest = binned.join(chosen, "node", "left_anti").select("node", "bin")
    there = rest.groupBy("bin").agg(F.count("*").alias("there"))
    wanted = wanted.join(there, "bin", "left").select(F.col("bin").alias("for_bin"), "wanted", F.when(F.coalesce("there", F.lit(0)) >= F.col("wanted"), F.col("bin")).otherwise(None).alias("own"))
    fits = (F.col("bin") == F.col("own")) | (F.col("own").isNull() & (F.col("bin") >= F.col("for_bin") - 1))
    pool = rest.join(F.broadcast(wanted), fits).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # at most 64 bins
    w = W.partitionBy("draw", "for_bin").orderBy(draw_key(F.lit("bin"), "draw", "node"), "node")
    rows = pool.withColumn("rn", F.row_number().over(w)).where("rn <= wanted")
    total = wanted.agg(F.sum("wanted").alias("k"))
    first = W.partitionBy("draw").orderBy("for_bin", "rn")  # a draw has as many rows as there are targets
    rows = rows.withColumn("at", F.row_number().over(first)).join(F.broadcast(total), how="cross").where("at <= k")  # one row
    return rows.select("draw", "node").distinct()


def growing_start(cand: DataFrame, target: int, name: str, n: int) -> DataFrame:
    """(draw, m, all): the first place of `ranked` up to which the sizes (node, size) add up to target, or one behind the last; how
    many places there are. Sizes are summed by the first digits of the order; only rows of the digits that reach the target are sorted.
    """
    from ancestra.plans.materialise import settle

    order = draw_key(F.lit(name), "draw", "node")
    rows = draws(cand, n, "size").withColumn("bin", F.substring(order, 1, 3))
    bins = settle(rows.groupBy("draw", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n")))  # 4,096 a draw at most
    w = W.partitionBy("draw").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.select("draw", "bin", F.sum("size").over(w).alias("sum"), F.sum("n").over(w).alias("last"), (F.sum("size").over(w) - F.col("size")).alias("before"), (F.sum("n").over(w) - F.col("n")).alias("done"))
    reached = bins.where(F.col("sum") >= target).groupBy("draw").agg(F.min(F.struct("bin", "before", "done")).alias("x")).select("draw", "x.*")
    within = rows.join(F.broadcast(reached), ["draw", "bin"]).withColumn("order", F.unhex(order))  # a row a draw
    sums = within.select("draw", "done", (F.col("before") + F.sum("size").over(W.partitionBy("draw").orderBy("order", "node").rowsBetween(W.unboundedPreceding, 0))).alias("sum"))
    found = sums.groupBy("draw").agg((F.first("done") + F.count_if(F.col("sum") < target) + 1).alias("m"))
    whole = bins.groupBy("draw").agg(F.max("last").alias("all"))
    return whole.join(found, "draw", "left").select("draw", F.coalesce("m", F.col("all") + 1).alias("m"), "all")


def growing_prefix(points: DataFrame, sizes: DataFrame | None, target: int, tolerance: float = 0.95, growth: float = 1.15, start: DataFrame | None = None) -> DataFrame:
    """(draw, m, removed): the first prefix of the sequence m, int(growth * m) + 1, ... that removes tolerance * target
    providers, or all candidates; the sequence starts where the sizes (draw, rank, size) of single closures first add up to
    the target, or where `growing_start` told. `points` are those of `curve`, so a step is a look-up in it and not another removal.
    """
    if start is None:
        reached = sizes.withColumn("sum", F.sum("size").over(W.partitionBy("draw").orderBy("rank")))
        start = reached.groupBy("draw").agg((F.count_if(F.col("sum") < target) + 1).alias("m"), F.max("rank").alias("all"))
    start = start.select("draw", F.least("m", "all").alias("m"), "all")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)), F.array("m"),
        lambda acc, _: F.when(F.element_at(acc, -1) >= F.col("all"), acc).otherwise(F.concat(acc, F.array(F.least(F.col("all"), F.floor(F.element_at(acc, -1) * growth).cast("long") + 1)))),
    )
    tried = start.select("draw", "all", steps.alias("ms"))
    # a point counts from the first step on that is not in front of it; of those of a step the greatest does
    step = F.try_element_at(F.filter("ms", lambda x: x >= F.col("m")), F.lit(1))
    most = points.join(F.broadcast(tried), "draw").groupBy("draw", step.alias("at")).agg(F.max("removed").alias("removed"))  # a row a draw
    rows = tried.select("draw", "all", F.explode("ms").alias("m")).join(most.select(F.col("draw").alias("d"), "at", "removed"), (F.col("draw") == F.col("d")) & (F.col("m") == F.col("at")), "left")
    got = F.coalesce(F.max("removed").over(W.partitionBy("draw").orderBy("m").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    fine = rows.withColumn("got", got).where((F.col("got") >= tolerance * target) | (F.col("m") >= F.col("all")))
    return fine.groupBy("draw").agg(F.min(F.struct("m", F.col("got").alias("removed"))).alias("x")).select("draw", "x.*")


def license_removals(nodes: DataFrame, closed: DataFrame, classes: list[str]) -> DataFrame:
    """(scenario_id, removed_class, node): all providers of a class and their legal closure."""
    seeds = nodes.where(F.col("is_provider") & F.col("cls").isin(classes)).select(F.concat(F.lit("license:"), F.col("cls")).alias("scenario_id"), "node")
    return graph.removed_legal(closed, seeds).withColumn("removed_class", F.substring("scenario_id", 9, 99))


def greedy(cand: DataFrame, closed: DataFrame, nodes: DataFrame, k: int, pool: int = 2000) -> list[int]:
    """k candidates, each the one that loses most options given those before (ties: the smaller node).

    The pool is the union of the first `pool` by descendants and by authors. A step is one job: the marginal loss of
    all candidates; only the best one comes to the driver.
    """
    from ancestra.plans.materialise import settle

    best = cand.orderBy(F.desc("descendants"), "node").limit(pool).unionByName(cand.orderBy(F.desc("descendant_authors"), "node").limit(pool)).select("node").distinct()
    p = settle(options.pairs(nodes, "strict"))
    reach_ = settle(closed.join(best, F.col("anc") == F.col("node"), "left_semi").select(F.col("anc").alias("cand"), F.col("de").alias("node")).unionByName(best.select(F.col("node").alias("cand"), "node")).distinct())
    chosen: list[int] = []
    alive = p
    for _ in range(k):
        left = options.providers(alive).select(*options.OPTION, "providers")
        hit = reach_.join(alive, "node").groupBy("cand", *options.OPTION).agg(F.count("*").alias("n"))
        gain = hit.join(left, options.OPTION).where("n = providers").groupBy("cand").agg(F.count("*").alias("gain"))
        row = best.where(~F.col("node").isin(chosen)).join(gain, F.col("node") == F.col("cand"), "left").orderBy(F.desc(F.coalesce("gain", F.lit(0))), "node").first()
        if row is None:
            break
        chosen.append(row.node)
        alive = settle(alive.join(reach_.where(F.col("cand") == row.node).select("node"), "node", "left_anti"))
    return chosen


def stratified_sample(rows: DataFrame, key: str, strata: dict[str, tuple], seen: DataFrame, name: str = "sample") -> DataFrame:
    """(key, stratum): of each stratum (condition, n) the first n rows by hash order that no earlier stratum took and `seen` hasn't."""
    rest = rows.join(seen.select(key), key, "left_anti").withColumn("__h", F.md5(F.concat_ws(":", F.lit(name), F.col(key).cast("string"))))
    out = None
    for stratum, (condition, n) in strata.items():
        left = rest if out is None else rest.join(out.select(key), key, "left_anti")
        took = left.where(condition).orderBy("__h", key).limit(n).select(key, F.lit(stratum).alias("stratum"))
        out = took if out is None else out.unionByName(took)
    return out
