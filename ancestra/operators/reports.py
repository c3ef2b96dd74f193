"""Named report queries over the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions import names


def bucket_table(definitions: dict[str, DataFrame], column: str = "n_root_lineages") -> DataFrame:
    """A row for each definition of options: shares of options with 1, 2-5, 6-20 and more lineages, and their number."""
    out = None
    for name, counts in definitions.items():
        some = counts.where(F.col(column) > 0)
        row = bucket_shares(some, column).join(some.agg(F.count("*").alias("options")), how="cross").withColumn("definition", F.lit(name))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def bucket_shares(counts: DataFrame, column: str = "n_root_lineages") -> DataFrame:
    share = lambda b: F.bround(100.0 * F.avg((F.coalesce(names.size_bucket(F.col(column)) == b, F.lit(False))).cast("int")), 4)
    return counts.agg(share("1").alias("one"), share("2-5").alias("two_to_five"), share("6-20").alias("six_to_twenty"), share(">20").alias("over_twenty"))


def degree_ccdf(edges: DataFrame) -> DataFrame:
    """children, n, share of parents with at least so many children."""
    per = edges.groupBy("p").agg(F.count("*").alias("children")).groupBy("children").agg(F.count("*").alias("n"))
    w = W.orderBy("children")  # distinct degrees: few rows, and aggregated
    before = F.sum("n").over(w) - F.col("n")
    return per.select("children", "n", F.bround(1 - before / F.sum("n").over(W.partitionBy(F.lit(1))), 9).alias("ccdf"))


def relations_by_year(edges: DataFrame, nodes: DataFrame, kinds: list[str], since: int) -> DataFrame:
    at = nodes.select(F.col("node").alias("ch"), F.year("created_at").alias("year"))
    kind = F.when(F.col("relation").isin(kinds), F.col("relation")).otherwise("other")
    rows = edges.join(at, "ch").where(F.col("year") >= since).withColumn("kind", kind)
    return rows.groupBy("year").pivot("kind", [*kinds, "other"]).count().na.fill(0)


def concentration(roots: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """The accounts whose roots most derived providers hang on: rank, derived, share, and the share of the union up to each rank."""
    acc = nodes.select(F.col("node").alias("root"), names.company(F.col("author")).alias("account"))
    rows = roots.where("node <> root").join(nodes.where("is_provider").select("node"), "node", "left_semi").join(acc, "root").select("node", "account").distinct()
    per = rows.groupBy("account").agg(F.count("*").alias("derived"))
    ranks = per.orderBy(F.desc("derived"), "account").limit(top).withColumn("rank", F.row_number().over(W.orderBy(F.desc("derived"), "account")))  # `top` rows
    total = rows.agg(F.count_distinct("node").alias("total"))
    first = rows.join(F.broadcast(ranks), "account").groupBy("node").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("new"))
    out = ranks.join(first, "rank", "left").join(total, how="cross")  # one row
    union = F.sum(F.coalesce("new", F.lit(0))).over(W.orderBy("rank"))
    return out.select("rank", "account", "derived", F.bround(100.0 * F.col("derived") / F.col("total"), 6).alias("share"), F.bround(100.0 * union / F.col("total"), 6).alias("union_share"))


def cleaning_effect(edges: DataFrame, kept: DataFrame, top: int = 8) -> DataFrame:
    """Children of each parent before and after cleaning, min-ranks, share removed; the first `top` of the old ranks."""
    a = edges.groupBy("p").agg(F.count("*").alias("before"))
    b = edges.join(kept.select(F.col("node").alias("ch")), "ch", "left_semi").groupBy("p").agg(F.count("*").alias("after"))
    rows = a.join(b, "p", "full_outer").select("p", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    counts = rows.groupBy("after").agg(F.count("*").alias("n"))  # ranks by counts of values, not by a sort of all rows
    after = counts.select("after", (F.sum("n").over(W.orderBy(F.desc("after"))) - F.col("n") + 1).alias("rank_after"))
    counts = rows.groupBy("before").agg(F.count("*").alias("n"))
    before = counts.select("before", (F.sum("n").over(W.orderBy(F.desc("before"))) - F.col("n") + 1).alias("rank_before"))
    first = rows.orderBy(F.desc("before"), "p").limit(top)
    return first.join(before, "before").join(after, "after").select("p", "before", "after", "rank_before", "rank_after", F.bround(100.0 * (F.col("before") - F.col("after")) / F.greatest("before", F.lit(1)), 4).alias("pct_removed"))


def license_summary(nodes: DataFrame) -> DataFrame:
    """cls, nodes, share, licenses (ids of the class)."""
    total = nodes.agg(F.count("*").alias("total"))
    per = nodes.groupBy("cls").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))  # a class has tens of ids
    return per.join(total, how="cross").select("cls", "n", F.bround(100.0 * F.col("n") / F.col("total"), 4).alias("share"), "licenses")  # one row


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of headline counts and shares, degrees of parents among them."""
    null = lambda c: F.count_if(F.col(c).isNull())
    n = nodes.agg(
        F.count("*").alias("nodes"), F.count_if("is_provider").alias("providers"), F.count_distinct("author").alias("authors"), null("license").alias("without_license"), null("languages").alias("without_languages"),
        null("task").alias("without_task"), null("created_at").alias("without_date"), F.sum("downloads").alias("downloads"), F.count_if(F.coalesce("downloads", F.lit(0)) == 0).alias("without_downloads"),
        F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"),
    )
    kinds = ("finetune", "adapter", "quantized", "merge", "mirror")
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("p").alias("parents"), F.count_distinct("ch").alias("children"), *(F.count_if(F.col("relation") == k).alias(f"{k}_edges") for k in kinds))
    degree = edges.groupBy("p").agg(F.count("*").alias("d")).agg(F.max("d").alias("most_children"), F.bround(F.avg("d"), 6).alias("mean_children"), F.count_if(F.col("d") >= 10).alias("parents_of_10"))
    merges = edges.groupBy("ch").agg(F.count("*").alias("d")).agg(F.count_if(F.col("d") > 1).alias("with_several_parents"))
    return n.join(e, how="cross").join(degree, how="cross").join(merges, how="cross")  # one row each


def missing_parents(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, absent, least_children: int = 20) -> DataFrame:
    """Of absent parents with so many children: their children (all, providers), first and last one, downloads; copies of the same
    name, the most downloaded one with its date and children; and the options of the children that other providers still have.

    nodes: node, nm (name without owner), created_at, downloads, is_provider; pairs: node and option columns of providers.
    """
    missing = edges.where(absent).select("p", "ch")
    size = missing.groupBy("p").agg(F.count("*").alias("children")).where(F.col("children") >= least_children)
    child = nodes.select(F.col("node").alias("ch"), "created_at", "downloads", "is_provider")
    kids = missing.join(size.select("p"), "p", "left_semi").distinct().join(child, "ch")
    told = kids.groupBy("p").agg(F.count_if("is_provider").alias("provider_children"), F.min("created_at").alias("first_child"), F.max("created_at").alias("last_child"), F.sum(F.coalesce("downloads", F.lit(0))).alias("children_downloads"))
    # copies: nodes of the parent's name other than itself, and of these the first by downloads
    parent = nodes.select(F.col("node").alias("p"), "nm").join(size.select("p"), "p", "left_semi")
    there = edges.where(~absent).groupBy(F.col("p").alias("copy")).agg(F.count("*").alias("copy_children"))
    copies = parent.join(nodes.select(F.col("node").alias("copy"), "nm", F.col("downloads").alias("copy_downloads"), F.col("created_at").alias("copy_created")), "nm").where("copy <> p")
    best = copies.groupBy("p").agg(F.count("*").alias("same_name_copies"), F.min(F.struct(-F.col("copy_downloads"), "copy", "copy_created")).alias("x"))
    best = best.select("p", "same_name_copies", F.col("x.copy").alias("copy"), F.col("x.copy_created").alias("copy_created")).join(there, "copy", "left")
    # an option is still provided if it has more providers than the parent's children among them
    option = [c for c in pairs.columns if c not in ("node", "downloads")]
    whole = pairs.groupBy(*option).agg(F.count_distinct("node").alias("providers"))
    own = kids.select("p", F.col("ch").alias("node")).join(pairs, "node").groupBy("p", *option).agg(F.count_distinct("node").alias("own"))
    options = own.join(whole, option).groupBy("p").agg(F.count("*").alias("options_of_children"), F.bround(100.0 * F.avg((F.col("providers") > F.col("own")).cast("int")), 4).alias("pct_options_elsewhere"))
    rows = size.join(told, "p", "left").join(best, "p", "left").join(options, "p", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "p", "children", n("provider_children"), "first_child", "last_child", n("children_downloads"), n("same_name_copies"),
        F.col("copy").alias("top_copy"), F.col("copy_created").alias("top_copy_created"), n("copy_children"), n("options_of_children"), "pct_options_elsewhere",
    )


def rq2_table(tests: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """A row for each shock and strategy, with the reference rows 'greedy' and 'random': per k the loss, and 'ratio (percentile)'
    with a star where the test rejects; '--' where both losses are 0."""
    ratio = F.when((F.col("null_mean") == 0) & (F.col("observed") == 0), F.lit("--")).otherwise(
        F.concat(F.when(F.col("ratio_vs_matched") == float("inf"), "inf").otherwise(F.call_function("format_number", "ratio_vs_matched", F.lit("0.00"))), F.lit(" ("), F.call_function("format_number", 100 * F.col("percentile_in_null"), F.lit("0")), F.lit(")"), F.when(F.col("reject"), "*").otherwise(""))
    )
    rows = tests.select(*keys, "strategy", "k", F.bround("observed", 6).alias("loss"), ratio.alias("ratio"))
    once = tests.groupBy(*keys, "k").agg(F.max("greedy_ref").alias("greedy"), F.max("uniform_mean").alias("random"))
    for name in ("greedy", "random"):
        rows = rows.unionByName(once.where(F.col(name).isNotNull()).select(*keys, F.lit(name).alias("strategy"), "k", F.bround(name, 6).alias("loss"), F.lit(None).cast("string").alias("ratio")))
    wide = rows.groupBy(*keys, "strategy").pivot("k", ks).agg(F.max("loss").alias("loss"), F.max("ratio").alias("ratio"))
    return wide.select(*keys, "strategy", *(F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in ks for c in ("loss", "ratio")))


def in_order(table: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The rows of a fixed list of names, with their place in it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column)).cast("int")
    return table.withColumn("place", place).where("place > 0")


def robustness(verdicts: DataFrame, base: str) -> DataFrame:
    """verdicts (variant, hypothesis, value, supported) with whether a variant's verdict differs from the base's."""
    told = verdicts.where(F.col("variant") == base).select("hypothesis", F.col("supported").alias("base"))
    return verdicts.join(told, "hypothesis", "left").select("variant", "hypothesis", "value", "supported", F.coalesce(F.col("supported") != F.col("base"), F.lit(False)).alias("flips"))


def detectable_ranges(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the least and largest null mean and detectable excess, and the largest observed excess."""
    low, high = F.min, F.max
    return effects.groupBy(*keys).agg(
        low("null_mean").alias("null_mean_low"), high("null_mean").alias("null_mean_high"), low("min_detectable_excess").alias("excess_low"),
        high("min_detectable_excess").alias("excess_high"), high("observed_minus_null").alias("observed_minus_null"),
    )


def size_ratios(nulls: DataFrame, targets: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Quantiles of the draws' removed nodes over their target's, which is joined by keys such as (k, strategy)."""
    rows = nulls.join(targets, keys).withColumn("ratio", F.col("removed") / F.nullif("target", F.lit(0)))
    q = lambda p: F.bround(F.percentile("ratio", F.lit(p)), 6)
    return rows.groupBy(*by).agg(q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95"), F.bround(F.max("ratio"), 6).alias("largest"))


def differences(nulls: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observed loss less the mean of its null (value), the null's 2.5 and 97.5 percentiles, and the median of removed over target size."""
    rows = nulls.join(observed, keys)
    q = lambda c, p: F.bround(F.percentile(c, F.lit(p)), 6)
    return rows.withColumn("ratio", F.col("removed") / F.nullif("target", F.lit(0))).groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.bround(F.avg("value"), 6).alias("null_mean"), F.bround(F.max("observed") - F.avg("value"), 6).alias("difference"),
        q("value", 0.025).alias("p025"), q("value", 0.975).alias("p975"), q("ratio", 0.5).alias("median_size_ratio"),
    )


def single_shares(counts: DataFrame, views: dict) -> DataFrame:
    """view, share (of options with one lineage, in percent), n_options, for filters or other counts of options: view -> (column, condition).

    One pass: an option is a row for each view that it is in.
    """
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(c).alias("n"), cond.alias("ok")) for v, (c, cond) in views.items()))).alias("x")
    rows = counts.select(each).select("x.*").where("ok and n > 0")
    return rows.groupBy("view").agg(F.bround(100.0 * F.avg((F.col("n") == 1).cast("int")), 6).alias("share"), F.count("*").alias("n_options"))


def companies(concentration_: DataFrame, mapping: DataFrame) -> DataFrame:
    """rank, company, accounts (of the map, else itself), share, union_share."""
    listed = mapping.groupBy(F.col("company").alias("account")).agg(F.array_join(F.array_sort(F.collect_set("member")), ", ").alias("accounts"))  # a map of tens of rows
    return concentration_.join(listed, "account", "left").select("rank", F.col("account").alias("company"), F.coalesce("accounts", "account").alias("accounts"), "share", "union_share")


def cleaning_reasons(flags: DataFrame, reasons: list[str]) -> DataFrame:
    """reason, nodes, share: how many nodes have each flag (flags overlap)."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("hit")) for r in reasons))).alias("x")
    return flags.select(each).select("x.*").groupBy("reason").agg(F.count_if("hit").alias("nodes"), F.bround(100.0 * F.avg(F.col("hit").cast("int")), 4).alias("share"))


def tier_sizes(flags: DataFrame, edges: DataFrame) -> DataFrame:
    """tier, nodes, share, edges (by child), excluded_with_children (nodes outside the tier that have children)."""
    parents = edges.groupBy(F.col("parent_id").alias("model_id")).agg(F.count("*").alias("as_parent"))
    children = edges.groupBy(F.col("child_id").alias("model_id")).agg(F.count("*").alias("as_child"))
    rows = flags.join(parents, "model_id", "left").join(children, "model_id", "left")
    tiers = {"T0": F.lit(True), "T1": F.col("in_T1"), "T2": F.col("in_T2")}
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), c.alias("in_tier")) for t, c in tiers.items()))).alias("x")
    rows = rows.select(each, F.coalesce("as_child", F.lit(0)).alias("as_child"), F.col("as_parent").isNotNull().alias("has_children")).select("x.*", "as_child", "has_children")
    return rows.groupBy("tier").agg(
        F.count_if("in_tier").alias("nodes"), F.bround(100.0 * F.avg(F.col("in_tier").cast("int")), 4).alias("share"),
        F.sum(F.when(F.col("in_tier"), F.col("as_child")).otherwise(0)).alias("edges"), F.count_if(~F.col("in_tier") & F.col("has_children")).alias("excluded_with_children"),
    )


def top_parents(flags: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The parents with most children: children, share of them outside T1, children in T1."""
    child = flags.select(F.col("model_id").alias("child_id"), (~F.col("in_T1")).alias("out"))
    rows = edges.join(child, "child_id", "left").groupBy("parent_id").agg(F.count("*").alias("children"), F.count_if("out").alias("excluded"))
    return rows.orderBy(F.desc("children"), "parent_id").limit(top).select("parent_id", "children", F.bround(100.0 * F.col("excluded") / F.col("children"), 4).alias("pct_excluded"), (F.col("children") - F.col("excluded")).alias("children_T1"))


def inference_summary(edges_all: DataFrame) -> DataFrame:
    """source, edges, violations (against time), children, in_cycles, reconnected: a row for each source of edges."""
    return edges_all.groupBy("source").agg(
        F.count("*").alias("edges"), F.count_if(~F.col("temporal_ok")).alias("violations"), F.count_distinct("child_id").alias("children"),
        F.count_if("in_cycle").alias("in_cycles"), F.count_if(F.col("parent_resolution").isNotNull()).alias("reconnected"),
    )


def inference_examples(edges_all: DataFrame, n: int = 5) -> DataFrame:
    """The first edges of each inferred source."""
    w = W.partitionBy("source").orderBy("parent_id", "child_id")
    return edges_all.where("source <> 'declared'").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("source", "rn", "parent_id", "child_id")


def filled(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """field, missing_before, missing_after, filled: what inheritance gave (after has inherited_<field>)."""
    count = lambda df, cond, name: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), cond(f).alias("hit")) for f in fields))).alias("x")).select("x.*").groupBy("field").agg(F.count_if("hit").alias(name))
    null = lambda f: F.col(f).isNull()
    rows = count(before, null, "missing_before").join(count(after, null, "missing_after"), "field")
    return rows.join(count(after, lambda f: F.col(f"inherited_{f}"), "filled"), "field")


def null_bands(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return values.groupBy(*keys).agg(F.count("*").alias("n"), F.bround(F.avg(value), 6).alias("mean"), F.bround(q(0.025), 6).alias("p025"), F.bround(q(0.05), 6).alias("p05"), F.bround(q(0.5), 6).alias("median"), F.bround(q(0.95), 6).alias("p95"), F.bround(q(0.975), 6).alias("p975"), F.max(value).alias("largest"))


def contrast(tests: DataFrame, keys: list[str], providers: int, floor: float) -> DataFrame:
    """Per strategy and k the share of providers removed, the loss, and its null's 5 to 95 percent band, at least `floor`."""
    return tests.select(*keys, "strategy", "k", (100.0 * F.col("removed_providers") / providers).alias("pct_providers"), "observed", F.greatest("p05", F.lit(floor)).alias("low"), F.greatest("null_p95", F.lit(floor)).alias("high"))


def clamped(ratio, low: float, high: float):
    """Ratios for a log axis: infinity at the top, what isn't positive at the bottom."""
    return F.when(ratio == float("inf"), F.lit(high)).when(ratio <= 0, F.lit(low)).otherwise(ratio)
