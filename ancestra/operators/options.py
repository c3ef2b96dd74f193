"""Functional options (task, language, license class): who provides them, and what a removal costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions.licenses import commercial

OPTION = ["task", "lang", "cls"]


def pairs(nodes: DataFrame, definition: str = "full") -> DataFrame:
    """(node, task, lang, cls, downloads) of providers. coarse: lang is '*', still a row for each language."""
    rows = nodes.where("is_provider").select("node", F.coalesce("task", F.lit("unk")).alias("task"), F.explode(F.split(F.coalesce("languages", F.lit("unk")), ",")).alias("lang"), "cls", "downloads")
    return rows.withColumn("lang", F.lit("*")) if definition == "coarse" else rows


def providers(p: DataFrame) -> DataFrame:
    return p.groupBy(*OPTION).agg(F.count("*").alias("providers"), F.sum("downloads").alias("downloads"), F.max("downloads").alias("best"))


def survivors(p: DataFrame, removed: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Of each scenario and option: providers, downloads, best before; lost and best_after. A removal is aggregated to options before it meets them."""
    total = providers(p)
    gone = removed.join(p, "node").groupBy("scenario_id", *OPTION).agg(F.count("*").alias("gone"))
    touched = gone.select("scenario_id", *OPTION)
    left = p.join(touched, OPTION).join(removed, ["scenario_id", "node"], "left_anti").groupBy("scenario_id", *OPTION).agg(F.max("downloads").alias("best_left"))
    every = total.join(scenarios.select("scenario_id").distinct(), how="cross")  # a row a scenario: what is reported
    out = every.join(gone, ["scenario_id", *OPTION], "left").join(left, ["scenario_id", *OPTION], "left")
    return out.withColumns({"remaining": F.col("providers") - F.coalesce("gone", F.lit(0)), "best_after": F.when(F.col("gone").isNull(), F.col("best")).otherwise(F.coalesce("best_left", F.lit(0)))}).drop("gone", "best_left")


def touched_loss(p: DataFrame, removed: DataFrame, scenarios: DataFrame, definition: str = "full", strict: bool = False) -> DataFrame:
    """What `loss` of `survivors` gives, by way of the options that a removal touches alone: an option none of whose
    providers goes is not lost, so counts of all options are totals and the rows follow the removals, not scenarios x options.
    """
    total = providers(p).select(*OPTION, "providers", "downloads")
    com = commercial(F.col("cls"), strict)
    gone = removed.join(p, "node").groupBy("scenario_id", *OPTION).agg(F.count("*").alias("gone"))
    if definition == "full":
        # what is left of a group's options of unknown language, and of all of them
        whole = total.groupBy("task", "cls").agg(F.sum("providers").alias("all"), F.sum(F.when(F.col("lang") == "unk", F.col("providers")).otherwise(0)).alias("unk"))
        group = gone.groupBy("scenario_id", "task", "cls").agg(F.sum("gone").alias("all_gone"), F.sum(F.when(F.col("lang") == "unk", F.col("gone")).otherwise(0)).alias("unk_gone"))
        group = group.join(whole, ["task", "cls"]).select("scenario_id", "task", "cls", (F.col("all") == F.col("all_gone")).alias("none_left"), (F.col("unk") == F.col("unk_gone")).alias("no_unk_left"))
        rows = gone.join(total, OPTION).join(group, ["scenario_id", "task", "cls"])
        lost = rows.where(F.when(F.col("lang") == "unk", F.col("none_left")).otherwise((F.col("gone") == F.col("providers")) & F.col("no_unk_left")))
    else:
        lost = gone.join(total, OPTION).where("gone = providers")
    per = lost.groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("downloads").alias("d"), F.count(F.when(com, 1)).alias("c"))
    sums = total.agg(F.count("*").alias("options_total"), F.sum("downloads").alias("all_d"), F.count(F.when(com, 1)).alias("all_c"))
    rows = scenarios.select("scenario_id").distinct().join(per, "scenario_id", "left").join(sums, how="cross")  # one row
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: 100.0 * a / F.greatest(b, F.lit(1))
    return rows.select(
        "scenario_id", "options_total", n("n").alias("options_lost"), ratio(n("n"), F.col("options_total")).alias("pct_options_lost"),
        ratio(n("d"), F.col("all_d")).alias("pct_demand_lost"), ratio(n("c"), F.col("all_c")).alias("pct_commercial_lost"),
    )


def with_loss(options: DataFrame, definition: str = "full") -> DataFrame:
    """A column lost. full: an unknown language stands for any: a known one survives by it, and it by any of its group."""
    if definition != "full":
        return options.withColumn("lost", F.col("remaining") == 0)
    group = W.partitionBy("scenario_id", "task", "cls")
    unk = F.sum(F.when(F.col("lang") == "unk", F.col("remaining")).otherwise(0)).over(group)
    whole = F.sum("remaining").over(group)
    return options.withColumn("lost", F.when(F.col("lang") == "unk", whole == 0).otherwise((F.col("remaining") == 0) & (unk == 0)))


def loss(options: DataFrame, definition: str = "full", removed_class: bool = False, strict: bool = False) -> DataFrame:
    """A row a scenario: options_total, options_lost, pct, demand- and commercially weighted; collateral: without the removed class."""
    rows = with_loss(options, definition)
    ratio = lambda a, b: 100.0 * a / F.greatest(b, F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    lost, com = F.col("lost"), commercial(F.col("cls"), strict)
    out = [
        F.count("*").alias("options_total"),
        n(lost).alias("options_lost"),
        ratio(n(lost), F.count("*")).alias("pct_options_lost"),
        ratio(F.sum(F.when(lost, F.col("downloads")).otherwise(0)), F.sum("downloads")).alias("pct_demand_lost"),
        ratio(n(lost & com), n(com)).alias("pct_commercial_lost"),
    ]
    if removed_class:
        other = F.col("cls") != F.col("removed_class")
        out += [n(lost & other).alias("collateral_options_lost"), ratio(n(lost & other), n(other)).alias("pct_collateral_options_lost"), ratio(n(lost & other & com), n(other & com)).alias("pct_collateral_commercial_lost")]
    return rows.groupBy("scenario_id").agg(*out)


def node_losses(removed: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row a scenario: models_lost (providers), models_lost_incl_flagged (all nodes), pct_downloads_lost of all downloads."""
    per = removed.join(nodes.select("node", "is_provider", "downloads"), "node").groupBy("scenario_id").agg(
        F.count_if("is_provider").alias("models_lost"), F.count("*").alias("models_lost_incl_flagged"), F.sum(F.coalesce("downloads", F.lit(0))).alias("gone")
    )
    total = nodes.agg(F.sum(F.coalesce("downloads", F.lit(0))).alias("total"))
    return per.join(total, how="cross").select("scenario_id", "models_lost", "models_lost_incl_flagged", (100.0 * F.col("gone") / F.greatest("total", F.lit(1))).alias("pct_downloads_lost"))  # one row


def degradation(options: DataFrame, definition: str = "full") -> DataFrame:
    """A row a scenario: share of options whose best surviving downloads fall below a tenth, and the demand-weighted fall."""
    rows = options
    if definition == "full":
        group = W.partitionBy("scenario_id", "task", "cls")
        for c in ("best", "best_after"):
            unk = F.max(F.when(F.col("lang") == "unk", F.col(c))).over(group)
            rows = rows.withColumn(f"{c}_w", F.when(F.col("lang") == "unk", F.max(c).over(group)).otherwise(F.greatest(F.col(c), unk)))
    else:
        rows = rows.withColumns({"best_w": F.col("best"), "best_after_w": F.col("best_after")})
    rows = rows.where("best_w > 0").withColumn("ratio", F.col("best_after_w") / F.col("best_w"))
    return rows.groupBy("scenario_id").agg(
        F.bround(100.0 * F.avg((F.col("ratio") < 0.1).cast("int")), 6).alias("pct_options_degraded90"),
        F.bround(100.0 * F.sum(F.col("downloads") * (1 - F.col("ratio"))) / F.greatest(F.sum("downloads"), F.lit(1)), 6).alias("pct_demand_degraded"),
    )


def lineage_counts(p: DataFrame, roots: DataFrame, definition: str = "full") -> DataFrame:
    """Distinct roots of each option's providers; full: with those of providers of unknown language in its group."""
    rows = p.join(roots, "node").select(*OPTION, "root").distinct()
    if definition == "full":
        options = rows.select(*OPTION).distinct()
        unk = rows.where("lang = 'unk'").select("task", "cls", "root")
        known = options.where("lang <> 'unk'").join(unk, ["task", "cls"]).select(*OPTION, "root")
        whole = rows.where("lang <> 'unk'").select("task", F.lit("unk").alias("lang"), "cls", "root").join(options.where("lang = 'unk'"), OPTION, "left_semi")
        rows = rows.unionByName(known).unionByName(whole)
    return rows.groupBy(*OPTION).agg(F.count_distinct("root").alias("n_root_lineages"))
