"""Quality rules with thresholds learnt from the data, in DataFrame functions only.

Fixed base rules come first. The others compare a statistic of a document with its language and source: each
(lang, source) has a KLL quantile sketch of each statistic; a source of under `least_rows` documents uses the
merged sketches of its language, a language of under `least_rows` those of all. A document fails above

    median + reach * max(upper quartile - median, spread)

of the group it is measured by (mean word length also below the mirrored bound). With `learnt`, spreads
reach to a tail quantile (LEARNT) of the group, or of its language where the group's quartile is its median, and
their least is LEARNT's: a statistic that is 0 for nearly all of a language has a threshold near 0. Sketches are partly built where
the rows are, so a source that holds a third of them is no hot spot; thresholds are joined back by group.

Null texts count as empty (base_failed, as n_words < 10); null languages and sources are groups of their own.
Rows that repeat an id are judged on their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.llm.corpus import settled

#: Statistic, least spread that counts, whether low values fail too.
STATISTICS = (("symbols_per_word", 0.1, False), ("mean_word_chars", 0.75, True), ("dup_line_share", 0.1, False))
#: Tail quantile (mirrored below the median) and least spread of learnt thresholds, chosen by the labels of sf0.1.
LEARNT = {"symbols_per_word": (0.9, 0.01), "mean_word_chars": (0.9, 0.05), "dup_line_share": (0.98, 0.01)}
REACH = 5.0
LEAST_ROWS = 30
#: Size parameter of the sketches: exact up to so many rows, rank error about 2 / k beyond.
SKETCH_K = 1024

WORD = r"[^\x20\x09-\x0D]+"


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of `window` words that occur twice or more in the array."""
    at = lambda i, k: F.get(words, i + k)
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*(at(i, k) for k in range(window))))
    found = F.transform(
        F.array(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.get(found, F.lit(0)),
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    return F.when(F.size(words) <= window, F.lit(0)).when(F.size(F.array_distinct(grams)) == F.size(words) - window + 1, F.lit(0)).otherwise(covered).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """A row per document: doc_id, the columns to keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.col("text")
    rows = docs.select(docs[id_col].alias("doc_id"), *(docs[c] for c in keep), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        *keep,
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    return rows.select(
        "doc_id",
        *keep,
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: float = REACH, least_rows: int = LEAST_ROWS, keep: tuple[str, ...] = (), learnt: bool = False) -> DataFrame:
    """A row per document: doc_id, the base statistics, base_failed, kept, failed (names of the rules it fails), columns to keep."""
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    rows = statistics(docs, id_col, text_col, ("lang", "source", *keep)).withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbols_per_word": F.col("n_symbols") / one("n_words"),
            "mean_word_chars": F.col("word_chars") / one("n_words"),
            "dup_line_share": F.col("n_dup_lines") / one("n_lines"),
        }
    )
    rows = settled(rows)
    names = [s for s, _, _ in STATISTICS]
    group = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(s, SKETCH_K).alias(s) for s in names))
    merged = lambda *keys: group.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(s, SKETCH_K).alias(s) for s in names))
    wide = merged("lang").select(F.col("lang").alias("l"), F.col("n").alias("ln"), *(F.col(s).alias(f"l_{s}") for s in names))
    whole = merged().select(F.struct(*names)).scalar()
    chosen = group.join(wide, group["lang"].eqNullSafe(wide["l"])).withColumn("a", whole)
    limits = []
    for s, spread, both in STATISTICS:
        sketch = F.when(F.col("n") >= least_rows, F.col(s)).when(F.col("ln") >= least_rows, F.col(f"l_{s}")).otherwise(F.col("a")[s])
        low, mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.5, 0.75))
        above, below = high - mid, mid - low
        if learnt:
            tail, spread = LEARNT[s]
            wider = F.when(F.col("ln") >= least_rows, F.col(f"l_{s}")).otherwise(F.col("a")[s])
            far = lambda k, q: F.abs(F.kll_sketch_get_quantile_double(k, F.lit(q)) - F.kll_sketch_get_quantile_double(k, F.lit(0.5)))
            above, below = (F.when(x > 0, far(sketch, q)).otherwise(far(wider, q)) for x, q in ((above, tail), (below, 1 - tail)))
        limits.append((mid + reach * F.greatest(above, F.lit(spread))).alias(f"{s}_high"))
        if both:
            limits.append((mid - reach * F.greatest(below, F.lit(spread))).alias(f"{s}_low"))
    limits = chosen.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *limits)
    rows = rows.join(limits, rows["lang"].eqNullSafe(limits["g_lang"]) & rows["source"].eqNullSafe(limits["g_source"]), "left")
    fails = []
    for s, _, both in STATISTICS:
        fails.append(F.when(F.col(s) > F.col(f"{s}_high"), F.lit(f"{s}_high")))
        if both:
            fails.append(F.when(F.col(s) < F.col(f"{s}_low"), F.lit(f"{s}_low")))
    rows = rows.withColumn("failed", F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *fails)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("failed") == 0).alias("kept"), "failed", *keep)
