"""One-permutation MinHash fingerprints in DataFrame functions only.

The 5-word shingles of a text are hashed once; the upper bits of a hash choose one of BINS bins, and each bin
keeps its least hash. Empty bins are filled by optimal densification: bin i takes the value of the first filled
bin in its own random sequence of probes, which depends on i and the number of the try alone; what is empty
after ROUNDS tries takes that of the filled bin whose hash with i is least (the same choice, made without
replacement). Of each value (hashed with its bin) the low BITS bits are kept, one hexadecimal digit a bin. Two unrelated values agree
once in 2**BITS, so the share p of equal digits estimates likeness by (p - c) / (1 - c), c = 2**-BITS, held in [0, 1].

Words are [^\\x20\\x09-\\x0D]+; 1 to 4 words make one shingle; a text without words has all digits 0. Null texts
are empty. A very long text is one row's work: its shingles are an array in memory. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.llm.corpus import NULL_ID, settled
from ancestra.llm.rules import WORD

BINS, BITS, ROUNDS, SHINGLE = 256, 4, 24, 5
_BIN_BITS = BINS.bit_length() - 1


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - _BIN_BITS).cast("int")


def _probe(i: Column, t: Column) -> Column:
    """The bin that bin i looks into at its try t."""
    return F.pmod(F.hash(i, t), F.lit(BINS))


def digits(text: Column) -> Column:
    """The fingerprint of a text: BINS hexadecimal digits."""

    def of_words(w: Column) -> Column:
        at = lambda i: F.get(w, i)
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(at(i + k) for k in range(SHINGLE))))
        hashes = F.when(F.size(w) >= SHINGLE, grams).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
        # order of the upper bits is that of bins, but for the sign: bins of negative hashes come first
        return _bound(F.array_sort(hashes), of_sorted)

    def of_sorted(h: Column) -> Column:
        least = F.filter(h, lambda x, k: (k == 0) | (_bin(x) != _bin(F.get(h, F.greatest(k - 1, F.lit(0))))))
        turned = F.transform(least, lambda x: F.pmod(_bin(x) + BINS // 2, F.lit(BINS)))  # bins in ascending order
        return _bound(F.struct(least.alias("v"), turned.alias("b")), of_least)

    def of_least(s: Column) -> Column:
        n = F.size(s["b"])
        value = lambda k: F.get(s["v"], k)
        none = lambda k: F.array_repeat(F.lit(None).cast("bigint"), k)
        filled = F.flatten(F.transform(s["b"], lambda b, k: F.concat(none(b - F.when(k > 0, F.get(s["b"], F.greatest(k - 1, F.lit(0)))).otherwise(F.lit(-1)) - 1), F.array(value(k)))))
        filled = F.concat(filled, none(BINS - 1 - F.get(s["b"], n - 1)))
        return F.when(n == 0, F.lit("0" * BINS)).otherwise(_bound(filled, lambda f: of_filled(f, s)))

    def of_filled(f: Column, s: Column) -> Column:
        empty = lambda acc: F.exists(acc, lambda x: x.isNull())
        dense = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            f,
            lambda acc, t: F.when(empty(acc), F.transform(acc, lambda x, i: F.coalesce(x, F.get(f, _probe(i, t))))).otherwise(acc),
        )
        last = lambda i: F.get(s["v"], F.get(F.array_sort(F.transform(s["b"], lambda b, k: F.struct(F.hash(b, i, F.lit(0)).alias("p"), k.alias("k")))), F.lit(0))["k"])
        dense = _bound(dense, lambda d: F.when(empty(d), F.transform(d, lambda x, i: F.coalesce(x, last(i)))).otherwise(d))
        # a value's digit depends on its bin too: else one value in many bins would agree with another in all or none
        return F.array_join(F.transform(dense, lambda x, i: F.substring(F.lit("0123456789abcdef"), F.hash(x, i).bitwiseAND(F.lit((1 << BITS) - 1)) + 1, F.lit(1))), "")

    return _bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / BINS - chance) / (1 - chance)))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, fingerprint."""
    return docs.select(docs[id_col].alias("doc_id"), digits(F.coalesce(docs[text_col], F.lit(""))).alias("fingerprint"))


def followers(ids: DataFrame) -> DataFrame:
    """ids: i, n. A row (i, n, next) in ascending i; the last is followed by the first.

    Ids are range-partitioned and the next one is looked up within a partition; only the first id of each
    partition, a row a partition, is brought together.
    """
    part = settled(ids.repartitionByRange(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i").withColumn("p", F.spark_partition_id()))
    firsts = part.groupBy("p").agg(F.min("i").alias("first"))  # a row a partition
    least = firsts.agg(F.min("first")).scalar()
    firsts = firsts.select("p", F.lead("first").over(W.orderBy("p")).alias("after")).select("p", F.coalesce("after", least).alias("after"))
    inside = F.lead("i").over(W.partitionBy("p").orderBy("i"))
    return part.withColumn("inside", inside).join(F.broadcast(firsts), "p").select("i", "n", F.coalesce("inside", "after").alias("next"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(i, t, n_chars, e): ids, texts, and the texts with their last quarter replaced by as much of the start of the next document;
    and (i, next). A null id counts as the least; of rows that repeat an id, the one whose text has the least xxhash64 follows."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    # rows of one id count as one where they follow: the text of least hash, and the longest start that any of them takes
    after = settled(followers(rows.groupBy("i").agg(F.max(F.floor(F.length("t") / 4)).alias("n"))))
    wanted = after.select(F.col("next").alias("i"), F.col("i").alias("before"), "n")
    starts = rows.join(wanted, "i").select(F.col("before").alias("i"), F.substring(F.col("t"), F.lit(1), F.col("n").cast("int")).alias("start"), F.xxhash64("t").alias("h"))
    starts = starts.groupBy("i").agg(F.min_by("start", "h").alias("start"))
    both = rows.join(starts, "i", "left").withColumn("m", F.floor(F.length("t") / 4).cast("int"))
    new = F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - F.col("m")), F.substring(F.coalesce("start", F.lit("")), F.lit(1), F.col("m")))
    return both.select("i", "t", F.length("t").cast("long").alias("n_chars"), new.alias("e")), after.select("i", "next")


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256."""
    both, _ = with_edits(docs, id_col, text_col)
    return both.select(F.nullif("i", F.lit(NULL_ID)).alias("doc_id"), "n_chars", F.sha2(F.encode("e", "utf-8"), 256).alias("edited_sha256"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see with_edits.

    An empty table gives no rows; other columns are ignored.
    """
    both, after = with_edits(docs, id_col, text_col)
    done = settled(both.select("i", "n_chars", F.sha2(F.encode("e", "utf-8"), 256).alias("edited_sha256"), digits(F.col("t")).alias("fingerprint"), digits(F.col("e")).alias("edited_fingerprint"), F.xxhash64("t").alias("h")))
    follow = done.groupBy("i").agg(F.min_by("fingerprint", "h").alias("next_fingerprint")).select(F.col("i").alias("next"), "next_fingerprint")
    done = done.join(after, "i").join(follow, "next")
    return done.select(
        F.nullif("i", F.lit(NULL_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
