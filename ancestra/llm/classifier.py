"""Quality classifier: a sparse ensemble of rules.

Shallow trees are boosted on text statistics of a bounded sample of labelled documents; every path from a root to
a node of a tree is a rule, a conjunction of comparisons. A logistic model with a lasso penalty gives the rules
their weights, most of them zero, and the rest is compiled into one Spark expression over the statistics, so
scoring is a projection. Label, language, source and id are no inputs.

At most `sample` labelled rows (those of least hash of the id) reach the driver; ids whose crc32 modulo 3 is 1 are
held out. Null and empty texts have statistics of 0 and get a score. Labels that are null are left out; of several
for one id the least counts. Without labels the score is 0.5. Rows that repeat an id are scored each, and an empty table
has no rows. Further columns stay as they are; names that begin with __s_ are this module's own. A very long text is
one row's work: its words and lines are arrays in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.llm.rules import WORD

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, PENALTY = 24, 3, 48, 2e-3
NAMES = ("words", "word_chars", "symbols", "pipes", "digits", "capitals", "marks", "distinct", "line_words", "dup_lines")


def held_out(id_col: Column, folds: int = 3) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == 1, F.lit(False))


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "__s_") -> DataFrame:
    """df with a column prefix + name for each of NAMES."""
    p = lambda c: f"{prefix}{c}"
    t = F.coalesce(df[text_col], F.lit(""))
    less = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    df = df.withColumns({p("t"): t, p("w"): F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), p("l"): F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)})
    t, w, lines = F.col(p("t")), F.col(p("w")), F.col(p("l"))
    n = F.greatest(F.size(w), F.lit(1))
    df = df.withColumns(
        {
            p("words"): F.size(w).cast("double"),
            p("word_chars"): F.length(F.translate(t, " \t\n\x0b\x0c\r", "")) / n,
            p("symbols"): less(t, "#*$%&<>") / n,
            p("pipes"): less(t, "|") / n,
            p("digits"): less(t, "0123456789") / n,
            p("capitals"): less(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
            p("marks"): less(t, ".,;:!?") / n,
            p("distinct"): F.size(F.array_distinct(w)) / n,
            p("line_words"): F.size(w) / F.greatest(F.size(lines), F.lit(1)),
            p("dup_lines"): (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
        }
    )
    return df.drop(p("t"), p("w"), p("l"))


Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether above, bound


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = "__s_") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, above, bound in rule:
                c = F.col(f"{prefix}{NAMES[f]}")
                holds = holds & ((c > bound) if above else (c <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, bound in rule:
        out &= (x[:, f] > bound) if above else (x[:, f] <= bound)
    return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> list[tuple[Rule, np.ndarray, float, bool]]:
    """Nodes of a boosted tree: rule, rows, step, whether a leaf."""
    out = []

    def grow(rows: np.ndarray, rule: Rule, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-3, None)
        if depth < DEPTH and len(rows) >= 20:
            for f, e in enumerate(edges):
                if len(e):
                    gs = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], hessian[rows], len(e) + 1))[:-1]
                    ns = np.cumsum(np.bincount(binned[rows, f], minlength=len(e) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < 10) | (len(rows) - ns < 10)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k))
        split = best[1]
        if rule:
            out.append((rule, rows, -g / (h + 1), split is None))
        if split is not None:
            f, k = split
            above = binned[rows, f] > k
            for side in (False, True):
                grow(rows[above == side], (*rule, (f, side, float(edges[f][k]))), depth + 1)

    grow(np.arange(len(binned)), (), 0)
    return out


def _simple(rule: Rule) -> Rule:
    """The tightest bound of each statistic and side."""
    tight: dict = {}
    for f, above, b in rule:
        tight[f, above] = (max if above else min)(b, tight.get((f, above), b))
    return tuple((f, above, b) for (f, above), b in sorted(tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    """x: statistics, y: 0 or 1."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(base, ())
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    f = np.full(len(y), base)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        for rule, rows, step, leaf in _tree(binned, edges, p - y, p * (1 - p)):
            rules.setdefault(_simple(rule))
            if leaf:
                f[rows] += 0.3 * step
    found = list(rules)
    z = np.stack([_applies(r, x) for r in found], 1).astype(np.float32)
    _, one = np.unique(z, axis=1, return_index=True)
    found, z = [found[i] for i in sorted(one)], z[:, sorted(one)]
    centre, scale = z.mean(0), np.maximum(z.std(0), 0.05)
    z = (z - centre) / scale
    # lasso logistic by accelerated proximal gradient
    bound = 0.25 * np.linalg.norm(z, 2) ** 2 / len(y) + 0.25
    w, b, v, c, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - (z.T @ r) / len(y) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / bound, 0)
        after = c - r.mean() / bound
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (last - 1) / t * (new - w), after + (last - 1) / t * (after - b)
        w, b = new, after
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[kept] / scale[kept]
    return Model(float(b - (weights * centre[kept]).sum()), tuple((found[i], float(a)) for i, a in zip(kept, weights)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labels of documents that aren't held out."""
    known = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"])).groupBy(labels["doc_id"].alias("__id")).agg(F.min(label).cast("int").alias("__y"))
    chosen = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64("__id"), "__id").limit(sample).collect() or [], "__id long, __y int")
    rows = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__t")).join(F.broadcast(chosen), "__id")  # sample rows at most
    rows = with_statistics(rows, "__t").select("__id", "__y", *(f"__s_{n}" for n in NAMES))
    # rows that repeat an id count too: `sample` rows at most, in a fixed order
    got = sorted(tuple(r) for r in rows.orderBy(F.xxhash64("__id"), *rows.columns).limit(sample).collect())
    table = np.array(got, float).reshape(-1, len(NAMES) + 2)
    return fit_rules(table[:, 2:], table[:, 1])


def scored(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with the score as another column."""
    names = docs.columns
    return with_statistics(docs, text_col).withColumn(f"__s_{to}", model.score()).select(*names, F.col(f"__s_{to}").alias(to))
