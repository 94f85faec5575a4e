"""Operator 8: quality classifier as a sparse ensemble of rules.

Small trees are grown on text statistics of labelled documents; every path from
a root becomes a conjunctive rule. A lasso logistic regression weighs the rules
and drops most of them, and what is left is compiled into one Spark column
expression, so that scoring is a narrow built-in projection over all documents.

The trees and weights are fitted on a bounded sample of ``max_rows`` labelled
documents, chosen by hash; of rows with equal ids one is taken, so that the bound
holds whatever the table.

Defined cases
-------------
* Null and empty texts have all statistics 0 and are scored like any text.
* Without labels of both kinds there is no model: score 1, keep.
* A document labelled several times has the least of its labels; null labels are
  left out, null ids are scored and carried but not trained on.
* Repeated rows are scored alike, each on its own. Long texts count whole. An
  empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import text_of

MAX_ROWS = 20_000
TREES = 60
DEPTH = 3
LASSO = 2e-3
STEPS = 600
CUTS = 24
SEED = 17
KEEP = 0.5

STATS = ("n_chars", "n_words", "word_length", "upper", "digit", "mark", "symbol", "distinct_words", "distinct_lines", "line_words")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus one column ``_s_<name>`` a statistic, rounded so that thresholds mean the same everywhere."""
    out = docs.withColumn("_text", text_of(docs))
    chars = F.length("_text")
    out = out.withColumns(
        {
            "_w": F.filter(F.split(F.lower("_text"), "[^\\p{L}\\p{Nd}]+"), lambda w: w != ""),
            "_l": F.filter(F.split("_text", "\n"), lambda x: x != ""),
            "_c": chars,
        }
    )
    out = out.withColumns({"_nw": F.size("_w"), "_nl": F.size("_l")})

    def part(n: Column, of: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(n, of), 4), F.lit(0.0))

    def without(pattern: str) -> Column:
        return F.col("_c") - F.length(F.regexp_replace("_text", pattern, ""))

    stats = {
        "n_chars": F.col("_c").cast("double"),
        "n_words": F.col("_nw").cast("double"),
        "word_length": part(F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w)), F.col("_nw")),
        "upper": part(without("[A-Z]+"), F.col("_c")),
        "digit": part(without("[0-9]+"), F.col("_c")),
        "mark": part(without("[.,;:?'\"()-]+"), F.col("_c")),
        "symbol": part(without("[!#$%&*|=~^<>@_+/{}\\[\\]\\\\]+"), F.col("_c")),
        "distinct_words": part(F.size(F.array_distinct("_w")), F.col("_nw")),
        "distinct_lines": part(F.size(F.array_distinct("_l")), F.col("_nl")),
        "line_words": part(F.col("_nw"), F.col("_nl")),
    }
    return out.withColumns({f"_s_{k}": v for k, v in stats.items()}).drop("_text", "_w", "_l", "_c", "_nw", "_nl")


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, threshold, above): above means > threshold, else <=."""

    terms: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, t, above in self.terms:
            out &= (x[:, f] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, t, above in self.terms:
            c = F.col(f"_s_{STATS[f]}")
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


def _tree(x: np.ndarray, r: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, list[Rule]]:
    """Least-squares tree for the residual ``r``: (fitted values, rules of all nodes but the root)."""
    fit, rules = np.zeros(len(r)), []

    def simpler(terms: tuple) -> Rule:
        # of several bounds on one side of a statistic the tightest says it all
        best: dict[tuple[int, bool], float] = {}
        for f, t, above in terms:
            k = (f, above)
            best[k] = t if k not in best else (max if above else min)(best[k], t)
        return Rule(tuple(sorted((f, t, above) for (f, above), t in best.items())))

    def grow(at: np.ndarray, terms: tuple) -> None:
        if terms:
            rules.append(simpler(terms))
        fit[at] = r[at].mean()
        if len(terms) >= depth or len(at) < 10:
            return
        best = (1e-9, None)
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            v = x[at, f]
            for t in np.unique(np.round(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1]), 4)):
                up = v > t
                n = int(up.sum())
                if n < 4 or n > len(at) - 4:
                    continue
                a, b = r[at][up].mean(), r[at][~up].mean()
                gain = n * (len(at) - n) / len(at) * (a - b) ** 2
                if gain > best[0]:
                    best = (gain, (int(f), float(t)))
        if best[1]:
            f, t = best[1]
            up = x[at, f] > t
            grow(at[up], (*terms, (f, t, True)))
            grow(at[~up], (*terms, (f, t, False)))

    grow(np.arange(len(r)), ())
    return fit, rules


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    """Distinct rules of trees boosted on random halves of the rows."""
    rng = np.random.default_rng(seed)
    s = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        at = rng.choice(len(y), min(len(y), max(40, len(y) // 2)), replace=False)
        r = y - 1 / (1 + np.exp(-s))
        _, rules = _tree(x[at], r[at], rng, int(rng.integers(1, depth + 1)))
        found |= dict.fromkeys(rules)
        leaf = np.zeros(len(y))
        deep = [q for q in rules if not any(set(q.terms) < set(o.terms) for o in rules)]
        for q in deep:
            h = q.holds(x)
            if h.any():
                leaf[h] = r[h].mean()
        s += 2.0 * leaf
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, lasso: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(intercept, weights), by accelerated proximal gradient; the intercept isn't shrunk."""
    n, m = z.shape
    q = z.T @ z / n
    v = np.ones(m)
    for _ in range(30):  # largest eigenvalue, by power iteration
        v = q @ v
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 4 / (float(v @ q @ v) + 1.0)
    w, b, tk = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 1.0
    u, c = w.copy(), b
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ u + c))) - y
        new = u - rate * (z.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        nb = c - rate * g.mean()
        tn = (1 + np.sqrt(1 + 4 * tk * tk)) / 2
        u, c = new + (tk - 1) / tn * (new - w), nb + (tk - 1) / tn * (nb - b)
        w, b, tk = new, nb, tn
    return b, w


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            out += w * rule.holds(x)
        return out

    def column(self) -> Column:
        s = F.lit(self.intercept)
        for rule, w in self.rules:
            s = s + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.round(1 / (1 + F.exp(-s)), 6)


def fit(x: np.ndarray, y: np.ndarray, lasso: float = LASSO) -> Ensemble:
    rules = extract_rules(x, y)
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    # rules that hold for the same rows are one
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    b, w = lasso_logistic(z[:, first], y, lasso)
    return Ensemble(round(b, 6), [(rules[i], round(float(v), 6)) for i, v in zip(first, w, strict=True) if abs(v) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lasso: float = LASSO) -> Ensemble | None:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("_quality"))
    # at most max_rows rows, so the broadcast is bounded
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("_quality").alias("_quality"), F.min("text").alias("text"))).select("_quality", *[f"_s_{s}" for s in STATS])
    # partition order is no property of the data
    got = np.array(sorted(map(tuple, rows.collect())), float).reshape(-1, len(STATS) + 1)
    y = (got[:, 0] > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(got[:, 1:], y, lasso)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: float = KEEP) -> DataFrame:
    """(doc_id, quality_score, keep) of every document."""
    model = train(docs, labels, max_rows)
    if model is None:
        return docs.select("doc_id", F.lit(1.0).alias("quality_score"), F.lit(True).alias("keep"))
    out = statistics(docs.select("doc_id", "text")).select("doc_id", *[f"_s_{s}" for s in STATS])
    return out.select("doc_id", model.column().alias("quality_score")).withColumn("keep", F.col("quality_score") >= keep)
