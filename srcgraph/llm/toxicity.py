"""Operator 7: severity of toxicity by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(t_k - w x)``: one sparse weight vector is shared by all
grades and the thresholds ``t_1 < t_2 < t_3`` are ordered by construction. The
features are hashed word counts, ``log(1 + count)``; lasso leaves only the words
that tell. The output is the expected severity, ``sum_k P(grade >= k)``.

Labels say toxic or not. The grades of the toxic ones come from the intensity of
words that are commoner among them than chance allows: tertiles of their number.
The model is fitted on a bounded sample of ``max_rows`` labelled documents, chosen
by hash (of rows with equal ids one, so the bound holds whatever the table); features
of fewer than ``MIN_HAVE`` of them, or as common among toxic ones as chance allows, are
left out before the fit. Every document is scored, in one narrow pass with a weight
table of fixed size.

Defined cases
-------------
* Null and empty texts have no words; they get the severity that the thresholds
  alone give, as has any text without a telling word.
* Without labels of both kinds there is no model: severity 0, grade 0, not toxic.
* A document labelled several times counts as toxic if any of its labels says so; null labels are left out.
* Null ids are scored and carried, never trained on. Repeated rows are scored
  alike, each on its own. Long texts are scored whole. An empty table gives an
  empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import U64, chunks, raw_text, words

BITS = 18
GRADES = 3
MAX_ROWS = 20_000
#: Labelled documents that must hold a feature for it to tell anything.
MIN_HAVE = 3
LASSO = 2e-4
STEPS = 400
TELLING = 4.0


def counts(buf: np.ndarray, offs: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the hashed words of each text, of features in ``use`` only."""
    _, _, row, h = words(buf, offs)
    dim = (h >> U64(64 - BITS)).astype(np.int64)
    if use is not None:
        at = np.flatnonzero(use[dim])
        row, dim = row[at], dim[at]
    key, n = np.unique((row << BITS) | dim, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -500, 500)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, lasso: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient; the thresholds are a start and positive gaps."""
    n, k = len(y), int(y.max())
    p = np.array([(y >= g).mean() for g in range(1, k + 1)])
    p = np.clip(p, 1e-4, 1 - 1e-4)
    t = np.log((1 - p) / p)
    t = np.maximum.accumulate(t + 1e-3 * np.arange(k))
    norm = np.bincount(col, weights=val**2, minlength=width)
    rate = 4.0 / (1 + norm.max() / n * 4)
    w = np.zeros(width)
    v, vt, tk = w.copy(), t.copy(), 1.0

    def edges(th: np.ndarray) -> np.ndarray:
        return np.concatenate([[-np.inf], th, [np.inf]])

    for _ in range(steps):
        s = np.bincount(row, weights=val * v[col], minlength=n)
        e = edges(vt)
        # likelihood of grade y: F(t_{y+1} - s) - F(t_y - s)
        hi, lo = 1 / (1 + np.exp(-np.clip(e[y + 1] - s, -60, 60))), 1 / (1 + np.exp(-np.clip(e[y] - s, -60, 60)))
        hi, lo = np.where(y == k, 1.0, hi), np.where(y == 0, 0.0, lo)
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        gs = (dhi - dlo) / n  # gradient of the loss by s
        g = np.bincount(col, weights=val * gs[row], minlength=width)
        gt = np.array([-(dhi[y == j].sum() - dlo[y == j + 1].sum()) / n for j in range(k)])
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        nt = vt - 2.0 * gt
        nt = np.concatenate([nt[:1], nt[0] + np.cumsum(np.maximum(np.diff(nt), 0.05))])
        tn = (1 + np.sqrt(1 + 4 * tk * tk)) / 2
        v, vt = new + (tk - 1) / tn * (new - w), nt
        w, t, tk = new, nt, tn
    return w, t


def grades(row: np.ndarray, dim: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grade of each document, features kept): intensity tertiles of the toxic ones, and the features that differ more than chance would."""
    size = 1 << BITS
    have = np.bincount(dim, minlength=size)
    bad = np.bincount(dim[toxic[row]], minlength=size)
    share, total = toxic.mean(), len(toxic)
    # how far the number of toxic documents with a word is from its expectation
    want = have * share
    z = (bad - want) / np.sqrt(np.maximum(want * (1 - share) * (1 - have / (total + 1)), 0.5))
    z[have < MIN_HAVE] = 0
    kept = np.flatnonzero(np.abs(z) > 2.0)
    telling = z > TELLING
    intensity = np.bincount(row, weights=n * telling[dim], minlength=total)
    y = np.zeros(total, np.int64)
    of = np.sort(intensity[toxic])
    cut = [of[len(of) * g // GRADES] for g in range(1, GRADES)]
    y[toxic] = 1 + sum((intensity[toxic] > c).astype(np.int64) for c in cut)
    # grades that no document reaches close up
    _, y = np.unique(np.append(y, 0), return_inverse=True)
    return y[:-1], kept


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lasso: float = LASSO) -> Ordinal | None:
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most max_rows rows, so the broadcast is bounded
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    text = text.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = raw_text(batch.column(1))
            rows = []
            for lo, hi in chunks(offs):
                row, dim, n = counts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                rows += [np.stack([dim[a:b], n[a:b]]).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["toxic", "found"])

    got = text.mapInArrow(extract, "toxic int, found binary").collect()
    # partition order is no property of the data
    got = sorted(((r.toxic, bytes(r.found)) for r in got))
    toxic = np.array([t > 0 for t, _ in got], bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    pairs = [np.frombuffer(f, np.int32).reshape(2, -1) for _, f in got]
    row = np.repeat(np.arange(len(got)), [p.shape[1] for p in pairs])
    dim, n = np.concatenate(pairs, axis=1).astype(np.int64)
    y, kept = grades(row, dim, n, toxic)
    if not len(kept):
        return None
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    at = np.flatnonzero(place[dim] >= 0)
    w, t = fit_ordinal(row[at], place[dim[at]], np.log1p(n[at]), y, len(kept), lasso)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Ordinal(weights, t)


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every document."""
    model = train(docs, labels, max_rows)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("expected_severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model.weights != 0
        for batch in batches:
            buf, offs = raw_text(batch.column(1))
            s = np.zeros(batch.num_rows)
            for lo, hi in chunks(offs):
                row, dim, n = counts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], use)
                s[lo:hi] = np.bincount(row, weights=model.weights[dim] * np.log1p(n), minlength=hi - lo)
            p = model.severity(s)
            grade = np.argmax(np.concatenate([np.ones((len(p), 1)), p], axis=1) - np.concatenate([p, np.zeros((len(p), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p.sum(axis=1), 6)), pa.array(grade.astype(np.int32)), pa.array(p[:, 0] >= 0.5)], ["doc_id", "expected_severity", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, expected_severity double, grade int, toxic boolean")
