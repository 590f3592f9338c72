"""Quality classifier: quadratic discriminant over transformed text counts.

Each class is a Gaussian over the transformed counts.  Its covariance is shrunk
towards a scaled identity by the oracle-approximating rule (closed form in the
sample size), after pooling a documented share of the other class's scatter;
the score is the logistic of the difference of the log densities plus the log
odds of the classes, with Mahalanobis distances by the cached Cholesky factors.

Fitting is distributed and takes every labelled row: one pass gives sufficient
statistics per task (counts, sums, products), which add up to a few matrices.

Cases: null text counts as empty and is scored like any other; rows without a
label, with a null label or outside the training rows take no part in fitting;
with one class alone the score is 1 or 0 by that class, with none 0.5; repeated
labels of one document count once each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, row_chunks, text_bytes, write_table
from .text_stats import TextStats

#: Share of the pooled covariance in each class's covariance.
POOLED = 0.3
THRESHOLD = 0.7


def _share(part, whole):
    """Variance-stabilised share."""
    return np.arcsin(np.sqrt(np.minimum((part + 0.375) / (whole + 0.75), 1.0)))


#: The transformed counts of one chunk of documents, in column order.
FEATURES = (
    ("log_words", lambda t: np.log1p(t.n_words)),
    ("word_length", lambda t: np.log((t.word_chars + 1) / (t.n_words + 1))),
    ("line_length", lambda t: np.log((t.n_words + 1) / (t.n_lines + 1))),
    ("symbols", lambda t: np.log((t.n_symbols + 0.5) / (t.n_words + 1))),
    ("marks", lambda t: np.log((t.n_marks + 0.5) / (t.n_words + 1))),
    ("stops", lambda t: _share(t.n_stops, t.n_words)),
    ("capitals", lambda t: _share(t.n_upper, t.n_upper + t.n_lower)),
    ("digits", lambda t: _share(t.n_digits, t.n_chars)),
    ("wide", lambda t: _share(t.n_wide, t.n_chars)),
    ("letters", lambda t: _share(t.n_alpha_words, t.n_words)),
    ("duplicate_lines", lambda t: _share(t.n_dup_lines, t.n_lines)),
    ("repeats", lambda t: _share(t.n_repeat_words, t.n_words)),
    ("distinct", lambda t: _share(t.n_distinct, t.n_words)),
)


def features(t: TextStats) -> np.ndarray:
    return np.stack([f(t).astype(np.float64) for _, f in FEATURES], axis=1)


@dataclass
class QuadraticModel:
    """Class means, Cholesky factors of the shrunk covariances and log priors; None where a class is missing."""

    means: list
    factors: list
    log_priors: list

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means[0] is None or self.means[1] is None:
            return np.full(len(x), 0.5 if self.means[0] is self.means[1] else float(self.means[1] is not None))
        logs = []
        for m, c, p in zip(self.means, self.factors, self.log_priors):
            z = np.linalg.solve(c, (x - m).T)         # c is lower triangular: z'z is the Mahalanobis distance
            logs.append(p - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(c)).sum())
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """Oracle-approximating shrinkage of a covariance of ``n`` rows to its mean variance."""
    d = len(cov)
    mean = np.trace(cov) / d
    square = (cov * cov).sum()
    top = (1 - 2 / d) * square + (d * mean) ** 2
    low = (n + 1 - 2 / d) * (square - (d * mean) ** 2 / d)
    rho = 1.0 if low <= 0 else min(1.0, top / low)
    return (1 - rho) * cov + rho * mean * np.eye(d) + 1e-9 * np.eye(d)


def model_of(counts, sums, products, pooled: float = POOLED) -> QuadraticModel:
    """The model from class counts, sums and sums of outer products."""
    n = np.asarray(counts, float)
    if not n.all():
        return QuadraticModel([None if k == 0 else np.zeros(0) for k in n], [None] * 2, [0.0] * 2)
    means = [sums[c] / n[c] for c in (0, 1)]
    scatter = [products[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    both = (scatter[0] + scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-8))  # shrinkage acts on comparable units
    factors = []
    for c in (0, 1):
        cov = ((1 - pooled) * scatter[c] / n[c] + pooled * both) / np.outer(scale, scale)
        factors.append(scale[:, None] * np.linalg.cholesky(shrunk(cov, int(n[c]))))
    return QuadraticModel(means, factors, [float(np.log(k / n.sum())) for k in n])


def _features(batches):
    for b in batches:
        buf, off = text_bytes(b.column(1))
        x = [features(TextStats(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])) for lo, hi in row_chunks(off)]
        x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, len(FEATURES)))


def _sums(batches):
    d = len(FEATURES)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for b in batches:
        y, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
        for c in (0, 1):
            z = x[y == c]
            n[c] += len(z)
            s[c] += z.sum(axis=0)
            p[c] += z.T @ z
    if n.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(n), pa.array(list(s)), pa.array([q.reshape(-1) for q in p])], ["c", "n", "s", "p"])


def fit_quality(feature_rows: DataFrame, labels: DataFrame, pooled: float = POOLED) -> QuadraticModel:
    """Fit on the ``(doc_id, x)`` rows that ``labels (doc_id, label)`` marks 0 or 1."""
    labels = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("y"))
    part = (feature_rows.join(labels, "doc_id").select("y", "x")
            .mapInArrow(_sums, "c int, n double, s array<double>, p array<double>"))
    d = len(FEATURES)
    add = lambda c, m: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(m)])
    rows = {r["c"]: r for r in part.groupBy("c").agg(F.sum("n").alias("n"), add("s", d).alias("s"), add("p", d * d).alias("p")).collect()}
    n, s, p = [0, 0], [None, None], [None, None]
    for c, r in rows.items():
        n[c], s[c], p[c] = int(r["n"]), np.array(r["s"]), np.array(r["p"]).reshape(d, d)
    return model_of(n, s, p, pooled)


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x)``: one pass over the texts, written once for fitting and scoring."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return write_table(rows.mapInArrow(released(_features), "doc_id long, x array<double>"), "qda_features")[0]


def quality_scores(feature_rows: DataFrame, model: QuadraticModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    def run(batches):
        for b in batches:
            s = model.scores(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
    return feature_rows.mapInArrow(run, "doc_id long, score double, predicted int")
