"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts (P) and unlabelled text (U); a
missing or a clean label says nothing.  With the class prior ``pi`` the risk is

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

and where the second term falls below zero (the model overfits U) the step goes
up that term instead, which keeps the risk estimate from turning negative.

The model is linear over the presence of terms (words, and runs of four and five
bytes inside words, so that inflected or joined forms count), hashed to
``2**BUCKET_BITS`` buckets and picked by how much oftener they occur in P than
in U.  It is fitted in numpy on bounded samples (``max_positive``,
``max_unlabelled`` rows, whole texts of any length): the executors turn texts
into term sets, which stay in a table, and count the terms; the driver sees the
picked terms and, for each sampled row, which of them it holds.  Scoring reads
every whole text, a long one in parts cut between words.

Cases: null text counts as empty and gets the score of a text without any of
the words; labels that are null, or of documents outside the training rows, are
not read; without positives every score is the prior (0 if unknown); repeated
rows get equal scores, and of several texts under one id one is learned from; a
null id counts as the empty text in the split and has no label; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_tables, mix, prefix_hash, range_hash, text_bytes, text_parts, words_of, write_table

MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
MAX_TERMS = 192
BUCKET_BITS = 22
GRAMS = (4, 5)
THRESHOLD = 0.5
#: The prior is taken this much higher: an estimate below the true share of U holds the terms' weights down,
#: one above it is caught by the non-negative step.
PRIOR_MARGIN = 1.2

# bytes that part words: everything in ASCII but letters and digits; capitals fold
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0x80:] = np.arange(0x80, 256)
_PARTS = _FOLD == 32


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every term of a chunk, repeats included."""
    buf = _FOLD[buf]
    h, rows, _, _ = words_of(buf, off)
    shift = U64(64 - BUCKET_BITS)
    out_r, out_b = [rows], [(h >> shift).astype(np.int64)]
    n = len(buf)
    cut = np.zeros(n + 1, np.int32)
    np.cumsum(buf == 32, out=cut[1:])
    edge = np.zeros(n + 1, np.int32)                  # rows begun by here
    np.add.at(edge, off[:-1][off[:-1] < n], 1)
    edge = np.cumsum(edge)
    p = prefix_hash(buf)
    for g in GRAMS:
        if n >= g:
            at = np.flatnonzero((cut[g:] == cut[:n - g + 1]) & (edge[g - 1:n] == edge[:n - g + 1]))
            out_r.append(np.searchsorted(off, at, "right") - 1)
            out_b.append((mix(range_hash(p, at, at + g), g) >> shift).astype(np.int64))
    return np.concatenate(out_r), np.concatenate(out_b)


@dataclass
class PUModel:
    """Buckets of the chosen terms (ascending), their weights and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, m = len(off) - 1, len(self.buckets)
        g = np.full(n, self.bias)
        if m and len(buf):
            if not hasattr(self, "_slot"):
                self._slot = np.full(1 << BUCKET_BITS, -1, np.int32)
                self._slot[self.buckets] = np.arange(m)
            cells = []
            for part, at, who in text_parts(buf, off, _PARTS):
                rows, b = terms(part, at)
                slot = self._slot[b]
                hit = slot >= 0
                cells.append(np.unique(who[rows[hit]] * m + slot[hit]))
            cell = np.unique(np.concatenate(cells))   # a term counts once a text, in whichever parts it stands
            g += np.bincount(cell // m, weights=self.weights[cell % m], minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(g, -700, 700)))


def pick_terms(sets: DataFrame, n_pos: int, n_unl: int, limit: int = MAX_TERMS, z_min: float = 5.0) -> tuple[np.ndarray, float]:
    """Buckets twice as frequent in P as in U, by ``z_min`` standard errors at least; the ``limit`` strongest.

    Also the share of P in U that the ten strongest suggest: a term of toxic
    texts alone is ``prior`` times as frequent in U as in P.
    """
    m = max(1, n_unl)
    counts = (sets.mapInArrow(_term_counts, "kind int, bucket int, n long").groupBy("bucket")
              .agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("np"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("nu")))
    both = (F.col("np") + F.col("nu")) / (n_pos + n_unl)
    z = (F.col("p") - F.col("u")) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / m) + 1e-12)
    best = (counts.withColumn("p", F.col("np") / n_pos).withColumn("u", F.col("nu") / m).where("p >= 2 * u").withColumn("z", z)
            .where(F.col("z") >= z_min).orderBy(F.desc("z"), "bucket").limit(limit).select("bucket", "p", "u").collect())
    top = best[:10]
    return np.sort(np.array([r["bucket"] for r in best], np.int64)), sum(r["u"] for r in top) / sum(r["p"] for r in top) if top else 1.0


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4,
             beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk (logistic loss, Adam)."""
    d = xp.shape[1]
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, steps + 1):
        gp, gu = xp @ w + b, xu @ w + b
        up, dn_p, dn_u = -(1 - sig(gp)), sig(gp), sig(gu)      # slopes of loss(+) on P, loss(-) on P and U
        neg = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = lambda x, s: np.append(s @ x, s.sum()) / len(x)
        g_neg = grad(xu, dn_u) - prior * grad(xp, dn_p)
        g = prior * grad(xp, up) + g_neg if neg >= -beta else -gamma * g_neg
        g[:-1] += l2 * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _term_sets(batches):
    """The set of each whole text's term buckets."""
    for b in batches:
        buf, off = text_bytes(b.column(1))
        sets = [np.zeros(0, np.int64)] * (len(off) - 1)
        for part, at, rows in text_parts(buf, off, _PARTS):
            r, t = terms(part, at)
            pair = np.unique(r << BUCKET_BITS | t)
            cut = np.searchsorted(pair >> BUCKET_BITS, np.arange(len(rows) + 1))
            t = pair & ((1 << BUCKET_BITS) - 1)
            for i, row in enumerate(rows):
                own = t[cut[i]:cut[i + 1]]
                sets[row] = np.union1d(sets[row], own) if len(sets[row]) else own
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.int32).tobytes() for s in sets], pa.binary())], ["kind", "terms"])


def _term_counts(batches):
    """Rows of each kind that hold a bucket, per task."""
    total = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for b in batches:
        for kind, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[kind, np.frombuffer(cell, np.int32)] += 1          # a set: no bucket twice
    for kind in (0, 1):
        at = np.flatnonzero(total[kind])
        for lo in range(0, len(at), 1 << 16):
            part = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.astype(np.int32)), pa.array(total[kind, part].astype(np.int64))],
                                             ["kind", "bucket", "n"])


def _presence(buckets: np.ndarray):
    """Which of the picked buckets each row holds, as a byte a bucket."""
    def run(batches):
        for b in batches:
            cells = [np.isin(buckets, np.frombuffer(c, np.int32)).astype(np.uint8).tobytes() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary())], ["kind", "held"])
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, training=None, doc_id: str = "doc_id", text: str = "text",
                 max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
                 prior: float | None = None) -> PUModel:
    """Fit on ``labels (doc_id, label)`` and the documents where the column ``training`` holds.

    ``prior`` defaults to the share of positives among the training labels, and is
    lowered to what the strongest terms suggest.
    """
    training = F.lit(True) if training is None else training
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null").where(training)
    marks = labels.where("label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(training)
    n, k = marks.agg(F.count("*"), F.sum("label")).first()
    if prior is None:
        prior = (k or 0) / n if n else 0.0
    none = PUModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -700.0)
    if not k:
        return none
    rank = lambda salt: F.xxhash64(F.lit(salt), "doc_id")
    take = lambda df, salt, m, kind: (df.select("doc_id").distinct().orderBy(rank(salt), "doc_id").limit(m)
                                      .withColumn("kind", F.lit(kind)))
    chosen = (take(rows.join(marks.where("label = 1"), "doc_id", "left_semi"), "p", max_positive, 1)
              .unionByName(take(rows, "u", max_unlabelled, 0)))
    # at most max_positive + max_unlabelled ids: safe to broadcast; one text an id
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("kind", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("kind", "text")
    sets, path = write_table(texts.mapInArrow(_term_sets, "kind int, terms binary"), "pu_terms")
    sizes = {r["kind"]: r["n"] for r in sets.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return none
    buckets, seen = pick_terms(sets, sizes[1], sizes[0])
    if not len(buckets):
        return none
    held = sets.mapInArrow(_presence(buckets), "kind int, held binary").collect()        # rows x at most MAX_TERMS bytes
    drop_tables(docs.sparkSession, path)
    x = {kind: np.array([np.frombuffer(r["held"], np.uint8) for r in held if r["kind"] == kind], float) for kind in (0, 1)}
    prior = min(max(PRIOR_MARGIN * min(prior, seen), 1e-4), 0.9)
    w, b = fit_nnpu(x[1], x[0], prior)
    return PUModel(buckets, w, b)


def toxicity_scores(docs: DataFrame, model: PUModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row, over its whole text."""
    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(1))
            s = model.scores(buf, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
