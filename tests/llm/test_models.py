import random

import numpy as np
from pyspark.sql import functions as F

from redline.llm.quality_qda import fit_quality, model_of, quality_scores, shrunk, text_features
from redline.llm.toxicity_pu import fit_nnpu, fit_toxicity, toxicity_scores

from .helpers import docs


def _corpus(n=240):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    rows, quality, toxic = [], [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(40, 120))]
        q, t = int(i % 5 != 0), int(i % 4 == 1)
        if not q:
            w = [x.upper() + "!!" for x in w]
        if t:
            w[rnd.randrange(len(w))] = rnd.choice(["vilewort", "badling", "scumly,"])
        rows.append((i, " ".join(w)))
        quality.append((i, q))
        toxic.append((i, t))
    return rows, quality, toxic


def _labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, label int")


def test_quadratic_model_is_the_gaussian_density_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, [0.5, 2, 1], (300, 3))]
    m = model_of([400, 300], [a.sum(0) for a in x], [a.T @ a for a in x], pooled=0.0)
    probe = rng.normal(0, 2, (20, 3))
    logs = []
    for c in (0, 1):
        cov = m.factors[c] @ m.factors[c].T
        d = probe - x[c].mean(0)
        logs.append(m.log_priors[c] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(m.scores(probe), 1 / (1 + np.exp(logs[0] - logs[1])))
    wide = np.diag([1.0, 4.0])
    assert np.allclose(shrunk(wide, 10**7), wide, atol=1e-4)          # much data: no shrinkage
    assert abs(shrunk(wide, 2)[0, 0] - wide[0, 0]) > 0.1              # little data: towards the mean variance


def test_quality_held_out(spark):
    rows, quality, _ = _corpus()
    x = text_features(docs(spark, rows + [(900, None), (901, "")]))
    model = fit_quality(x, _labels(spark, quality).where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in quality_scores(x, model).collect()}
    held = [(got[i].predicted, q) for i, q in quality if i % 3 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) + 2
    assert got[900].score == got[901].score


def test_quality_without_classes(spark):
    rows, quality, _ = _corpus(10)
    x = text_features(docs(spark, rows))
    one = fit_quality(x, _labels(spark, [(i, 1) for i, _ in quality]))
    assert {r.score for r in quality_scores(x, one).collect()} == {1.0}
    none = fit_quality(x, _labels(spark, [(5000, 1), (1, None)]))
    assert {r.score for r in quality_scores(x, none).collect()} == {0.5}
    assert text_features(docs(spark, rows).where("false")).count() == 0


def test_non_negative_risk_separates_unlabelled_positives():
    rng = np.random.default_rng(1)
    p = np.column_stack([rng.random(300) < 0.9, rng.random(300) < 0.5]).astype(float)
    u = np.column_stack([rng.random(2000) < 0.9 * 0.2, rng.random(2000) < 0.5]).astype(float)
    w, b = fit_nnpu(p, u, 0.2)
    assert w[0] + b > 0 > b and abs(w[1]) < w[0] / 4


def test_toxicity_held_out(spark):
    rows, _, toxic = _corpus(600)
    d, labels = docs(spark, rows + [(900, None), (901, "")]), _labels(spark, [(i, t) for i, t in toxic if i % 2])
    model = fit_toxicity(d, labels, training=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity_scores(d, model).collect()}
    held = [(got[i].predicted, t) for i, t in toxic if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert len(got) == len(rows) + 2 and got[900].predicted == 0


def test_toxicity_without_positives(spark):
    rows, _, _ = _corpus(10)
    d = docs(spark, rows)
    model = fit_toxicity(d, _labels(spark, [(1, 0), (2, None)]))
    assert {r.predicted for r in toxicity_scores(d, model).collect()} == {0}
    assert toxicity_scores(d.where("false"), model).count() == 0
