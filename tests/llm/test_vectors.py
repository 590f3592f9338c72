"""Exact searches over integer vectors against brute force."""
import math
import random

import numpy as np
import pytest

from redline.llm import hard_negatives as hn
from redline.llm.vectors import Piece, best_rows, integer_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, v string, score int, block int, no int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def vectors(n, dims, seed, scale=0.2):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0, scale) for _ in range(dims)], rnd.randrange(3)) for i in range(n)]


def integers(e):
    return None if e is None or any(c is None or not math.isfinite(c) for c in e) else [math.floor(256 * c) for c in e]


def brute(rows, step=50):
    data = []
    for i, e, label in rows:
        v = integers(e)
        if i is not None and label is not None and v is not None:
            data.append((i, (label + 1) % 10 if i % 7 == 0 else label, v))
    asked = {}
    for i, label, v in data:
        if i % step == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    out = []
    for a, (label, q) in asked.items():
        scores = [(sum(x * y for x, y in zip(q, v)), i, c) for i, c, v in data if i != a]
        best = sorted(((s, i) for s, i, c in scores if c == label), key=lambda t: (-t[0], t[1]))[:5]
        for p, pos in best:
            near = sorted(((s, i) for s, i, c in scores if c != label and 50 * p <= 100 * s <= 95 * p), key=lambda t: (-t[0], t[1]))[:3]
            out += [(a, pos, r + 1, i, p, s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **sizes):
    from pyspark.sql import functions as F
    df = frame(spark, rows)
    v = hn.labelled_vectors(df, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in hn.mine_negatives(v.where("vec_id % 50 = 0"), v, **sizes).collect())


@pytest.mark.parametrize("dims,scale", [(1, 0.2), (8, 0.2), (13, 3.0), (64, 1e6)])
def test_plane_bytes_give_exact_scores(dims, scale):
    rng = np.random.default_rng(dims)
    x = np.floor(rng.normal(0, scale, (300, dims)) * 256).astype(np.int64)
    block = hn.PlaneBlock(Piece(np.arange(300), x, [rng.integers(0, 4, 300)]))
    q = np.floor(rng.normal(0, scale, (7, dims)) * 256).astype(np.int64)
    assert block.scores(q, slice(0, 300)).tolist() == (block.x.astype(object) @ q.T.astype(object)).tolist()
    assert block.scores(q, slice(40, 90)).tolist() == (block.x[40:90].astype(object) @ q.T.astype(object)).tolist()


def test_subset_tables():
    t = hn.subset_sums(np.array([[3, -5, 7], [1, 1, 1]]), 1)[0]
    assert t[0].tolist() == [0, 0] and t[5].tolist() == [10, 2] and t[255].tolist() == [5, 3]


def test_best_rows_breaks_ties_by_id():
    assert best_rows(np.array([9, 4, 7, 1]), np.array([5, 5, 6, 5]), 3).tolist() == [2, 3, 1]
    assert best_rows(np.array([], int), np.array([], int), 3).tolist() == []


def test_negatives_match_brute_force(spark):
    rows = vectors(230, 5, 1)
    rows += [(50, None, 1), (300, [0.1, None, 0.2], 1), (350, [float("nan")] * 5, 1), (400, [float("inf"), 0.0, 0.0, 0.0, 0.0], 2), (None, [0.1] * 5, 1),
             (450, [0.3] * 5, None), (500, [0.5, 0.5], 0), (550, [], 1), rows[3], rows[3], rows[100], (150, [0.1] * 5, 2), (600, [0.0] * 5, 1), (601, [0.0] * 5, 2)]
    want = brute(rows)
    assert len(want) > 20
    assert mined(spark, rows, block_rows=60, chunk_rows=2) == want == mined(spark, rows)


def test_large_components_are_scored_exactly(spark):
    rows = [(i, [c * 1e6 for c in e], label) for i, e, label in vectors(120, 4, 2)] + [(i + 200, [c * 1e7 for c in e], label) for i, e, label in vectors(9, 4, 6)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_a_long_are_an_error(spark):
    rows = [(0, [1e10] * 4, 1), (1, [1e10] * 4, 1), (2, [1e9] * 4, 2)]
    with pytest.raises(Exception, match="exceeds a long"):
        mined(spark, rows)
    with pytest.raises(Exception, match="exceeds a long"):
        integer_vectors(frame(spark, [(0, [1e300], 1)])).collect()


def test_no_rows_no_anchors_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, vectors(40, 3, 3)[1:]) == []
    assert mined(spark, [(i, e, 4) for i, e, _ in vectors(6, 3, 4)]) == []


def test_blocks_are_shuffled_once(spark):
    """Each block once, each chunk once a block."""
    from pyspark.sql import functions as F
    v = hn.labelled_vectors(frame(spark, vectors(400, 6, 5)), F.col("label"))
    def answer(index, chunk):
        return (np.array([index]), chunk.ids[:1])
    from redline.llm.vectors import block_search
    got = block_search(v, v.where("vec_id % 10 = 0"), lambda piece: int(piece.ids.sum()), answer, "block long, first long", "count", longs=("label",), block_rows=100, chunk_rows=5)
    rows = got.collect()
    assert len(rows) == 4 * 8 and len({r.block for r in rows}) == 4
