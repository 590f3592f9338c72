"""Batch alignment against the sequence matcher, pair by pair."""
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redline.functions import blocks as B
from redline.operators.align import align_tokens

TOKENS = pa.list_(pa.string())


def same(pairs):
    got = B.align_batch(pa.array([p[0] for p in pairs], TOKENS), pa.array([p[1] for p in pairs], TOKENS), align_tokens).to_pylist()
    assert len(got) == len(pairs)
    for (a, b), g in zip(pairs, got):
        if a is None or b is None:
            assert g is None
        else:
            assert (g["tags"], g["gap_tags"]) == align_tokens(a, b), (a, b)


words = st.lists(st.sampled_from("abcdé"), max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.none() | words, st.none() | words), max_size=8))
def test_any_batch(pairs):
    same(pairs)


@pytest.mark.parametrize("seed", range(12))
def test_edited_sentences_and_popular_words(seed):
    rnd = random.Random(seed)
    v = [str(i) for i in range(rnd.choice([3, 30, 300]))]
    pairs = []
    for n in (3, 20, 199, 200, 201, 450):
        a = [rnd.choice(v) if rnd.random() < 0.6 else "the" for _ in range(n)]
        b = [x for x in a if rnd.random() < 0.95]
        for _ in range(n // 20):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice(v))
        pairs += [(a, b), (b, a), (a, a), (a[: n // 3], b)]
    same(pairs + [(["the"] * 250, ["the"] * 260), ([], ["x"]), (None, None)])


def test_a_slice_of_a_batch_and_no_rows():
    whole = pa.array([["x"], ["a", "b"], None, ["c"]], TOKENS)
    other = pa.array([["x"], ["b"], ["a"], ["d", "c"]], TOKENS)
    got = B.align_batch(whole.slice(1, 3), other.slice(1, 3), align_tokens).to_pylist()
    assert got[0]["tags"] == ["DELETE", "KEEP"] and got[1] is None and got[2]["gap_tags"] == ["INSERT_d", "KEEP_GAP"]
    assert len(B.align_batch(whole.slice(0, 0), other.slice(0, 0), align_tokens)) == 0


def test_pairs_beyond_the_cell_limit_are_aligned_alone(monkeypatch):
    monkeypatch.setattr(B, "MAX_CELLS", 30)
    asked = []

    def one(a, b):
        asked.append(len(a))
        return align_tokens(a, b)

    pairs = [(["a"] * 8, ["a"] * 7), (["a", "b"], ["b"]), (["a"] * 8, ["a", "b"] * 7), (["a"] * 5, ["a"] * 6), (["c"], [])]
    got = B.align_batch(pa.array([p[0] for p in pairs], TOKENS), pa.array([p[1] for p in pairs], TOKENS), one).to_pylist()
    assert [(g["tags"], g["gap_tags"]) for g in got] == [align_tokens(*p) for p in pairs] and asked == [8, 8]


def test_time_grows_with_the_batch():
    """A batch of long texts with few repeats takes rounds by depth, not a Python step a word."""
    rnd = random.Random(1)
    a = [str(rnd.randrange(5000)) for _ in range(20_000)]
    b = [x for x in a if rnd.random() < 0.98]
    same([(a, b)])
    rounds = [0]
    grow = B._grow

    def counted(*args):
        rounds[0] += 1
        return grow(*args)

    B._grow = counted
    try:
        codes = {w: i for i, w in enumerate(sorted({*a, *b}))}
        x, y = (np.array([codes[w] for w in t]) for t in (a, b))
        B.matching_blocks(x, np.array([0, len(x)]), y, np.array([0, len(y)]))
    finally:
        B._grow = grow
    assert rounds[0] < 200


def test_blocks_grow_by_many_tokens_at_a_time(monkeypatch):
    """a block that grows over thousands of popular tokens takes some rounds, not one a token."""
    import numpy as np
    from redline.functions import blocks
    a = np.array([0] * 5000 + [1] + [0] * 3000)
    rounds, plain = [], np.arange
    monkeypatch.setattr(blocks.np, "arange", lambda *x: rounds.append(1) or plain(*x))
    n = blocks._equal(a, a, np.array([5001, 4999, 8000, 5]), np.array([5001, 4999, 8000, 4]), np.array([3000, 1, 0, 9000 - 5000]), 1)
    assert n.tolist() == [3000, 1, 0, 4000] and len(rounds) < 30
    assert blocks._equal(a, a, np.array([4999, 3]), np.array([4999, 4]), np.array([5000, 4]), -1).tolist() == [5000, 4]
