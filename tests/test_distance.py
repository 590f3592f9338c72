from hypothesis import given, settings
from hypothesis import strategies as st

from redline.functions.distance import bitparallel_levenshtein


def _dp(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
        prev = cur
    return prev[-1]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcé日 ", max_size=30), st.text(alphabet="abcé日 ", max_size=30))
def test_bitparallel_equals_dp(a, b):
    assert bitparallel_levenshtein(a, b) == _dp(a, b)


def test_batches_equal_single_pairs():
    """Short and long, near and far pairs, nulls, characters beyond the basic plane; above ``most`` any larger number."""
    import random

    import pyarrow as pa

    from redline.functions import distance as D
    r = random.Random(3)
    left, right = [], []
    for i in range(400):
        a = "".join(r.choice("abcé日 \U0001F600") for _ in range(r.choice([0, 3, 31, 33, 70, 200]) + r.randrange(9)))
        b = list(a)
        for _ in range(r.choice([0, 2, 12, 80])):
            if b:
                b[r.randrange(len(b))] = r.choice(["", "x", "yy"])
        left.append(None if i % 40 == 7 else a)
        right.append(None if i % 40 == 9 else "".join(b))
    true = [None if a is None or b is None else bitparallel_levenshtein(a, b) for a, b in zip(left, right)]
    assert D.text_distances(pa.array(left), pa.array(right), pa.nulls(400, pa.int64())).to_pylist() == true
    most = [r.choice([0, 5, 31, 32, 60]) for _ in left]
    got = D.text_distances(pa.array(left), pa.array(right), pa.array(most)).to_pylist()
    assert all(g == t or (t is not None and min(g, t) > m) for g, t, m in zip(got, true, most))
    assert D.text_distances(pa.array([None, ""], pa.string()), pa.array(["a", ""]), pa.nulls(2, pa.int64())).to_pylist() == [None, 0]


def test_small_distances_step_together(monkeypatch):
    """A batch of long minimal edits: all but the few longest pairs leave the single-pair path alone."""
    import pyarrow as pa

    from redline.functions import distance as D
    calls = []
    monkeypatch.setattr(D, "bitparallel_levenshtein", lambda *a: calls.append(a) or bitparallel_levenshtein(*a))
    left = ["word " * 40 + str(i) for i in range(500)]
    got = D.text_distances(pa.array(left), pa.array([x.replace("word", "wrod", 2) for x in left]), pa.nulls(500, pa.int64()))
    assert set(got.to_pylist()) == {4} and len(calls) < 60


def test_texts_that_differ_all_over_are_bounded_together(monkeypatch):
    """With a limit, reversed texts of a batch do not step alone, but for the few longest; no pair within its limit is lost."""
    import random

    import pyarrow as pa

    from redline.functions import distance as D
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    left = [" ".join(r.choice(words) for _ in range(r.randrange(14, 90))) for _ in range(400)]
    # every third only damaged: at its end, at its front or all over, up to and beyond the limit
    def damaged(t, i):
        b = list(t)
        for _ in range(r.randrange(len(b) // 2)):
            b[r.randrange(len(b)) if i % 2 else r.randrange(len(b) // 3)] = r.choice(["", "x", "yy"])
        return "".join(b)
    right = [damaged(t, i) if i % 3 == 0 else t[::-1] for i, t in enumerate(left)]
    true = [bitparallel_levenshtein(a, b) for a, b in zip(left, right)]
    most = [len(a) * 3 // 10 for a in left]
    calls = []
    monkeypatch.setattr(D, "bitparallel_levenshtein", lambda *a: calls.append(a) or bitparallel_levenshtein(*a))
    got = D.text_distances(pa.array(left), pa.array(right), pa.array(most)).to_pylist()
    assert all(g == t or min(g, t) > m for g, t, m in zip(got, true, most))
    assert len(calls) < 200 and sum(t > m for t, m in zip(true, most)) > 260


def test_edit_filter_folds_each_text_once_for_python(spark):
    """The filter says what the edit ratio says, also where folding changes lengths, and folds a text few times a row."""
    from pyspark.sql import functions as F

    from redline.functions.text import edit_ratio, within_edit_ratio
    long = "Some Plain Words In A Row Of Many "
    rows = [(None, long), (long, None), (None, None), ("", ""), ("", "a"), ("", long), (long, long), ("abc", "abc"), ("ABC", "abc"), (long, long.upper()),
            (long * 3, (long * 3)[::-1]), (long * 3, long * 4), (long * 3, long * 9), ("a" * 70 + "b" * 30, "a" * 100), ("a" * 69 + "b" * 31, "a" * 100),
            ("a" * 7 + "b" * 3, "a" * 10), ("a" * 6 + "b" * 4, "a" * 10), ("\u0130" * 40, "i" * 40), ("\u0130" * 40, "\u0130" * 30), ("\u03a3" * 40, "\u03c3" * 40)]
    df = spark.createDataFrame([(i, o, c) for i, (o, c) in enumerate(rows)], "i int, o string, c string")
    for t in (0.0, 0.3, 1.0, -0.1):
        got = df.select("i", F.coalesce(edit_ratio("o", "c") <= t, F.lit(False)).alias("want"), within_edit_ratio("o", "c", t).alias("kept")).collect()
        assert [r.kept for r in got] == [r.want for r in got]
    plan = df.where(within_edit_ratio("o", "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 4                  # for Python, and for the short rows
