"""Sequence metrics against brute-force Python on a small fixture."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from redline.functions import bitvectors as V
from redline.operators import textmetrics as TM

PAIRS = [(1, "the cat sat on the mat", "the cat sat on a mat"),
         (2, "a b c d", "a b c d"),
         (3, "x y", "y x z"),
         (4, "", "hello world"),
         (5, "one two three four five", "one three two four five six")]


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
        prev = cur
    return prev[-1]


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def _df(spark):
    return spark.createDataFrame(PAIRS, "pair_id long, prediction string, reference string")


def test_wer(spark):
    got = TM.word_error_rate(_df(spark)).collect()[0].wer
    want = sum(_lev(p.split(), r.split()) for _, p, r in PAIRS) / sum(len(r.split()) for _, _, r in PAIRS)
    assert abs(got - want) < 1e-12


def test_rouge_l_and_lcs(spark):
    got = TM.rouge_l(_df(spark)).collect()[0].rougeL
    fs = []
    for _, p, r in PAIRS:
        a, b = p.split(), r.split()
        lcs = _lcs(a, b)
        fs.append(0.0 if lcs == 0 else 2 * lcs / (len(a) + len(b)))
    assert abs(got - sum(fs) / len(fs)) < 1e-12


def test_bleu(spark):
    got = TM.corpus_bleu(_df(spark)).collect()[0].bleu
    m, t = Counter(), Counter()
    c = r_len = 0
    for _, p, r in PAIRS:
        a, b = p.split(), r.split()
        c += len(a)
        r_len += len(b)
        for n in range(1, 5):
            ga = Counter(tuple(a[i:i + n]) for i in range(len(a) - n + 1))
            gb = Counter(tuple(b[i:i + n]) for i in range(len(b) - n + 1))
            m[n] += sum(min(v, gb[k]) for k, v in ga.items())
            t[n] += sum(ga.values())
    bp = 1.0 if c > r_len else math.exp(1 - r_len / c)
    want = bp * math.exp(sum(math.log(m[n] / t[n]) for n in range(1, 5)) / 4) * 100
    assert abs(got - want) < 1e-9


def _trace(ref, can):
    """The reference tokens that the textbook walk through the table takes."""
    t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(can) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if ref[i - 1] == can[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = [False] * len(ref), len(ref), len(can)
    while i and j:
        if ref[i - 1] == can[j - 1]:
            out[i - 1] = True
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


@pytest.mark.parametrize("longest", [5, 70, 150, 300])
def test_bit_vectors_against_tables(longest, monkeypatch):
    """Lanes of one to four words, and longer ones on Python integers."""
    monkeypatch.setattr(V, "HISTORY_BYTES", 1 << 16)
    rnd = random.Random(longest)
    pairs = [tuple([rnd.randrange(6) for _ in range(rnd.randint(0, longest))] for _ in "ab") for _ in range(16)]
    a, b = (np.array([x for p in pairs for x in p[s]], np.int64) for s in (0, 1))
    a_off, b_off = (np.append(0, np.cumsum([len(p[s]) for p in pairs])) for s in (0, 1))
    assert V.distances(a, a_off, b, b_off).tolist() == [_lev(x, y) for x, y in pairs]
    assert V.lcs_lengths(a, a_off, b, b_off).tolist() == [_lcs(x, y) for x, y in pairs]
    assert V.lcs_members(a, a_off, b, b_off).tolist() == [t for x, y in pairs for t in _trace(x, y)]


def _lsum(pred, ref):
    """Union of each reference line's subsequences, words counted no oftener than the prediction has them."""
    p, r = ([line.split() for line in (t or "").split("\n")] for t in (pred, ref))
    have, hits = Counter(w for line in p for w in line), 0
    for line in r:
        union = [any(t) for t in zip(*(_trace(line, c) for c in p))]
        for w, taken in zip(line, union):
            if taken and have[w]:
                have[w] -= 1
                hits += 1
    n = sum(map(len, p)) + sum(map(len, r))
    return 2 * hits / n if hits else 0.0


def test_rouge_lsum_over_lines(spark):
    rnd = random.Random(3)
    text = lambda: "\n".join(" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 5)))
    pairs = [(text(), text()) for _ in range(60)] + [("", "a"), (None, "a b"), ("a", None), ("x\ny", "y\nx"), ("a a a", "a\na"), ("w " * 300, "w " * 290)]
    got = TM.rouge_lsum(spark.createDataFrame(pairs, "prediction string, reference string").repartition(2)).first()[0]
    assert got == pytest.approx(sum(_lsum(*p) for p in pairs) / len(pairs))
    one = spark.createDataFrame([("the cat\nsat down", "sat down\nthe cat")], "prediction string, reference string")
    assert TM.rouge_lsum(one).first()[0] == 1.0 > TM.rouge_l(one).first()[0]


def test_every_row_is_a_pair_of_its_own(spark):
    """One right and two swapped pairs score alike under one key and under three; a null side has no tokens."""
    rows = [("a b c d", "a b c d"), ("e f g h", "h g f e"), ("i j k l", "l k j i")]
    one, three = (spark.createDataFrame([(k * i, *r) for i, r in enumerate(rows)], "pair_id long, prediction string, reference string") for k in (0, 1))
    for f, name in ((TM.corpus_bleu, "bleu"), (TM.rouge_n, "rouge2")):
        assert f(one).first()[name] == pytest.approx(f(three).first()[name])
    assert TM.rouge_n(one).first().rouge2 == pytest.approx(1 / 3)
    odd = spark.createDataFrame([(1, None, "a b"), (1, "a b", "a b")], "pair_id long, prediction string, reference string")
    assert TM.rouge_n(odd).first().rouge1 == TM.rouge_l(odd).first()[0] == 0.5 and TM.word_error_rate(odd).first()[0] == 0.5
    assert TM.rouge_n(odd.where("false")).first().rouge1 is None
