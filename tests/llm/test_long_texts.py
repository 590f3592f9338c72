"""Long texts in parts: the same results as in one piece, in memory of a few times the text."""
import random
import tracemalloc

import numpy as np
import pytest

from redline.llm import common, quality_cascade, quality_qda, toxicity_pu
from redline.llm.text_stats import TextStats


def texts(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé#!. ") for _ in range(rnd.randint(1, 12)))
    return [rnd.choice(["\n", " "]).join(word() for _ in range(rnd.randint(0, 300))) for _ in range(n)] + ["x" * 700, "", "\n" * 50, "q " * 400]


def chunk(rows):
    data = [t.encode() for t in rows]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data]))


@pytest.mark.parametrize("part", [1, 7, 64])
def test_hashes_and_counts_do_not_depend_on_the_parts(monkeypatch, part):
    buf, off = chunk(texts(1, 12))
    whole = TextStats(buf, off)
    want = {n: getattr(whole, n) for n in ("n_words", "n_dup_lines", "n_repeat_words", "n_distinct", "n_alpha_words", "n_lines")}
    monkeypatch.setattr(common, "CHUNK_BYTES", part)
    cut = TextStats(buf, off)
    for n, v in want.items():
        assert getattr(cut, n).tolist() == v.tolist(), n
    assert all((x == y).all() for x, y in zip(cut.words, whole.words)) and (cut.lines[0] == whole.lines[0]).all()


def test_parts_cover_every_row_and_end_between_words():
    buf, off = chunk(texts(2, 20))
    space = common._SPACE
    seen = [b""] * (len(off) - 1)
    for part, at, rows in common.text_parts(buf, off, space, 100):
        for k, r in enumerate(rows):
            seen[r] += part[at[k]:at[k + 1]].tobytes()
            end = len(seen[r])
            assert end == off[r + 1] - off[r] or space[seen[r][-1]]
    assert seen == [buf[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]


def test_sliced_rows_keep_what_was_computed():
    buf, off = chunk(texts(3, 30))
    t = TextStats(buf, off)
    names = ("n_words", "n_dup_lines", "n_repeat_words", "n_alpha_words", "word_chars", "n_symbols")
    for n in names[:3]:
        getattr(t, n)
    keep = np.array([0, 3, 4, 9, 31, 33])
    part, alone = t.rows(keep), TextStats(*chunk([buf[off[i]:off[i + 1]].tobytes().decode() for i in keep]))
    assert "words" in part._made and "n_repeat_words" in part._made
    for n in names:
        assert getattr(part, n).tolist() == getattr(alone, n).tolist() == getattr(t, n)[keep].tolist(), n
    assert all((x == y).all() for x, y in zip(part.words, alone.words))


@pytest.mark.parametrize("work,times", [
    (lambda b, o: quality_qda.features(TextStats(b, o)), 24),
    (lambda b, o: (lambda t: (quality_cascade.base_failed(t), [r.rejects(t) for r in quality_cascade.RULES]))(TextStats(b, o)), 24),
    (lambda b, o: toxicity_pu.PUModel(np.arange(0, 4000, 21), np.ones(191), 0.0).scores(b, o), 12)], ids=["op2", "op10", "op4"])
def test_memory_is_a_few_times_the_text(work, times):
    """At 50 MB this stays under the 1.2 GB that a worker has beside the heap."""
    rnd = random.Random(5)
    lexicon = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    buf, off = chunk([" ".join(rnd.choice(lexicon) for _ in range(2_000_000))])
    common.powers(common.CHUNK_BYTES)
    tracemalloc.start()
    work(buf, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < times * len(buf) + (32 << 20), peak / len(buf)
