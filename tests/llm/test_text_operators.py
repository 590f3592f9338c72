import random

import numpy as np
import pytest

from redline.llm.common import connected_components
from redline.llm.induced_sort import permuted_lcp, suffix_arrays
from redline.llm.ngram_join import ngram_join
from redline.llm.quality_cascade import RULES, quality_cascade, rule_order
from redline.llm.suffix_dedup import suffix_dedup
import redline.llm.ngram_join as nj
import redline.llm.suffix_dedup as sd

from .helpers import base_counts, components, docs, repeated_bytes, shingles


def test_suffix_arrays_and_common_prefixes_equal_sorting():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n, lanes, letters = int(rng.integers(1, 70)), int(rng.integers(1, 5)), int(rng.integers(1, 5))
        t = rng.integers(1, 1 + letters, (n, lanes)).astype(np.int32)
        t[-1] = 0
        sa = suffix_arrays(t, letters + 1)
        lcp = permuted_lcp(t, sa)
        for b in range(lanes):
            s = t[:, b].tolist()
            want = sorted(range(n), key=lambda i: s[i:])
            assert sa[:, b].tolist() == want
            for x, y in zip(want, want[1:]):
                k = 0
                while x + k < n and y + k < n and s[x + k] == s[y + k]:
                    k += 1
                assert lcp[y, b] == k


def _texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, near = prose(60), prose(80)
    rows = [(i, prose(rnd.randint(0, 120))) for i in range(20)]
    rows += [(20 + i, prose(10) + " " + passage + " " + prose(8)) for i in range(12)]       # one passage, many contexts
    rows += [(40 + i, near.replace(near.split()[i], word(), 1)) for i in range(8)]          # near copies
    rows += [(50 + i, rows[3][1]) for i in range(4)]                                        # exact copies
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "one two"), (64, "one two"), (65, "ab" * 400), (66, prose(3000))]
    return rows


@pytest.mark.parametrize("split_bytes", [12 << 10, 300])
def test_suffix_dedup_equals_counting_windows(spark, monkeypatch, split_bytes):
    monkeypatch.setattr(sd, "SPLIT_BYTES", split_bytes)     # the small value splits anchors down to single windows
    monkeypatch.setattr(sd, "BLOCK_BYTES", 2000)
    rows = _texts(4)
    want = repeated_bytes(rows, 50)
    got = suffix_dedup(docs(spark, rows), length=50, k=12, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, gone, spans), r.doc_id
        assert r.kept_text == kept.decode("utf-8", "ignore")


def test_suffix_dedup_sorts_without_the_segments_table(spark, monkeypatch):
    """While the shards are sorted only the places of the segments are kept, and the shuffle that counted them is let go."""
    import pathlib
    events, sort, forget = [], sd._sorted_shards, sd.forget_shuffles

    def seen(*a):
        root = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        events.append({x.name.rsplit("-", 1)[0] for x in root.iterdir()} - before)
        return sort(*a)
    before = {x.name.rsplit("-", 1)[0] for x in pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir()} - {"sa_segments"}
    monkeypatch.setattr(sd, "_sorted_shards", seen)
    monkeypatch.setattr(sd, "forget_shuffles", lambda s: (events.append("forgot"), forget(s)))
    rows = [(i, "some words that come again and again in every text " * 3 + str(i)) for i in range(9)]
    got = suffix_dedup(docs(spark, rows), length=50, k=12).collect()
    assert all(r["n_removed"] > 100 for r in got) and len(got) == 9
    at = next(i for i, e in enumerate(events) if e != "forgot")
    assert "sa_segments" not in events[at] and events[:at] == ["forgot", "forgot"]


def test_ngram_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nj, "SMALL", 3)                     # large buckets: pivots, then blocks
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(nj, "PIVOT_ROUNDS", 1)
    rows = _texts(5) + [(70 + i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in range(12)]   # a chain of links
    sets = {d: shingles(t) for d, t in rows}
    want = components(sets, 85)
    got = ngram_join(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, len(sets[d]), want[d]) for d in sets)


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(rnd.randint(300, 330), rnd.randint(300, 330)) for _ in range(20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = {i: frozenset([i]) for e in edges for i in e}
    root = {i: i for i in sets}
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in root.items() if k in got} == got
    assert all(root[k] == k for k in root if k not in got)


def test_cascade_counts_order_and_verdict(spark):
    rnd = random.Random(1)
    rows = _texts(6) + [(80, "a b c d " * 40), (81, "x\ny\nx\n \n\nx"), (82, "WORD!! " * 60), (83, " ".join(f"w{i}$$$" for i in range(80)))]
    rows += [(90 + i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(80))) for i in range(5)]
    got = {r.doc_id: r for r in quality_cascade(docs(spark, rows)).collect()}
    for d, t in rows:
        want = base_counts(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rejected_by is None)
    assert got[83].rejected_by == "symbols" and all(got[90 + i].kept for i in range(5))
    assert {r.name for r in rule_order(docs(spark, rows))} == {r.name for r in RULES}


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).where("doc_id = 0")
    assert suffix_dedup(none).count() == 0
    assert ngram_join(none).count() == 0
    assert quality_cascade(none).count() == 0
