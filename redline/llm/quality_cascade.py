"""Quality rules as a short-circuit cascade ordered by rejections per cost.

Every rule looks at the counts of a document and rejects or passes it; a
document is kept if no rule rejects it.  The order changes the cost alone: on a
sample each rule's cost (seconds a document) and selectivity (share rejected)
are measured, and rules run by rejections per second, each on the documents
that are still in.

Cases: null and empty texts have no words and fail the base gate; repeated rows
are judged alike; an empty table gives an empty result; other columns are not
read; a document of any length is judged whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_bytes
from .text_stats import TextStats


@dataclass(frozen=True)
class Rule:
    """``rejects(stats)`` is True for each row that fails."""

    name: str
    rejects: Callable[[TextStats], np.ndarray]


def base_failed(t: TextStats, min_words: int = 50, max_repeat_pct: int = 50) -> np.ndarray:
    return (t.n_words < min_words) | (100 * t.n_repeat_words > max_repeat_pct * t.n_words)


#: Thresholds are integer comparisons, so that every engine agrees on them.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)),
    Rule("capitals", lambda t: 2 * t.n_upper > t.n_upper + t.n_lower),
    Rule("marks", lambda t: 5 * t.n_marks > t.n_words),
    Rule("letters", lambda t: 10 * t.n_alpha_words < 7 * t.n_words),
)
#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 2000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(rules):
    def run(batches):
        spent, out, rows = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for b in batches:
            buf, off = text_bytes(b.column(0))
            for lo, hi in row_chunks(off):
                t = TextStats(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                left = np.flatnonzero(~base_failed(t))
                rows += len(left)
                for i, r in enumerate(rules):
                    mine = t.rows(left)               # what the gate has computed is there for every rule, as in the cascade
                    t0 = time.perf_counter()
                    out[i] += int(r.rejects(mine).sum())
                    spent[i] += time.perf_counter() - t0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.name for r in rules]), pa.array(out), pa.array([rows] * len(rules), pa.int64()), pa.array(spent)],
                ["rule", "rejected", "rows", "seconds"])
    return run


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text", seed: int = 11) -> list[Rule]:
    """The rules by rejections per second on about ``sample_rows`` rows (a bounded sample, order only)."""
    n = docs.count()
    if not n:
        return list(rules)
    share = min(1.0, sample_rows / n)
    rows = (docs.select(F.col(text).cast("string").alias("text")).sample(False, share, seed)
            .mapInArrow(_measure(rules), "rule string, rejected long, rows long, seconds double")
            .groupBy("rule").agg(F.sum("rejected").alias("k"), F.sum("rows").alias("n"), F.sum("seconds").alias("s")).collect())
    gain = {r["rule"]: (r["k"] / r["n"]) / max(r["s"] / r["n"], 1e-12) for r in rows}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def _judge(rules):
    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(1))
            cols: list = [[] for _ in range(len(_COUNTS) + 3)]
            for lo, hi in row_chunks(off):
                t = TextStats(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                base = base_failed(t)
                by = np.full(t.n, -1)
                inn = np.flatnonzero(~base)
                left = t.rows(inn) if len(inn) < t.n else t
                for i, r in enumerate(rules):
                    if not len(inn):
                        break
                    out = r.rejects(left)
                    by[inn[out]] = i
                    if out.any():
                        inn, left = inn[~out], left.rows(np.flatnonzero(~out))
                kept = np.zeros(t.n, bool)
                kept[inn] = True
                for c, v in zip(cols, (*(getattr(t, n) for n in _COUNTS), base, kept, by)):
                    c.append(v)
            v = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            names = [r.name for r in rules]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x.astype(np.int64)) for x in v[:5]), pa.array(v[5].astype(bool)), pa.array(v[6].astype(bool)),
                 pa.array([names[i] if i >= 0 else None for i in v[7].tolist()], pa.string())],
                ["doc_id", *_COUNTS, "base_failed", "kept", "rejected_by"])
    return run


def quality_cascade(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text",
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the first rule that rejected."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = rule_order(rows, rules, sample_rows)
    return rows.mapInArrow(_judge(order), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                          "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
