"""Hard-negative mining by Four-Russians scoring.

Components become integers ``floor(256 * x)``.  The dimensions go in groups of
eight; for an anchor, a table of 256 entries per group holds the sums of its
components over every subset of the group.  A candidate stores, for each binary
digit of its components (two's complement) and each group, the byte of the
eight components' digits.  A digit's part of the score is the sum of one table
entry a group; the parts, shifted by their digit and added (the sign digit
subtracted), are the exact score.

First every anchor's best rows of its own label are its positives.  Then, for
each positive, the best rows of other labels whose score lies in a band under
the positive's are the negatives.  Blocks of candidates are kept by label, so
the first pass scores only an anchor's own label; partial best rows of the
blocks are merged per anchor.

Cases: rows with a null id, label or vector, or a null or non-finite component
take no part; shorter vectors count as zero in the missing dimensions; an
anchor's own rows are all rows with its id, whatever their label; of repeated
anchor ids the smallest label, then vector asks; repeated rows are positives and
negatives as often as they occur; ties go to the smaller id; anchors without
positives and positives without negatives give no rows; products beyond a long
are added in Python integers, and a score that a long cannot hold is an error;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table
from .vectors import Piece, as_longs, best_rows, block_search, integer_vectors, product_bound

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these shares of its positive's, in per cent.
BAND = (50, 95)
GROUP = 8
#: Rows scored at once: bounds the looked-up entries to about a megabyte.
SLAB_ROWS = 1024


class PlaneBlock:
    """Candidates by label and id, as packed bytes ``codes[digit, group, row]``."""

    def __init__(self, piece: Piece):
        by = np.lexsort((piece.ids, piece.longs[0]))
        self.ids, self.labels, self.x = piece.ids[by], piece.longs[0][by], piece.x[by]
        low, high = (int(self.x.min()), int(self.x.max())) if self.x.size else (0, 0)
        self.digits = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
        groups = -(-self.x.shape[1] // GROUP)
        wide = np.zeros((len(self.ids), groups * GROUP), np.int64)
        wide[:, :self.x.shape[1]] = self.x
        self.codes = np.stack([np.packbits(((wide >> d) & 1).astype(np.uint8).reshape(len(wide), groups, GROUP), axis=2, bitorder="little")[:, :, 0].T
                               for d in range(self.digits)])

    def rows_of(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))

    def scores(self, anchors: np.ndarray, rows: slice) -> np.ndarray:
        """Exact inner products, ``(row, anchor)``; Python integers where a long may not hold them."""
        bound = product_bound(self.x, anchors)
        kind = np.int32 if bound < 1 << 30 else np.int64 if bound < 1 << 62 else object
        tables = subset_sums(anchors, self.codes.shape[1], kind)
        n = rows.stop - rows.start
        out = np.zeros((n, len(anchors)), kind)
        for lo in range(0, n, SLAB_ROWS):
            part = self.codes[:, :, rows.start + lo:min(rows.start + lo + SLAB_ROWS, rows.stop)]
            for d in range(self.digits - 1, -1, -1):
                digit = tables[0][part[d, 0]]
                for g in range(1, len(tables)):
                    digit = digit + tables[g][part[d, g]]
                into = out[lo:lo + part.shape[2]]
                into *= 2                             # shift-add from the sign digit, which counts negative, downwards
                into += -digit if d == self.digits - 1 else digit
        return out


def subset_sums(anchors: np.ndarray, groups: int, kind=np.int64) -> list[np.ndarray]:
    """Per group a table ``(256, anchor)``: entry ``s`` sums the components whose bit is set in ``s``."""
    wide = np.zeros((len(anchors), groups * GROUP), kind)
    wide[:, :anchors.shape[1]] = anchors
    out = []
    for g in range(groups):
        t = np.zeros((1 << GROUP, len(anchors)), kind)
        for j in range(GROUP):
            t[1 << j:2 << j] = t[:1 << j] + wide[:, g * GROUP + j]
        out.append(t)
    return out


def _concat(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*parts) if parts else ((),) * 5))


def _positives(k: int):
    def answer(block: PlaneBlock, chunk: Piece):
        parts = []
        for label in np.unique(chunk.longs[0]):
            rows = block.rows_of(label)
            who = np.flatnonzero(chunk.longs[0] == label)
            s = block.scores(chunk.x[who], rows)
            ids = block.ids[rows]
            for a, own in enumerate(chunk.ids[who]):
                other = np.flatnonzero(ids != own)
                at = other[best_rows(ids[other], s[other, a], k)]
                parts.append((np.full(len(at), own), ids[at], as_longs(s[at, a])))
        return _concat(parts)[:3]
    return answer


def _negatives(k: int, band: tuple[int, int]):
    def answer(block: PlaneBlock, chunk: Piece):
        parts = []
        s = block.scores(chunk.x, slice(0, len(block.ids)))
        for a, own in enumerate(chunk.ids):
            own_label = block.rows_of(chunk.longs[0][a])
            fit = block.ids != own
            fit[own_label] = False
            other = np.flatnonzero(fit)
            column, ids = s[other, a], block.ids[other]
            for nth, score in enumerate(chunk.lists[0][a].tolist()):
                near = np.flatnonzero((100 * column.astype(object) >= band[0] * score) & (100 * column.astype(object) <= band[1] * score)
                                      if column.dtype == object else (column >= -(-band[0] * score // 100)) & (column <= band[1] * score // 100))
                at = near[best_rows(ids[near], column[near], k)]
                parts.append((np.full(len(at), own), np.full(len(at), nth), ids[at], as_longs(column[at])))
        return _concat(parts)[:4]
    return answer


def mine_negatives(anchors: DataFrame, candidates: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
                   **sizes) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; inputs are ``(vec_id, v, label)``, label a long."""
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.v", "a.label")
    found = block_search(candidates, asked, PlaneBlock, _positives(positives), "anchor_id long, positive_id long, positive_score long", "mine_positives",
                         longs=("label",), query_longs=("label",), **sizes)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best, _ = write_table(found.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < positives), "mine_best")
    scores = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("p"))
    ready = asked.join(scores, asked["vec_id"] == scores["anchor_id"]).select("vec_id", "v", "label", F.col("p.positive_score").alias("scores"))
    near = block_search(candidates, ready, PlaneBlock, _negatives(negatives, band), "anchor_id long, nth long, negative_id long, negative_score long", "mine_negatives",
                        longs=("label",), query_longs=("label",), query_lists=("scores",), **sizes)
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.join(best, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """``(vec_id, v, label)`` of the rows that take part."""
    return integer_vectors(embeddings.withColumn("_class", label.cast("long")).where("_class is not null"), "_class").withColumnRenamed("_class", "label")
