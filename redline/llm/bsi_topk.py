"""Exact top-k inner products on a bit-sliced index.

Components become integers ``floor(scale * x)``.  Vectors are dealt evenly to
blocks; a block holds, for every dimension, one bitmap per binary digit of the
component (shifted to be non-negative).  For one query the digits' bitmaps,
weighted by the digits of ``|q|`` (complemented where ``q < 0``), are added by
full adders on whole bitmaps, which gives the scores of all rows of the block
as bit slices.  The best ``k`` rows are then found from the most significant
slice downwards: rows surely in, rows tied so far.  The rows still tied at the
last slice have equal scores and are resolved by id.

``coarse_bits`` low digits can be left out of the sums; rows within the error
that this allows around the k-th score are then scored exactly.

A task holds one block, builds its slices once and streams the queries past it;
the partial best rows are merged per query.

Cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows without an id; any finite component is kept: sums beyond a
long are added in Python integers, and a score that a long cannot hold is an
error; shorter vectors count as zero in the missing dimensions; a query's own
row is every row with its id; of repeated query ids the smallest vector asks;
repeated rows are candidates as often as they occur; fewer than ``k`` candidates
give fewer results; ties go to the smaller id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64
from .vectors import BLOCK_ROWS, CHUNK_ROWS, Piece, as_longs, block_search, integer_vectors, product_bound  # noqa: F401

K = 5
COARSE_BITS = 4


class SlicedBlock:
    """Bitmaps of one block: ``slices[dim][digit]`` over rows in ascending id order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(ids)
        if product_bound(x, x) >= 1 << 62:            # differences of components may not fit a long
            x = x.astype(object)
        self.low = x.min(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
        self.digits = [int(v).bit_length() for v in (x - self.low).max(axis=0)] if len(x) else []
        words = (self.n + 63) // 64
        self.slices = []
        for j, n in enumerate(self.digits):
            u = x[:, j] - self.low[j]
            bits = np.stack([(u >> d) & 1 for d in range(n)]).astype(np.uint8) if n else np.zeros((0, self.n), np.uint8)
            packed = np.zeros((n, words * 8), np.uint8)
            packed[:, : (self.n + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
            self.slices.append(packed.view(U64))
        full = np.zeros(words * 8, np.uint8)
        full[: (self.n + 7) // 8] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.all = full.view(U64)

    def summed(self, q: np.ndarray, coarse: int) -> tuple[list[np.ndarray], int]:
        """Slices of ``score' >> coarse`` (a lower bound) and the most that the left-out digits can add to it."""
        piles: dict[int, list[np.ndarray]] = {}
        slack = 0
        for j, w in enumerate(q.tolist()):
            a = abs(w)
            for d in range(self.digits[j]):
                s = self.slices[j][d]
                if w < 0:
                    s = ~s & self.all
                for e in range(a.bit_length()):
                    if a >> e & 1:
                        if d + e < coarse:
                            slack += 1 << (d + e)
                        else:
                            piles.setdefault(d + e - coarse, []).append(s)
        out, p, top = [], 0, max(piles, default=-1)
        while p <= top:
            pile = piles.get(p, [])
            while len(pile) > 2:                      # a full adder: three bitmaps to a sum and a carry
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                half = a ^ b
                pile.insert(0, half ^ c)
                piles.setdefault(p + 1, []).append((a & b) | (half & c))
            if len(pile) == 2:
                a, b = pile
                piles.setdefault(p + 1, []).append(a & b)
                pile = [a ^ b]
            out.append(pile[0] if pile else np.zeros_like(self.all))
            top = max(top, max((k for k, v in piles.items() if v), default=-1) if p >= top else top)
            p += 1
        return out, slack

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def best(self, q: np.ndarray, own: int, k: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the block's best ``k`` rows other than ``own``."""
        slices, slack = self.summed(q, coarse)
        lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        live = self.all
        if hi > lo:
            mask = np.zeros(len(self.all) * 64, np.uint8)
            mask[lo:hi] = 1
            live = live & ~np.packbits(mask, bitorder="little").view(U64)
        sure, tied, kth = np.zeros_like(live), live, 0
        count = int(np.bitwise_count(live).sum())
        if count > k:
            have = 0
            for i in range(len(slices) - 1, -1, -1):
                up = tied & slices[i]
                n = int(np.bitwise_count(up).sum())
                if have + n > k:
                    tied, kth = up, kth | 1 << i
                elif have + n < k:
                    sure, tied, have = sure | up, tied & ~slices[i], have + n
                else:
                    sure, tied, kth = sure | up, np.zeros_like(live), kth | 1 << i
                    break
        rows = self._rows(sure | tied)
        if slack and count > k:
            # rows whose bound lies within the error of the k-th may still belong
            floor = max(0, kth - (slack >> coarse) - 1)
            rows = self._rows(_at_least(slices, floor, live))
        wide = product_bound(self.x, q[None, :]) >= 1 << 62
        scores = self.x[rows].astype(object) @ q.astype(object) if wide else self.x[rows] @ q
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def _at_least(slices: list[np.ndarray], value: int, live: np.ndarray) -> np.ndarray:
    """Rows whose sliced number is ``value`` or more, from the top slice downwards."""
    above, equal = np.zeros_like(live), live
    if value >> len(slices):
        return above
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            equal = equal & slices[i]
        else:
            above, equal = above | (equal & slices[i]), equal & ~slices[i]
    return above | equal


def _index(piece: Piece) -> SlicedBlock:
    by = np.argsort(piece.ids, kind="stable")
    return SlicedBlock(piece.ids[by], piece.x[by])


def _best(k: int, coarse: int):
    def answer(block: SlicedBlock, chunk: Piece):
        found = [(own, *block.best(w, own, k, coarse)) for own, w in zip(chunk.ids.tolist(), chunk.x)]
        return (np.concatenate([np.full(len(i), own) for own, i, _ in found]), np.concatenate([i for _, i, _ in found]),
                np.concatenate([as_longs(s) for _, _, s in found]))
    return answer


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, coarse_bits: int = COARSE_BITS, block_rows: int = BLOCK_ROWS,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs are ``(vec_id, v array<long>)``."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    part = block_search(candidates, asked, _index, _best(k, coarse_bits), "query_id long, vec_id long, score long", "bsi",
                        block_rows=block_rows, chunk_rows=chunk_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
