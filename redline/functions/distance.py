"""Edit distance: bit-parallel Levenshtein in an Arrow UDF for all but short texts.

Spark's ``levenshtein`` fills the full n*m table (and its thresholded form is
not banded).  Short texts stay with it in the JVM; beyond, the bit-vector
recurrence of Myers / Hyyro computes the same distance with one word-parallel
step per character of the second string.  Small distances, the usual case, need
only 64 rows around the diagonal: all pairs of an Arrow batch step together in
numpy.  Of the pairs beyond that band, a bound from 64-character segments finds
those above their limit; the others step alone on Python's integers after equal
ends are cut off.  The UDF receives NULL for short rows and for equal texts, so
they cost a null in the batch.  The edit filter's bounds are checked in the batch
too: as Spark expressions they would fold and measure each text many times a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from .blocks import _spans

U64 = np.uint64
# Texts up to this many characters use the JVM built-in.
LONG_TEXT_CHARS = 32
# Distances up to this one come from a band of 64 rows around the diagonal.
BAND = 31
# Pairs that step together, and entries of their tables (pairs x codes).
LANES, DENSE = 1 << 14, 1 << 21
# Of a batch, so many of the longest texts step alone.
FEW = 16
# Codes of a segment, and the same number for the pairs that are bounded by segments.
SEGMENT, FEWER = 64, 16


def common_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the equal beginning and, in what is left, of the equal end."""
    n = min(len(a), len(b))

    def same(x, y, most):                  # halving: slices compare at memory speed
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if x(lo, mid) == y(lo, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    head = same(lambda i, j: a[i:j], lambda i, j: b[i:j], n)
    tail = same(lambda i, j: a[len(a) - j:len(a) - i], lambda i, j: b[len(b) - j:len(b) - i], n - head)
    return head, tail


def bitparallel_levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance (unit costs, code points), O(len(b) * len(a) / w).

    With ``most``, any number above it may stand for a distance above it.
    """
    head, tail = common_ends(a, b)
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    m = len(a)
    if m == 0:
        return len(b)
    peq: dict = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    mask = (1 << m) - 1
    high = 1 << (m - 1)
    pv, mv, score = mask, 0, m
    left = len(b)
    for ch in b:
        left -= 1
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ((ph << 1) | 1) & mask   # top row D[0][j] = j: carry in +1
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if most is not None and score - left > most:      # each step lowers it by one at most
            return score - left
    return score


def _code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a column and the ``n + 1`` offsets of its texts."""
    text = col.cast(pa.string())
    off = np.append(0, np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False)))
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), "")[0].as_py()
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), off.astype(np.int64)


def banded(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Distances up to ``BAND`` of pairs of code lists, more than ``BAND`` where the distance is above it.

    Left sides have more than ``BAND`` codes and are the longer ones, by ``BAND``
    at most.  A lane (a pair) keeps the 64 rows around its diagonal in one word
    (Hyyro's banded recurrence) and, for each code, the band's rows where the left
    side has it; these move up a row a step, which is caught up when a code is met.
    """
    n, m = np.diff(a_off), np.diff(b_off)
    out = np.zeros(len(n), np.int64)
    width = 1 + int(max(a.max(initial=0), b.max(initial=0)))
    size = max(64, min(LANES, DENSE // width))
    order = np.argsort(-m, kind="stable")
    one, last = U64(1), U64(63)
    for lo in range(0, len(order), size):
        who = order[lo:lo + size]
        k, n1, m1, x_at, y_at = len(who), n[who], m[who], a_off[who], b_off[who]
        bits, since = np.zeros(k * width, U64), np.zeros(k * width, U64)
        base, shorter = np.arange(k) * width, -m1

        def rows(at, i):                              # the code's bits, caught up to step i
            return bits[at] >> (U64(i + BAND) - since[at])        # numpy shifts 64 places or more to 0

        vp, vn = np.full(k, ~U64(0) << U64(63 - BAND)), np.zeros(k, U64)
        score = np.full(k, BAND, U64)                  # unsigned like the words; wraps on the way, not at the end
        for i in range(-BAND, int(m1[0])):
            live = k if i < 0 else int(np.searchsorted(shorter, -i, "left"))
            new = np.flatnonzero(n1[:live] > i + BAND)
            at = base[new] + a[x_at[new] + (i + BAND)]
            bits[at], since[at] = rows(at, i) | (one << last), U64(i + BAND)
            if i < 0:
                continue
            p, q = vp[:live], vn[:live]
            x = rows(base[:live] + b[y_at[:live] + i], i)
            d0 = (((x & p) + p) ^ p) | x | q
            hp, hn = q | ~(d0 | p), d0 & p
            # down the band's lowest diagonal, then along the last row
            score[:live] += (d0 >> last) ^ one
            end = np.flatnonzero(n1[:live] <= i + BAND)
            row = (n1[end] - (i + BAND) + 62).astype(U64)
            score[end] += ((hp[end] >> row) & one) - ((hn[end] >> row) & one) - ((d0[end] >> last) ^ one)
            d0 >>= one
            vp[:live], vn[:live] = hn | ~(d0 | hp), d0 & hp
        out[who] = score
    return out


def segment_bounds(codes: np.ndarray, a_at: np.ndarray, n: np.ndarray, b_at: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair of code lists a number that its distance reaches, unless the distance is above ``most``.

    The left side is cut into segments of 64 codes.  An alignment that costs
    ``most`` at most puts each segment beside a part of the right side at most so
    many places away: the least cost of each there (Myers' search, a word a
    segment, all segments of all pairs together) adds up to the bound.
    """
    pieces, one, last = n // SEGMENT, U64(1), U64(63)
    pair = np.repeat(np.arange(len(n)), pieces)
    at = SEGMENT * _spans(np.zeros(len(n), np.int64), pieces)
    start = np.maximum(0, at - most[pair])
    size = np.maximum(0, np.minimum(m[pair], at + SEGMENT + most[pair]) - start)
    by = np.argsort(-size, kind="stable")
    pair, size, x_at, y_at = pair[by], size[by], (a_at[pair] + at)[by], (b_at[pair] + start)[by]
    out, width = np.zeros(len(n), np.int64), 1 + int(codes.max(initial=0))
    step = max(64, min(LANES, DENSE // width))
    for lo in range(0, len(pair), step):
        who = slice(lo, lo + step)
        x, y, shorter = x_at[who], y_at[who], -size[who]
        k = len(x)
        bits, base = np.zeros(k * width, U64), np.arange(k) * width
        for i in range(SEGMENT):
            bits[base + codes[x + i]] |= one << U64(i)
        vp, vn, score, best = np.full(k, ~U64(0)), np.zeros(k, U64), np.full(k, SEGMENT), np.full(k, SEGMENT)
        for j in range(-int(shorter[0])):
            live = int(np.searchsorted(shorter, -j, "left"))
            p, q = vp[:live], vn[:live]
            eq = bits[base[:live] + codes[y[:live] + j]]
            d0 = (((eq & p) + p) ^ p) | eq | q
            hp, hn = q | ~(d0 | p), d0 & p
            score[:live] += (hp >> last).view(np.int64) - (hn >> last).view(np.int64)
            np.minimum(best[:live], score[:live], out=best[:live])
            hp, hn = hp << one, hn << one             # a match may begin anywhere: nothing comes in above
            vp[:live], vn[:live] = hn | ~(d0 | hp), d0 & hp
        out += np.bincount(pair[who], best, len(n)).astype(np.int64)
    return out


def text_distances(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """Levenshtein distance of each pair of texts, null where a side is null; ``most`` as in ``bitparallel_levenshtein``."""
    here = pc.and_(pc.is_valid(a), pc.is_valid(b))
    a, b, limit = a.filter(here), b.filter(here), most.filter(here).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    (x, x_off), (y, y_off) = _code_points(a), _code_points(b)
    seen = np.zeros(0x110000, bool)                   # characters of the batch, numbered from 0
    seen[x] = seen[y] = True
    code = np.cumsum(seen) - 1
    both = np.concatenate([code[x], code[y]])
    n, m = np.diff(x_off), np.diff(y_off)
    out = np.full(len(n), -1)
    near = np.flatnonzero((np.maximum(n, m) > BAND) & (np.abs(n - m) <= BAND))
    if len(near) > FEW:                               # the few longest would step on for themselves
        near = near[m[near] <= np.sort(m[near])[-FEW]]
    if len(near):                                     # the longer side is the left one
        swap = (n < m)[near]
        start = x_off[near], len(x) + y_off[near]
        longer, shorter = np.where(swap, start[1], start[0]), np.where(swap, start[0], start[1])
        n1, m1 = np.maximum(n, m)[near], np.minimum(n, m)[near]
        offsets = lambda length: np.append(0, np.cumsum(length))
        out[near] = banded(both[_spans(longer, n1)], offsets(n1), both[_spans(shorter, m1)], offsets(m1))
    far = np.flatnonzero((out < 0) | ((out > BAND) & (limit > BAND)))
    apart = far[(n[far] >= SEGMENT) & (limit[far] < n[far])]
    if len(apart) > FEWER:                            # bounds decide most of those that differ all over
        reach = np.minimum(m, 2 * np.minimum(limit, n) + SEGMENT)[apart]
        apart = apart[reach <= np.sort(reach)[-FEWER]]
        bound = segment_bounds(both, x_off[apart], n[apart], len(x) + y_off[apart], m[apart], limit[apart])
        out[apart] = np.where(bound > limit[apart], bound, -1)
        far = far[(out[far] < 0) | (out[far] <= limit[far])]
    for r, s, t, k in zip(far.tolist(), a.take(pa.array(far)).to_pylist(), b.take(pa.array(far)).to_pylist(), limit[far].tolist()):
        out[r] = bitparallel_levenshtein(s, t, k)
    valid = here.to_numpy(zero_copy_only=False)
    return pa.array(out, pa.int64()).take(pa.array(np.cumsum(valid) - 1, mask=~valid))


@F.arrow_udf(LongType())
def _levenshtein_udf(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    return text_distances(a, b, most)


def levenshtein(left: Column, right: Column, long_chars: int = LONG_TEXT_CHARS, most: Column | None = None,
                needed: Column | None = None) -> Column:
    """Levenshtein distance: JVM for short rows, bit-parallel UDF for long rows.

    ``most``: distances above it need not be exact (they stay above it).
    ``needed``: rows where it does not hold get NULL and cost nothing.
    """
    is_long = F.greatest(F.length(left), F.length(right)) > F.lit(long_chars)
    needed = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))
    same = left == right                              # not sent to Python
    go = is_long & needed & ~same
    udf_d = _levenshtein_udf(F.when(go, left), F.when(go, right), F.lit(None).cast("long") if most is None else most.cast("long"))
    return F.when(needed & same, F.lit(0).cast("long")).when(go, udf_d).when(needed, F.levenshtein(left, right).cast("long"))


@F.arrow_udf(BooleanType())
def _share_udf(a: pa.Array, b: pa.Array, whole: pa.Array, most: pa.Array) -> pa.Array:
    """Whether the distance is at most ``most`` of ``whole``; the difference in length decides before a distance is asked for."""
    least = pc.cast(pc.abs(pc.subtract(pc.utf8_length(a), pc.utf8_length(b))), pa.float64())
    whole = pc.cast(whole, pa.float64())
    near = pc.less_equal(pc.divide(least, whole), most)
    d = text_distances(pc.if_else(near, a, None), pc.if_else(near, b, None), pc.cast(pc.ceil(pc.multiply(whole, most)), pa.int64()))
    return pc.and_(near, pc.fill_null(pc.less_equal(pc.divide(pc.cast(d, pa.float64()), whole), most), False))


def share_within(left: Column, right: Column, fold, most: float, long_chars: int = LONG_TEXT_CHARS) -> Column:
    """Whether the distance of the folded texts is at most ``most`` of the longer unfolded text's length.

    Rows whose texts are equal before folding are not sent to Python, short ones
    go to the JVM's distance; a text is folded once.  False if a side is NULL or
    both are empty.
    """
    whole, same, t = F.greatest(F.length(left), F.length(right)), left == right, F.lit(float(most))
    go = (whole > F.lit(long_chars)) & ~same
    far = _share_udf(F.when(go, fold(left)), F.when(go, fold(right)), F.when(go, whole), t)
    short = F.levenshtein(fold(left), fold(right)).cast("double") / F.nullif(whole, F.lit(0)).cast("double") <= t
    return F.coalesce(F.when(same, (whole > 0) & (F.lit(0.0) <= t)).when(go, far).otherwise(short), F.lit(False))
