"""Word edit distance and longest common subsequences of many pairs at once.

Both recurrences keep one bit a left-side token and take one step a right-side
token: Myers' vertical differences for the distance, Hyyro's carry for the
subsequence.  A lane is a pair; the lanes of a batch step together in numpy, in
groups by the 64-bit words that their left side takes (``MAX_WORDS`` at most;
longer ones, few in any text, step alone on Python integers).

Token lists come as codes: flat arrays ``a, b`` with ``n + 1`` offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .blocks import _flat, _spans

U64 = np.uint64
MAX_WORDS = 4
#: Bytes of history that lanes keep at once when their subsequence is traced.
HISTORY_BYTES = 32 << 20


def codes_of(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal strings of two flat columns get equal numbers."""
    x = pa.concat_arrays([left.cast(pa.string()), right.cast(pa.string())]).dictionary_encode().indices.to_numpy().astype(np.int64)
    return x[:len(left)], x[len(left):]


def _lanes(a_off: np.ndarray, b_off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Lanes with equal word counts, longest right side first; the empty ones are left out."""
    n, m = np.diff(a_off), np.diff(b_off)
    words = -(-n // 64)
    for w in np.unique(words[(n > 0) & (m > 0)]):
        who = np.flatnonzero((words == w) & (m > 0))
        yield int(w), who[np.argsort(-m[who], kind="stable")]


def _equal_bits(a, a_off, b, b_off, who: np.ndarray, words: int):
    """``(masks, at)``: ``masks[w][at[i] + j]`` has the bits of lane ``i``'s left tokens that equal its right token ``j``."""
    n, m = np.diff(a_off)[who], np.diff(b_off)[who]
    x, y = a[_spans(a_off[who], n)], b[_spans(b_off[who], m)]
    lane_x, lane_y = np.repeat(np.arange(len(who)), n), np.repeat(np.arange(len(who)), m)
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    width = int(max(x.max(), y.max())) + 1
    key = (lane_x * width + x) * words + place // 64
    by = np.argsort(key, kind="stable")
    key = key[by]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    bits = np.bitwise_or.reduceat(U64(1) << (place[by] % 64).astype(U64), head)
    key = key[head]
    masks = []
    for w in range(words):
        wanted = (lane_y * width + y) * words + w
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        masks.append(np.where(key[at] == wanted, bits[at], U64(0)))
    return masks, np.cumsum(m) - m


def _steps(m: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(step, lanes still running)`` for right-side lengths in descending order."""
    for j in range(int(m[0])):
        yield j, int(np.searchsorted(-m, -j, "left"))


def distances(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Levenshtein distance of every pair."""
    from .distance import bitparallel_levenshtein
    n, m = np.diff(a_off), np.diff(b_off)
    out = np.where(n == 0, m, n)                      # one side empty; lanes that run are overwritten
    for words, who in _lanes(a_off, b_off):
        if words > MAX_WORDS:
            for r in who:
                out[r] = bitparallel_levenshtein(a[a_off[r]:a_off[r + 1]].tolist(), b[b_off[r]:b_off[r + 1]].tolist())
            continue
        masks, at = _equal_bits(a, a_off, b, b_off, who, words)
        up = [np.full(len(who), ~U64(0)) for _ in range(words)]
        down = [np.zeros(len(who), U64) for _ in range(words)]
        top = [np.full(len(who), U64(1) << U64(63))] * (words - 1) + [U64(1) << ((n[who] - 1) % 64).astype(U64)]
        score = n[who].copy()
        for j, live in _steps(m[who]):
            carry = np.ones(live, np.int64)           # the row above grows by one a step
            for w in range(words):
                eq, pv, mv = masks[w][at[:live] + j], up[w][:live], down[w][:live]
                less, more = (carry < 0).astype(U64), (carry > 0).astype(U64)
                xv = eq | mv
                eq = eq | less
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                carry = ((ph & top[w][:live]) != 0).astype(np.int64) - ((mh & top[w][:live]) != 0)
                ph, mh = ph << U64(1) | more, mh << U64(1) | less
                up[w][:live], down[w][:live] = mh | ~(xv | ph), ph & xv
            score[:live] += carry
        out[who] = score
    return out


def _ones(n: np.ndarray, words: int) -> list[np.ndarray]:
    """The lowest ``n`` bits set, word by word."""
    out = []
    for w in range(words):
        k = np.clip(n - 64 * w, 0, 64)
        out.append(np.where(k == 64, ~U64(0), (U64(1) << np.minimum(k, 63).astype(U64)) - U64(1)))
    return out


def _lcs_step(state: list[np.ndarray], masks: list[np.ndarray], at: np.ndarray, live: int) -> None:
    """Bits of tokens that lengthen the common subsequence turn to zero."""
    carry = np.zeros(live, U64)
    for s, eq in zip(state, masks):
        v = s[:live]
        u = v & eq[at]
        t = v + u
        over = t < v
        total = t + carry
        carry = (over | (total < t)).astype(U64)
        s[:live] = total | (v - u)


def lcs_lengths(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of every pair."""
    n, m = np.diff(a_off), np.diff(b_off)
    out = np.zeros(len(n), np.int64)
    for words, who in _lanes(a_off, b_off):
        if words > MAX_WORDS:
            for r in who:
                s = _long_states(a[a_off[r]:a_off[r + 1]].tolist(), b[b_off[r]:b_off[r + 1]].tolist())[-1]
                out[r] = n[r] - (s & ((1 << int(n[r])) - 1)).bit_count()
            continue
        masks, at = _equal_bits(a, a_off, b, b_off, who, words)
        state = [np.full(len(who), ~U64(0)) for _ in range(words)]
        for j, live in _steps(m[who]):
            _lcs_step(state, masks, at[:live] + j, live)
        out[who] = n[who] - sum(np.bitwise_count(s & k).astype(np.int64) for s, k in zip(state, _ones(n[who], words)))
    return out


def _long_states(a: list, b: list) -> list[int]:
    """State of the subsequence recurrence after each right-side token, as Python integers."""
    eq: dict = {}
    for i, x in enumerate(a):
        eq[x] = eq.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    states = [mask]
    for y in b:
        s = states[-1]
        u = s & eq.get(y, 0)
        states.append(((s + u) | (s - u)) & mask)
    return states


def lcs_members(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """For every left token, whether the pair's common subsequence takes it.

    Of several longest ones that which is met from the ends backwards: equal
    tokens are taken; else the right side steps back if that alone keeps the
    length, otherwise the left one.
    """
    out = np.zeros(len(a), bool)
    n, m = np.diff(a_off), np.diff(b_off)
    for words, who in _lanes(a_off, b_off):
        if words > MAX_WORDS:
            for r in who:
                out[a_off[r]:a_off[r + 1]] = _long_members(a[a_off[r]:a_off[r + 1]].tolist(), b[b_off[r]:b_off[r + 1]].tolist())
            continue
        lo = 0
        while lo < len(who):                          # the longest right side comes first
            hi = min(len(who), lo + max(1, HISTORY_BYTES // (8 * words * (int(m[who[lo]]) + 1))))
            _trace(a, a_off, b, b_off, who[lo:hi], words, out)
            lo = hi
    return out


def _trace(a, a_off, b, b_off, who, words, out) -> None:
    n, m = np.diff(a_off)[who], np.diff(b_off)[who]
    masks, at = _equal_bits(a, a_off, b, b_off, who, words)
    state = [np.full(len(who), ~U64(0)) for _ in range(words)]
    history = np.empty((int(m[0]) + 1, words, len(who)), U64)
    history[0] = ~U64(0)
    for j, live in _steps(m):
        _lcs_step(state, masks, at[:live] + j, live)
        history[j + 1] = state

    def length(i, j, lane):                           # of the first i and j tokens: zeros below bit i
        return i - sum(np.bitwise_count(history[j, w, lane] & k).astype(np.int64) for w, k in enumerate(_ones(i, words)))

    lane, i, j = np.arange(len(who)), n.copy(), m.copy()
    while len(lane):
        x, y = a_off[who[lane]] + i - 1, b_off[who[lane]] + j - 1
        same = a[x] == b[y]
        out[x[same]] = True
        right = ~same & (length(i, j - 1, lane) > length(i - 1, j, lane))
        i, j = i - (same | ~right), j - (same | right)
        go = (i > 0) & (j > 0)
        lane, i, j = lane[go], i[go], j[go]


def _long_members(a: list, b: list) -> list[bool]:
    states = _long_states(a, b)
    out, i, j = [False] * len(a), len(a), len(b)
    length = lambda i, j: i - (states[j] & ((1 << i) - 1)).bit_count()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out[i - 1] = True
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


def union_hits(ref: np.ndarray, ref_lines: np.ndarray, ref_rows: np.ndarray, pred: np.ndarray, pred_lines: np.ndarray, pred_rows: np.ndarray) -> np.ndarray:
    """Per row: reference tokens in the union, over the prediction's lines, of each reference line's common subsequences.

    ``*_lines`` are token offsets by line, ``*_rows`` line offsets by row.  A word
    counts no oftener than the prediction has it.
    """
    n_rows = len(ref_rows) - 1
    r_row, p_row = (np.repeat(np.arange(n_rows), np.diff(x)) for x in (ref_rows, pred_rows))      # row of each line
    per = np.diff(pred_rows)[r_row]                   # each reference line meets every line of its prediction
    r_line, p_line = np.repeat(np.arange(len(r_row)), per), _spans(pred_rows[r_row], per)
    r_len, p_len = np.diff(ref_lines), np.diff(pred_lines)
    taken = np.zeros(len(ref), bool)
    lo, size = 0, np.cumsum(r_len[r_line] + p_len[p_line])
    while lo < len(r_line):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 20), "right")))
        a_at, b_at = _spans(ref_lines[r_line[lo:hi]], r_len[r_line[lo:hi]]), _spans(pred_lines[p_line[lo:hi]], p_len[p_line[lo:hi]])
        a_off, b_off = (np.append(0, np.cumsum(x)) for x in (r_len[r_line[lo:hi]], p_len[p_line[lo:hi]]))
        hit = lcs_members(ref[a_at], a_off, pred[b_at], b_off)
        taken[a_at[hit]] = True
        lo = hi
    ref_row, pred_row = np.repeat(r_row, r_len), np.repeat(p_row, p_len)
    width = int(max(ref.max(initial=0), pred.max(initial=0))) + 1
    words, count = np.unique((ref_row * width + ref)[taken], return_counts=True)
    have, times = np.unique(pred_row * width + pred, return_counts=True)
    at = np.minimum(np.searchsorted(have, words), max(0, len(have) - 1))
    return np.bincount(words // width, np.minimum(count, times[at] if len(have) else 0), n_rows).astype(np.int64)


def _pairwise(left: pa.Array, right: pa.Array, f) -> pa.Array:
    """``f`` on token lists; a null list is empty."""
    left, right = left.fill_null([]), right.fill_null([])
    (a, a_off), (b, b_off) = _flat(left), _flat(right)
    return pa.array(f(*_coded(a, b, a_off, b_off)), pa.int64())


def _coded(a, b, a_off, b_off):
    x, y = codes_of(a, b)
    return x, a_off, y, b_off


@F.arrow_udf(LongType())
def word_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    return _pairwise(left, right, distances)


@F.arrow_udf(LongType())
def common_length(left: pa.Array, right: pa.Array) -> pa.Array:
    return _pairwise(left, right, lcs_lengths)


@F.arrow_udf(LongType())
def union_length(ref: pa.Array, pred: pa.Array) -> pa.Array:
    """``union_hits`` on lists of lines, each a list of tokens."""
    (r_lines, r_rows), (p_lines, p_rows) = _flat(ref), _flat(pred)
    (r, r_off), (p, p_off) = _flat(r_lines), _flat(p_lines)
    x, y = codes_of(r, p)
    return pa.array(union_hits(x, r_off, r_rows, y, p_off, p_rows), pa.int64())
