"""Longest-matching-block alignment of whole Arrow batches of token lists.

The rule is that of ``difflib.SequenceMatcher``: in an interval of both sides,
the longest run of equal tokens is a block (of equally long ones that which ends
first on the left side, then on the right), it is extended over equal tokens,
and the rule goes on left and right of it.  On a right side of 200 tokens or
more, tokens that occur there more than ``n // 100 + 1`` times are popular: they
start no block, but blocks extend over them.

Here all pairs of a batch are worked at once in numpy.  Equal tokens are *cells*
``(i, j)``; cells that follow each other on a diagonal are *islands*.  Every
interval picks its best island, and each island is clipped to what the chosen
block leaves of it on either side, so an island is in one interval at a time and
a round costs no more than the islands that are left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tags import DELETE, INSERT, KEEP, KEEP_GAP, REPLACE

# Fixed values of the matcher's popular-token rule.
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Equal token pairs worked at once; a pair of texts with more is aligned on its own.
MAX_CELLS = 4_000_000


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _popular(b: np.ndarray, row: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Right-side tokens that may not start a block; ``b`` holds codes."""
    n = np.diff(off)
    if not (n >= POPULAR_FROM).any():
        return np.zeros(len(b), bool)
    out = np.zeros(len(b), bool)
    at = np.flatnonzero(n[row] >= POPULAR_FROM)       # the other pairs have no popular tokens
    _, same, count = np.unique(row[at] * (int(b.max()) + 1) + b[at], return_inverse=True, return_counts=True)
    out[at] = count[same] > n[row[at]] // POPULAR_SHARE + 1
    return out


def matching_blocks(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, length)`` of every pair's blocks as places in the flat ``a`` and ``b`` (token codes), ascending."""
    a_row, b_row = (np.repeat(np.arange(len(o) - 1), np.diff(o)) for o in (a_off, b_off))
    popular = _popular(b, b_row, b_off)
    loose = np.zeros(len(a_off) - 1, bool)            # pairs in which blocks may grow beyond their island
    loose[b_row[popular]] = True

    # cells, as places in a and b, in order of diagonal and place
    width = int(max(a.max(initial=0), b.max(initial=0))) + 1
    seeds = np.flatnonzero(~popular)
    key = b_row[seeds] * width + b[seeds]
    by = np.argsort(key, kind="stable")
    seeds, key = seeds[by], key[by]
    wanted = a_row * width + a
    first, last = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    i = np.repeat(np.arange(len(a)), last - first)
    j = seeds[_spans(first, last - first)]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1) | (a_row[i[1:]] != a_row[i[:-1]])
    at = np.flatnonzero(new)
    start, diagonal = i[at], (i - j)[at]
    end = start + np.diff(np.append(at, len(i)))      # one behind the last
    # an interval per pair to begin with, and the islands' places among the intervals
    box = np.stack([a_off[:-1], a_off[1:], b_off[:-1], b_off[1:]])
    rows = np.arange(len(a_off) - 1)
    some = (box[0] < box[1]) & (box[2] < box[3])
    place = np.cumsum(some) - 1
    owner = place[a_row[start]]
    box, rows = box[:, some], rows[some]

    found: list[np.ndarray] = []
    while box.shape[1]:
        n = box.shape[1]
        block = np.stack([box[0], box[2], np.zeros(n, np.int64)])        # no island: the corner
        by = np.lexsort((-diagonal, end, start - end, owner))
        head = by[np.flatnonzero(np.diff(owner[by], prepend=-1))]
        block[:, owner[head]] = start[head], start[head] - diagonal[head], end[head] - start[head]
        _grow(a, b, box, block, loose[rows])
        hit = block[2] > 0
        found.append(block[:, hit])
        left = np.stack([box[0], block[0], box[2], block[1]])
        right = np.stack([block[0] + block[2], box[1], block[1] + block[2], box[3]])
        boxes = np.concatenate([left, right], axis=1)
        keep = np.concatenate([hit, hit]) & (boxes[0] < boxes[1]) & (boxes[2] < boxes[3])
        place = np.where(keep, np.cumsum(keep) - 1, -1)
        # what is left of each island in the interval's halves
        parts = []
        for half in (0, n):
            to = owner + half
            lo = np.maximum(start, np.maximum(boxes[0, to], boxes[2, to] + diagonal))
            hi = np.minimum(end, np.minimum(boxes[1, to], boxes[3, to] + diagonal))
            live = (lo < hi) & (place[to] >= 0)
            parts.append((lo[live], hi[live], diagonal[live], place[to][live]))
        start, end, diagonal, owner = (np.concatenate(x) for x in zip(*parts))
        box, rows = boxes[:, keep], np.concatenate([rows, rows])[keep]
    out = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return tuple(out[:, np.argsort(out[0], kind="stable")])


def _grow(a: np.ndarray, b: np.ndarray, box: np.ndarray, block: np.ndarray, loose: np.ndarray) -> None:
    """Blocks extended over equal tokens inside their interval."""
    live = np.flatnonzero(loose & (block[2] > 0))     # towards the front; a corner has nothing before it
    i, j = block[0, live], block[1, live]
    n = _equal(a, b, i - 1, j - 1, np.minimum(i - box[0, live], j - box[2, live]), -1)
    block[0, live] -= n
    block[1, live] -= n
    block[2, live] += n
    live = np.flatnonzero(loose)
    i, j = block[0, live] + block[2, live], block[1, live] + block[2, live]
    block[2, live] += _equal(a, b, i, j, np.minimum(box[1, live] - i, box[3, live] - j), 1)


def _equal(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many tokens from ``i`` and ``j`` on, ``room`` at most, are equal: more of them are compared at once the longer it goes."""
    out, live, width = np.zeros(len(i), np.int64), np.flatnonzero(room > 0), 2
    while len(live):
        t = out[live, None] + np.arange(width)
        inside = t < room[live, None]
        t = np.where(inside, way * t, 0)
        same = (a[i[live, None] + t] == b[j[live, None] + t]) & inside
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[live] += n
        live, width = live[n == width], min(2 * width, 256)
    return out


def _cells(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Equal token pairs of each pair of lists, popular tokens left out."""
    a_row, b_row = (np.repeat(np.arange(len(o) - 1), np.diff(o)) for o in (a_off, b_off))
    width = int(max(a.max(initial=0), b.max(initial=0))) + 1
    key = np.sort((b_row * width + b)[~_popular(b, b_row, b_off)])
    wanted = a_row * width + a
    n = np.searchsorted(key, wanted, "right") - np.searchsorted(key, wanted, "left")
    return np.bincount(a_row, n, len(a_off) - 1).astype(np.int64)


def _same(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Pairs whose lists are equal."""
    n = np.diff(a_off)
    out = n == np.diff(b_off)
    at = np.flatnonzero(out & (n > 0))
    differs = a[_spans(a_off[at], n[at])] != b[_spans(b_off[at], n[at])]
    out[at] = ~np.logical_or.reduceat(differs, np.cumsum(n[at]) - n[at]) if len(at) else True
    return out


def _rows(codes: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' codes, their offsets, and their places among all codes (one more stands for the end)."""
    n = np.diff(off)[rows]
    at = _spans(off[rows], n)
    return codes[at], np.append(0, np.cumsum(n)), np.append(at, len(codes))


def _flat(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.slice(off[0], off[-1] - off[0]), off - off[0]


def align_batch(orig: pa.Array, corr: pa.Array, one: Callable[[list, list], tuple[list, list]]) -> pa.Array:
    """``struct(tags, gap_tags)`` of each pair of token lists, null where a side is null.

    ``one`` aligns a single pair; it gets those with more than ``MAX_CELLS`` equal token pairs.
    """
    here = pc.and_(pc.is_valid(orig), pc.is_valid(corr))
    whole_batch = pc.all(here).as_py() is not False   # nothing to leave out: no copies
    a_tok, a_off = _flat(orig if whole_batch else orig.filter(here))
    b_tok, b_off = _flat(corr if whole_batch else corr.filter(here))
    words = pa.concat_arrays([a_tok.cast(pa.string()), b_tok.cast(pa.string())]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    a, b = codes[:len(a_tok)], codes[len(a_tok):]
    dictionary = words.dictionary

    n_rows = len(a_off) - 1
    # equal lists are one block (where popular tokens may be all there is, the matcher decides)
    same = _same(a, a_off, b, b_off) & (np.diff(b_off) < POPULAR_FROM)
    whole = np.flatnonzero(same & (np.diff(a_off) > 0))
    blocks: list[tuple] = [(a_off[whole], b_off[whole], np.diff(a_off)[whole])]
    rest = np.flatnonzero(~same)
    (x, x_off, x_at), (y, y_off, y_at) = _rows(a, a_off, rest), _rows(b, b_off, rest)
    cells = _cells(x, x_off, y, y_off)
    alone = rest[cells > MAX_CELLS]
    lo = 0
    while lo < len(rest):                             # as many pairs at once as hold MAX_CELLS cells
        if cells[lo] > MAX_CELLS:
            lo += 1
            continue
        over = np.flatnonzero(np.cumsum(cells[lo:]) > MAX_CELLS)
        hi = lo + int(over[0]) if len(over) else len(rest)
        i, j, n = matching_blocks(x[x_off[lo]:x_off[hi]], x_off[lo:hi + 1] - x_off[lo], y[y_off[lo]:y_off[hi]], y_off[lo:hi + 1] - y_off[lo])
        blocks.append((x_at[i + x_off[lo]], y_at[j + y_off[lo]], n))
        lo = hi
    i, j, n = (np.concatenate(p) for p in zip(*blocks))

    # what lies between two blocks, each pair closed by an empty block at its end
    row = np.searchsorted(a_off, i, "right") - 1
    row, i, j, n = (np.concatenate(x) for x in ((row, np.arange(n_rows)), (i, a_off[1:]), (j, b_off[1:]), (n, np.zeros(n_rows, np.int64))))
    by = np.lexsort((n == 0, i, row))
    row, i, j, n = row[by], i[by], j[by], n[by]
    head = np.diff(row, prepend=-1) > 0
    at, to = (np.where(head, o[row], np.append(0, (x + n)[:-1])) for o, x in ((a_off, i), (b_off, j)))
    tag = np.ones(len(a), np.int64)                   # 0 KEEP, 1 DELETE, else REPLACE by a word
    tag[_spans(i, n)] = 0
    swap = (i - at == j - to)
    tag[_spans(at[swap], (i - at)[swap])] = 2 + b[_spans(to[swap], (j - to)[swap])]
    spell = pa.concat_arrays([pa.array([KEEP, DELETE]), pc.binary_join_element_wise(pa.scalar(REPLACE), dictionary, "")])
    tags = pa.ListArray.from_arrays(pa.array(a_off, pa.int32()), spell.take(pa.array(tag)))

    ins = np.flatnonzero(~swap & (j > to))
    length = (j - to)[ins]
    inserted = pc.binary_join_element_wise(pa.scalar(INSERT), dictionary.take(pa.array(b[_spans(to[ins], length)])), "")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), inserted), " ")
    gap_off = a_off + np.arange(n_rows + 1)           # one gap more than tokens
    gap = np.zeros(int(gap_off[-1]), np.int64)
    gap[i[ins] + row[ins]] = 1 + np.arange(len(ins))
    gaps = pa.ListArray.from_arrays(pa.array(gap_off, pa.int32()), pa.concat_arrays([pa.array([KEEP_GAP]), texts.cast(pa.string())]).take(pa.array(gap)))

    done = pa.StructArray.from_arrays([tags, gaps], ["tags", "gap_tags"])
    for r in alone.tolist():
        t, g = one(a_tok[a_off[r]:a_off[r + 1]].to_pylist(), b_tok[b_off[r]:b_off[r + 1]].to_pylist())
        done = pa.concat_arrays([done.slice(0, r), pa.array([{"tags": t, "gap_tags": g}], done.type), done.slice(r + 1)])
    if whole_batch:
        return done
    where = np.where(here.to_numpy(zero_copy_only=False), np.cumsum(here.to_numpy(zero_copy_only=False)) - 1, -1)
    return done.take(pa.array(where, mask=where < 0))
