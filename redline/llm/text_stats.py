"""Per-document text counts over byte arrays, a chunk of documents at a time."""

from __future__ import annotations

import numpy as np

from .common import U64, _SPACE, hash_ranges, mix, window_hash, words_of


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


# Character classes of the rules.
SYMBOLS = b"#*$%&|<>"
_UPPER = _table(bytes(range(65, 91)))
_LOWERCASE = _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(SYMBOLS)
_MARK = _table(b"!?")
_STOP = _table(b".,;:")
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False                # continuation bytes
_WIDE = np.zeros(256, bool)
_WIDE[0x80:] = True


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once in its row."""
    x = mix(keys ^ mix(rows.astype(U64), 3))
    s = np.sort(x)
    many = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(many):
        return np.zeros(len(x), bool)
    return many[np.minimum(np.searchsorted(many, x), len(many) - 1)] == x


class TextStats:
    """Lazily computed per-row arrays of one chunk (``buf`` bytes, ``off`` row offsets)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1
        self._made: dict = {}

    def rows(self, keep: np.ndarray) -> "TextStats":
        """The chosen rows alone, with the parts of what was computed already; nothing is split or hashed again."""
        lens = np.diff(self.off)[keep]
        off = np.concatenate([[0], np.cumsum(lens)])
        shift = self.off[:-1][keep] - off[:-1]
        out = TextStats(self.buf[np.repeat(shift, lens) + np.arange(off[-1])], off)
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        for name, v in self._made.items():
            if name in ("words", "lines"):            # (hash, row[, start, end]) of each
                mine = np.flatnonzero(place[v[1]] >= 0)
                row = place[v[1][mine]]
                out._made[name] = (v[0][mine], row, *(x[mine] - shift[row] for x in v[2:]))
            else:
                out._made[name] = v[keep]
        return out

    def count(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        full = np.flatnonzero(np.diff(self.off))      # empty rows hold no bytes between their neighbours
        if len(full):
            out[full] = np.add.reduceat(table[self.buf].view(np.uint8), self.off[full], dtype=np.int64)
        return out

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(self, f"_get_{name}")()
        return self._made[name]

    def _get_words(self):
        return words_of(self.buf, self.off)

    def _get_n_words(self):
        return np.bincount(self.words[1], minlength=self.n)

    def _get_n_chars(self):
        return self.count(_HEAD)

    def _get_word_chars(self):
        return self.count(_HEAD & ~_SPACE)

    def _get_n_symbols(self):
        return self.count(_SYMBOL)

    def _get_n_upper(self):
        return self.count(_UPPER)

    def _get_n_lower(self):
        return self.count(_LOWERCASE)

    def _get_n_digits(self):
        return self.count(_DIGIT)

    def _get_n_marks(self):
        return self.count(_MARK)

    def _get_n_stops(self):
        return self.count(_STOP)

    def _get_n_wide(self):
        return self.count(_WIDE & _HEAD)

    def _get_lines(self):
        """``(hash, row)`` of every line that holds a word, split at line feeds."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        nl = np.flatnonzero(self.buf == 10)
        bounds = self.off[:-1][np.diff(self.off) > 0]
        starts = np.unique(np.concatenate([bounds, nl + 1]))
        starts = starts[starts < n]
        ends = np.concatenate([starts[1:], [n]])
        ends = ends - (self.buf[ends - 1] == 10)      # the feed is no part of the line
        keep = np.add.reduceat((~_SPACE[self.buf]).view(np.uint8), starts, dtype=np.int64) > 0     # the feed is a space
        starts, ends = starts[keep], ends[keep]
        return hash_ranges(self.buf, starts, ends), np.searchsorted(self.off, starts, "right") - 1

    def _get_n_lines(self):
        return np.bincount(self.lines[1], minlength=self.n)

    def _get_n_dup_lines(self):
        """Lines equal to an earlier line of their row."""
        h, rows = self.lines
        pair = np.unique(np.stack([rows.astype(U64), h]), axis=1) if len(h) else np.zeros((2, 0), U64)
        return self.n_lines - np.bincount(pair[0].astype(np.int64), minlength=self.n)

    def _get_n_repeat_words(self):
        """Words in three-word windows that the row holds twice or more."""
        h, rows, _, _ = self.words
        w, wr, at = window_hash(h, rows, 3)
        at = at[repeated(w, wr)]
        inside = np.zeros(len(h) + 3, np.int32)
        for i in range(3):
            inside[at + i] = 1
        return np.bincount(rows[inside[:len(h)] > 0], minlength=self.n)

    def _get_n_distinct(self):
        h, rows, _, _ = self.words
        x = mix(h ^ mix(rows.astype(U64), 3))
        # distinct words are counted by row through their first copy
        order = np.argsort(x, kind="stable")
        x = x[order]
        first = np.ones(len(x), bool)
        first[1:] = x[1:] != x[:-1]
        return np.bincount(rows[order[first]], minlength=self.n)

    def _get_n_alpha_words(self):
        """Words that hold a letter (any byte beyond ASCII counts as one)."""
        _, rows, s, _ = self.words
        if not len(s):
            return np.zeros(self.n, np.int64)
        # from one word to the next there are only spaces besides
        letters = np.add.reduceat((_UPPER | _LOWERCASE | _WIDE)[self.buf].view(np.uint8), s, dtype=np.int64)
        return np.bincount(rows[letters > 0], minlength=self.n)
