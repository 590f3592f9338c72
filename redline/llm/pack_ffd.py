"""Packing token streams into fixed sequences: first-fit decreasing by tournament tree.

Documents are tokenized in the executors; a document's ids are cut into slices
of ``slice_len`` ids, slices are dealt to random groups of about
``group_tokens`` ids, and every group is packed on its own:

* runs of ``seq_len`` ids fill sequences of their own;
* the remainders are placed in order of falling length, each into the first
  sequence with room.  The tree over the sequences holds the largest room below
  each node, so the first fit is found in logarithmic time;
* what lies in the emptiest sequences at the end is cut to fill the gaps of the
  others, so a group leaves one sequence open at most.

Cases: null or empty text is the end id alone; repeated rows and ids are packed
as often as they occur; a document longer than a sequence, or than a slice, is
cut; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, row_chunks, text_bytes

SEQ_LEN = 2048
END_ID = 1
#: Ids a group holds on average; bounds the memory of a packing task.
GROUP_TOKENS = 1 << 21
#: Ids of one document that stay together.
SLICE_LEN = 1 << 16
#: Distinct words a worker keeps tokenized.
CACHE_WORDS = 700_000
#: Text tokenized at once.
CHUNK = 2 << 20


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = _SIGN[39] = False


def _spaced(buf: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts in ASCII lower case, with a space wherever a sign follows an ASCII letter or digit.

    The tokenizer folds case and parts signs (but the apostrophe) from letters
    and digits itself, so neither changes an id; equal words meet in the cache.
    """
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    at = np.flatnonzero(_ALNUM[low[:-1]] & _SIGN[low[1:]]) + 1
    return np.insert(low, at, 32).tobytes(), off + np.searchsorted(at, off, "right")


# The rules of tokenizers for which ``_spaced`` and encoding by words change no id.
BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class _Words(dict):
    """Little-endian 16-bit ids of words (UTF-8, parted by ASCII white space), by the tokenizer.

    Under the rules of ``BY_WORDS`` no token crosses ASCII white space, so a text's
    ids are its words' ids in a row; under other rules every text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("the tokenizer has more ids than 16 bits hold")
        rules = json.loads(self.tok.to_str())
        special = [t["content"] for t in rules.get("added_tokens") or ()]
        self.by_words = (rules.get("normalizer"), rules.get("pre_tokenizer")) == BY_WORDS and all("<|" in t for t in special)
        mark = rules["model"].get("end_of_word_suffix")
        self.closes = np.zeros(1 << 16, bool)
        if mark:
            self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith(mark)]] = True

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, "<u2").tobytes()

    def fill(self, words: set) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        rest = []
        for lo in range(0, len(new), 4096):
            part = [(w, w.decode()) for w in new[lo:lo + 4096]]
            plain = [(w, t) for w, t in part if t.isalpha()]
            rest += [(w, t) for w, t in part if not t.isalpha()]
            # a word of letters is one piece, which its only token with an end mark closes
            ids = np.array(self.tok.encode_batch_fast([" ".join(t for _, t in plain)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                raw, at = ids.tobytes(), 0
                for (w, _), e in zip(plain, (2 * ends).tolist()):
                    self[w] = raw[at:e]
                    at = e
            else:
                rest += plain
        for lo in range(0, len(rest), 4096):
            part = rest[lo:lo + 4096]
            for (w, _), e in zip(part, self.tok.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                self[w] = np.array(e.ids, "<u2").tobytes()

    def texts(self, buf: np.ndarray, off: np.ndarray):
        """Ids of every text of a chunk."""
        if not self.by_words:
            yield from (self.whole(buf[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist()))
            return
        raw, at = _spaced(buf, off)
        plain = b"<|" not in raw                      # may begin a special token, which signs and case are part of
        words = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        self.fill(set().union(*words))
        for i, ws in enumerate(words):
            if plain or b"<|" not in (text := buf[off[i]:off[i + 1]].tobytes()):
                yield b"".join(map(self.__getitem__, ws))
            else:
                yield self.whole(text)


@functools.lru_cache(1)
def _words_of(path: str) -> _Words:
    """One cache a worker process, shared by its tasks."""
    return _Words(path)


def _tokenize(path: str, end_id: int, slice_len: int):
    def run(batches):
        cache = _words_of(path)
        end = np.array([end_id], "<u2").tobytes()
        for b in batches:
            buf, off = text_bytes(b.column(1))
            docs = b.column(0).to_pylist()
            for lo, hi in row_chunks(off, CHUNK):
                cols: tuple = ([], [], [], [])
                for d, ids in zip(docs[lo:hi], cache.texts(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])):
                    ids += end
                    n = len(ids) // 2
                    for s in range(0, n, slice_len):
                        for c, v in zip(cols, (d, s, n, ids[2 * s:2 * (s + slice_len)])):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "doc_tokens", "ids"])
    return run


class TournamentTree:
    """Rooms of numbered bins; ``first_fit`` finds the first bin with enough of it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        t, i = self.tree, 1
        while i < self.size:
            i *= 2
            if t[i] < need:
                i += 1
        return i - self.size

    def take(self, bin_: int, amount: int) -> None:
        t, i = self.tree, bin_ + self.size
        t[i] -= amount
        while i > 1:
            i //= 2
            best = max(t[2 * i], t[2 * i + 1])
            if t[i] == best:
                break
            t[i] = best

    def room(self, bin_: int) -> int:
        return self.tree[bin_ + self.size]


def pack_lengths(lengths: list[int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start in the item, length, sequence, offset)`` for items of the given lengths."""
    out, rest, seq = [], [], 0
    for i, n in enumerate(lengths):
        full = n // seq_len
        for k in range(full):
            out.append((i, k * seq_len, seq_len, seq, 0))
            seq += 1
        if n % seq_len:
            rest.append((n % seq_len, i, full * seq_len))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = TournamentTree(max(1, len(rest)), seq_len), []
    for n, i, at in rest:
        b = tree.first_fit(n)
        if b == len(bins):
            bins.append([])
        bins[b].append((i, at, n))
        tree.take(b, n)
    # the emptiest sequences are cut up to fill the gaps of the fuller ones
    room = [tree.room(b) for b in range(len(bins))]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))
    gap, last = 0, len(order) - 1
    while gap < last:
        src, dst = order[last], order[gap]
        if not room[dst]:
            gap += 1
        elif not bins[src]:
            last -= 1
        else:
            i, at, n = bins[src].pop()
            m = min(n, room[dst])
            bins[dst].append((i, at + n - m, m))
            room[dst] -= m
            if n > m:
                bins[src].append((i, at, n - m))
    for b in bins:
        off = 0
        for i, at, n in b:
            out.append((i, at, n, seq, off))
            off += n
        seq += bool(b)
    return out


def _pack(seq_len: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        doc, start, total = (t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        ids = [np.frombuffer(x.as_buffer(), "<u2") for x in t.column("ids")]
        group = t.column("grp")[0].as_py()
        # a fixed order, so that a lost task packs its group the same way again
        raw = t.column("ids").to_pylist()
        order = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, start[i], raw[i]))
        pieces = pack_lengths([len(ids[i]) for i in order], seq_len)
        cols = list(zip(*((doc[order[i]], start[order[i]] + at, n, ids[order[i]][at:at + n].astype("<u4").tobytes(), total[order[i]],
                           (group << 32) | seq, off) for i, at, n, seq, off in pieces)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS,
                   slice_len: int = SLICE_LEN, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit ids; ``tokenizer`` is a path that
    every executor can open (a file of an installed package).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # a token is three to four bytes long; a group needs its size only roughly
    n = rows.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0
    groups = int(n // (3 * group_tokens) + 1)
    tokens = rows.mapInArrow(released(_tokenize(tokenizer, end_id, slice_len)), "doc_id long, start long, doc_tokens long, ids binary")
    # identical rows of one id spread by where they lie in their partition
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.monotonically_increasing_id()), F.lit(groups))
    return (tokens.withColumn("grp", dealt).groupBy("grp").applyInArrow(
        released(_pack(seq_len)), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"))
