"""Sub-words by longest match against a piece vocabulary: a plug-in for ``subword_fn``.

A word is cut from left to right into the longest pieces that the vocabulary
has; pieces inside a word are looked up with ``inner`` before them, as
vocabularies of that kind mark them.  A character that begins no piece is a
piece of its own.  The vocabulary becomes a trie; a batch's distinct words are
cut once each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .blocks import _flat

_END = ""


def trie_of(pieces: Iterable[str]) -> dict:
    """Nested maps by character; an entry for the empty string ends a piece."""
    root: dict = {}
    for p in pieces:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        if p:
            node[_END] = {}
    return root


def cut(word: str, first: dict, rest: dict, inner: str) -> list[str]:
    """The word's pieces, those inside it with their mark."""
    out, at = [], 0
    while at < len(word):
        node, end, i = (rest if at else first), at, at
        while i < len(word) and word[i] in node:
            node, i = node[word[i]], i + 1
            if _END in node:
                end = i
        end = max(end, at + 1)
        out.append((inner if at else "") + word[at:end])
        at = end
    return out


def longest_match(vocabulary: Iterable[str], inner: str = "##") -> Callable[[Column], Column]:
    """``subword_fn`` of a piece vocabulary, whose size bounds what travels to the executors."""
    vocabulary = list(vocabulary)
    first = trie_of(p for p in vocabulary if not (inner and p.startswith(inner)))
    rest = trie_of(p[len(inner):] for p in vocabulary if p.startswith(inner))

    def lists_of(words: pa.Array) -> pa.Array:
        d = words.cast(pa.string()).dictionary_encode()
        return pa.array([cut(w, first, rest, inner) for w in d.dictionary.to_pylist()], pa.list_(pa.string())).take(d.indices)

    @F.arrow_udf(ArrayType(StringType()))
    def pieces(words: pa.Array) -> pa.Array:
        return lists_of(words)

    @F.arrow_udf(ArrayType(ArrayType(StringType())))
    def pieces_of_words(lists: pa.Array) -> pa.Array:
        words, off = _flat(lists)
        out = pa.ListArray.from_arrays(pa.array(off, pa.int32()), lists_of(words))
        return out if not lists.null_count else out.take(pa.array(range(len(lists)), mask=lists.is_null().to_numpy(zero_copy_only=False)))

    def subword_fn(token):
        return pieces(F.col(token) if isinstance(token, str) else token)

    subword_fn.of_words = pieces_of_words             # for whole arrays, as no Python function runs inside a lambda
    return subword_fn
