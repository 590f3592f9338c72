"""Fixed-length encoding of tagged examples.

The sub-word step is re-aimed: a word splits into pieces of at most
``PIECE_CHARS`` code points, and a piece's id is a stable hash bucket shifted
past the special ids.  A real tokenizer plugs in through ``subword_fn``, a
``Column -> array<string>`` function.  One that runs in Python also has
``of_words``, the same for an array of words, since no Python function runs
inside a lambda (``functions.pieces.longest_match`` is one).

Layout per example: ``<s>`` + pieces + ``</s>``, truncated to ``max_length``
then right-padded; the label sits on the first piece of every word (its tag
id), -100 elsewhere (specials, continuation pieces, padding); the mask is 1 on
real positions (specials included), 0 on padding.

Plan: ids, masks and labels of whole Arrow batches, where a batch's distinct
words are cut once and its distinct pieces hashed once; words beyond
``max_length`` leave no piece and are not sent.  A vocabulary small enough for a
broadcast join goes to the tasks as a list, so nothing is shuffled.  Beyond that
the distinct REPLACE tags of a row are looked up in one join and come back as a
small map.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.blocks import _flat, _spans
from ..functions.tags import BASE_TAGS, DELETE, KEEP
from .joins import listed, materialize
from .vocab import vocab_ids

# Special token ids of the encoding.
BOS_ID, PAD_ID, EOS_ID = 0, 1, 2
FIRST_PIECE_ID = 4
PIECE_BUCKETS = 50261          # piece ids fall in [4, 50265)
PIECE_CHARS = 4
MAX_LENGTH = 128
IGNORE = -100
ENCODED = StructType([StructField(n, ArrayType(IntegerType())) for n in ("input_ids", "attention_mask", "labels")])
#: A piece of ``subword_pieces``: as in Java's regular expressions, a dot is no line end.
_LINE_END = "[\n\r\u0085\u2028\u2029]"
_PIECE = re.compile("[^%s{1,%d}" % (_LINE_END[1:], PIECE_CHARS))
#: Words of more pieces are cut by themselves.
MANY_PIECES = 16


def subword_pieces(token) -> "F.Column":
    """Pieces of one word."""
    t = F.col(token) if isinstance(token, str) else token
    return F.regexp_extract_all(t, F.lit(".{1,%d}" % PIECE_CHARS), 0)


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _pieces_of_words(lists: pa.Array) -> pa.Array:
    words, off = _flat(lists)
    cut = _cut(words.cast(pa.string()))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), cut, mask=lists.is_null() if lists.null_count else None)


def _cut(words: pa.Array) -> pa.Array:
    """``subword_pieces`` of each word: a slice of all words at a time, few words by themselves."""
    size = pc.utf8_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    alone = (size > MANY_PIECES * PIECE_CHARS) | pc.match_substring_regex(words, _LINE_END).fill_null(False).to_numpy(zero_copy_only=False)
    own = [_PIECE.findall(w) for w in words.filter(pa.array(alone)).to_pylist()]
    count = -(-size // PIECE_CHARS)
    count[alone] = [len(x) for x in own]
    off = np.append(0, np.cumsum(count))
    parts, places = [pa.array([p for x in own for p in x], pa.string())], [_spans(off[:-1][alone], count[alone])]
    for k in range(int(count[~alone].max(initial=0))):
        at = np.flatnonzero((count > k) & ~alone)
        parts.append(pc.utf8_slice_codeunits(words.take(pa.array(at)), k * PIECE_CHARS, (k + 1) * PIECE_CHARS))
        places.append(off[at] + k)
    order = np.empty(int(off[-1]), np.int64)
    order[np.concatenate(places)] = np.arange(len(order))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.concat_arrays(parts).take(pa.array(order)), mask=words.is_null() if words.null_count else None)


subword_pieces.of_words = _pieces_of_words            # for whole arrays


def piece_id(piece) -> "F.Column":
    """Stable id of a piece (P9): 4 + first 24 bits of md5 mod buckets."""
    p = F.col(piece) if isinstance(piece, str) else piece
    return (F.lit(FIRST_PIECE_ID)
            + F.conv(F.substring(F.md5(p), 1, 6), 16, 10).cast("long") % PIECE_BUCKETS).cast("int")


def subword_table(long_tokens: DataFrame, key: str = "pair_id", subword_fn=subword_pieces) -> DataFrame:
    """Long sub-token table ``(key, word_id, piece_no, piece)`` from ``(key, pos, token)``."""
    return (long_tokens.select(key, F.col("pos").alias("word_id"),
                               F.posexplode(subword_fn(F.col("token"))).alias("piece_no", "piece")))


def is_first_subtoken(subtokens: DataFrame, key: str = "ex_id", order: str = "sub_pos",
                      word_id: str = "word_id") -> DataFrame:
    """W1/F6 on a long sub-token table: first piece of its word, specials excluded.

    ``lag`` over a window partitioned by example: groups are one example's
    sub-tokens (bounded by the sequence length).
    """
    w = Window.partitionBy(key).orderBy(order)
    prev = F.lag(word_id).over(w)
    return subtokens.withColumn(
        "is_first", F.col(word_id).isNotNull() & ~F.col(word_id).eqNullSafe(prev))


def encode_examples(tagged: DataFrame, vocab: DataFrame, key: str = "pair_id",
                    max_length: int = MAX_LENGTH, subword_fn=subword_pieces, carry=()) -> DataFrame:
    """``(key, input_ids, attention_mask, labels, *carry)``, arrays of ``max_length`` ints, one row a row."""
    ids = vocab_ids(vocab)
    named = listed_tags(vocab)
    # no word beyond max_length - 2 can leave a piece
    some = lambda c: F.slice(c, 1, max_length)
    if named is not None:
        rows, tags = tagged, some(F.col("tags"))
    else:
        rows = materialize(tagged.select(key, "orig_tokens", "tags", *carry).withColumn("_id", F.monotonically_increasing_id()), "examples")
        words = rows.select("_id", F.explode(F.array_distinct(F.filter(some(F.col("tags")), lambda t: ~t.isin(*BASE_TAGS)))).alias("_tag"))
        known = (words.join(vocab.select(F.col("tag").alias("_tag"), "tag_id"), "_tag").groupBy("_id")
                 .agg(F.map_from_entries(F.collect_list(F.struct("_tag", "tag_id"))).alias("_ids")))
        rows = rows.join(known, "_id", "left")
        tags = F.transform(some(F.col("tags")), lambda t: F.when(t == KEEP, F.lit(ids[KEEP])).when(t == DELETE, F.lit(ids[DELETE])).otherwise(F.col("_ids")[t]))
    whole = getattr(subword_fn, "of_words", None)
    words = some(F.col("orig_tokens"))
    run = encoder(whole.func if whole else None, named, ids[KEEP], max_length)
    out = rows.select(key, *carry, run(words if whole else F.transform(words, subword_fn), tags).alias("_e"))
    return out.select(key, *[F.col(f"_e.{f}").alias(f) for f in ENCODED.names], *carry)


def listed_tags(vocab: DataFrame) -> list[tuple[str, int]] | None:
    """The vocabulary's rows if Spark would broadcast as many bytes in a join, else None."""
    return listed(vocab.select("tag", "tag_id"))


def encoder(cut: Callable[[pa.Array], pa.Array] | None, named: list[tuple[str, int]] | None, keep: int, max_length: int = MAX_LENGTH):
    """Arrow UDF of lists of words and of their tags -> ``ENCODED``.

    ``cut`` makes the pieces of lists of words; without it the words come as
    lists of pieces.  ``named``: the vocabulary, else the tags come as ids.  A
    missing or unknown tag is KEEP's; a missing word leaves no ids or labels.
    """
    body = max_length - 2

    @F.arrow_udf(ENCODED)
    def run(words: pa.Array, tags: pa.Array) -> pa.Array:
        n = len(words)
        gone = words.is_null().to_numpy(zero_copy_only=False) | tags.is_null().to_numpy(zero_copy_only=False)
        # arrays without nulls, so that offsets say all
        words, tags = (c.filter(pa.array(~gone)) for c in (words, tags))
        lists, off = _flat(cut(words) if cut else words)
        spelt, t_off = _flat(tags)
        here, size, t_size = np.flatnonzero(~gone), np.diff(off), np.diff(t_off)
        row = np.repeat(np.arange(len(here)), size)
        lost = t_size > size
        lost[row[lists.is_null().to_numpy(zero_copy_only=False)]] = True

        if named is None:
            label = spelt.cast(pa.int64())
        else:
            label = pa.array([i for _, i in named], pa.int64()).take(pc.index_in(spelt.cast(pa.string()), pa.array([t for t, _ in named], pa.string())))
        label = np.append(label.fill_null(keep).to_numpy(zero_copy_only=False), keep).astype(np.int32)
        pos = np.arange(len(row)) - off[row]
        label = label[np.where(pos < t_size[row], t_off[row] + pos, len(label) - 1)]

        count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = lists.flatten().cast(pa.string()).dictionary_encode()
        known = [FIRST_PIECE_ID + int(md5(p.encode()).hexdigest()[:6], 16) % PIECE_BUCKETS for p in pieces.dictionary.to_pylist()]
        piece = pieces.indices
        word = np.repeat(np.arange(len(row)), count)
        first = np.zeros(len(word), bool)
        first[(np.cumsum(count) - count)[count > 0]] = True
        total = np.bincount(row, count, len(here)).astype(np.int64)
        place = np.arange(len(word)) - np.repeat(np.cumsum(total) - total, total)
        at = np.flatnonzero(place < body)
        real = np.minimum(total, body) + 2

        ids, labels, mask = (np.full((n, max_length), x, np.int32) for x in (PAD_ID, IGNORE, 1))
        r, c = here[row[word[at]]], place[at] + 1
        ids[here, 0], ids[here, real - 1] = BOS_ID, EOS_ID
        missing = piece.is_null().to_numpy(zero_copy_only=False)[at]
        ids[r, c] = np.array([*known, PAD_ID], np.int32)[piece.fill_null(len(known)).to_numpy(zero_copy_only=False)[at]]
        labels[r, c] = np.where(first[at], label[word[at]], IGNORE)
        mask[here] = np.arange(max_length) < real[:, None]
        mask[here[lost]] = 1
        none = gone.copy()
        none[here[lost]] = True
        empty = np.zeros((n, max_length), bool)
        empty[r[missing], c[missing]] = True
        ends = pa.array(np.arange(n + 1) * max_length, pa.int32())
        out = lambda x, **kw: pa.ListArray.from_arrays(ends, pa.array(x.ravel(), mask=empty.ravel() if x is ids and missing.any() else None), **kw)
        rows = dict(mask=pa.array(none)) if none.any() else {}
        return pa.StructArray.from_arrays([out(ids, **rows), out(mask), out(labels, **rows)], ENCODED.names)
    return run


def write_encoded(encoded: DataFrame, path: str, split_col: str = "split") -> None:
    """Persist encoded splits partitioned by ``split`` (K1)."""
    encoded.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_encoded(spark, path: str, split: str | None = None) -> DataFrame:
    """Reload encoded splits; a ``split`` filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
