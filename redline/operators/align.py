"""Token alignment: original/corrected token arrays -> one edit tag per token.

Semantics are those of a longest-matching-block sequence alignment
(``difflib.SequenceMatcher`` opcodes):

* equal   -> ``KEEP`` per token
* delete  -> ``DELETE`` per token
* replace of equal length -> position-wise ``REPLACE_<corrected token>``
* replace of unequal length -> ``DELETE`` per original token, and the corrected
  span as ``INSERT_*`` entries in the gap after them
* insert  -> ``INSERT_*`` entries in the gap at the current position

Plan shape: one pass, no shuffle.  An Arrow UDF aligns all pairs of a batch
together (``functions.blocks``); no pair is worked on its own but one with more
equal word pairs than ``blocks.MAX_CELLS``.  The native array expressions of
``functions.tags`` (``fast_path``, ``fast_tags``) say the same for most
minimal-edit pairs, but cost several times the UDF's time.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import tags as T
from ..functions.blocks import align_batch
from ..functions.text import WS_CLASS

ALIGN_SCHEMA = StructType([StructField("tags", ArrayType(StringType())),
                           StructField("gap_tags", ArrayType(StringType()))])
TAGGED_SCHEMA = StructType([StructField(n, ArrayType(StringType())) for n in ("orig_tokens", "corr_tokens", "tags", "gap_tags")])
#: White space but the space itself.
OTHER_WS = WS_CLASS.replace(" ", "", 1)


def align_tokens(orig: list, corr: list) -> tuple[list, list]:
    """Per-row helper: tags and gap tags for one pair of token lists.

    Between two matching blocks lies a span of each side: spans of equal length
    replace each other word by word; any others are deleted here and inserted
    in the gap behind them.
    """
    tags: list[str] = [T.DELETE] * len(orig)
    gaps = [T.KEEP_GAP] * (len(orig) + 1)
    at, to = 0, 0
    for i, j, n in difflib.SequenceMatcher(None, orig, corr).get_matching_blocks():
        if i - at == j - to:
            tags[at:i] = [T.REPLACE + w for w in corr[to:j]]
        elif j > to:
            gaps[i] = " ".join(T.INSERT + w for w in corr[to:j])
        tags[i:i + n] = [T.KEEP] * n
        at, to = i + n, j + n
    return tags, gaps


@F.arrow_udf(ALIGN_SCHEMA)
def _align_udf(orig: pa.Array, corr: pa.Array) -> pa.Array:
    return align_batch(orig, corr, align_tokens)


def _tokens(text: pa.Array) -> pa.Array:
    """``functions.text.tokenize`` of a column of texts; null stays null."""
    text = text.cast(pa.string())
    if pc.any(pc.match_substring_regex(text, OTHER_WS)).as_py():
        text = pc.replace_substring_regex(text, OTHER_WS, " ")
    cut = pc.split_pattern(text, " ")
    words, row = cut.flatten(), pc.list_parent_indices(cut)
    full = pc.not_equal(words, "")                    # runs of spaces, and spaces at an end
    n = np.bincount(row.filter(full).to_numpy(), minlength=len(text))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), words.filter(full), mask=pc.is_null(text) if text.null_count else None)


@F.arrow_udf(TAGGED_SCHEMA)
def _tagged_udf(original: pa.Array, corrected: pa.Array) -> pa.Array:
    o, c = _tokens(original), _tokens(corrected)
    aligned = align_batch(o, c, align_tokens)
    return pa.StructArray.from_arrays([o, c, *aligned.flatten()], TAGGED_SCHEMA.names)


def texts_to_tags(df: DataFrame, original: str = "original_text", corrected: str = "corrected_text") -> DataFrame:
    """Add ``orig_tokens, corr_tokens, tags, gap_tags`` of two text columns.

    As ``tokenize_pairs`` and ``diff_to_tags`` do, in one pass: texts, not token
    lists, go to the Arrow batches, where both steps work on whole columns.
    """
    out = df.withColumn("_tagged", _tagged_udf(original, corrected))
    return out.select(*df.columns, *[F.col(f"_tagged.{n}").alias(n) for n in TAGGED_SCHEMA.names])


def diff_to_tags(df: DataFrame, orig_tokens: str = "orig_tokens",
                 corr_tokens: str = "corr_tokens", tags: str = "tags",
                 gap_tags: str = "gap_tags", keep_flag: bool = False) -> DataFrame:
    """Add ``tags`` (one per original token) and ``gap_tags`` (len + 1)."""
    o, c = F.col(orig_tokens), F.col(corr_tokens)
    out = (df.withColumn("_aligned", _align_udf(o, c))
             .withColumn(tags, F.col("_aligned.tags"))
             .withColumn(gap_tags, F.col("_aligned.gap_tags")).drop("_aligned"))
    return out.withColumn("_fast", F.coalesce(T.fast_path(o, c), F.lit(False))) if keep_flag else out


def gap_inserts(df: DataFrame, key: str = "pair_id", gap_tags: str = "gap_tags") -> DataFrame:
    """Long form of the non-empty gaps: ``(key, gap_pos, ins_tokens)``."""
    g = df.select(key, F.posexplode(gap_tags).alias("gap_pos", "gap"))
    return (g.where(F.col("gap") != T.KEEP_GAP)
             .select(key, "gap_pos",
                     F.transform(F.split("gap", " "),
                                 lambda s: s.substr(F.lit(len(T.INSERT) + 1), F.length(s)))
                     .alias("ins_tokens")))
