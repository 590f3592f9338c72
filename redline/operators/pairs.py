"""Pair-corpus filters and the tokenised/tagged corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_ratio, tokenize, within_edit_ratio
from .align import texts_to_tags

ORIG, CORR = "original_text", "corrected_text"


def drop_null_pairs(df: DataFrame, original: str = ORIG, corrected: str = CORR) -> DataFrame:
    """Drop pairs with either side NULL (F1).

    Written as ``isNotNull`` predicates (not ``dropna``) so Catalyst pushes them
    into the Parquet scan.
    """
    return df.where(F.col(original).isNotNull() & F.col(corrected).isNotNull())


def with_edit_ratio(df: DataFrame, original: str = ORIG, corrected: str = CORR,
                    name: str = "edit_ratio") -> DataFrame:
    """Add the case-folded edit ratio."""
    return df.withColumn(name, edit_ratio(original, corrected))


def minimal_edit_filter(df: DataFrame, threshold: float = 0.30, original: str = ORIG,
                        corrected: str = CORR) -> DataFrame:
    """Keep pairs whose edit ratio is at most ``threshold`` (inclusive) (F2)."""
    return df.where(within_edit_ratio(original, corrected, threshold))


def tokenize_pairs(df: DataFrame, original: str = ORIG, corrected: str = CORR) -> DataFrame:
    """Add ``orig_tokens`` and ``corr_tokens``."""
    return (df.withColumn("orig_tokens", tokenize(original))
              .withColumn("corr_tokens", tokenize(corrected)))


def tagged_pairs(pairs: DataFrame, threshold: float = 0.30, key: str = "pair_id") -> DataFrame:
    """Pairs -> ``(key, orig_tokens, corr_tokens, tags, gap_tags)``.

    F1 and F2 run before tokenising (F1 reaches the scan), then P1 and P3.  All
    narrow: the corpus is never shuffled here.
    """
    kept = minimal_edit_filter(drop_null_pairs(pairs), threshold)
    return texts_to_tags(kept).select(key, "orig_tokens", "corr_tokens", "tags", "gap_tags")
