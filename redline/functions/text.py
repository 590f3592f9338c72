"""Column functions for text: tokenising, stripping, edit distance.

All of these are native Spark expressions (codegen'd, JVM side); nothing here
calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts, which is what
# ``str.split()`` / ``str.strip()`` break on.  The same class, written once, is
# valid in Java regex (Spark) and in RE2 (DuckDB oracles).
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"
NON_WS = WS_CLASS.replace("[", "[^", 1)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """Python ``text.strip().split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(text), WS_RUN), lambda t: t != F.lit(""))


def py_strip(text) -> Column:
    """Python ``text.strip()`` (P21); Spark's ``trim`` only strips spaces."""
    return F.regexp_replace(_c(text), "^" + WS_RUN + "|" + WS_RUN + r"\z", "")


def is_blank(text) -> Column:
    """True when the text has no non-whitespace character (``not s.strip()``)."""
    return ~_c(text).rlike(NON_WS)


def edit_ratio(original, corrected) -> Column:
    """Case-folded Levenshtein distance over the longer *unfolded* length.

    Code-point based, double division.  NULL when both sides are empty (the
    reference would divide by zero).
    """
    from .distance import levenshtein
    o, c = _c(original), _c(corrected)
    mx = F.greatest(F.length(o), F.length(c))
    return (levenshtein(F.lower(o), F.lower(c)).cast("double")
            / F.nullif(mx, F.lit(0)).cast("double"))


def within_edit_ratio(original, corrected, threshold: float = 0.30) -> Column:
    """``edit_ratio(o, c) <= threshold`` (inclusive, double division) (F2).

    The folded length difference is a lower bound of the distance; pairs beyond
    it are rejected before the distance is computed, and the distance stops
    counting above the threshold.  False, hence not kept, when both sides are
    empty.
    """
    from .distance import share_within
    return share_within(_c(original), _c(corrected), F.lower, threshold)
