"""Edit-tag grammar as native column expressions.

A tag is one of ``KEEP``, ``DELETE``, ``REPLACE_<token>`` or ``INSERT_<token>``;
a gap carries ``KEEP_GAP`` or space-joined ``INSERT_<token>`` entries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tag grammar.
KEEP = "KEEP"
DELETE = "DELETE"
INSERT = "INSERT_"
REPLACE = "REPLACE_"
KEEP_GAP = "KEEP_GAP"
BASE_TAGS = (KEEP, DELETE)

# Bound under which the native alignment is provably the sequence matcher's:
# at this many corrected tokens the matcher starts ignoring popular tokens.
FAST_PATH_MAX_TOKENS = 200


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_replace(tag) -> Column:
    return _c(tag).startswith(REPLACE)


def is_insert(tag) -> Column:
    return _c(tag).startswith(INSERT)


def tag_op(tag) -> Column:
    """Operation name: KEEP, DELETE, REPLACE, INSERT, else the tag itself."""
    t = _c(tag)
    return (F.when(t.startswith(REPLACE), F.lit("REPLACE"))
            .when(t.startswith(INSERT), F.lit("INSERT"))
            .otherwise(t))


def strip_prefix(tag) -> Column:
    """Text after the first ``_``; empty string when there is none."""
    t = _c(tag)
    pos = F.instr(t, "_")
    return F.when(pos > 0, t.substr(pos + 1, F.length(t))).otherwise(F.lit(""))


def _apply_one(tok: Column, tag: Column) -> Column:
    return (F.when(tok.isNull() | tag.isNull(), F.lit(None))
            .when(tag == KEEP, tok)
            .when(tag == DELETE, F.lit(None))
            .when(tag.startswith(REPLACE), tag.substr(F.lit(len(REPLACE) + 1), F.length(tag)))
            .otherwise(tok))


def applied_tokens(tokens, tags) -> Column:
    """Output tokens after applying tags; pairs beyond the shorter list vanish.

    KEEP keeps the token, DELETE drops it, ``REPLACE_x`` yields ``x``, any other
    tag (``INSERT_*`` included) falls back to the token.
    """
    out = F.zip_with(_c(tokens), _c(tags), _apply_one)
    return F.filter(out, lambda x: x.isNotNull())


def apply_tags(tokens, tags) -> Column:
    """Corrected sentence: applied tokens joined by one space."""
    return F.array_join(applied_tokens(tokens, tags), " ")


def fast_path(orig_tokens, corr_tokens) -> Column:
    """Rows whose alignment is the position-wise one (no Python needed).

    Equal lengths below the popular-token bound, and no token that differs at
    its position occurs anywhere on the other side.  Then every matching block
    is a run of the diagonal and the longest-first matcher picks exactly those.
    """
    o, c = _c(orig_tokens), _c(corr_tokens)
    mo = F.filter(F.zip_with(o, c, lambda x, y: F.when(x != y, x)), lambda x: x.isNotNull())
    mc = F.filter(F.zip_with(o, c, lambda x, y: F.when(x != y, y)), lambda x: x.isNotNull())
    return ((F.size(o) == F.size(c)) & (F.size(c) < FAST_PATH_MAX_TOKENS)
            & ~F.arrays_overlap(mo, c) & ~F.arrays_overlap(mc, o))


def fast_tags(orig_tokens, corr_tokens) -> Column:
    return F.zip_with(_c(orig_tokens), _c(corr_tokens),
                      lambda x, y: F.when(x == y, F.lit(KEEP)).otherwise(F.concat(F.lit(REPLACE), y)))


def default_gaps(orig_tokens) -> Column:
    return F.array_repeat(F.lit(KEEP_GAP), F.size(_c(orig_tokens)) + 1)


def rebuild_from_tags(tokens, tags, gap_tags) -> Column:
    """Apply tags and put each gap's inserts before the token at that gap.

    With the tags of ``diff_to_tags`` this gives back the corrected tokens
    exactly (the round-trip invariant used to check the general path).  A row
    without inserts, the usual case, needs its tags alone.
    """
    toks, tgs, gaps = _c(tokens), _c(tags), _c(gap_tags)

    def ins(g):
        return F.when(g == KEEP_GAP, F.array().cast("array<string>")).otherwise(
            F.transform(F.split(g, " "), lambda s: s.substr(F.lit(len(INSERT) + 1), F.length(s))))

    per_pos = F.transform(gaps, lambda g, i: F.concat(
        ins(g),
        F.when(i < F.size(toks), F.filter(F.array(_apply_one(F.get(toks, i), F.get(tgs, i))),
                                          lambda x: x.isNotNull()))
        .otherwise(F.array().cast("array<string>"))))
    plain = toks.isNotNull() & tgs.isNotNull() & (F.size(gaps) == F.size(toks) + 1) & F.forall(gaps, lambda g: g == KEEP_GAP)
    return F.when(plain, applied_tokens(toks, tgs)).otherwise(F.flatten(per_pos))
