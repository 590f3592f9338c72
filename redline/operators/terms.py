"""Software-term lists -> term frequency dictionary.

A line is ``base`` or ``base/<word>[alias|alias...]``: it splits once on
``/<letters>[`` (case-insensitive), trailing ``]`` are stripped from the alias
block, aliases split on ``|``; every term is stripped and loses its spaces.
Each term counts 1; the dictionary sums counts per term and keeps first-seen
order.  Empty terms are dropped (the reference would crash on them).

Plan: per-line expressions, one explode, one partial aggregation by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, py_strip

# Fixed value: the alias-block separator pattern.
ALIAS_SPLIT = r"(?iu)/[a-z]+\["


def drop_blank_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Skip whitespace-only lines."""
    return lines.where(~is_blank(F.col(line)))


def parse_term_lines(lines: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """``(line_no, term_no, term)``: one row per non-empty cleaned term (P20)."""
    parts = F.split(F.col(line), ALIAS_SPLIT, 2)
    aliases = F.when(F.size(parts) == 2,
                     F.split(F.regexp_replace(F.get(parts, 1), r"\]+\z", ""), r"\|", -1)) \
               .otherwise(F.array().cast("array<string>"))
    terms = F.concat(F.array(F.get(parts, 0)), aliases)
    ex = drop_blank_lines(lines, line).select(line_no, F.posexplode(terms).alias("term_no", "raw"))
    cleaned = F.replace(py_strip(F.col("raw")), F.lit(" "), F.lit(""))
    return ex.select(line_no, "term_no", cleaned.alias("term")).where(F.col("term") != "")


def merge_term_counts(terms: DataFrame, line_no: str = "line_no") -> DataFrame:
    """``(term, freq, first_line, first_term_no)``: counts summed per term (A2).

    A partial aggregation: a term occurring on a third of all lines costs one
    pre-aggregated row per map task in the shuffle.
    """
    if "freq" not in terms.columns:
        terms = terms.withColumn("freq", F.lit(1).cast("long"))
    first = F.min(F.struct(F.col(line_no).alias("l"), F.col("term_no").alias("t")))
    agg = terms.groupBy("term").agg(F.sum("freq").alias("freq"), first.alias("_first"))
    return agg.select("term", "freq", F.col("_first.l").alias("first_line"),
                      F.col("_first.t").alias("first_term_no"))


def term_lines_from_parts(part: DataFrame) -> DataFrame:
    """``(line_no, line)`` term lines derived from the ``part`` table.

    ``p_partkey % 7``: 0 blank line, 1 plain name, 2 nested alias block,
    3 alias block with an empty alias, otherwise ``name/alias[brand|type]``.
    """
    k = F.col("p_partkey") % 7
    name, brand, ptype = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    line = (F.when(k == 0, F.lit("   "))
             .when(k == 1, name)
             .when(k == 2, F.concat(name, F.lit("/js["), brand, F.lit("/x["), ptype, F.lit("]]")))
             .when(k == 3, F.concat(name, F.lit("/Alias[|"), brand, F.lit("]")))
             .otherwise(F.concat(name, F.lit("/alias["), brand, F.lit("|"), ptype, F.lit("]"))))
    return part.select(F.col("p_partkey").alias("line_no"), line.alias("line"))
