"""Readers and writers.

Readers take string or stated schemas (no type inference); writers go through
the DataFrame writer, so they are distributed and atomic per job.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts
from .csvrecords import records
from ..functions.text import is_blank, py_strip
from ..operators.vocab import vocab_lines

# The words pandas reads as missing by default.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
            "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Line separators of ``str.splitlines`` beyond the text source's \n, \r, \r\n.
EXTRA_LINE_BREAKS = r"[\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def na_to_null(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isin(*NA_WORDS), F.lit(None).cast("string")).otherwise(col)


def read_pairs_csv(spark: SparkSession, path: str, original: str = "original_text",
                   corrected: str = "corrected_text") -> DataFrame:
    """Pair CSV with header (S1): quoted fields, doubled quotes, embedded newlines;
    every column read as string; pandas' missing words become NULL on the two
    text columns.  Other columns are carried unchanged.

    The files' columns must come in one order: a file whose header differs from
    the first one's fails the read (columns are never taken by position alone).
    A file of any size is read by as many tasks as it has blocks
    (``csvrecords``); a row with another number of fields fails the read.
    """
    opts = dict(escape='"', mode="FAILFAST")
    names = spark.read.options(**opts, header=True, multiLine=True, inferSchema=False).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = records(spark, path)
    row = F.from_csv("text", schema, opts).alias("r")
    head = rows.where("record = 1").select(row)
    if not head.where(F.array(*[F.col(f"r.`{n}`") for n in names]) != F.array(*[F.lit(n) for n in names])).isEmpty():
        raise ValueError(f"not every file in {path} has the columns {', '.join(names)} in this order")
    df = rows.where("record > 1").select(row).select(*[F.col(f"r.`{n}`").alias(n) for n in names])
    return df.withColumn(original, na_to_null(original)).withColumn(corrected, na_to_null(corrected))


def write_pairs_csv(df: DataFrame, path: str) -> None:
    """Pairs as CSV with header; NULL written as an empty field."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("quoteAll", True).option("nullValue", "").csv(path))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(at, value)`` of every line; ``at`` orders by file name, block and line.

    Spark packs splits by size, so its own row order does not follow the files.
    """
    m = F.col("_metadata")
    at = F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(at.alias("at"), "value")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line (S2): ``(line_id, sentence)``; blank lines kept.

    Ordering by ``line_id`` (file, block, line) restores the input order; part
    files count in the order of their names.
    """
    return _lines(spark, path).select(F.col("at").alias("line_id"), F.col("value").alias("sentence"))


def write_sentences(df: DataFrame, path: str, col: str = "sentence", order: str | None = None) -> None:
    out = df.orderBy(order) if order else df
    out.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_corrected(df: DataFrame, path: str, order: str = "line_id", col: str = "corrected") -> None:
    """One corrected sentence per input line, in input order (K3).

    A range-partitioned sort: part files come out in order, no single task.
    """
    write_sentences(df, path, col, order)


def write_verbose_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per sentence: original, corrected, tokens."""
    tokens = F.transform("token_details", lambda d: F.struct(
        d["token"].alias("token"), d["pred_tag"].alias("tag"), d["top_probs"].alias("probs")))
    obj = F.to_json(F.struct(F.col("sentence").alias("original"), F.col("corrected").alias("corrected"),
                             tokens.alias("tokens")))
    df.select(obj.alias("value")).write.mode("overwrite").text(path)


VERBOSE_SCHEMA = ("original string, corrected string, "
                  "tokens array<struct<token:string,tag:string,probs:map<string,double>>>")


def read_verbose_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERBOSE_SCHEMA).json(path)


def write_tag_vocab(vocab: DataFrame, path: str) -> None:
    """The vocabulary as one JSON object in id order, non-ASCII kept (K2).

    The object is the part files in order of their names, one entry a line.
    """
    vocab_lines(vocab).orderBy("tag_id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read_tag_vocab(spark: SparkSession, path: str) -> DataFrame:
    """JSON object ``tag -> id`` back to ``(tag, tag_id)``.

    Files of one entry a line are read line by line, by any number of tasks.  A
    file laid out otherwise is read whole; one that is no object of integers
    fails the read.
    """
    raw = spark.read.text(path).where(~is_blank(F.col("value")))
    body = F.regexp_replace(py_strip(F.col("value")), r"^\{|[,}]\z", "")
    entries = raw.select(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,int>").alias("m"))
    odd = lambda m: F.col(m).isNull() | F.exists(F.map_values(m), lambda v: v.isNull())
    if entries.where(odd("m")).isEmpty():
        return entries.select(F.explode("m").alias("tag", "tag_id"))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,int>").alias("m"))
    checked = F.when(odd("m"), F.raise_error(F.lit("the vocabulary is no JSON object of integers")).cast("map<string,int>")).otherwise(F.col("m"))
    return whole.select(F.explode(checked).alias("tag", "tag_id"))


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """Term lines (S5) with ``str.splitlines`` breaks: ``(line_no, line)``."""
    parts = _lines(spark, path).select("at", F.posexplode(F.split("value", EXTRA_LINE_BREAKS, -1)).alias("_k", "line"))
    return parts.select(F.struct("at", "_k").alias("line_no"), "line")


def write_term_dict(dictionary: DataFrame, path: str) -> None:
    """``term freq`` lines in first-seen order (K5)."""
    out = dictionary.orderBy("first_line", "first_term_no")
    out.select(F.concat_ws(" ", "term", F.col("freq").cast("string")).alias("value")) \
       .write.mode("overwrite").text(path)


def read_term_dict(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(F.get(parts, 0).alias("term"),
                                        F.get(parts, 1).cast("long").alias("freq"))


def save_model(model: DataFrame, vocab: DataFrame, path: str) -> str:
    """Publish a fitted count tagger with its vocabulary as a new version; its name (K6)."""
    return artifacts.publish(model.sparkSession, path, model=model, vocab=vocab)


def load_model(spark: SparkSession, path: str):
    """``(model, vocab)`` of the newest whole version, or False on any failure (K6); loading again gives the same."""
    try:
        found = artifacts.load(spark, path, "model", "vocab")
    except PySparkException as e:
        artifacts.log.warning("no model could be read from %s: %s", path, e.getCondition())
        return False
    return found[1:] if found else False
