"""Tag vocabulary: build, encode, decode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import BASE_TAGS, DELETE, KEEP
from .joins import dense_index, materialize


def build_tag_vocab(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    """``(tag, tag_id)``: distinct token tags plus KEEP and DELETE, ids 0..n-1 in
    code-point order.  Gap tags are not part of it.

    A row gives each of its tags once, and ``distinct`` is a partial (map-side)
    aggregation, so a tag held by a third of all tokens (KEEP) costs one row per
    map task in the shuffle.
    """
    spark = tagged.sparkSession
    base = spark.createDataFrame([(t,) for t in BASE_TAGS], "tag string")
    distinct = tagged.select(F.explode(F.array_distinct(tags)).alias("tag")).unionByName(base).distinct()
    return materialize(dense_index(distinct, "tag", "tag_id", "vocab_ids"), "vocab")


def vocab_ids(vocab: DataFrame) -> dict:
    """Ids of the base tags (two driver-sized lookups)."""
    rows = vocab.where(F.col("tag").isin(*BASE_TAGS)).collect()
    ids = {r["tag"]: r["tag_id"] for r in rows}
    return {KEEP: ids[KEEP], DELETE: ids[DELETE]}


def encode_tags(long_tags: DataFrame, vocab: DataFrame, tag: str = "tag", out: str = "tag_id",
                ids: dict | None = None) -> DataFrame:
    """Tag -> id; out-of-vocabulary tags get KEEP's id.

    The two base tags (the hot keys: most tokens are KEEP) are resolved by a
    literal comparison.  In the join they carry a key of their own that matches
    nothing and differs from row to row, so a shuffle join deals them evenly.
    ``ids`` (from ``vocab_ids``) saves the lookup when the caller has it.
    """
    ids = ids or vocab_ids(vocab)
    v = vocab.where(~F.col("tag").isin(*BASE_TAGS)).select(F.col("tag").alias("_vtag"), F.col("tag_id").alias("_vid"))
    t = F.col(tag)
    stray = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in long_tags.columns]).cast("string"))
    j = (long_tags.withColumn("_key", F.when(t.isin(*BASE_TAGS) | t.isNull(), stray).otherwise(t))
         .join(v, F.col("_key") == F.col("_vtag"), "left"))
    enc = (F.when(t == KEEP, F.lit(ids[KEEP])).when(t == DELETE, F.lit(ids[DELETE]))
            .otherwise(F.coalesce(F.col("_vid"), F.lit(ids[KEEP]))))
    return j.withColumn(out, enc.cast("int")).drop("_key", "_vtag", "_vid")


def decode_tags(long_ids: DataFrame, vocab: DataFrame, tag_id: str = "tag_id",
                out: str = "tag") -> DataFrame:
    """Id -> tag (inner join on id, J2)."""
    v = vocab.select(F.col("tag_id").alias("_vid"), F.col("tag").alias(out))
    return long_ids.join(v, F.col(tag_id) == F.col("_vid"), "inner").drop("_vid")


def vocab_lines(vocab: DataFrame) -> DataFrame:
    """``(tag_id, line)``: lines that make one JSON object in id order (K2).

    The first line opens the object and the last closes it, so the lines can be
    written by as many tasks as the vocabulary needs.
    """
    last = vocab.agg(F.max("tag_id")).first()[0]
    entry = F.concat(F.lit(" "), F.to_json(F.array("tag")).substr(F.lit(2), F.length(F.to_json(F.array("tag"))) - 2),
                     F.lit(": "), F.col("tag_id").cast("string"))
    return vocab.select("tag_id", F.concat(
        F.when(F.col("tag_id") == 0, F.lit("{")).otherwise(F.lit("")), entry,
        F.when(F.col("tag_id") == F.lit(last), F.lit("}")).otherwise(F.lit(","))).alias("line"))
