"""Seeded train/validation split.

Rows are ordered by ``md5(seed|key)`` (then ``key``, then the md5 of the row; rows
alike in every column are interchangeable); the first
``floor(n * val_split)`` form the validation split.  Exact and reproducible on
any partitioning.

At scale a global ``orderBy().limit(k)`` funnels k rows through one task.
Instead: count rows per 20-bit md5 prefix bucket (at most 2^20 small rows),
find the bucket where the running count crosses k, and within that one bucket
(~1/10^6 of the data) find the k-th row.  The split is then a predicate against
that single cut-off row -- no join, no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX_HEX = 5  # 20-bit buckets


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).withColumn("_b", F.conv(F.substring(h, 1, PREFIX_HEX), 16, 10).cast("int"))


def row_hash(columns: list[str]):
    """What tells rows of one key apart (of strings, numbers, arrays: anything JSON holds)."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in columns])))


def with_split(df: DataFrame, val_split: float | None = 0.05, seed: int = 42,
               key: str = "pair_id", col: str = "split", row: str | None = None) -> DataFrame:
    """Add ``split`` = 'validation' | 'train'.  ``None``, 0 or >= 1: all train.

    ``row`` names a column that already holds the rows' ``row_hash``; it does not come back.
    """
    if not val_split or not 0 < val_split < 1.0:
        return df.withColumn(col, F.lit("train")).drop(*[row] * bool(row))
    hashed = _hashed(df, key, seed)
    # one pass: bucket counts (<= 2^20 rows) also give the total
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).cache()
    n = counts.agg(F.sum("_n")).first()[0] or 0
    k = int(n * float(val_split))
    if k == 0:
        counts.unpersist()
        return df.withColumn(col, F.lit("train")).drop(*[row] * bool(row))
    run = counts.withColumn("_cum", F.sum("_n").over(Window.orderBy("_b")))
    cut = run.where(F.col("_cum") >= k).orderBy("_b").select("_b", "_cum", "_n").first()
    b, before = cut["_b"], cut["_cum"] - cut["_n"]
    # only the cut-off's bucket needs the row's own hash
    hashed = hashed.withColumn("_t", F.when(F.col("_b") == b, F.col(row) if row else row_hash(df.columns)))
    out = [c for c in df.columns if c != row] + [col]
    need = k - before
    counts.unpersist()
    edge = (hashed.where(F.col("_b") == b)
            .groupBy("_h", key, "_t").agg(F.count("*").alias("_n"))
            .select("_h", key, "_t", "_n", F.sum("_n").over(Window.orderBy("_h", key, "_t")).alias("_r"))
            .where(F.col("_r") >= need).orderBy("_r").first())
    at = lambda r: F.struct(F.lit(r["_h"]).alias("h"), F.lit(r[key]).alias("k"), F.lit(r["_t"]).alias("t"))
    cur = F.struct(F.col("_h").alias("h"), F.col(key).alias("k"), F.col("_t").alias("t"))
    is_val = (F.col("_b") < b) | ((F.col("_b") == b) & (cur < at(edge)))
    over = edge["_r"] - need
    if not over:
        is_val = is_val | (cur == at(edge))
    else:  # rows equal in every column stand at the cut: number those alone
        twin = hashed.where((F.col("_b") == b) & (cur == at(edge)))
        rest = hashed.where(~((F.col("_b") == b) & (cur == at(edge))))
        nth = F.row_number().over(Window.partitionBy("_t").orderBy("_t"))
        side = lambda c: F.when(c, F.lit("validation")).otherwise(F.lit("train"))
        return rest.withColumn(col, side(is_val)).select(*out).unionByName(twin.withColumn(col, side(nth <= edge["_n"] - over)).select(*out))
    return hashed.withColumn(col, F.when(is_val, F.lit("validation")).otherwise(F.lit("train"))).select(*out)


def split_train_validation(df: DataFrame, val_split: float | None = 0.05, seed: int = 42,
                           key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    s = with_split(df, val_split, seed, key)
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "validation").drop("split"))


def split_complement(all_rows: DataFrame, validation: DataFrame, key: str = "pair_id") -> DataFrame:
    """Train = all rows not in validation (left anti join on the key, X2)."""
    return all_rows.join(validation.select(key), key, "left_anti")
