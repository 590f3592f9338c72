"""Lineage cuts and dense ids shared by the operators.

Joins carry no broadcast hint: tables come written (``materialize``), so Spark
knows their bytes and broadcasts below its own threshold only; beyond it the
join is a shuffle join that adaptive execution re-plans and un-skews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Pieces a core into which ``spread`` deals its rows.
PIECES = 4


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (lost executors recompute from the files, not from the
    source) and gives the optimizer exact file sizes for join planning.  Zstandard:
    token lists take half the bytes that Snappy needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly by ``keys`` (near-unique, so no hot key), written once.

    For CPU-heavy work on inputs that arrive in few splits.  Written, because
    Catalyst pushes filters through a repartition, which would put an expensive
    predicate back into the scan's stage.  The number of pieces is a multiple of
    the cores: left to adaptive execution there are a few more pieces than cores,
    and the work behind takes two rounds, the second with most cores idle.
    """
    spark = df.sparkSession
    pieces = max(PIECES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartition(pieces, *[F.col(k) for k in keys]), "spread")


def listed(df: DataFrame) -> list[tuple] | None:
    """The rows of a written table of a text and numbers if Spark would broadcast as many bytes in a join, else None."""
    most = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    text, *numbers = df.columns
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8 * (1 + len(numbers)))).first()[0] or 0
    return [tuple(r) for r in df.collect()] if size <= most else None


def dense_index(df: DataFrame, col: str, id_col: str, name: str = "dense") -> DataFrame:
    """Dense 0-based ids in ascending binary order of ``col`` (values unique).

    Distributed: range-partition and sort by ``col``; the monotonically
    increasing id then encodes (partition, offset-in-partition).  Partition
    sizes (one row per partition: bounded by the partition count) give each
    partition's starting id.  No global single-task window over the data.
    """
    ordered = df.select(col).repartitionByRange(col).sortWithinPartitions(col)
    pinned = materialize(ordered.select(col, F.monotonically_increasing_id().alias("_mid")), name)
    part = F.shiftright("_mid", 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = pinned.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = pinned.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.select(col, (F.col("_off") + local).cast("int").alias(id_col))
