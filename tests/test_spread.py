"""Rows for CPU-heavy work are dealt into several pieces a core."""
from redline.operators import joins


def test_spread_gives_every_core_the_same_share(spark):
    rows = spark.range(0, 2000).selectExpr("id", "id % 7 as line")
    out = joins.spread(rows, "id", "line")
    assert len(out.inputFiles()) >= joins.PIECES * spark.sparkContext.defaultParallelism
    assert sorted(out.collect()) == sorted(rows.collect())
