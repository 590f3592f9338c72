"""Mixing sources to target weights, cut at each source's exact budget.

Every document gets a hash-random key.  Documents are range-sorted by
``(source, key)``, sizes are summed up along that order by distributed prefix
sums (within each range partition, then over the partitions' totals), and each
source is cut where the running sum reaches its budget; the document at the
cut gives the part that is still missing.  A budget beyond the source's size
takes whole epochs first and cuts in the last one.

Targets share ``budget`` by weight; a source stops at ``max_epochs`` times its
size and the excess is shared again by weight until no source is above: the
water level at which the capped shares add up to the budget.

Cases: a null source is a source of its own, last in order; null text has size
0 and takes 0; keys come from id and text, so rows without an id or with a
common one are in random order as well; identical rows share a key and are
interchangeable; a hot source, or a row that repeats without end, is split over
many range partitions; an empty table gives an empty result; other columns are
not read by the plan and are carried by ``mixed_documents``.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import write_table

#: The weights repeat over the sources in order.
WEIGHTS = (5, 2, 1)
BUDGET_PCT = 150
MAX_EPOCHS = 2

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text) -> "F.Column":
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    The windows here run over the sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    every = Window.partitionBy(F.lit(1))
    rise = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("all", F.sum("source_size").over(every) * F.lit(budget_pct / 100.0))
          .withColumn("all_w", F.sum("w").over(every))
          .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("full_w", F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level if every source before this one, in order of cap / weight, is full
    s = s.withColumn("level", (F.col("all") - F.col("full")) / (F.col("all_w") - F.col("full_w")))
    s = s.withColumn("open", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every))
    target = F.when(F.col("open").isNull() | (F.col("open") * F.col("w") >= F.col("cap")), F.col("cap")).otherwise(F.col("open") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS, seed: int = 7,
             doc_id: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (and ``row``, if named) for every document."""
    extra = [F.col(row).alias("row")] if row else []
    # the text is part of the key: rows without an id, or with a common one, are in random order too
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id).cast("long").cast("string"), F.md5(F.col(text).cast("binary"))))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"), *extra)
    # equal rows share a key; the place lets them spread over partitions, and which of them is taken makes no difference
    order = ["source", "key", "doc_id", "size", "place"]
    ranged = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged, _ = write_table(ranged.withColumn("part", F.spark_partition_id()), "mix_sorted")

    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, budget_pct, max_epochs)
    # one row for each source and range partition that holds it
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    parts = (parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
             .select("p.source", "p.part", "p.ahead", "t.source_size", "t.target"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = run.alias("d").join(parts.alias("p"), F.expr("d.part = p.part and d.source <=> p.source"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("ahead") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return j.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if row else []))


@F.pandas_udf(StringType())
def _first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """Texts up to the end of their ``n``-th word; one row a source needs it."""
    ends = (next(islice(re.finditer(WORD, t), k - 1, None)).end() for t, k in zip(text, n))
    return pd.Series([t[:e] for t, e in zip(text, ends)])


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: whole copies of each document, then the words of its part; columns as in ``docs``, whatever their names.

    ``n_chars`` of a part, if present, is that of its text.  ``docs`` is written
    once under a row number, so that repeated ids stay apart.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole_row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in at.items()]).alias("d")
    numbered, _ = write_table(docs.select(whole_row, F.monotonically_increasing_id().alias("row")), "mix_rows")
    named = numbered.select("row", *[F.col(f"d.{at[c]}").alias(n) for c, n in ((doc_id, "doc_id"), (source, "source"), (text, "text"))])
    plan = mix_plan(named, row="row", **options).where("taken > 0").select("row", "size", "taken")
    copies = numbered.join(plan, "row")
    whole = copies.where("taken >= size").select("d", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    part = copies.withColumn("left", F.col("taken") % F.col("size")).where("left > 0").withColumn("cut", _first_words(f"d.{at[text]}", "left"))
    new = {text: F.col("cut")}
    if "n_chars" in at:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return whole.select(*[F.col(f"d.{n}").alias(c) for c, n in at.items()]).unionByName(
        part.select(*[new.get(c, F.col(f"d.{n}")).alias(c) for c, n in at.items()]))
