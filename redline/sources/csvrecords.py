"""CSV records of large files by several tasks, line feeds inside quotes included.

Whether a physical line begins a record depends on everything before it in its
file: it does unless a quoted field is still open.  Each line, though, only maps
the state before it (outside, inside quotes) to the state behind it, and such
maps compose: a line keeps the state, flips it, or sets it whatever it was.  So
files are read in blocks like any text; a running count of flips since the last
line that sets the state gives each line's state but for the block's own first
one, which the summaries of the blocks before it give: one row a block.

Lines are written once between the two passes, so that both see the same blocks.
Only records of several lines are grouped; the others pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import materialize

# Inside quotes up to a closing one; whole fields and their commas.
_IN = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_IN}"|[^",][^,]*+|),)*+'
#: A line from outside, and one from inside, that ends in an open quote.
_OPENS = rf'^{_FIELDS}"{_IN}\z'
_STAYS = rf'^{_IN}(?:",{_FIELDS}"{_IN})?\z'


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, text)``: every record's text without its last line break; ``record`` counts from 1 in its file.

    Line breaks are LF or CR LF, and LF in the text.  Empty lines outside quotes
    are no records; a quote still open at a file's end fails the read.
    """
    m = F.col("_metadata")
    quoted = F.col("line").contains('"')
    raw = (spark.read.option("lineSep", "\n").text(path)
           .select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"),
                   F.regexp_replace("value", r"\r\z", "").alias("line")))
    lines = materialize(raw.withColumn("from_out", quoted & F.col("line").rlike(_OPENS)).withColumn("from_in", ~quoted | F.col("line").rlike(_STAYS)), "csv_lines")

    sets, flips = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    run = Window.partitionBy("file", "block").orderBy("at")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("flips", F.sum(flips.cast("long")).over(so_far))
    t = t.withColumn("set", F.last(F.when(sets, F.struct(F.col("from_in").alias("to"), F.col("flips").alias("n"))), ignorenulls=True).over(so_far))
    # what is known of the state behind the line without the block's start: set to a value, or flipped or not
    odd = (F.col("flips") - F.coalesce(F.col("set.n"), F.lit(0))) % 2 == 1
    t = t.select("file", "block", "at", "line", F.col("set").isNotNull().alias("fixed"), (F.coalesce(F.col("set.to"), F.lit(False)) != odd).alias("bit"))

    # one row a block: the state at its start
    ends = t.groupBy("file", "block").agg(F.max_by(F.struct("fixed", "bit"), "at").alias("e")).select("file", "block", "e.*")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(~F.col("fixed") & F.col("bit"), 1).otherwise(0)).over(before), F.lit(0))
    ends = ends.withColumn("turns", F.sum(F.when(~F.col("fixed") & F.col("bit"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("fixed"), F.struct("bit", "turns")), ignorenulls=True).over(before)
    starts = ends.withColumn("last", last).withColumn("turned", turns)
    inside = F.coalesce(F.col("last.bit"), F.lit(False)) != ((F.col("turned") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1)
    starts = starts.select(F.col("file").alias("f"), F.col("block").alias("b"), inside.alias("start"))

    j = t.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    j = j.withColumn("behind", F.when(F.col("fixed"), F.col("bit")).otherwise(F.col("bit") != F.col("start")))
    j = j.withColumn("inside", F.coalesce(F.lag("behind").over(run), F.col("start")))
    # blank lines outside quotes are no records
    j = j.where("inside or line <> ''")
    j = j.withColumn("no", F.sum((~F.col("inside")).cast("long")).over(so_far))
    j = materialize(j.select("file", "block", "at", "line", "inside", "behind", "no"), "csv_states")

    counts = j.groupBy("file", "block").agg(F.max("no").alias("n"), F.max_by("behind", "at").alias("open"))
    total = F.coalesce(F.sum("n").over(before), F.lit(0))
    counts = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), total.alias("earlier"))
    r = j.join(counts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(
        "file", (F.col("no") + F.col("earlier")).alias("record"), "block", "at", "line", "inside", "behind")
    single = r.where("not inside and not behind").select("file", "record", F.col("line").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line", "behind")))
    several = (r.where("inside or behind").groupBy("file", "record").agg(parts.alias("p"))
               .select("file", "record", F.when(F.element_at("p", -1)["behind"], F.raise_error(F.lit("a quoted field is open at the end of the file")))
                       .otherwise(F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("text")))
    return single.unionByName(several)
