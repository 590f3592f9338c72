"""Chat formatting: cumulative snapshots collapse to maximal conversations.

A chat logged after every turn leaves snapshots, each a prefix of the next.
Every turn gets a rolling hash of the turns up to it (two 64-bit hashes, xored
along the conversation, each salted by its place).  A conversation whose last
hash is the hash of a proper prefix elsewhere is a snapshot and goes by an
anti-join; of equal conversations the smallest id stays.  Only the remaining
ones are rendered.

The prefix hashes are made distinct before the anti-join, and equal
conversations are pre-aggregated, so that one very common first turn or
conversation is one row a task.  Windows and rendering run within a
conversation, whose text is one output cell.

Cases: null role and text count as empty; turns are ordered by number (null
first), then role and text, gaps in the numbering do not matter; repeated rows
(same conversation, number, role and text) count once; rows without a
conversation id are no conversation and are left out; markers inside a text
are broken up, so that a text cannot forge a turn; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    t = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                             F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return t.where("conv_id is not null").distinct()


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, n_turns, h1, h2`` of every turn: rolling hashes of the turns up to it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.xxhash64("pos", "role", F.lit("\x1f"), "text")
    two = F.xxhash64(F.lit(0x5EED), "text", F.lit("\x1f"), "role", "pos")
    return (turns.withColumn("pos", F.row_number().over(order))
            .select("conv_id", "turn", "role", "text", "pos", one.alias("t1"), two.alias("t2"))
            .select("conv_id", "pos", F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"),
                    F.bit_xor("t1").over(sofar).alias("h1"), F.bit_xor("t2").over(sofar).alias("h2")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies``: one id for each conversation that no longer one extends."""
    h = prefix_hashes(turns)
    last = h.where("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = h.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return last.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def _safe(c: str):
    return F.replace(F.col(c), F.lit("<|"), F.lit("< |"))


def chat_documents(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, chat`` of the maximal conversations."""
    turns = _turns(conversations, conv_id, turn, role, text)
    kept = maximal_conversations(turns)
    line = F.concat(F.lit(START), _safe("role"), F.lit("\n"), _safe("text"), F.lit(END + "\n"))
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "")
    return (turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(rendered.alias("chat")))
