"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows, in turn order, are edited until their role initials read
``(s?(ua)+)?``: a row is kept (0), given the role user or assistant (1) or
deleted (2; blank rows and repeats must be), an empty user or assistant row is
inserted (5), and a truncated row that stays costs 5 more.  The cheapest edits
win; of equally cheap ones the least string of their initials (the *audit*).

The search walks an explicit stack of prefixes ``(next row, grammar state, cost,
audit)``.  Suffix lower bounds come from a relaxation that knows only whether a
user or an assistant row is due; an incumbent ``(cost, audit)`` cuts prefixes
that cannot beat it; per node, a table of the best prefix so far eliminates the
dominated ones.  An emptied stack proves the incumbent optimal.  (Of two
prefixes of equal cost at one node neither is a prefix of the other, as the
difference would be inserts alone, so the better one stays better under every
suffix.)

Equal rows of one turn stand next to each other; they are counted before any
shuffle and enter the search as one row, as all but the first must be deleted.
Rows are numbered over range partitions, so a conversation of any length is
dealt to many tasks: blocks of ``BLOCK_ROWS`` rows are searched from every
grammar state to every other, and the blocks' results are composed in a tree,
first inside a task, then over tasks in groups of ``FAN``.  The hash of the
repaired text is sequential by nature: its pass streams sorted rows and holds
one batch and the conversation's audit.

Cases: nulls in role, text and the damage key count as one space; null
conversation ids are one conversation; rows of one turn (null turns come first)
are taken by role, then text; a role's initial is its first character, so an
empty role is never legal; texts are never cut; a conversation without rows
after damage, and one whose rows are all deleted, has an empty audit or one of
deletions and the hash of the empty string; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import released, write_table

BLOCK_ROWS = 256
FAN = 16
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# Grammar states, and the state after keeping a row of each initial.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: States from which each state can be reached at all.
SOURCES = {START: {START}, SYSTEM: {START, SYSTEM}, USER: {0, 1, 2, 3}, ASSISTANT: {0, 1, 2, 3}}
FINAL = (START, ASSISTANT)
#: What a row asks for: nothing, deletion, or the price of a cut ending.
SOUND, FORCED, CUT = range(3)


def due(state: int) -> int:
    """The state that an inserted or re-roled row leads to."""
    return ASSISTANT if state == USER else USER


def suffix_bounds(rows: list[tuple[str, int, int]], goal: int) -> list[tuple[int, int]]:
    """Least cost from each row on, for (user due, assistant due): a system row may stand wherever a user is due."""
    end = (0, INSERT) if goal != USER else (INSERT, 0)
    out = [end]
    for initial, kind, copies in reversed(rows):
        nxt, extra = out[-1], DELETE * (copies - 1)
        if kind == FORCED:
            both = [DELETE + nxt[0], DELETE + nxt[1]]
        else:
            stay = TRUNCATED if kind == CUT else 0
            both = [min(DELETE + nxt[c], REROLE + stay + nxt[1 - c]) for c in (0, 1)]
            if initial == "s":
                both[0] = min(both[0], stay + nxt[0])
            elif initial == "u":
                both[0] = min(both[0], stay + nxt[1])
            elif initial == "a":
                both[1] = min(both[1], stay + nxt[0])
        both = [b + extra for b in both]
        out.append((min(both[0], INSERT + both[1]), min(both[1], INSERT + both[0])))
    return out[::-1]


def search(rows: list[tuple[str, int, int]], entry: int = START, goals: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """Cheapest ``(cost, audit)`` from ``entry`` to one of ``goals``; one letter a row, inserts between.

    ``rows`` are ``(initial, kind, copies)``.
    """
    n = len(rows)
    bounds = suffix_bounds(rows, goals[-1])
    sources = set().union(*(SOURCES[g] for g in goals))
    if entry not in sources:
        return None
    best: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    incumbent: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best[i, state] != (cost, audit):
            continue                                            # dominated since it was pushed
        if incumbent is not None:
            least = cost + bounds[i][state == USER]
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][:len(audit)]):
                continue
        if i == n and state in goals and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        steps = [(i, due(state), cost + INSERT, audit + "I")]
        if i < n:
            initial, kind, copies = rows[i]
            paid = cost + DELETE * (copies - 1)
            steps.append((i + 1, state, paid + DELETE, audit + "D"))
            if kind != FORCED:
                stay = TRUNCATED if kind == CUT else 0
                steps.append((i + 1, due(state), paid + REROLE + stay, audit + "R"))
                kept = AFTER.get((state, initial))
                if kept is not None:
                    steps.append((i + 1, kept, paid + stay, audit + "K"))
        fresh = []
        for step in steps:
            j, to, total, text = step
            if to not in sources:
                continue
            known = best.get((j, to))
            if known is None or (total, text) < known:
                best[j, to] = (total, text)
                fresh.append((total + bounds[j][to == USER], text, step))
        stack += [step for _, _, step in sorted(fresh, reverse=True)]
    return incumbent


def block_matrix(rows: list[tuple[str, int, int]]) -> list:
    """``search`` from every state to every state, as 16 entries."""
    return [search(rows, a, (b,)) for a in range(4) for b in range(4)]


def compose(left: list, right: list) -> list:
    """Results over two neighbouring stretches of rows from those of each."""
    out = []
    for a in range(4):
        for b in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := left[4 * a + m]) is not None and (y := right[4 * m + b]) is not None]
            out.append(min(ways) if ways else None)
    return out


def composed(parts: list[list]) -> list:
    """All stretches as one, pairwise, so that texts are copied a logarithmic number of times."""
    while len(parts) > 1:
        parts = [compose(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def result_of(matrix: list) -> tuple[int, str]:
    return min(matrix[4 * START + g] for g in FINAL if matrix[4 * START + g] is not None)


# --------------------------------------------------------------------------
# tables
# --------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: the rows after damage; nulls in role and text are a space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies")))


def _ordered(rows: DataFrame) -> DataFrame:
    """Equal rows counted; ``place`` numbers all rows by conversation, turn, role and text."""
    keys = ["conv_id", "turn", "role", "text"]
    g = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return (g.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(64)))
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
            .select(*keys, "copies", F.monotonically_increasing_id().alias("place"), F.left("role", F.lit(1)).alias("initial"),
                    F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("same"),
                    (end == "").alias("is_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("is_cut")))


def _faults(placed: DataFrame) -> DataFrame:
    """``placed`` without texts, with ``kind`` and the counts of each first fault."""
    light = placed.select("conv_id", "turn", "place", "initial", "copies", "same", "is_blank", "is_cut")
    first = (light.groupBy("conv_id", "same").agg(F.min("place").alias("first_place"), F.count("*").alias("n")).where("n > 1")
             .select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first_place"))
    j = light.join(first, light["conv_id"].eqNullSafe(first["c"]) & (light["same"] == first["s"]), "left")
    repeat = F.coalesce(F.col("place") > F.col("first_place"), F.lit(False))
    zero = F.lit(0).cast("long")
    return j.select(
        "conv_id", "turn", "place", "initial", "copies",
        F.when(F.col("is_blank") | repeat, FORCED).when(F.col("is_cut"), CUT).otherwise(SOUND).alias("kind"),
        F.when(F.col("is_blank"), F.col("copies")).otherwise(zero).alias("blank"),
        F.when(F.col("is_blank"), zero).when(repeat, F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"),
        F.when(~F.col("is_blank") & ~repeat & F.col("is_cut"), 1).otherwise(0).cast("long").alias("truncated"))


def _illegal(rows: list[tuple[str, int, int]]) -> int:
    """Neighbours that are not su, ua or au; copies of a row follow each other."""
    bad = sum(c - 1 for _, _, c in rows)
    return bad + sum(1 for a, b in zip(rows, rows[1:]) if a[0] + b[0] not in ("su", "ua", "au"))


class _Run:
    """One task's stretch of a conversation: the rows of an only block, else a matrix a block."""

    def __init__(self, conv):
        self.conv, self.rows, self.parts, self.illegal, self.first, self.last = conv, [], [], 0, None, None

    def close_block(self, more: bool):
        rows = self.rows
        if rows:
            self.illegal += _illegal(rows) + (self.last is not None and self.last + rows[0][0] not in ("su", "ua", "au"))
            self.first = rows[0][0] if self.first is None else self.first
            self.last = rows[-1][0]
            if more or self.parts:
                self.parts.append(block_matrix(rows))
                self.rows = []
        return self

    def matrix(self) -> list:
        return composed(self.parts) if self.parts else block_matrix(self.rows)

    def result(self) -> tuple[int, str]:
        return result_of(composed(self.parts)) if self.parts else search(self.rows)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[_Run]:
    """The conversations of a sorted partition."""
    run = None
    for b in batches:
        for conv, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if run is None or conv != run.conv:
                if run is not None:
                    yield run.close_block(False)
                run = _Run(conv)
            elif len(run.rows) == BLOCK_ROWS:
                run.close_block(True)
            run.rows.append(tuple(row))
    if run is not None:
        yield run.close_block(False)


def _searched(schema: pa.Schema):
    """Results of whole conversations; matrices of a partition's first and last one, which may go on in its neighbours."""
    def run(batches):
        part, out = TaskContext.get().partitionId(), []

        def row(r: _Run, edge: bool):
            if not edge:
                return (r.conv, part, *r.result(), r.illegal, None, None, r.first, r.last)
            m = r.matrix()
            return (r.conv, part, None, None, r.illegal, [-1 if x is None else x[0] for x in m], ["" if x is None else x[1] for x in m], r.first, r.last)

        def batch():
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        before, edge = None, True
        for r in _runs(batches):
            if before is not None:
                out.append(row(before, edge))
                edge = False
            before = r
            if len(out) >= 4096:
                yield batch()
        if before is not None:
            out.append(row(before, True))
            yield batch()
    return run


def _merged(schema: pa.Schema):
    """Stretches of one conversation from a few tasks as one."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        matrix = composed([[None if c < 0 else (c, a) for c, a in zip(r["costs"], r["audits"])] for r in rows])
        illegal = sum(r["illegal"] for r in rows) + sum(1 for a, b in zip(rows, rows[1:]) if a["last"] + b["first"] not in ("su", "ua", "au"))
        one = {**rows[0], "illegal": illegal, "last": rows[-1]["last"], "costs": [-1 if m is None else m[0] for m in matrix],
               "audits": ["" if m is None else m[1] for m in matrix]}
        one["cost"], one["audit"] = result_of(matrix)
        return pa.Table.from_pylist([one], schema=schema)
    return run


def _rewritten(schema: pa.Schema):
    """Streams each conversation's result and rows; hashes what the audit leaves of them."""
    def run(batches):
        now, done = None, None

        def finish():
            conv, cost, illegal, audit, at, state, digest, empty, letters = done
            state_, empty_ = state, empty
            for x in audit[at:]:
                state_ = due(state_)
                digest.update((b"" if empty_ else b"\n") + (b"assistant:" if state_ == ASSISTANT else b"user:"))
                empty_ = False
                letters.append(x)
            return conv, cost, illegal, "".join(letters), digest.hexdigest()

        for b in batches:
            out = []
            conv, kind, role, text, copies, cost, illegal, audit = (b.column(b.schema.get_field_index(n)).to_pylist() for n in
                                                                    ("conv_id", "row_kind", "role", "text", "copies", "cost", "illegal", "audit"))
            for i, k in enumerate(kind):
                if k == 0:
                    if done is not None:
                        out.append(finish())
                    done = [conv[i], cost[i], illegal[i], audit[i], 0, START, hashlib.sha256(), True, []]
                    continue
                plan, at, state, digest, empty, letters = done[3:]
                while True:
                    x = plan[at]
                    at += 1
                    letters.append(x)
                    if x == "D":
                        break
                    if x == "K":
                        state, who, what = AFTER[state, role[i][:1]], role[i], text[i]
                    else:
                        state = due(state)
                        who, what = ("assistant" if state == ASSISTANT else "user"), (text[i] if x == "R" else "")
                    digest.update(f"{'' if empty else chr(10)}{who}:{what}".encode())
                    empty = False
                    if x != "I":
                        break
                letters.append("D" * (copies[i] - 1))
                done[4], done[5], done[7] = at, state, empty
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if done is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(finish(), schema)], schema=schema)
    return run


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation in
    ``rows (conv_id, turn, role, text, copies)``; role and text are not null."""
    spark = rows.sparkSession
    key = rows.schema["conv_id"].dataType.simpleString()
    placed, _ = write_table(_ordered(rows), "repair_rows")
    faults, _ = write_table(_faults(placed), "repair_faults")
    per_turn = faults.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = per_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    found_type = _schema(spark, f"conv_id {key}, part int, cost long, audit string, illegal long, costs array<long>, audits array<string>, first string, last string")
    light = faults.select("conv_id", "initial", "kind", "copies", "place").repartitionByRange("place").sortWithinPartitions("place")
    found, _ = write_table(light.drop("place").mapInArrow(released(_searched(to_arrow_schema(found_type))), found_type), "repair_found")
    edge = found.where("cost is null")
    groups = (edge.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        edge = (edge.withColumn("stretch", F.floor(F.col("part") / FAN).cast("int")).groupBy("conv_id", "stretch")
                .applyInArrow(_merged(to_arrow_schema(found_type)), found_type).withColumn("part", F.floor(F.col("part") / FAN).cast("int")))
        groups = -(-groups // FAN)
        if groups == 1:
            break
        edge, _ = write_table(edge, "repair_edge")
    plans = found.where("cost is not null").unionByName(edge).select("conv_id", "cost", "illegal", "audit")

    stream = (plans.withColumn("row_kind", F.lit(0)).withColumn("place", F.lit(-1).cast("long"))
              .unionByName(placed.select("conv_id", "place", "role", "text", "copies", F.lit(1).alias("row_kind")), allowMissingColumns=True)
              .repartition("conv_id").sortWithinPartitions("conv_id", "row_kind", "place"))
    done_type = _schema(spark, f"conv_id {key}, cost long, illegal long, audit string, repaired_sha256 string")
    done = stream.mapInArrow(released(_rewritten(to_arrow_schema(done_type))), done_type)
    # one row a conversation from either side; grouping joins null ids as well
    both = done.unionByName(counts, allowMissingColumns=True)
    return both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every original conversation."""
    r = repair(damaged(conversations))
    kept = conversations.select("conv_id").distinct().unionByName(r, allowMissingColumns=True)
    n = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return kept.groupBy("conv_id").agg(*[n(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                       F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                       F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
