"""Structure repair against exhaustive search over small conversations."""
import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from redline.llm import structure_repair as sr

WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) by dynamic programming over whole strings; rows are (initial, kind, copies=1)."""
    rows = tuple(rows)

    @lru_cache(None)
    def go(i, out, room):
        ways = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", out):
                ways.append((0, ""))
        else:
            x, kind, _ = rows[i]
            c, a = go(i + 1, out, room)
            ways.append((c + 2, "D" + a))
            if kind != sr.FORCED:
                stay = 5 * (kind == sr.CUT)
                for letter, role, price in (("K", x, 0), ("R", "u", 1), ("R", "a", 1)):
                    if re.fullmatch("s?(ua)*u?", out + role):
                        c, a = go(i + 1, out + role, room)
                        ways.append((c + price + stay, letter + a))
        if room:
            for role in "ua":
                if re.fullmatch("s?(ua)*u?", out + role):
                    c, a = go(i, out + role, room - 1)
                    ways.append((c + 5, "I" + a))
        return min(ways, default=(10**9, ""))

    return go(0, "", 3)


def test_search_is_optimal_on_all_short_conversations():
    kinds = [(x, k, 1) for x in "suat" for k in (sr.SOUND, sr.FORCED, sr.CUT) if k != sr.FORCED or x == "u"]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert sr.search(list(rows)) == cheapest(rows), rows


def test_blocks_compose_to_the_whole():
    rnd = random.Random(5)
    for _ in range(150):
        n = rnd.randint(1, 14)
        rows = [(rnd.choice("suuaat"), rnd.choice((0, 0, 0, 1, 2)), 1) for _ in range(n)]
        at = sorted(rnd.randint(0, n) for _ in range(3))
        parts = [p for p in (rows[:at[0]], rows[at[0]:at[1]], rows[at[1]:at[2]], rows[at[2]:]) if p]
        whole = sr.search(rows)
        assert sr.result_of(sr.composed([sr.block_matrix(p) for p in parts])) == whole
        if n < 9:
            assert whole == cheapest(tuple(rows))


def brute(table):
    """The contract, row by row in Python, on (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            if k == 1:
                text = ""
            if k == 2:
                text = re.sub("[.!?]", "", text)
            if k == 4:
                role = "user"
            rows += [(turn, role, text)] * (2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, n = set(), [], [0, 0, 0]
        for _, role, text in rows:
            end = text.rstrip(WS)
            f = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if f is not None:
                n[f] += 1
            kinds.append((role[:1] or "-", {None: sr.SOUND, 0: sr.FORCED, 1: sr.FORCED, 2: sr.CUT}[f], 1))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = cheapest(kinds) if len(kinds) < 12 else sr.search(kinds)
        i, kept = 0, []
        for x in audit:
            due = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
            if x == "I":
                kept.append((due, ""))
                continue
            if x != "D":
                kept.append((rows[i][1] if x == "K" else due, rows[i][2]))
            i += 1
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, copies int, place string, kind double, same int, cost int, part int"


def run(spark, table, parts=3):
    df = spark.createDataFrame([(*r, 7, "x", 0.5, 1, 2, 3) for r in table], SCHEMA).repartition(parts)
    got = sr.repaired_conversations(df).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations(seed, n):
    rnd = random.Random(seed)
    words = ["Yes.", "No?", "Go on", "Wait!", "", " \t", "Sure. \n", "é.", None, "ok"]
    table = []
    for c in [None, *range(n)]:
        for t in range(rnd.randint(1, 7)):
            table.append((c, None if rnd.random() < 0.1 else t + rnd.choice((0, 0, 0, 2)), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]),
                          rnd.choice(words) if rnd.random() < 0.5 else f"text {rnd.random()}."))
    return table + table[:5]


def test_damage_counts_and_repair_match_brute_force(spark):
    table = conversations(1, 60)
    assert run(spark, table) == brute(table)


def test_empty_table_and_conversation_without_rows(spark):
    assert run(spark, [], 1) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "a.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("block", [3, 256])
def test_one_long_conversation_over_many_tasks(spark, monkeypatch, block):
    """A conversation that spreads over partitions and blocks, with a row repeated thousands of times."""
    monkeypatch.setattr(sr, "BLOCK_ROWS", block)
    monkeypatch.setattr(sr, "FAN", 2)
    rnd = random.Random(2)
    table = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["same.", f"line {t}.", f"cut {t}"])) for t in range(400)]
    table += [(1, 7, "user", "again and again.")] * 3000 + [(0, 0, "user", "x."), (2, 1, "assistant", "y.")]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, table) == brute(table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
