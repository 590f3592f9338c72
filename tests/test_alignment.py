"""Alignment golden cases (hand-written) and properties of the native fast path."""
import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redline.functions import tags as T
from redline.operators.align import align_tokens, diff_to_tags

GOLDEN = [
    # (original, corrected, tags, {gap: inserts})
    ("a fuil stack engineer huilding web apps", "a full-stack engineer building web apps",
     ["KEEP", "DELETE", "DELETE", "KEEP", "REPLACE_building", "KEEP", "KEEP"],
     {3: "INSERT_full-stack"}),
    ("a b c", "a b c", ["KEEP"] * 3, {}),
    ("a c", "a b c", ["KEEP", "KEEP"], {1: "INSERT_b"}),
    ("a b c", "a c", ["KEEP", "DELETE", "KEEP"], {}),
    ("a x c", "a b c", ["KEEP", "REPLACE_b", "KEEP"], {}),
    ("a b", "b a", ["KEEP", "DELETE"], {0: "INSERT_b"}),
    ("", "a", [], {0: "INSERT_a"}),
    ("a snake_cse", "a snake_case", ["KEEP", "REPLACE_snake_case"], {}),
]


def _gaps(g):
    return {i: x for i, x in enumerate(g) if x != T.KEEP_GAP}


def test_golden_python_helper():
    for o, c, tags, gaps in GOLDEN:
        t, g = align_tokens(o.split(), c.split())
        assert t == tags, (o, c)
        assert _gaps(g) == gaps, (o, c)


def test_golden_spark(spark):
    rows = [(i, o.split(), c.split()) for i, (o, c, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "pair_id long, orig_tokens array<string>, corr_tokens array<string>")
    out = {r.pair_id: r for r in diff_to_tags(df, keep_flag=True).collect()}
    for i, (o, c, tags, gaps) in enumerate(GOLDEN):
        assert out[i].tags == tags, (o, c)
        assert _gaps(out[i].gap_tags) == gaps, (o, c)
    # the swap must not take the native path
    assert out[5]._fast is False
    assert out[1]._fast is True and out[4]._fast is True


def test_autojunk_long_line(spark):
    toks = []
    for i in range(150):
        toks += ["the", f"x{i}"]
    corr = list(toks)
    noisy = list(toks)
    noisy[1], noisy[3] = "Q1", "Q3"
    t, _ = align_tokens(noisy, corr)
    assert t[2] == "REPLACE_the"  # popular token between two edits
    df = spark.createDataFrame([(1, noisy, corr)], "pair_id long, orig_tokens array<string>, corr_tokens array<string>")
    r = diff_to_tags(df, keep_flag=True).collect()[0]
    assert r._fast is False and r.tags == t


words = st.lists(st.sampled_from(["a", "b", "c", "d", "e", "f"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_fast_path_agrees_with_matcher_when_it_applies(o, c):
    if len(o) != len(c):
        return
    mo = {x for x, y in zip(o, c) if x != y}
    mc = {y for x, y in zip(o, c) if x != y}
    if mo & set(c) or mc & set(o):
        return
    fast = ["KEEP" if x == y else "REPLACE_" + y for x, y in zip(o, c)]
    assert align_tokens(o, c)[0] == fast


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_round_trip(o, c):
    tags, gaps = align_tokens(o, c)
    assert len(tags) == len(o) and len(gaps) == len(o) + 1
    out = []
    for i in range(len(o) + 1):
        if gaps[i] != T.KEEP_GAP:
            out += [s[len(T.INSERT):] for s in gaps[i].split(" ")]
        if i < len(o):
            tg = tags[i]
            if tg == "KEEP":
                out.append(o[i])
            elif tg.startswith("REPLACE_"):
                out.append(tg[len("REPLACE_"):])
    assert out == c
    assert difflib.SequenceMatcher(None, o, c) is not None


def test_fast_path_predicate_and_rebuild_native(spark):
    rows = [(1, ["a", "x", "c"], ["a", "b", "c"]), (2, ["a", "b"], ["b", "a"]), (3, [], ["a"])]
    df = spark.createDataFrame(rows, "pair_id long, orig_tokens array<string>, corr_tokens array<string>")
    out = diff_to_tags(df).select(
        "pair_id", (T.rebuild_from_tags("orig_tokens", "tags", "gap_tags") == F.col("corr_tokens")).alias("ok"))
    assert all(r.ok for r in out.collect())


def test_texts_to_tags_is_tokenising_and_aligning(spark):
    """One pass over texts gives what the two operators give, odd white space, nulls and empty texts included."""
    from redline.operators.align import diff_to_tags, texts_to_tags
    from redline.operators.pairs import tokenize_pairs
    texts = ["a fuil stack", " a  full-stack\tx ", "", "   ", None, "a b c　", "\x1ca\x1fb\x0bc\x85d", "é 日本 \U0001F600", "a b a b", "b a"]
    rows = [(10 * i + j, o, c) for i, o in enumerate(texts) for j, c in enumerate(texts)]
    df = spark.createDataFrame(rows, "pair_id long, original_text string, corrected_text string")
    names = ["pair_id", "orig_tokens", "corr_tokens", "tags", "gap_tags"]
    got = texts_to_tags(df).select(*names)
    want = diff_to_tags(tokenize_pairs(df)).select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_tagged_udf(") == 1            # both sides, tokens and tags from one call
