"""Tokenising, stripping, tag application: Spark expressions vs Python semantics."""
from pyspark.sql import functions as F

from redline.functions import tags as T
from redline.functions import text as X

SAMPLES = ["  a  b\tc\n", "x y z", "a\x1cb\x1fc", "", "   ", "one", "a　b c\x85d",
           "tab\x0bvt\x0cff"]


def test_tokenize_and_strip_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    out = df.select("s", X.tokenize("s").alias("t"), X.py_strip("s").alias("p"),
                    X.is_blank("s").alias("b")).collect()
    for r in out:
        assert r.t == r.s.split(), repr(r.s)
        assert r.p == r.s.strip(), repr(r.s)
        assert r.b == (not r.s.strip()), repr(r.s)


def test_apply_tags_cases(spark):
    rows = [(["a", "b", "c"], ["KEEP", "DELETE", "REPLACE_x"], "a x"),
            (["a"], ["INSERT_x"], "a"),                      # unknown/insert tag falls back to token
            (["a", "b"], ["KEEP"], "a"),                     # zip stops at the shorter list
            (["a", "snake_cse"], ["KEEP", "REPLACE_snake_case"], "a snake_case"),
            ([], [], "")]
    df = spark.createDataFrame(rows, "tokens array<string>, tags array<string>, want string")
    for r in df.select(T.apply_tags("tokens", "tags").alias("got"), "want").collect():
        assert r.got == r.want


def test_tag_parts(spark):
    df = spark.createDataFrame([("REPLACE_a_b",), ("KEEP",), ("INSERT_x",)], "tag string")
    r = df.select(T.strip_prefix("tag").alias("a"), T.tag_op("tag").alias("op")).collect()
    assert [x.a for x in r] == ["a_b", "", "x"]
    assert [x.op for x in r] == ["REPLACE", "KEEP", "INSERT"]


def test_edit_ratio_filter(spark):
    rows = [("Hello world", "hello world", True), ("abc", "xyz", False), ("abcdefghij", "abcdefgxyz", True),
            ("abcdefghij", "abcdefwxyz", False)]
    df = spark.createDataFrame(rows, "o string, c string, want boolean")
    for r in df.select(X.within_edit_ratio("o", "c").alias("got"), "want").collect():
        assert r.got == r.want


def test_long_text_distance_matches_builtin(spark):
    a = "abcde fghij " * 300
    b = a[:1000] + "ZZZ" + a[1010:]
    df = spark.createDataFrame([(a, b)], "a string, b string")
    from redline.functions.distance import levenshtein
    r = df.select(levenshtein(F.col("a"), F.col("b")).alias("x"),
                  F.levenshtein("a", "b").alias("y")).collect()[0]
    assert r.x == r.y
