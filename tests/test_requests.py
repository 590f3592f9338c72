import json

import pytest
from pyspark.sql import functions as F

from redline.operators import tagger, vocab
from redline.operators.requests import parse_requests, response_json, route_requests
from redline.streaming.correct_stream import respond, run_correct_stream, with_latency


@pytest.fixture(scope="module")
def fitted(spark):
    t = spark.createDataFrame([(1, ["teh", "cat"], ["REPLACE_the", "KEEP"]), (2, ["teh", "dog"], ["REPLACE_the", "KEEP"])],
                              "pair_id long, orig_tokens array<string>, tags array<string>")
    v = vocab.build_tag_vocab(t)
    return tagger.fit_count_tagger(t, v), v


def _bodies(spark, rows):
    return spark.createDataFrame([(k, b if isinstance(b, str) else json.dumps(b)) for k, b in rows], "request_id string, body string")


def test_rows_alike_get_a_response_each(spark, fitted):
    rows = [("a", {"sentence": "teh cat"}), ("a", {"sentence": "teh dog ran"}), ("a", {"sentence": "teh cat"})]
    got = respond(_bodies(spark, rows), *fitted, keys=("request_id",)).collect()
    assert sorted(r.corrected_sentence for r in got) == ["the cat", "the cat", "the dog ran"]


@pytest.mark.parametrize("body,want", [
    ('{"top_k": "99999999999999999999"}', 1 << 31), ('{"top_k": 1e300}', 1 << 31), ('{"top_k": -1e300}', -(1 << 31)),
    ('{"top_k": "\\n3"}', 3), ('{"top_k": " +4 "}', 4), ('{"top_k": 2.9}', 2), ('{"top_k": true}', 1), ('{"top_k": "1_0"}', 10),
    ('{"top_k": "x"}', None), ('{"top_k": null}', None), ("[1]", 3), ("{", 3), (None, 3)])
def test_top_k_of_any_size(spark, body, want):
    df = spark.createDataFrame([("q", body)], "request_id string, body string")
    assert parse_requests(df).first()["top_k"] == want


def test_huge_top_k_leaves_the_batch_alive(spark, fitted):
    rows = [("a", {"sentence": "teh cat", "top_k": "9" * 40}), ("b", {"sentence": "teh", "top_k": 1})]
    got = {r.request_id: r for r in respond(_bodies(spark, rows), *fitted, keys=("request_id",)).collect()}
    assert got["a"].corrected_sentence == "the cat" and len(got["b"].token_details[0].top) == 1


def test_no_model_is_503_before_parsing(spark):
    got = respond(_bodies(spark, [("a", "{")]), None, None, keys=("request_id",)).first()
    assert got.status == 503 and got.error
    assert route_requests(parse_requests(_bodies(spark, [("a", {})])), model_ready=False).first()["route"] == "no_model"


def test_wire_form_has_all_fields(spark, fitted):
    rows = [("a", {"sentence": "teh cat"}), ("b", {"sentence": " "}), ("c", {"sentence": 5})]
    got = {r.request_id: json.loads(r.json) for r in response_json(respond(_bodies(spark, rows), *fitted, keys=("request_id",))).collect()}
    fields = {"original_sentence", "corrected_sentence", "token_details", "model_name", "processing_time_ms", "corrections_made", "message"}
    assert set(got["a"]) == fields == set(got["b"]) and set(got["c"]) == {"error"}
    assert got["b"]["token_details"] == [] and got["a"]["corrections_made"] is True


def test_every_batch_of_a_stream_of_bodies_has_its_time(spark, fitted, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(6):
        (src / f"{i}.json").write_text(json.dumps({"request_id": str(i), "body": json.dumps({"sentence": f"teh n{i}"})}) + "\n")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        responses, latency = run_correct_stream(spark, str(src), *fitted)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = with_latency(responses, latency).collect()
    assert latency.count() == 6 and len(rows) == 6
    assert all(r.processing_time_ms > 0 and r.corrected_sentence == f"the n{r.request_id}" for r in rows)


def test_correct_batch_with_repeated_keys_and_full_distribution(spark, fitted):
    s = spark.createDataFrame([(1, "teh cat"), (1, "a  teh"), (2, " "), (3, None)], "k int, sentence string")
    got = sorted((r.k, r.corrected) for r in tagger.correct_batch(s, *fitted, key="k").collect() if r.corrected is not None)
    assert got == [(1, "a the"), (1, "the cat"), (2, "")]
    d = tagger.full_distribution(s.where("k = 1"), *fitted, key="k")
    sums = d.groupBy("sentence" if "sentence" in d.columns else "token").agg(F.sum("prob").alias("p"), F.count("*").alias("n")).collect()
    assert all(abs(r.p - round(r.p)) < 1e-9 for r in sums)
    assert {r.n % fitted[1].count() for r in sums} == {0}


def test_correct_verbose_with_repeated_and_missing_keys(spark, fitted):
    s = spark.createDataFrame([(1, "teh cat"), (1, "a  teh"), (2, " "), (None, "teh"), (None, "x teh")], "k int, sentence string")
    rows = tagger.correct_verbose(s, *fitted, key="k").collect()
    got = sorted((r.k or 0, r.sentence, r.corrected, len(r.token_details)) for r in rows)
    assert got == [(0, "teh", "the", 1), (0, "x teh", "x the", 2), (1, "a  teh", "a the", 2), (1, "teh cat", "the cat", 2), (2, " ", "", 0)]
