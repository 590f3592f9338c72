"""Published versions, and a session without a configured checkpoint folder."""
import os
import shutil
import subprocess
import sys

import pytest

from redline.operators.tagger import fit_count_tagger
from redline.operators.vocab import build_tag_vocab
from redline.sources import artifacts, io
from redline.streaming.correct_stream import run_correct_stream


def fitted(spark, word):
    tagged = spark.createDataFrame([(1, ["teh", "cat"], [f"REPLACE_{word}", "KEEP"])] * 3, "pair_id long, orig_tokens array<string>, tags array<string>")
    vocab = build_tag_vocab(tagged)
    return fit_count_tagger(tagged, vocab), vocab


def test_only_whole_versions_are_loaded(spark, tmp_path):
    path = str(tmp_path / "model")
    assert io.load_model(spark, path) is False
    model, vocab = fitted(spark, "the")
    first = io.save_model(model, vocab, path)
    assert artifacts.newest(spark, path) == first
    for _ in range(2):                                # loading again gives the same
        m, v = io.load_model(spark, path)
        assert sorted(map(str, m.collect())) == sorted(map(str, model.collect())) and v.count() == vocab.count()
    # a writer that stopped before its manifest
    model.write.parquet(f"{path}/version=99999999999999999999-dead/model")
    assert artifacts.newest(spark, path) == first
    # a version that lost a file after it was published
    second = io.save_model(*fitted(spark, "them"), path)
    assert artifacts.newest(spark, path) == second > first
    assert artifacts.load(spark, path, "model", "vocab")[0] == second
    shutil.rmtree(f"{path}/version={second}/vocab")
    assert artifacts.load(spark, path, "model", "vocab")[0] == first
    shutil.rmtree(f"{path}/version={first}/model")
    assert io.load_model(spark, path) is False


def test_stream_takes_up_a_new_version_between_batches(spark, tmp_path):
    path, source = str(tmp_path / "model"), tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text('{"request_id": "%d", "body": "{\\"sentence\\": \\"teh cat\\"}"}\n' % i)
        os.utime(source / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    words, seen = ["the", "they"], []

    def publish(batch):
        # before the second batch a first model, before the third a second one
        if len(seen) in (1, 2):
            io.save_model(*fitted(spark, words[len(seen) - 1]), path)
        seen.append(1)
        return batch

    calls = []
    newest = artifacts.newest

    def watched(s, p):
        publish(None)
        calls.append(p)
        return newest(s, p)

    artifacts.newest = watched
    try:
        responses, _ = run_correct_stream(spark, str(source), None, None, model_path=path)
    finally:
        artifacts.newest = newest
    got = {r.request_id: (r.status, r.error, r.corrected_sentence) for r in responses.collect()}
    assert got == {"0": (503, "Model unavailable.", None), "1": (200, None, "the cat"), "2": (200, None, "they cat")}
    assert responses.where("model_version is not null").select("model_version").distinct().count() == 2


@pytest.mark.parametrize("text", ['{"KEEP": 0, "DELETE":\n 1,\n "REPLACE_é, }": 2}', '{"KEEP": 0, "DELETE": 1, "REPLACE_é, }": 2}', '{\n"KEEP": 0,\n"DELETE": 1,\n"REPLACE_é, }": 2\n}\n'])
def test_vocabulary_in_any_layout(spark, tmp_path, text):
    (tmp_path / "v.json").write_text(text)
    assert sorted(tuple(r) for r in io.read_tag_vocab(spark, str(tmp_path)).collect()) == [("DELETE", 1), ("KEEP", 0), ("REPLACE_é, }", 2)]


@pytest.mark.parametrize("text", ['{"KEEP": 0, "DELETE":\n', '["KEEP"]', '{"KEEP": 0,\n"DELETE": "one"}'])
def test_a_broken_vocabulary_is_refused(spark, tmp_path, text):
    (tmp_path / "v.json").write_text(text)
    with pytest.raises(Exception, match="no JSON object of integers"):
        io.read_tag_vocab(spark, str(tmp_path)).collect()


def test_local_session_without_a_configured_folder(tmp_path):
    code = ("from redline.session import get_spark\nfrom redline.operators.joins import materialize\n"
            "s = get_spark('local[1]', 1)\nprint('rows', materialize(s.range(3)).count())\ns.stop()")
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
