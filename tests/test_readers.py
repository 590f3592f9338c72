import pytest

from redline.functions.text import within_edit_ratio
from redline.operators.joins import dense_index
from redline.operators.split import with_split
from redline.operators.vocab import encode_tags
from redline.plans.corpus import build_dataset, count_tagger
from redline.operators.metrics import evaluate_tagger
from redline.sources import io


def test_lines_follow_file_names_not_sizes(spark, tmp_path):
    (tmp_path / "part-00000").write_text("first\nsecond\n")
    (tmp_path / "part-00001").write_text("".join(f"line {i} {'x' * 50}\n" for i in range(3000)))
    got = [r.sentence for r in io.read_sentences(spark, str(tmp_path)).orderBy("line_id").collect()]
    assert got[:3] == ["first", "second", "line 0 " + "x" * 50] and got[-1].startswith("line 2999 ") and len(got) == 3002
    terms = io.read_term_list(spark, str(tmp_path)).orderBy("line_no").limit(2).collect()
    assert [r.line for r in terms] == ["first", "second"]


def test_csv_columns_are_never_taken_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text('original_text,corrected_text\n"a ""q"", b","c\nd"\nNA,x\n')
    good = sorted(io.read_pairs_csv(spark, str(tmp_path)).collect(), key=lambda r: r.corrected_text)
    assert (good[0].original_text, good[0].corrected_text) == ('a "q", b', "c\nd") and good[1].original_text is None
    (tmp_path / "b.csv").write_text("corrected_text,original_text\nright,wrong\n")
    with pytest.raises(ValueError, match="in this order"):
        io.read_pairs_csv(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("original_text,corrected_text\na,b,c\n")
    with pytest.raises(Exception):
        io.read_pairs_csv(spark, str(tmp_path)).collect()


def test_split_is_exact_with_repeated_keys(spark):
    same = spark.createDataFrame([(1, i) for i in range(100)], "pair_id long, x int")
    assert with_split(same, 0.05).where("split = 'validation'").count() == 5
    alike = spark.createDataFrame([(1, 1)] * 100 + [(i, 0) for i in range(2, 102)], "pair_id long, x int")
    s = with_split(alike, 0.25)
    assert s.where("split = 'validation'").count() == 50 and s.count() == 200


def test_two_empty_sides_do_not_stop_the_job(spark):
    df = spark.createDataFrame([("", ""), ("a", "a"), ("x" * 300, "x" * 299 + "y"), ("x" * 300, "y" * 300), ("é" * 150, "e" * 40)], "o string, c string")
    assert [r[0] for r in df.select(within_edit_ratio("o", "c")).collect()] == [False, True, True, False, False]


def test_base_tags_do_not_meet_in_one_partition(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tags = spark.range(4000).selectExpr("id", "case when id % 10 = 0 then concat('REPLACE_', id % 7) else 'KEEP' end as tag")
        vocab = dense_index(tags.select("tag").distinct().union(spark.sql("select 'DELETE'")), "tag", "tag_id")
        enc = encode_tags(tags, vocab)
        sizes = enc.rdd.glom().map(len).collect()
        assert enc.count() == 4000 and max(sizes) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dataset_from_any_pairs(spark):
    rows = [(i, f"teh cat number {i}", f"the cat number {i}") for i in range(60)] + [(99, None, "x"), (98, "abc", "xyzxyzxyz")]
    c = build_dataset(spark.createDataFrame(rows, "pair_id long, original_text string, corrected_text string"), val_split=0.2)
    s = c.stats().first()
    assert (s.n_pairs, s.n_kept, s.n_train, s.n_validation, s.n_tags) == (62, 60, 48, 12, 3)
    assert evaluate_tagger(c.split("validation"), count_tagger(c), c.vocab).first()["token_accuracy"] == 1.0
    assert {len(r.input_ids) for r in c.encoded(max_length=16).collect()} == {16} and c.encoded().count() == 60
