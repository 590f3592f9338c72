"""CSV over several tasks against Python's reader and Spark's one-task reader."""
import csv
import io as stdio
import random

import pytest

from redline.sources import csvrecords, io

FIELDS = ["plain", "", "a, b", 'say ""x""', "two\nlines", "é", "\n", '"', ',"\n', "NA", "x" * 40, '""\n""', "end\n"]


def table(seed, n):
    rnd = random.Random(seed)
    return [[f"{rnd.choice(FIELDS)}{i}" if rnd.random() < 0.5 else rnd.choice(FIELDS) for _ in range(3)] for i in range(n)]


def text(rows, end="\n", header=("original_text", "corrected_text", "more")):
    out = stdio.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    """Blocks of a hundred bytes or so: quoted fields run over their edges."""
    keys = {"spark.sql.files.maxPartitionBytes": "128b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.shuffle.partitions": "4"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_one_file_in_many_blocks(spark, tmp_path, small_blocks, seed, end):
    rows = table(seed, 60)
    (tmp_path / "a.csv").write_bytes(text(rows, end).replace("\n\n", "\n\n").encode())
    got = csvrecords.records(spark, str(tmp_path)).orderBy("record").collect()
    assert [r.record for r in got] == list(range(1, 62))
    assert [next(csv.reader(stdio.StringIO(r.text, newline=""))) for r in got[1:]] == rows
    blocks = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_block_start as b").distinct().count()
    assert blocks > 5
    pairs = io.read_pairs_csv(spark, str(tmp_path)).collect()
    null = lambda v: None if v in io.NA_WORDS else v
    assert sorted(map(str, ((r.original_text, r.corrected_text) for r in pairs))) == sorted(map(str, ((null(a), null(b)) for a, b, _ in rows)))


def test_equal_to_the_reader_of_one_task(spark, tmp_path, small_blocks):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(text(table(10 + i, 25)), newline="")
    whole = (spark.read.options(header=True, multiLine=True, escape='"').schema("original_text string, corrected_text string, more string").csv(str(tmp_path))
             .select(io.na_to_null("original_text").alias("o"), io.na_to_null("corrected_text").alias("c"), "more"))
    got = io.read_pairs_csv(spark, str(tmp_path))
    assert sorted(map(str, got.toDF("o", "c", "more").collect())) == sorted(map(str, whole.collect()))


def test_blank_lines_open_quotes_and_headers_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text('original_text,corrected_text\n\na,"\n\n"\n\nc,d"e"\n\n')
    assert sorted((r.original_text, r.corrected_text) for r in io.read_pairs_csv(spark, str(tmp_path)).collect()) == [("a", "\n\n"), ("c", 'd"e"')]
    alone, broken = tmp_path / "alone", tmp_path / "broken"
    for p, t in ((alone, "original_text,corrected_text\n"), (broken, 'original_text,corrected_text\na,"b\nc,d\n')):
        p.mkdir()
        (p / "x.csv").write_text(t)
    assert io.read_pairs_csv(spark, str(alone)).collect() == []
    with pytest.raises(Exception, match="open at the end"):
        io.read_pairs_csv(spark, str(broken)).collect()
