"""Every stage of the pipeline against a plain version on a small folder of tables."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redline.llm.queries import quality_model
from redline.llm.quality_qda import quality_scores

from .helpers import WORD, components, repeated_bytes, shingles
from .test_plans import _mix_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, near = prose(70), prose(150).split()
    rows, labels = [], []

    def add(text, junk=False):
        i = len(rows)
        rows.append((i, text, "xx", rnd.choice(["a", "b", None, "hot", "hot"]), None if text is None else len(text)))
        if rnd.random() < 0.8:
            labels.append((i, 0 if junk else 1, 0))

    for _ in range(120):
        add(prose(rnd.randint(30, 200)))
    for _ in range(40):
        add(" ".join(word().upper() + "!!" for _ in range(rnd.randint(30, 150))), junk=True)
    for _ in range(10):
        add(prose(20) + " " + passage + " " + prose(20))
    for i in range(8):
        add(" ".join(near[:i] + [word()] + near[i + 1:]))
    for i in (0, 1, 0):
        add(rows[i][1])
    add("")
    add(None)
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Each stage's input and output, as the pipeline hands them on."""
    df, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    at = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, df, folder)
        made.write.parquet(f"{at}/{name}")
        out.append((df, spark.read.parquet(f"{at}/{name}")))
        df = out[-1][1]
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_of_all_but_the_last(stages):
    for df, made in stages[:-1]:
        assert made.dtypes == df.dtypes


def test_quality_keeps_what_the_classifier_accepts(spark, stages, folder):
    df, made = stages[0]
    x, model = quality_model(df, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id for r in quality_scores(x, model).collect() if r.predicted}
    assert {r.doc_id for r in made.collect()} == want
    junk = {i for i, t in _texts(df).items() if t and t.isupper()}
    assert not junk & want and len(want) >= 0.95 * (df.count() - len(junk))


def test_one_of_each_near_duplicate_group_stays(stages):
    df, made = stages[1]
    comp = components({i: shingles(t, 5) for i, t in _texts(df).items()}, 80)
    assert {r.doc_id for r in made.collect()} == {i for i, c in comp.items() if i == c}


def test_repeated_strings_go(stages):
    df, made = stages[2]
    want = {i: k.decode("utf-8", "ignore") for i, (n, gone, _, k) in repeated_bytes(list(_texts(df).items()), 200).items() if k or not gone}
    got = {r.doc_id: r for r in made.collect()}
    assert {i: r.text or "" for i, r in got.items()} == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.values())


def test_sources_meet_their_targets(stages):
    df, made = stages[3]
    size = lambda rows: {s: sum(n for t, n in v) for s, v in rows.items()}
    by = [defaultdict(list), defaultdict(list)]
    for part, rows in zip(by, (df.collect(), made.collect())):
        for r in rows:
            part[r.source].append((r.doc_id, len(WORD.findall(r.text or ""))))
    want = _mix_by_hand(size(by[0]))
    assert all(abs(size(by[1]).get(s, 0) - t) <= 1 for s, t in want.items())
    copies = Counter(r.doc_id for r in made.collect())
    assert max(copies.values()) <= 2


def test_pieces_cover_every_document_of_the_mix(stages):
    df, made = stages[4]
    tokens, seqs = defaultdict(int), defaultdict(list)
    total = defaultdict(set)
    for r in made.collect():
        tokens[r.doc_id] += r.length
        total[r.doc_id].add(r.doc_tokens)
        seqs[r.sequence_id].append((r.offset, r.length))
    copies = Counter(r.doc_id for r in df.collect())
    assert set(tokens) == set(copies)
    assert all(tokens[i] == sum(total[i]) * (copies[i] if len(total[i]) == 1 else 1) for i in copies if len(total[i]) == 1 or copies[i] == len(total[i]))
    for pieces in seqs.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]


def test_run_is_the_stages_in_order(spark, folder, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mix", "pack"]
    got, want = key(corpus_pipeline.run(spark, folder)), key(stages[-1][1])
    assert sum(n for _, _, n, _ in got) == sum(n for _, _, n, _ in want)


def test_near_duplicates_link_on_five_words_and_80_percent(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(9))
    texts = []
    for more in range(0, 40, 3):                      # 96 of 96 + more shingles: linked up to 24 words more
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(more)])]
    base = [word() for _ in range(100)]
    texts += [" ".join(base), " ".join(base + [word() for _ in range(20)])]
    spark.createDataFrame([(i, t, "xx", "a", len(t)) for i, t in enumerate(texts)], COLUMNS).write.parquet(f"{tmp_path}/d")
    comp = components({i: shingles(t, 5) for i, t in enumerate(texts)}, 80)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()}
    assert got == {i for i, c in comp.items() if i == c}
    assert len(texts) - 1 not in got


def test_repeats_keep_rows_together_when_the_splits_change(spark, tmp_path):
    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("aeinorst") for _ in range(6)) for _ in range(n))
    passage = prose(60)
    rows = [(i, None if i == 9 else f"{prose(30)} {passage if i % 4 == 0 else prose(60)} {prose(30)}", "xx", f"s{i}", 0) for i in range(48)]
    rows += [(100, passage, "xx", "s100", 0), (None, prose(50), "xx", "sNone", 0)]
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(f"{tmp_path}/d")
    parts = spark.conf.get("spark.sql.files.minPartitionNum", None)
    made = corpus_pipeline.repeats(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # as if executors had gone before the last scan
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
        if parts is not None:
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
    plain = repeated_bytes([(r[3], r[1]) for r in rows], 200)
    want = {s: (d, None if t is None else plain[s][3].decode()) for d, t, _, s, _ in rows if plain[s][3] or not plain[s][1]}
    assert {r.source: (r.doc_id, r.text) for r in got} == want and len(got) == len(want) == 49


def test_row_numbers_do_not_follow_the_splits(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (plain, plain.withColumn("doc_id", F.explode(F.array("doc_id", "doc_id")))):
        rows, named = corpus_pipeline.numbered(df)
        assert named.columns == ["row", "doc_id", "text"] and rows.columns == ["d", "row"]
        seen = [{r.row: (r.doc_id, r.text) for r in named.collect()}]
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            seen.append({r.row: (r.d[df.columns.index("doc_id")], r.d[df.columns.index("text")]) for r in rows.select("*").collect()})
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert seen[0] == seen[1] and len(seen[0]) == df.count()


def test_rows_are_judged_by_row_with_repeated_and_missing_ids(spark, folder, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    good = [" ".join(word() for _ in range(100)) for _ in range(5)]
    junk = [" ".join(word().upper() + "!!" for _ in range(100)) for _ in range(2)]
    more = [(9001, good[0]), (9001, good[0]), (None, good[1]), (None, good[2]), (None, good[2]), (9002, good[3]), (9002, junk[0]), (None, junk[1]), (9002, good[4])]
    spark.read.parquet(f"{folder}/documents.parquet").unionByName(
        spark.createDataFrame([(i, t, "xx", "new", len(t)) for i, t in more], COLUMNS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    new = lambda df: Counter((r.doc_id, r.text) for r in df.where("source = 'new'").collect())
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(new(df))
    assert seen[0] == Counter((i, t) for i, t in more if t not in junk)
    assert seen[1] == Counter({(i, t) for i, t in more if t not in junk})
    assert seen[2] == seen[1]


CLASHING = ["_row", "_file", "_first", "_at", "_size", "_taken", "_copy", "_words", "row", "d", "size", "key", "place", "carried"]


@pytest.fixture(scope="module")
def clashing(spark, folder):
    """The documents without ``n_chars`` under columns that the stages might use themselves."""
    df = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars", "lang")
    return df.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(CLASHING)])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]], ids=lambda f: f.__name__)
def test_any_column_names_travel_along(spark, folder, clashing, stage):
    made = stage(spark, clashing, folder)
    assert made.columns == clashing.columns
    rows = made.collect()
    assert rows and all(r[c] == f"{i}:{r.doc_id}" for r in rows for i, c in enumerate(CLASHING))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_empty_tables(spark, folder, stage):
    df = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    made = stage(spark, df, folder)
    assert made.count() == 0 and (stage is corpus_pipeline.pack or made.dtypes == df.dtypes)


def test_rows_without_ids_are_mixed_at_random(spark):
    """What the mix takes of rows that share a missing id does not depend on their length."""
    from redline.llm.mix_sources import mix_plan
    rows = [(None, " ".join(["w"] * (1 + i % 20)) + f" x{i}", "a" if i % 3 else "b") for i in range(900)]
    plan = mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source_size > 0").collect()
    cut = [r for r in plan if r.target < 2 * r.source_size]
    short, long = ([r.taken / r.size for r in cut if (r.size <= 11) == small] for small in (True, False))
    assert abs(np.mean(short) - np.mean(long)) < 0.15
