"""Vocabulary, split, count tagger and scoring on small hand-made corpora."""
from pyspark.sql import functions as F

from redline.operators import split, tagger, vocab
from redline.operators.align import diff_to_tags


def _tagged(spark, pairs):
    rows = [(i, o.split(), c.split()) for i, (o, c) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "pair_id long, orig_tokens array<string>, corr_tokens array<string>")
    return diff_to_tags(df)


def test_vocab_dense_sorted_with_base_tags(spark):
    t = _tagged(spark, [("a x c", "a b c"), ("teh cat", "the cat"), ("a b", "a b")])
    v = vocab.build_tag_vocab(t).orderBy("tag_id").collect()
    tags = [r.tag for r in v]
    assert tags == sorted(tags) and [r.tag_id for r in v] == list(range(len(v)))
    assert {"KEEP", "DELETE", "REPLACE_b", "REPLACE_the"} <= set(tags)


def test_encode_unknown_tag_is_keep(spark):
    t = _tagged(spark, [("a x", "a b")])
    v = vocab.build_tag_vocab(t)
    ids = vocab.vocab_ids(v)
    df = spark.createDataFrame([("REPLACE_zzz",), ("DELETE",), ("REPLACE_b",)], "tag string")
    got = {r.tag: r.tag_id for r in vocab.encode_tags(df, v).collect()}
    assert got["REPLACE_zzz"] == ids["KEEP"] and got["DELETE"] == ids["DELETE"]
    assert got["REPLACE_b"] not in (ids["KEEP"], ids["DELETE"])


def test_split_sizes_and_complement(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "pair_id")
    tr, va = split.split_train_validation(df, 0.05, 42)
    assert va.count() == int(1003 * 0.05) and tr.count() == 1003 - int(1003 * 0.05)
    assert split.split_complement(df, va).count() == tr.count()
    # same rows as ordering by md5(seed|key) and taking the first k
    want = sorted(df.select("pair_id", F.md5(F.concat_ws("|", F.lit("42"), F.col("pair_id").cast("string")))
                            .alias("h")).collect(), key=lambda r: (r.h, r.pair_id))[:50]
    assert {r.pair_id for r in va.collect()} == {r.pair_id for r in want}
    assert split.with_split(df, None).where("split = 'validation'").count() == 0


def test_count_tagger_and_unseen_tokens(spark):
    t = _tagged(spark, [("teh cat", "the cat"), ("teh dog", "the dog"), ("teh cow", "the cow"),
                        ("a teh", "a teh")])
    v = vocab.build_tag_vocab(t)
    m = tagger.fit_count_tagger(t, v)
    d = {r.token: r.dist for r in m.collect()}
    # 'teh': 3x REPLACE_the, 1x KEEP (+1 pseudo-count) over N + 1 = 5
    assert d["teh"][0].tag == "REPLACE_the" and abs(d["teh"][0].prob - 0.6) < 1e-12
    assert abs(sum(e.prob for e in d["teh"]) - 1.0) < 1e-12
    s = spark.createDataFrame([(1, "teh unseenword cat"), (2, "   ")], "line_no long, sentence string")
    out = {r.line_no: r.corrected for r in tagger.correct_batch(s, m, v).collect()}
    # unseen tokens must stay (regression: default lost across the outer join)
    assert out == {1: "the unseenword cat", 2: ""}
    verbose = tagger.correct_verbose(s, m, v, default_k=2).where("line_no = 1").collect()[0]
    assert verbose.corrections_made is True
    assert [x.pred_tag for x in verbose.token_details] == ["REPLACE_the", "KEEP", "KEEP"]
    assert len(verbose.token_details[0].top) == 2


def test_full_distribution_and_metric_hook(spark):
    from redline.operators import metrics
    t = _tagged(spark, [("teh cat", "the cat"), ("teh dog", "the dog"), ("a teh", "a teh")])
    v = vocab.build_tag_vocab(t)
    m = tagger.fit_count_tagger(t, v)
    s = spark.createDataFrame([(1, "teh")], "line_no long, sentence string")
    full = tagger.correct_verbose(s, m, v, default_k=None).collect()[0].token_details[0]
    assert set(full.top_probs) == {"KEEP", "REPLACE_the"}
    assert abs(sum(full.top_probs.values()) - 1.0) < 1e-12
    hook = lambda p, l: [F.count_if(l == p).alias("hits")]
    r = metrics.evaluate_tagger(t, m, v, metric_fns=[hook]).collect()[0]
    assert r.hits == r.n_correct


def test_user_metrics_see_every_position_but_join_counts(spark, monkeypatch):
    from redline.operators import metrics
    t = _tagged(spark, [("teh cat " * 1100, "the cat " * 1100), ("teh", "teh")])
    v = vocab.build_tag_vocab(t)
    model = tagger.fit_count_tagger(t, v)
    joined, plain = [], metrics.score_tokens
    monkeypatch.setattr(metrics, "score_tokens", lambda df, *a: joined.append(df.count()) or plain(df, *a))
    fn = lambda pred, label: [F.count("*").alias("rows"), F.count_if(pred == label).alias("hits")]
    r = metrics.evaluate_tagger(t, model, v, metric_fns=(fn,)).first()
    alone = metrics.evaluate_tagger(t, model, v).first()
    assert r.rows == r.n_positions == 2201 and r.hits == r.n_correct == alone.n_correct
    assert (alone.n_positions, round(alone.cross_entropy, 9)) == (2201, round(r.cross_entropy, 9))
    assert joined == [3, 3]                           # (teh, REPLACE_the), (teh, KEEP), (cat, KEEP)


def test_counts_in_batches_are_those_of_the_rows(spark, monkeypatch):
    """zipped lists of any lengths, missing words and tags among them."""
    from pyspark.sql import functions as F

    from redline.operators import tagger, vocab
    rows = [(1, ["a", None, "b", "a"], ["KEEP", "KEEP", None, "DELETE"]), (2, ["a", "b"], ["DELETE"]), (3, None, ["KEEP"]), (4, ["a"], None), (5, [], []),
            (6, ["c"], ["KEEP", "REPLACE_x"]), (7, ["c", "c"], ["KEEP", "KEEP"]), (8, ["d"], ["REPLACE_gone"])]
    df = spark.createDataFrame(rows, "pair_id long, orig_tokens array<string>, tags array<string>").coalesce(1)
    v = vocab.build_tag_vocab(df.where("pair_id < 8 and tags is not null").withColumn("tags", F.array_compact("tags")))
    z = F.arrays_zip(F.col("orig_tokens").alias("token"), F.col("tags").alias("tag"))
    want = vocab.encode_tags(df.select(F.inline(z)).groupBy("token", "tag").agg(F.count(F.lit(1)).alias("n")), v)
    same = lambda d: sorted(map(repr, d.select("token", "tag", "n", "tag_id").collect()))
    for most in (1, 1 << 20):
        monkeypatch.setattr(tagger, "COUNTED", most)
        assert same(tagger.tag_counts(df, v)) == same(want)
    model = {r.token: (r.n_total, [(e.tag, round(e.prob, 6)) for e in r.dist]) for r in tagger.fit_count_tagger(df, v).collect()}
    assert model["c"] == (3, [("KEEP", 1.0)]) and model["a"][0] == 3 and [t for t, _ in model["a"][1]] == ["DELETE", "KEEP"]
    plan = df.sparkSession.createDataFrame([(1, "c a")], "line_no int, sentence string")
    every = {(r.token, r.tag): round(r.prob, 6) for r in tagger.full_distribution(plan, tagger.fit_count_tagger(df, v), v).collect()}
    assert len(every) == 2 * v.count() and every["c", "KEEP"] == 1.0 and every["a", "DELETE"] == every["a", "KEEP"] == 0.5 and every["c", "DELETE"] == 0


def test_tokens_that_are_only_kept_are_not_collected(spark, monkeypatch):
    """the rows that are brought together by token are those of tokens with some other tag."""
    from redline.operators import tagger, vocab
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["KEEP", "DELETE", "KEEP"])], "pair_id long, orig_tokens array<string>, tags array<string>")
    written, write = {}, tagger.materialize
    monkeypatch.setattr(tagger, "materialize", lambda d, name: written.setdefault(name, write(d, name)))
    tagger.fit_count_tagger(df, vocab.build_tag_vocab(df))
    assert [r[0] for r in written["mixed_tokens"].collect()] == ["b"] and written["count_tagger"].count() == 3
