"""Registered queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each reads the given tables (or data Spark derives from them) in full.  Output
columns are named and rounded exactly like the DuckDB twins in ``oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tags as TG
from ..operators import align, encode, metrics, pairs, split, tagger, vocab
from .corpus import build_corpus, build_dataset, count_tagger, fit_and_evaluate
from .fixtures import derived_pairs, requests_from_conversations

R = 6  # decimals kept on floating outputs
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def _dp(spark, sf):
    return derived_pairs(spark, sf)


def _kept(spark, sf):
    return pairs.minimal_edit_filter(pairs.drop_null_pairs(_dp(spark, sf)))


def _tagged(spark, sf):
    """Tagged F2 pairs."""
    return build_corpus(spark, sf).tagged.drop("split")


def q_derived_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _dp(spark, sf)


def q_drop_null_pairs(spark, sf):
    return pairs.drop_null_pairs(_dp(spark, sf))


def q_edit_ratio(spark, sf):
    df = pairs.with_edit_ratio(pairs.drop_null_pairs(_dp(spark, sf)))
    return df.select("pair_id", F.round("edit_ratio", R).alias("edit_ratio"))


def q_minimal_edit_filter(spark, sf):
    return _kept(spark, sf)


def q_tokenize(spark, sf):
    t = pairs.tokenize_pairs(_kept(spark, sf))
    o = t.select("pair_id", F.lit("original").alias("side"),
                 F.posexplode("orig_tokens").alias("pos", "token"))
    c = t.select("pair_id", F.lit("corrected").alias("side"),
                 F.posexplode("corr_tokens").alias("pos", "token"))
    return o.unionByName(c)


def q_diff_to_tags(spark, sf):
    return tagger.token_tags(_tagged(spark, sf))


def q_sql_edit_tags(spark, sf):
    """The alignment as SQL text over a table function."""
    from ..sqlfunctions import register
    register(spark)
    pairs_ = build_corpus(spark, sf).tagged
    return spark.sql("SELECT * FROM edit_tags(TABLE(SELECT pair_id, orig_tokens, corr_tokens FROM {pairs}))", pairs=pairs_)


def q_sql_apply_tags(spark, sf):
    """Tags aligned and applied by SQL functions."""
    from ..sqlfunctions import register
    register(spark)
    return spark.sql("""SELECT pair_id, apply_tags(orig_tokens, a.tags) AS applied_text
                        FROM (SELECT pair_id, orig_tokens, align_tokens(orig_tokens, corr_tokens) AS a FROM {pairs})""", pairs=build_corpus(spark, sf).tagged)


def q_gap_tags(spark, sf):
    g = align.gap_inserts(_tagged(spark, sf))
    return g.select("pair_id", "gap_pos", F.array_join("ins_tokens", " ").alias("ins_text"))


def q_diff_roundtrip(spark, sf):
    t = _tagged(spark, sf)
    rebuilt = TG.rebuild_from_tags("orig_tokens", "tags", "gap_tags")
    return t.select("pair_id",
                    (F.size("tags") == F.size("orig_tokens")).alias("length_ok"),
                    (rebuilt == F.col("corr_tokens")).alias("roundtrip_ok"))


def q_apply_tags(spark, sf):
    t = _tagged(spark, sf)
    return t.select("pair_id", TG.apply_tags("orig_tokens", "tags").alias("applied_text"))


def q_build_tag_vocab(spark, sf):
    return build_corpus(spark, sf).vocab


def q_tag_parts(spark, sf):
    v = build_corpus(spark, sf).vocab
    return v.select("tag", TG.tag_op("tag").alias("tag_op"), TG.strip_prefix("tag").alias("arg"),
                    TG.is_replace("tag").alias("is_replace"), TG.is_insert("tag").alias("is_insert"))


def q_encode_tags(spark, sf):
    c = build_corpus(spark, sf)
    long = tagger.token_tags(c.tagged)
    return vocab.encode_tags(long, c.vocab).select("pair_id", "pos", "tag_id")


def q_decode_tags(spark, sf):
    c = build_corpus(spark, sf)
    enc = vocab.encode_tags(tagger.token_tags(c.tagged), c.vocab).select("pair_id", "pos", "tag_id")
    return vocab.decode_tags(enc, c.vocab).select("pair_id", "pos", "tag")


def q_split_train_validation(spark, sf):
    return build_corpus(spark, sf).tagged.select("pair_id", "split")


def q_split_complement(spark, sf):
    c = build_corpus(spark, sf)
    return split.split_complement(c.tagged.select("pair_id"), c.split("validation")).select("pair_id")


def q_subword_explode(spark, sf):
    long = tagger.token_tags(_tagged(spark, sf))
    st = encode.subword_table(long)
    return st.select("pair_id", "word_id", "piece_no", "piece", encode.piece_id("piece").alias("piece_id"))


def q_first_subtoken(spark, sf):
    long = tagger.token_tags(_tagged(spark, sf))
    st = encode.subword_table(long)
    # 1-based sub-token position after <s>: ordered by (word, piece)
    st = st.withColumn("sub_key", F.struct("word_id", "piece_no"))
    flagged = encode.is_first_subtoken(st, "pair_id", "sub_key")
    return flagged.select("pair_id", "word_id", "piece_no", "is_first")


def q_encode_examples(spark, sf):
    c = build_corpus(spark, sf)
    e = encode.encode_examples(c.tagged, c.vocab)
    j = lambda col: F.array_join(F.col(col).cast("array<string>"), " ")
    return e.select("pair_id", j("input_ids").alias("input_ids"),
                    j("attention_mask").alias("attention_mask"), j("labels").alias("labels"))


def q_fit_count_tagger(spark, sf):
    c = build_corpus(spark, sf)
    m = count_tagger(c)
    e = m.select("token", "n_total", F.posexplode("dist").alias("rk", "d"))
    return e.select("token", "n_total", (F.col("rk") + 1).alias("rk"), "d.tag_id", "d.tag",
                    F.round("d.prob", R).alias("prob"), F.round("d.logit", R).alias("logit"))


def _validation_sentences(c):
    return c.split("validation").select(
        "pair_id", F.array_join("orig_tokens", " ").alias("sentence"))


def q_correct_batch(spark, sf):
    c = build_corpus(spark, sf)
    m = count_tagger(c)
    return tagger.correct_batch(_validation_sentences(c), m, c.vocab, key="pair_id")


def q_correct_verbose(spark, sf):
    c = build_corpus(spark, sf)
    m = count_tagger(c)
    v = tagger.correct_verbose(_validation_sentences(c), m, c.vocab, key="pair_id")
    d = v.select("pair_id", "corrected", "corrections_made",
                 F.posexplode("token_details").alias("pos", "t"))
    top = F.array_join(F.transform("t.top", lambda e: F.concat(
        e["tag"], F.lit("="), F.round(e["prob"] * 1000000).cast("long").cast("string"))), " ")
    return d.select("pair_id", "pos", "t.token", "t.pred_tag", top.alias("top3"),
                    "corrected", "corrections_made")


def q_token_accuracy(spark, sf):
    r = fit_and_evaluate(spark, sf)
    return r.select("n_correct", "n_positions", F.round("token_accuracy", R).alias("token_accuracy"),
                    F.round("cross_entropy", R).alias("cross_entropy"))


def q_context_accuracy(spark, sf):
    from ..operators.context import evaluate_in_context, fit_context_tagger
    c = build_corpus(spark, sf)
    r = evaluate_in_context(c.split("validation"), fit_context_tagger(c.split("train"), c.vocab), c.vocab)
    return r.select("n_positions", "n_correct", "n_correct_alone", *[F.round(x, R).alias(x) for x in ("token_accuracy", "token_accuracy_alone", "cross_entropy")])


def q_correct_in_context(spark, sf):
    from ..operators.context import correct_in_context, fit_context_tagger
    c = build_corpus(spark, sf)
    return correct_in_context(_validation_sentences(c), fit_context_tagger(c.split("train"), c.vocab), c.vocab, key="pair_id")


def q_sentence_metrics(spark, sf):
    c = build_corpus(spark, sf)
    m = count_tagger(c)
    val = c.split("validation").select("pair_id", F.array_join("orig_tokens", " ").alias("sentence"),
                                       F.array_join("corr_tokens", " ").alias("reference"))
    pred = tagger.correct_batch(val.select("pair_id", "sentence"), m, c.vocab, key="pair_id")
    j = pred.join(val.select("pair_id", "reference"), "pair_id").withColumnRenamed("corrected", "prediction")
    out = metrics.sentence_metrics(j)
    return out.select(*[F.round(x, R).alias(x) for x in ("cer", "gen_len", "sentence_accuracy")], "n_sentences")


def q_corpus_stats(spark, sf):
    return build_corpus(spark, sf).stats()


def q_softmax(spark, sf):
    m = count_tagger(build_corpus(spark, sf))
    p = m.select("token", tagger.softmax(F.transform("dist", lambda e: e["logit"])).alias("p"))
    return p.select("token", F.posexplode("p").alias("rk", "p")).select("token", (F.col("rk") + 1).alias("rk"), F.round("p", 12).alias("p"))


def q_full_distribution(spark, sf):
    c = build_corpus(spark, sf)
    d = tagger.full_distribution(_validation_sentences(c), count_tagger(c), c.vocab, key="pair_id")
    return d.groupBy("pair_id", "pos").agg(F.count("*").alias("n_tags"), F.count_if(F.col("prob") > 0).alias("n_seen"),
                                           F.round(F.sum("prob"), R).alias("total"), F.round(F.max("prob"), R).alias("best"))


QUERIES = {
    "derived_pairs": q_derived_pairs,
    "drop_null_pairs": q_drop_null_pairs,
    "edit_ratio": q_edit_ratio,
    "minimal_edit_filter": q_minimal_edit_filter,
    "tokenize": q_tokenize,
    "diff_to_tags": q_diff_to_tags,
    "sql_edit_tags": q_sql_edit_tags,
    "sql_apply_tags": q_sql_apply_tags,
    "gap_tags": q_gap_tags,
    "diff_roundtrip": q_diff_roundtrip,
    "apply_tags": q_apply_tags,
    "build_tag_vocab": q_build_tag_vocab,
    "tag_parts": q_tag_parts,
    "encode_tags": q_encode_tags,
    "decode_tags": q_decode_tags,
    "split_train_validation": q_split_train_validation,
    "split_complement": q_split_complement,
    "subword_explode": q_subword_explode,
    "first_subtoken": q_first_subtoken,
    "encode_examples": q_encode_examples,
    "fit_count_tagger": q_fit_count_tagger,
    "correct_batch": q_correct_batch,
    "correct_verbose": q_correct_verbose,
    "token_accuracy": q_token_accuracy,
    "context_accuracy": q_context_accuracy,
    "correct_in_context": q_correct_in_context,
    "sentence_metrics": q_sentence_metrics,
    "corpus_stats": q_corpus_stats,
    "softmax": q_softmax,
    "full_distribution": q_full_distribution,
}



# ---------------------------------------------------------------------------
# Requests, responses, stream
# ---------------------------------------------------------------------------

def _conversations(spark, sf):
    return spark.read.schema(CONVERSATIONS).parquet(f"{sf}/conversations.parquet")


def _kind(t):
    from ..operators.requests import NUMERIC_PREFIXES
    num = F.lit(False)
    for p in NUMERIC_PREFIXES:
        num = num | t.startswith(p)
    return (F.when(t == "MISSING", "missing").when(t == "STRING", "string").when(t == "VOID", "null")
             .when(num, "number").otherwise("other"))


def q_parse_requests(spark, sf):
    from ..operators.requests import parse_requests
    p = parse_requests(requests_from_conversations(_conversations(spark, sf)))
    return p.select("conv_id", "turn", "sentence", "top_k", _kind(F.col("sentence_type")).alias("sentence_kind"))


def q_route_requests(spark, sf):
    from ..operators.requests import parse_requests, route_requests
    r = route_requests(parse_requests(requests_from_conversations(_conversations(spark, sf))))
    return r.select("conv_id", "turn", "status", "error", "message")


def q_unavailable_responses(spark, sf):
    """Every request while no model is loaded."""
    from ..streaming.correct_stream import respond
    return respond(requests_from_conversations(_conversations(spark, sf)), None, None).select("conv_id", "turn", "status", "error")


def _details_text(col="token_details"):
    return F.array_join(F.transform(col, lambda d: F.concat_ws(
        "|", d["token"], d["pred_tag"],
        F.array_join(F.transform(d["top"], lambda e: F.concat(
            e["tag"], F.lit("="), F.round(e["prob"] * 1000000).cast("long").cast("string"))), ","))), " ; ")


def _response_cols(df):
    return df.select("conv_id", "turn", "status", "error", "message", "original_sentence",
                     "corrected_sentence", "corrections_made", "model_name",
                     _details_text().alias("details"))


def q_check_typos(spark, sf):
    from ..streaming.correct_stream import respond
    c = build_corpus(spark, sf)
    return _response_cols(respond(requests_from_conversations(_conversations(spark, sf)), count_tagger(c), c.vocab))


def _stream(spark, sf, c):
    from ..streaming.correct_stream import run_correct_stream
    return run_correct_stream(spark, f"{sf}/conversations*.parquet", count_tagger(c), c.vocab, schema=CONVERSATIONS,
                              keys=("conv_id", "turn"), to_requests=requests_from_conversations, file_format="parquet")


def q_correct_stream(spark, sf):
    c = build_corpus(spark, sf)
    responses, _ = _stream(spark, sf, c)
    return _response_cols(responses)


def q_stream_latency(spark, sf):
    from ..streaming.correct_stream import with_latency
    c = build_corpus(spark, sf)
    responses, latency = _stream(spark, sf, c)
    r = with_latency(responses, latency)
    # no row of a scored or empty request may lack its time
    return r.agg(F.count("*").alias("n_requests"), F.count_if((F.col("status") == 200) & F.col("processing_time_ms").isNull()).alias("n_untimed"))


def q_latency_summary(spark, sf):
    """Times differ from run to run: the row holds their count and that the quantiles lie in order inside the range."""
    from ..streaming.correct_stream import latency_summary, with_latency
    c = build_corpus(spark, sf)
    s = latency_summary(with_latency(*_stream(spark, sf, c)))
    inside = (F.col("fastest") > 0) & (F.col("fastest") <= F.col("p50")) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("slowest"))
    return s.select("n_scored", inside.alias("in_order"))


def q_response_json(spark, sf):
    from ..operators.requests import response_json
    from ..streaming.correct_stream import respond
    c = build_corpus(spark, sf)
    r = respond(requests_from_conversations(_conversations(spark, sf)), count_tagger(c), c.vocab)
    j = response_json(r).select("conv_id", "turn", "status", F.from_json("json", "original_sentence string, corrected_sentence string, "
                                "token_details array<struct<token:string,pred_tag:string,top_probs:map<string,double>>>, model_name string, "
                                "processing_time_ms double, corrections_made boolean, message string, error string").alias("j"),
                                F.size(F.json_object_keys("json")).alias("n_fields"))
    return j.select("conv_id", "turn", "n_fields", "j.error", "j.original_sentence", "j.corrected_sentence", "j.message", "j.model_name",
                    "j.corrections_made", F.array_join(F.transform("j.token_details", lambda d: F.concat_ws("|", d["token"], d["pred_tag"])), " ; ").alias("details"))


def q_render_token_table(spark, sf):
    from ..streaming.correct_stream import respond
    c = build_corpus(spark, sf)
    r = respond(requests_from_conversations(_conversations(spark, sf)), count_tagger(c), c.vocab)
    r = r.where(F.col("message") == "Typos checked successfully.")
    e = r.select("conv_id", "turn", F.posexplode("token_details").alias("i", "d"))
    pct = lambda e_: F.concat(e_["tag"], F.lit(": "), (F.round(e_["prob"] * 1000).cast("long") / 10)
                              .cast("long").cast("string"), F.lit("."),
                              (F.round(e_["prob"] * 1000).cast("long") % 10).cast("string"), F.lit("%"))
    return e.select("conv_id", "turn", (F.col("i") + 1).alias("row_no"), F.col("d.token").alias("token"),
                    F.col("d.pred_tag").alias("pred_tag"),
                    F.array_join(F.transform("d.top", pct), " | ").alias("top_probs"))


QUERIES.update({
    "parse_requests": q_parse_requests,
    "route_requests": q_route_requests,
    "unavailable_responses": q_unavailable_responses,
    "check_typos": q_check_typos,
    "correct_stream": q_correct_stream,
    "stream_latency": q_stream_latency,
    "latency_summary": q_latency_summary,
    "response_json": q_response_json,
    "render_token_table": q_render_token_table,
})


# ---------------------------------------------------------------------------
# Term lists (S5, F3, P20, A2, K5) and source/sink round trips
# ---------------------------------------------------------------------------

def _term_lines(spark, sf):
    from ..operators.terms import term_lines_from_parts
    return term_lines_from_parts(spark.read.parquet(f"{sf}/part.parquet"))


def q_term_dictionary(spark, sf):
    from ..operators.terms import merge_term_counts, parse_term_lines
    return merge_term_counts(parse_term_lines(_term_lines(spark, sf)))


def q_term_list_roundtrip(spark, sf):
    from ..operators.terms import merge_term_counts, parse_term_lines
    from ..session import scratch_path
    from ..sources import io
    src, dst = scratch_path(spark, "terms_in"), scratch_path(spark, "terms_out")
    io.write_sentences(_term_lines(spark, sf), src, col="line", order="line_no")
    d = merge_term_counts(parse_term_lines(io.read_term_list(spark, src)))
    io.write_term_dict(d, dst)
    return io.read_term_dict(spark, dst)


def q_pairs_csv_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "pairs_csv")
    io.write_pairs_csv(_dp(spark, sf), path)
    df = io.read_pairs_csv(spark, path)
    return df.select(F.col("pair_id").cast("long").alias("pair_id"), "original_text", "corrected_text")


def q_vocab_json_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "tag2id")
    io.write_tag_vocab(build_corpus(spark, sf).vocab, path)
    return io.read_tag_vocab(spark, path)


def q_encoded_roundtrip(spark, sf):
    from ..session import scratch_path
    c = build_corpus(spark, sf)
    path = scratch_path(spark, "encoded")
    encode.write_encoded(c.encoded(), path)
    back = encode.read_encoded(spark, path)
    j = lambda col: F.array_join(F.col(col).cast("array<string>"), " ")
    return back.select("pair_id", "split", j("input_ids").alias("input_ids"), j("attention_mask").alias("attention_mask"), j("labels").alias("labels"))


def _benchmark_lines(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return b.select("item_id", F.posexplode(F.split("text", "\n")).alias("ln", "sentence"))


def q_sentences_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    c = build_corpus(spark, sf)
    src, dst = scratch_path(spark, "sentences"), scratch_path(spark, "corrected")
    lines = _benchmark_lines(spark, sf)
    io.write_sentences(lines, src, order=["item_id", "ln"])
    s = io.read_sentences(spark, src)
    out = tagger.correct_batch(s, count_tagger(c), c.vocab, key="line_id")
    io.write_corrected(out, dst)
    # line numbers of what was written (a report of a few hundred lines)
    back = io.read_sentences(spark, dst)
    return back.select(F.row_number().over(Window.orderBy("line_id")).alias("line_no"), F.col("sentence").alias("corrected"))


def q_verbose_jsonl_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    c = build_corpus(spark, sf)
    path = scratch_path(spark, "verbose")
    s = _benchmark_lines(spark, sf).select(F.struct("item_id", "ln").alias("k"), "sentence")
    v = tagger.correct_verbose(s, count_tagger(c), c.vocab, key="k", default_k=5)
    io.write_verbose_jsonl(v, path)
    back = io.read_verbose_jsonl(spark, path)
    # maps have no order: entries by probability, then tag
    probs = lambda m: F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(
        (-F.round(e["value"] * 1000000).cast("long")).alias("p"), e["key"].alias("k")))), lambda e: F.concat(e["k"], F.lit("="), (-e["p"]).cast("string"))), ",")
    t = F.array_join(F.transform("tokens", lambda d: F.concat_ws("|", d["token"], d["tag"], probs(d["probs"]))), " ; ")
    return back.select("original", "corrected", t.alias("tokens"))


def q_dataset_from_csv(spark, sf):
    """Pairs written as CSV, read back, built into a dataset, fitted and evaluated."""
    from ..session import scratch_path
    from ..sources import io
    path = scratch_path(spark, "pairs_csv")
    io.write_pairs_csv(_dp(spark, sf), path)
    p = io.read_pairs_csv(spark, path).withColumn("pair_id", F.col("pair_id").cast("long"))
    c = build_dataset(p)
    r = metrics.evaluate_tagger(c.split("validation"), count_tagger(c), c.vocab)
    return r.select("n_correct", "n_positions", F.round("token_accuracy", R).alias("token_accuracy"),
                    F.round("cross_entropy", R).alias("cross_entropy"))


def q_user_metrics(spark, sf):
    """Metrics of the caller's own beside the built-in ones (U3): recall of changed tokens, and how often a change is proposed."""
    c = build_corpus(spark, sf)
    keep = vocab.vocab_ids(c.vocab)[TG.KEEP]
    changed = lambda pred, label: [F.count_if((label != keep) & (pred == label)).alias("n_recalled"), F.count_if(label != keep).alias("n_changed")]
    proposed = lambda pred, label: [F.count_if(pred != keep).alias("n_proposed")]
    r = metrics.evaluate_tagger(c.split("validation"), count_tagger(c), c.vocab, metric_fns=(changed, proposed))
    return r.select("n_correct", "n_positions", "n_recalled", "n_changed", "n_proposed")


def q_model_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import io
    c = build_corpus(spark, sf)
    path = scratch_path(spark, "model")
    io.save_model(count_tagger(c), c.vocab, path)
    m, v = io.load_model(spark, path)
    r = metrics.evaluate_tagger(c.split("validation"), m, v)
    return r.select("n_correct", "n_positions", F.round("token_accuracy", R).alias("token_accuracy"),
                    F.round("cross_entropy", R).alias("cross_entropy"))


QUERIES.update({
    "term_dictionary": q_term_dictionary,
    "term_list_roundtrip": q_term_list_roundtrip,
    "pairs_csv_roundtrip": q_pairs_csv_roundtrip,
    "vocab_json_roundtrip": q_vocab_json_roundtrip,
    "encoded_roundtrip": q_encoded_roundtrip,
    "sentences_roundtrip": q_sentences_roundtrip,
    "verbose_jsonl_roundtrip": q_verbose_jsonl_roundtrip,
    "model_roundtrip": q_model_roundtrip,
    "user_metrics": q_user_metrics,
    "dataset_from_csv": q_dataset_from_csv,
})


# ---------------------------------------------------------------------------
# Sequence metrics on the validation corrections
# ---------------------------------------------------------------------------

def _pred_ref(spark, sf):
    c = build_corpus(spark, sf)
    val = c.split("validation").select("pair_id", F.array_join("orig_tokens", " ").alias("sentence"),
                                       F.array_join("corr_tokens", " ").alias("reference"))
    pred = tagger.correct_batch(val.select("pair_id", "sentence"), count_tagger(c), c.vocab,
                                key="pair_id")
    return pred.join(val.select("pair_id", "reference"), "pair_id").withColumnRenamed("corrected", "prediction")


def q_word_error_rate(spark, sf):
    from ..operators.textmetrics import word_error_rate
    return word_error_rate(_pred_ref(spark, sf)).select(F.round("wer", R).alias("wer"))


def q_corpus_bleu(spark, sf):
    from ..operators.textmetrics import corpus_bleu
    b = corpus_bleu(_pred_ref(spark, sf))
    return b.select(F.round("bleu", R).alias("bleu"), "pred_len", "ref_len")


def q_rouge_n(spark, sf):
    from ..operators.textmetrics import rouge_n
    r = rouge_n(_pred_ref(spark, sf))
    return r.select(F.round("rouge1", R).alias("rouge1"), F.round("rouge2", R).alias("rouge2"))


def q_rouge_l(spark, sf):
    from ..operators.textmetrics import rouge_l
    r = rouge_l(_pred_ref(spark, sf))
    return r.select(F.round("rougeL", R).alias("rougeL"))


def q_rouge_lsum(spark, sf):
    """Texts of several lines: the validation lines of ten neighbouring documents."""
    from ..operators.textmetrics import rouge_lsum
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", c))), lambda x: x[c]), "\n").alias(c)
    texts = _pred_ref(spark, sf).groupBy(F.expr("pair_id div 1000000").alias("part")).agg(text("prediction"), text("reference"))
    return rouge_lsum(texts).select(F.round("rougeLsum", R).alias("rougeLsum"))


QUERIES.update({
    "rouge_lsum": q_rouge_lsum,
    "word_error_rate": q_word_error_rate,
    "corpus_bleu": q_corpus_bleu,
    "rouge_n": q_rouge_n,
    "rouge_l": q_rouge_l,
})


# ---------------------------------------------------------------------------
# Model plug-ins (M2, M6, U2) with A3/A4 on their outputs
# ---------------------------------------------------------------------------

def q_external_scorer_eval(spark, sf):
    from ..operators import external
    from ..functions.tags import KEEP
    c = build_corpus(spark, sf)
    num_tags = c.vocab.count()
    keep_id = vocab.vocab_ids(c.vocab)[KEEP]
    enc = encode.encode_examples(c.split("validation"), c.vocab)
    scored = external.external_model_scorer(enc, external.keep_baseline_model(num_tags, keep_id), num_tags)
    r = external.external_eval(external.score_positions(scored))
    return r.select("n_positions", "n_correct", F.round("token_accuracy", R).alias("token_accuracy"),
                    F.round("cross_entropy", R).alias("cross_entropy"))


def q_fit_linear_tagger(spark, sf):
    from ..operators import external
    from ..session import scratch_path
    c = build_corpus(spark, sf)

    labelled = lambda w: vocab.encode_tags(w, c.vocab, "tag", "label")
    model = external.fit_linear_tagger(labelled(external.context_buckets(c.split("train"))))
    path = scratch_path(spark, "linear_tagger")
    external.save_pipeline(model, path)           # K6 round trip
    model = external.load_pipeline(path)
    pred = model.transform(labelled(external.context_features(c.split("validation"))))
    hit = F.col("prediction").cast("int") == F.col("label")
    keep = vocab.vocab_ids(c.vocab)["KEEP"]
    # against always keeping the token
    return pred.agg(F.count(F.lit(1)).alias("n_positions"), (F.count_if(hit) >= F.count_if(F.col("label") == keep)).alias("beats_keep"))


def q_softmax_tagger(spark, sf):
    """The two-level softmax head beside the count tagger, on the validation split."""
    from ..operators import softmax_head
    c = build_corpus(spark, sf)
    train, held = c.split("train"), c.split("validation")
    tagger = softmax_head.fit_softmax_tagger(train, held)
    rows = softmax_head.examples(softmax_head.context_counts(held), tagger.candidates)
    alone = metrics.evaluate_tagger(held, count_tagger(c), c.vocab).select(F.col("n_correct").alias("n_correct_alone"))
    r = softmax_head.evaluate_softmax(rows, tagger).crossJoin(alone)          # one row each
    return r.select("n_positions", "n_correct_alone", (F.col("n_correct") >= F.col("n_correct_alone")).alias("reaches_count_tagger"))


def q_softmax_history(spark, sf):
    """One row an epoch of a published run that stopped after its third epoch and was started again."""
    from ..operators import softmax_head
    from ..session import scratch_path
    c, path = build_corpus(spark, sf), scratch_path(spark, "softmax_run")
    train, held = c.split("train"), c.split("validation")
    prepared = softmax_head.prepare(train, held)                          # both runs read the same counted contexts
    softmax_head.fit_softmax_tagger(train, held, epochs=3, path=path, prepared=prepared)
    history = softmax_head.fit_softmax_tagger(train, held, epochs=4, path=path, prepared=prepared).history
    rows = [(h["epoch"], i == 0 or h["loss"] < history[i - 1]["loss"], h["accuracy"] is not None) for i, h in enumerate(history)]
    return spark.createDataFrame(rows, "epoch int, loss_fell boolean, evaluated boolean")


QUERIES.update({
    "softmax_tagger": q_softmax_tagger,
    "softmax_history": q_softmax_history,
    "external_scorer_eval": q_external_scorer_eval,
    "fit_linear_tagger": q_fit_linear_tagger,
})
