"""Registered queries of the training-data operators and their SQL twins.

Each applies one operator with its production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES  # noqa: F401 - read by the entry module

#: Query rows of the top-k search are those whose id this divides.
QUERY_STEP = 50
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _remainder(col: str, parts: int):
    """CRC-32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % parts


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chat_collapse(spark, sf):
    from .chat_collapse import chat_documents
    return chat_documents(_table(spark, sf, "conversations"))


def quality_model(documents: DataFrame, labels: DataFrame, row: str = "doc_id"):
    """``(features, model)``: fitted on the labels of the training rows; features go by the column ``row``, a number."""
    from .quality_qda import fit_quality, text_features
    x = text_features(documents, doc_id=row)
    seen = labels.where(_remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    if row != "doc_id":
        seen = documents.select("doc_id", row).join(seen, "doc_id").select(F.col(row).alias("doc_id"), "label")
    return x, fit_quality(x, seen)


def op2_quality_qda(spark, sf):
    from .quality_qda import quality_scores
    x, model = quality_model(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    s = quality_scores(x, model)
    return s.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_suffix_dedup(spark, sf):
    from .suffix_dedup import suffix_dedup
    return suffix_dedup(_table(spark, sf, "documents"))


def op4_toxicity_pu(spark, sf):
    from .toxicity_pu import fit_toxicity, toxicity_scores
    docs = _table(spark, sf, "documents")
    labels = _table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, labels, training=_remainder("doc_id", 5) != 0)
    s = toxicity_scores(docs, model)
    return s.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_pack_ffd(spark, sf):
    from .pack_ffd import pack_documents
    p = pack_documents(_table(spark, sf, "documents"), tokenizer_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_host_reputation(spark, sf):
    """Outcomes: the labelled document of the page's id is good if of quality and not toxic."""
    from .host_reputation import url_verdicts
    good = _table(spark, sf, "labels").where("quality is not null or toxic is not null").select(
        F.col("doc_id").alias("page_id"), (F.coalesce(F.col("quality") == 1, F.lit(True)) & F.coalesce(F.col("toxic") != 1, F.lit(True))).cast("int").alias("good"))
    v = url_verdicts(_table(spark, sf, "pages"), good)
    return v.select("page_id", "host", "path", "rule", "verdict")


def op7_bsi_topk(spark, sf):
    from .bsi_topk import integer_vectors, top_k
    v = integer_vectors(_table(spark, sf, "embeddings"))
    return top_k(v.where(F.col("vec_id") % QUERY_STEP == 0), v)


def op8_ngram_join(spark, sf):
    from .ngram_join import ngram_join
    return ngram_join(_table(spark, sf, "documents"))


def op9_mix_sources(spark, sf):
    from .mix_sources import mix_plan
    return mix_plan(_table(spark, sf, "documents"))


def op10_quality_cascade(spark, sf):
    from .quality_cascade import quality_cascade
    return quality_cascade(_table(spark, sf, "documents")).drop("rejected_by")


def op11_hard_negatives(spark, sf):
    from .hard_negatives import labelled_vectors, mine_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = labelled_vectors(_table(spark, sf, "embeddings"), label)
    return mine_negatives(v.where(F.col("vec_id") % QUERY_STEP == 0), v)


def op12_language_id(spark, sf):
    from .language_id import fit_languages, predict_languages
    docs = _table(spark, sf, "documents")
    remainder = _remainder("doc_id", 3)
    p = predict_languages(docs, fit_languages(docs, training=remainder != 1))
    return p.select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score")


def op13_structure_repair(spark, sf):
    from .structure_repair import repaired_conversations
    return repaired_conversations(_table(spark, sf, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_chat_collapse, op2_quality_qda, op3_suffix_dedup, op4_toxicity_pu, op5_pack_ffd, op6_host_reputation,
    op7_bsi_topk, op8_ngram_join, op9_mix_sources, op10_quality_cascade, op11_hard_negatives,
    op12_language_id, op13_structure_repair)}
