"""Check-typos requests as DataFrames.

A request is a JSON body ``{"sentence": str, "top_k": int}``.  Parsing uses
the VARIANT type, which tells a missing field, a JSON null, a string and a
number apart.  Routing follows the service's order of checks:

0. no model loaded -> 503 ``Model unavailable.``, whatever the body;
1. body: malformed, or not a JSON object -> treated as ``{}``;
2. ``top_k`` (default 3): numbers truncate toward zero, integer strings
   parse, booleans are 1/0; anything else -> 400 ``top_k must be an integer``
   (the reference crashes there; this is a deliberate, documented deviation);
   numbers of any size are clamped later, so they saturate here;
3. ``sentence`` (default ``""``) present but not a string -> 400;
4. blank sentence -> 200, empty result, ``Input sentence was empty.``;
5. otherwise scored -> 200, ``Typos checked successfully.``

A request is a row: requests alike in every column (a redelivered body) get a
response each.  Everything is a per-row expression until scoring: one model join
and one regroup by request, with the routing fields carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, py_strip
from .joins import materialize
from .tagger import correct_verbose

# Fixed values of the service contract.
DEFAULT_TOP_K = 3
MODEL_NAME = "redline-count-tagger"
MSG_OK = "Typos checked successfully."
MSG_EMPTY = "Input sentence was empty."
ERR_SENTENCE = "'sentence' must be a string"
ERR_TOP_K = "top_k must be an integer"
ERR_MODEL = "Model unavailable."
#: A number this large or larger means all tags.
TOP_K_LIMIT = 1 << 31

NUMERIC_PREFIXES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")

def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``sentence_type``, ``sentence``, ``top_k``, ``top_k_ok`` (S3)."""
    v = F.try_parse_json(F.col(body))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    obj = F.when(is_obj, v)
    sv = F.try_variant_get(obj, "$.sentence", "variant")
    stype = F.schema_of_variant(sv)
    tv = F.try_variant_get(obj, "$.top_k", "variant")
    ttype = F.schema_of_variant(tv)
    is_num = F.lit(False)
    for p in NUMERIC_PREFIXES:
        is_num = is_num | ttype.startswith(p)
    tstr = py_strip(F.try_variant_get(tv, "$", "string"))
    limit = F.lit(float(TOP_K_LIMIT))
    whole = lambda d: F.greatest(-limit, F.least(limit, d)).cast("long")
    digits = tstr.rlike(r"^[+-]?[0-9]+(_[0-9]+)*\z")
    top_k = (F.when(tv.isNull(), F.lit(DEFAULT_TOP_K).cast("long"))
              .when(is_num, whole(F.try_variant_get(tv, "$", "double")))
              .when(ttype == "BOOLEAN", F.when(F.try_variant_get(tv, "$", "boolean"), 1).otherwise(0).cast("long"))
              .when((ttype == "STRING") & digits, whole(F.replace(tstr, F.lit("_"), F.lit("")).try_cast("double"))))
    return df.select(
        "*",
        F.when(sv.isNull(), F.lit("MISSING")).otherwise(stype).alias("sentence_type"),
        F.when(sv.isNull(), F.lit("")).when(stype == "STRING", F.try_variant_get(sv, "$", "string"))
        .alias("sentence"),
        top_k.alias("top_k"))


def route_requests(parsed: DataFrame, model_ready: bool = True) -> DataFrame:
    """Add ``status``, ``error``, ``message``, ``route``."""
    bad_k = F.col("top_k").isNull()
    bad_s = ~F.col("sentence_type").isin("STRING", "MISSING")
    blank = is_blank(F.col("sentence"))
    route = (F.when(F.lit(not model_ready), F.lit("no_model")).when(bad_k, F.lit("bad_top_k")).when(bad_s, F.lit("bad_sentence"))
              .when(blank, F.lit("empty")).otherwise(F.lit("score")))
    status = (F.when(route == "no_model", F.lit(503)).when(route.isin("bad_top_k", "bad_sentence"), F.lit(400))
               .otherwise(F.lit(200)))
    error = (F.when(route == "no_model", F.lit(ERR_MODEL)).when(route == "bad_top_k", F.lit(ERR_TOP_K))
              .when(route == "bad_sentence", F.lit(ERR_SENTENCE)))
    message = (F.when(route == "empty", F.lit(MSG_EMPTY))
                .when(route == "score", F.lit(MSG_OK)))
    return parsed.select("*", route.alias("route"), status.alias("status"), error.alias("error"),
                         message.alias("message"))


def check_typos(routed: DataFrame, model: DataFrame, vocab: DataFrame,
                keys=("conv_id", "turn"), num_tags: int | None = None, ids: dict | None = None) -> DataFrame:
    """Responses for routed requests (P16, P17): scored rows get the corrected
    sentence and token details; blank rows the empty result; errors only
    ``status`` and ``error``.  ``processing_time_ms`` is filled per micro-batch
    by the stream (T2); a per-row wall time has no meaning in a batch plan.

    ``keys`` are carried, not grouped by: every row is a request of its own.
    ``num_tags`` and ``ids`` save lookups on the vocabulary when given.
    """
    keys = list(keys)
    # written first, so that the row ids hold if a task runs again
    routed = materialize(routed.withColumn("_id", F.monotonically_increasing_id()), "requests")
    # Every request goes through one regroup: non-scored ones with an empty
    # text (no tokens, one row), their routing fields carried along -- no join
    # of requests back onto their scores.
    is_score_in = F.col("route") == "score"
    req = routed.select(
        "_id", F.struct("_id", *keys).alias("_key"),
        F.when(is_score_in, F.col("sentence")).otherwise(F.lit("")).alias("_s"),
        F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K).cast("long")).alias("_k"),
        F.struct("status", "error", "message", "route", "sentence").alias("_req"))
    scored = correct_verbose(req, model, vocab, key="_key", text="_s", top_k_col="_k",
                             pass_through="_req", num_tags=num_tags, ids=ids, row_id="_id")
    j = scored.select(*[F.col("_key." + k).alias(k) for k in keys],
                      "_req.status", "_req.error", "_req.message", "_req.route", "_req.sentence",
                      F.col("corrected").alias("_corrected"),
                      F.col("token_details").alias("_details"),
                      F.col("corrections_made").alias("_changed"))
    empty_details = F.array().cast(scored.schema["token_details"].dataType)
    is_score = F.col("route") == "score"
    is_empty = F.col("route") == "empty"
    return j.select(
        *keys, "status", "error", "message",
        F.when(F.col("status") == 200, F.col("sentence")).alias("original_sentence"),
        F.when(is_score, F.col("_corrected")).when(is_empty, F.lit("")).alias("corrected_sentence"),
        F.when(is_score, F.col("_details")).when(is_empty, empty_details).alias("token_details"),
        F.when(F.col("status") == 200, F.lit(MODEL_NAME)).alias("model_name"),
        F.when(is_score, F.col("_changed")).when(is_empty, F.lit(False)).alias("corrections_made"),
        F.when(is_empty, F.lit(0.0)).alias("processing_time_ms"))


def response_json(responses: DataFrame) -> DataFrame:
    """One JSON document per response (P17 wire form); a missing time is written as null."""
    ok = F.to_json(F.struct(
        "original_sentence", "corrected_sentence",
        F.transform("token_details", lambda d: F.struct(
            d["token"].alias("token"), d["pred_tag"].alias("pred_tag"),
            d["top_probs"].alias("top_probs"))).alias("token_details"),
        "model_name", "processing_time_ms", "corrections_made", "message"), {"ignoreNullFields": "false"})
    err = F.to_json(F.struct("error"))
    return responses.select("*", F.when(F.col("status") == 200, ok).otherwise(err).alias("json"))
