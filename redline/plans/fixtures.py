"""Derived pair corpus built from the ``documents`` table.

All non-blank lines of all languages are tokenised on spaces; tokens from a
frequency-ranked lexicon get deterministic noise keyed by an md5 bucket of
``doc_id|line_no|pos``.  The corrected side is the clean line, the original side
the noisy one.

Plan: one scan of ``documents`` (two columns read), a
partial-aggregated count for the lexicon (top 200: a bounded result), and the
noise in Arrow batches: tokens of the lexicon take one of their few noisy forms
by their md5 bucket, all tokens of a batch at once.  What is built on the pairs
reads them as columns of that pass, so nothing is worked out twice and they need
not be written.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import spread

# Fixed values of the fixture rules.
LEXICON_SIZE = 200
LEXICON_MIN_LEN = 4
NULL_ORIGINAL_MOD, NULL_ORIGINAL_REM = 50, 7
REVERSED_MOD = 20


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, line)`` for every non-blank line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return spread(lines.where(F.col("line").rlike("[^ ]")), "doc_id", "line_no")


def lexicon(lines: DataFrame, size: int = LEXICON_SIZE) -> DataFrame:
    """Most frequent alphabetic tokens of length >= 4 (count desc, token asc)."""
    toks = lines.select("line").mapInArrow(_token_counts, "token string, n long")
    toks = toks.where(F.col("token").rlike(r"^[A-Za-z]+\z") & (F.length("token") >= LEXICON_MIN_LEN))
    return (toks.groupBy("token").agg(F.sum("n").alias("n"))
                .orderBy(F.desc("n"), F.asc("token")).limit(size))


def _token_counts(batches):
    """Tokens of the lines of each Arrow batch with their counts: a row a distinct token reaches the aggregation."""
    for b in batches:
        counts = pc.value_counts(pc.list_flatten(pc.split_pattern(b.column(0).cast(pa.string()), " ")))
        counts = counts.filter(pc.not_equal(counts.field("values"), ""))
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["token", "n"])


def noise_buckets(doc_id, line_no: int, places: list[int]) -> list[bytes]:
    """md5 of ``doc_id|line_no|pos`` for places of one line; a missing id is left out."""
    head = "" if doc_id is None else f"{doc_id}|"
    head = f"{head}{line_no}|".encode()
    return [md5(head + b"%d" % p).digest() for p in places]


#: Upper ends of the buckets (the first 6 hex digits of the md5, mod 100) of each rule.
RULES = (10, 20, 26, 30, 32, 34, 36)


def noisy_forms(t: str) -> tuple:
    """Original-side texts for one clean token, a form a rule; None drops it."""
    return (t[0] + t[2] + t[1] + t[3:],               # swap chars 2, 3
            t[0] + t[2:],                             # drop char 2
            t[:2] + t[1:],                            # double char 2
            t[0] + "x" + t[2:],                       # char 2 -> x
            None,                                     # token dropped
            t + " " + t,                              # token repeated
            t[:2] + " " + t[2:],                      # token split
            t)


def _noisy_lines(lex: list[str]):
    """Arrow batches of ``doc_id, line_no, line`` -> with the noisy and the clean text of each line."""
    kinds = len(RULES) + 1

    def run(batches):
        forms = pa.array([f for t in lex for f in noisy_forms(t)], pa.string())
        known = pa.array(lex, pa.string())
        for b in batches:
            if not b.num_rows:
                continue
            cut = pc.split_pattern(b.column("line").cast(pa.string()), " ")
            words, row = pc.list_flatten(cut), pc.list_parent_indices(cut)
            full = pc.not_equal(words, "")            # runs of spaces, and spaces at an end
            words, row = words.filter(full), row.filter(full).to_numpy()
            off = np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows)))
            rank = pc.index_in(words, known).fill_null(-1).to_numpy()
            at = np.flatnonzero(rank >= 0)            # the tokens that may get noise
            pos, ends = (at - off[row[at]]).tolist(), np.searchsorted(row[at], np.arange(b.num_rows + 1)).tolist()
            ids, nos = b.column("doc_id").to_pylist(), b.column("line_no").to_pylist()
            hashes = b"".join(h for r in range(b.num_rows) if ends[r] < ends[r + 1]
                              for h in noise_buckets(ids[r], nos[r], pos[ends[r]:ends[r + 1]]))
            h = np.frombuffer(hashes, np.uint8).reshape(-1, 16)[:, :3].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
            form = np.full(len(words), -1)
            form[at] = rank[at] * kinds + np.searchsorted(RULES, h % 100, "right")
            swapped = pa.concat_arrays([words, forms]).take(pa.array(np.where(form < 0, np.arange(len(words)), len(words) + form)))
            there = pc.is_valid(swapped)
            left = np.append(0, np.cumsum(np.bincount(row[there.to_numpy(zero_copy_only=False)], minlength=b.num_rows)))
            join = lambda o, w: pc.binary_join(pa.ListArray.from_arrays(pa.array(o, pa.int32()), w), " ")
            clean = join(off, words)
            doc = b.column("doc_id")
            # as in SQL, a remainder has the sign of its dividend and none comes of a missing id
            rest = lambda m: pc.subtract(doc, pc.multiply(pc.divide(doc, m), m))
            text = pc.if_else(pc.equal(rest(REVERSED_MOD), 0).fill_null(False), pc.utf8_reverse(clean), join(left, swapped.filter(there)))
            gone = pc.equal(rest(NULL_ORIGINAL_MOD), NULL_ORIGINAL_REM).fill_null(False)
            yield pa.RecordBatch.from_arrays([doc, b.column("line_no"), pc.if_else(gone, pa.scalar(None, pa.string()), text), clean],
                                             ["doc_id", "line_no", "original_text", "corrected_text"])
    return run


def derived_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, original_text, corrected_text)`` from the documents table."""
    lines = document_lines(spark, sf_dir)
    # Bounded by LEXICON_SIZE: goes to the tasks as a list.
    lex = [r["token"] for r in lexicon(lines).collect()]
    pairs = (lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), "line")
             .mapInArrow(_noisy_lines(lex), "doc_id long, line_no int, original_text string, corrected_text string"))
    return pairs.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("pair_id"), "original_text", "corrected_text")


DERIVED_PAIRS_SQL = r"""
lines AS (
  SELECT doc_id, line, line_no FROM (
    SELECT doc_id,
           unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents)
  WHERE regexp_matches(line, '[^ ]')
),
toklines AS (
  SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS tokens FROM lines
),
toks AS (
  SELECT doc_id, line_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM toklines
),
lex AS (
  SELECT token FROM toks
  WHERE regexp_full_match(token, '[A-Za-z]+') AND length(token) >= 4
  GROUP BY token ORDER BY count(*) DESC, token ASC LIMIT 200
),
noisy AS (
  SELECT t.doc_id, t.line_no, t.pos, t.token,
         CASE WHEN l.token IS NULL THEN NULL
              ELSE ('0x' || substr(md5(concat_ws('|', t.doc_id::VARCHAR, t.line_no::VARCHAR, t.pos::VARCHAR)), 1, 6))::BIGINT % 100
         END AS h
  FROM toks t LEFT JOIN lex l ON t.token = l.token
),
noisy2 AS (
  SELECT doc_id, line_no, pos, token,
    CASE WHEN h IS NULL THEN token
         WHEN h < 10 THEN substr(token,1,1) || substr(token,3,1) || substr(token,2,1) || substr(token,4)
         WHEN h < 20 THEN substr(token,1,1) || substr(token,3)
         WHEN h < 26 THEN substr(token,1,2) || substr(token,2)
         WHEN h < 30 THEN substr(token,1,1) || 'x' || substr(token,3)
         WHEN h < 32 THEN NULL
         WHEN h < 34 THEN token || ' ' || token
         WHEN h < 36 THEN substr(token,1,2) || ' ' || substr(token,3)
         ELSE token END AS noisy
  FROM noisy
),
joined AS (
  SELECT doc_id, line_no,
         string_agg(token, ' ' ORDER BY pos) AS corrected_text,
         coalesce(string_agg(noisy, ' ' ORDER BY pos), '') AS noisy_text
  FROM noisy2 GROUP BY doc_id, line_no
),
pairs AS (
  SELECT doc_id * 100000 + line_no AS pair_id,
         CASE WHEN doc_id % 50 = 7 THEN NULL
              WHEN doc_id % 20 = 0 THEN reverse(corrected_text)
              ELSE noisy_text END AS original_text,
         corrected_text
  FROM joined
)"""


# Request variants derived from the conversations table (by conv_id % 10).
VARIANT_MOD = 10


def requests_from_conversations(conv: DataFrame) -> DataFrame:
    """``(conv_id, turn, body)``: one JSON request per user turn.

    ``top_k = 1 + turn % 5``; ``conv_id % 10`` picks a variant: 0 malformed,
    1 no sentence, 2 null sentence, 3 numeric sentence, 4 blank sentence,
    5 string top_k, 6 fractional top_k, 7 non-integer top_k, 8 JSON array,
    otherwise a well-formed request.
    """
    k = (F.lit(1) + F.col("turn") % 5).cast("int")
    text = F.col("text")
    obj = lambda *kv: F.to_json(F.struct(*kv))
    v = F.col("conv_id") % VARIANT_MOD
    whole = obj(text.alias("sentence"), k.alias("top_k"))
    body = (F.when(v == 0, F.expr("substring(to_json(named_struct('sentence', text)), 1, "
                                  "length(to_json(named_struct('sentence', text))) - 1)"))
             .when(v == 1, obj(k.alias("top_k")))
             .when(v == 2, F.concat(F.lit('{"sentence": null, "top_k": '), k.cast("string"), F.lit("}")))
             .when(v == 3, F.concat(F.lit('{"sentence": '), F.col("conv_id").cast("string"),
                                    F.lit(', "top_k": '), k.cast("string"), F.lit("}")))
             .when(v == 4, obj(F.lit("   ").alias("sentence"), k.alias("top_k")))
             .when(v == 5, obj(text.alias("sentence"), k.cast("string").alias("top_k")))
             .when(v == 6, obj(text.alias("sentence"), (k.cast("double") + 0.7).alias("top_k")))
             .when(v == 7, obj(text.alias("sentence"), F.lit("x").alias("top_k")))
             .when(v == 8, F.lit("[1, 2]"))
             .otherwise(whole))
    return conv.where(F.col("role") == "user").select("conv_id", "turn", body.alias("body"))
