"""Sequence metrics over (prediction, reference) pairs.

Tokens are P1 tokens (whitespace split); BLEU and ROUGE are defined on them
rather than on an external tokenizer (documented deviation).

* WER: sum of word-level edits over sum of reference words.
* BLEU: corpus-level clipped 1..4-gram precision with brevity penalty, no
  smoothing, scaled to 0..100.
* ROUGE-1/2: mean over pairs of the n-gram overlap F1.
* ROUGE-L: mean over pairs of the LCS F1.
* ROUGE-Lsum: the same by lines: the union, over the prediction's lines, of each
  reference line's LCS; a word counts no oftener than the prediction has it.

Every row is a pair of its own, also where keys repeat; a null side has no
tokens, and a pair without tokens scores 0 and counts.  Edits and subsequences
are found for whole Arrow batches (``functions.bitvectors``).

Plan: for n-grams, rows are numbered and written once, grams exploded once and
counted by (row, n, gram) -- a partial aggregation keyed by the row, so no group
outgrows one sentence -- then a single global aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitvectors import common_length, union_length, word_distance
from ..functions.text import tokenize
from .joins import materialize

MAX_N = 4
_ROW = "_row"


def _tokens(text: str) -> Column:
    return F.coalesce(tokenize(text), F.array().cast("array<string>"))


def word_error_rate(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Corpus WER."""
    t = df.select(_tokens(pred).alias("_p"), _tokens(ref).alias("_r"))
    return t.agg((F.sum(word_distance("_r", "_p")).cast("double") / F.nullif(F.sum(F.size("_r")), F.lit(0)).cast("double")).alias("wer"))


def _numbered(df: DataFrame, pred: str, ref: str) -> DataFrame:
    return materialize(df.select(F.col(pred).alias("_pred"), F.col(ref).alias("_ref"), F.monotonically_increasing_id().alias(_ROW)), "pairs_numbered")


def ngram_counts(df: DataFrame, key: str, pred: str = "prediction", ref: str = "reference",
                 max_n: int = MAX_N) -> DataFrame:
    """``(key, n, gram, cp, cr)``: n-gram counts on each side, per pair; ``key`` must be unique."""
    def grams(tokens: Column, n: int) -> Column:
        idx = F.sequence(F.lit(0), F.size(tokens) - n)
        return F.when(F.size(tokens) >= n, F.transform(
            idx, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(
            F.array().cast("array<string>"))

    # token arrays are bound as columns first: an expression used inside the
    # lambdas below would be re-evaluated for every n-gram
    df = df.select(key, _tokens(pred).alias("_p"), _tokens(ref).alias("_r"))
    p, r = F.col("_p"), F.col("_r")
    # one explode over all orders and both sides: the input plan runs once
    def tagger(n: int, ip: int):
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), F.lit(ip).alias("ip"),
                                  F.lit(1 - ip).alias("ir"))

    parts = [F.transform(grams(toks, n), tagger(n, ip))
             for n in range(1, max_n + 1) for toks, ip in ((p, 1), (r, 0))]
    e = df.select(key, F.explode(F.concat(*parts)).alias("g"))
    return (e.groupBy(key, F.col("g.n").alias("n"), F.col("g.gram").alias("gram"))
             .agg(F.sum("g.ip").alias("cp"), F.sum("g.ir").alias("cr")))


def corpus_bleu(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Corpus BLEU x 100 with brevity penalty, no smoothing (A10)."""
    g = ngram_counts(_numbered(df, pred, ref), _ROW, "_pred", "_ref")
    per_n = g.groupBy("n").agg(F.sum(F.least("cp", "cr")).alias("m"), F.sum("cp").alias("t"),
                               F.sum("cr").alias("tr"))
    # unigram totals are the corpus lengths: one aggregate, no join
    agg = per_n.agg(
        F.sum(F.when(F.col("m") > 0, F.log(F.col("m") / F.col("t")))).alias("s"),
        F.count_if(F.col("m") > 0).alias("k"),
        F.max(F.when(F.col("n") == 1, F.col("t"))).alias("c"),
        F.max(F.when(F.col("n") == 1, F.col("tr"))).alias("r"))
    c, r = F.coalesce(F.col("c"), F.lit(0)), F.coalesce(F.col("r"), F.lit(0))
    bp = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    bleu = F.when(F.col("k") < MAX_N, F.lit(0.0)).otherwise(bp * F.exp(F.col("s") / MAX_N)) * 100
    return agg.select(bleu.alias("bleu"), c.alias("pred_len"), r.alias("ref_len"))


def rouge_n(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Mean ROUGE-1 and ROUGE-2 F1 over pairs."""
    rows = _numbered(df, pred, ref)
    g = ngram_counts(rows, _ROW, "_pred", "_ref", max_n=2)
    per = g.groupBy(_ROW, "n").agg(F.sum(F.least("cp", "cr")).alias("o"), F.sum("cp").alias("tp"), F.sum("cr").alias("tr"))
    f1 = F.when(F.col("o") == 0, F.lit(0.0)).otherwise(2 * F.col("o") / (F.col("tp") + F.col("tr")))
    # pairs without n-grams have no group and add 0
    total = per.agg(F.sum(F.when(F.col("n") == 1, f1)).alias("s1"), F.sum(F.when(F.col("n") == 2, f1)).alias("s2"))
    n = rows.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))
    mean = lambda s: F.when(F.col("n").isNotNull(), F.coalesce(F.col(s), F.lit(0.0)) / F.col("n"))
    return total.crossJoin(n).select(mean("s1").alias("rouge1"), mean("s2").alias("rouge2"))     # one row each


def _mean_f1(hits: Column, sizes: Column, name: str) -> Column:
    return F.avg(F.when(hits == 0, F.lit(0.0)).otherwise(2 * hits / sizes)).alias(name)


def rouge_l(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Mean ROUGE-L F1 over pairs."""
    t = df.select(_tokens(pred).alias("_p"), _tokens(ref).alias("_r")).withColumn("_n", common_length("_r", "_p"))
    return t.agg(_mean_f1(F.col("_n"), F.size("_p") + F.size("_r"), "rougeL"))


def rouge_lsum(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Mean ROUGE-Lsum F1 over pairs of texts whose lines are sentences."""
    lines = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: tokenize(x))
    t = df.select(lines(pred).alias("_p"), lines(ref).alias("_r")).withColumn("_n", union_length("_r", "_p"))
    size = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + F.size(x))
    return t.agg(_mean_f1(F.col("_n"), size("_p") + size("_r"), "rougeLsum"))
