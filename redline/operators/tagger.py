"""Token tagger on Spark: fit, score, correct.

The count tagger is the frozen-feature classifier reduced to its identity
feature: for each token, the distribution of its training tags with one
pseudo-count on KEEP, ``p = (n + [tag = KEEP]) / (N + 1)`` and
``logit = ln p``.  A token never seen in training is KEEP with p = 1.

Model layout: one row per token, ``dist`` = array of
``struct(tag_id, tag, prob, logit)`` sorted best first (prob desc, tag_id asc).
Scoring is then one join on ``token``; argmax, top-k and the softmax are array
expressions on the joined row -- no per-tag explode, no second shuffle for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import _flat
from ..functions.tags import KEEP, apply_tags
from ..functions.text import py_strip, tokenize
from .joins import materialize
from .vocab import encode_tags, vocab_ids

DIST_TYPE = "array<struct<tag_id:int,tag:string,prob:double,logit:double>>"


def token_tags(tagged: DataFrame, key: str = "pair_id", tokens: str = "orig_tokens",
               tags: str = "tags") -> DataFrame:
    """Long form ``(key, pos, token, tag)`` of a tagged corpus."""
    z = F.arrays_zip(F.col(tokens).alias("token"), F.col(tags).alias("tag"))
    return (tagged.select(key, F.posexplode(z).alias("pos", "z"))
                  .select(key, "pos", F.col("z.token").alias("token"), F.col("z.tag").alias("tag"))
                  .where(F.col("tag").isNotNull() & F.col("token").isNotNull()))


def tag_counts(tagged: DataFrame, vocab: DataFrame, tokens: str = "orig_tokens", tags: str = "tags") -> DataFrame:
    """``(token, tag, n, tag_id)``: how often a token has a tag.

    Counted in Arrow batches first, many of them together, so that a task gives
    a few rows for its most frequent tokens.
    """
    part = tagged.select(tokens, tags).mapInArrow(_counted, "token string, tag string, n long")
    return encode_tags(part.groupBy("token", "tag").agg(F.sum("n").alias("n")), vocab)


#: Places of token lists that are counted together.
COUNTED = 1 << 20


def _counted(batches):
    """Arrow batches of tokens and tags, zipped -> ``token, tag, n``, each pair once for every ``COUNTED`` places or so."""
    held, size = [], 0
    for b in batches:
        here = pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(1)))
        (words, off), (tags, t_off) = (_flat(c.filter(here)) for c in b.columns)
        n, t_n = np.diff(off), np.diff(t_off)
        if (n != t_n).any():                          # the longer list's rest has no partner
            most = np.maximum(n, t_n)
            row = np.repeat(np.arange(len(n)), most)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
            words, tags = (c.take(pa.array(np.where(pos < k[row], o[row] + pos, 0), mask=pos >= k[row])) for c, o, k in ((words, off, n), (tags, t_off, t_n)))
        held.append((words.cast(pa.string()), tags.cast(pa.string())))
        size += len(words)
        if size >= COUNTED:
            yield _pairs_counted(held)
            held, size = [], 0
    if size:
        yield _pairs_counted(held)


def _pairs_counted(held: list) -> pa.RecordBatch:
    words, tags = (pa.concat_arrays(list(c)).dictionary_encode(null_encoding="encode") for c in zip(*held))
    width = len(tags.dictionary)
    key, n = np.unique(words.indices.to_numpy().astype(np.int64) * width + tags.indices.to_numpy(), return_counts=True)
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key // width)), tags.dictionary.take(pa.array(key % width)), pa.array(n)], ["token", "tag", "n"])


def fit_count_tagger(tagged: DataFrame, vocab: DataFrame, tokens: str = "orig_tokens",
                     tags: str = "tags", alpha: float = 1.0, counts: DataFrame | None = None) -> DataFrame:
    """``(token, n_total, dist)`` from a tagged corpus (M1), or from its ``tag_counts`` if the caller has them.

    Counting is a partial aggregation, so a token holding a third of all rows
    (e.g. "the") is pre-aggregated on the map side; the second grouping runs on
    the (token, tag) counts only.  Tags are encoded after counting (J1 on the
    small aggregate, not on every token), which is written: ``counts`` too are
    best a written table, with one row a token and tag.
    """
    counts = materialize(tag_counts(tagged, vocab, tokens, tags), "tag_counts") if counts is None else counts
    keep_id = vocab_ids(vocab)[KEEP]
    a = float(alpha)
    # most tokens are only ever kept: one row of theirs says all, and is not collected with others
    mixed = materialize(counts.where(~F.col("tag").eqNullSafe(KEEP)).select(F.col("token").alias("_mixed")).distinct(), "mixed_tokens")
    joined = lambda how: counts.join(mixed, F.col("token").eqNullSafe(F.col("_mixed")), how)
    per_tok = joined("left_semi").groupBy("token").agg(
        F.sum("n").alias("n_total"),
        F.collect_list(F.struct("tag_id", "tag", "n")).alias("obs"))
    per_tok = per_tok.unionByName(joined("left_anti").select("token", F.col("n").alias("n_total"), F.array(F.struct("tag_id", "tag", "n")).alias("obs")))
    has_keep = F.exists("obs", lambda e: e["tag_id"] == keep_id)
    obs = F.when(has_keep, F.col("obs")).otherwise(F.array_append(
        "obs", F.struct(F.lit(keep_id).cast("int").alias("tag_id"), F.lit(KEEP).alias("tag"),
                        F.lit(0).cast("long").alias("n"))))
    denom = F.col("n_total").cast("double") + a
    dist = F.transform(obs, lambda e: F.struct(
        e["tag_id"].alias("tag_id"), e["tag"].alias("tag"),
        ((e["n"].cast("double") + F.when(e["tag_id"] == keep_id, F.lit(a)).otherwise(F.lit(0.0)))
         / denom).alias("prob")))
    ranked = F.transform(
        F.array_sort(F.transform(dist, lambda e: F.struct(
            (-e["prob"]).alias("k1"), e["tag_id"].alias("k2"), e.alias("e")))),
        lambda s: F.struct(s["e"]["tag_id"].alias("tag_id"), s["e"]["tag"].alias("tag"),
                           s["e"]["prob"].alias("prob"), F.log(s["e"]["prob"]).alias("logit")))
    model = per_tok.select("token", "n_total", ranked.alias("dist"))
    return materialize(model, "count_tagger")


def _default_dist(keep_id: int):
    return F.array(F.struct(F.lit(keep_id).cast("int").alias("tag_id"), F.lit(KEEP).alias("tag"),
                            F.lit(1.0).alias("prob"), F.lit(0.0).alias("logit"))).cast(DIST_TYPE)


def score_tokens(long_tokens: DataFrame, model: DataFrame, vocab: DataFrame,
                 token: str = "token", ids: dict | None = None) -> DataFrame:
    """Attach the tag distribution to every token occurrence.

    A left join on the exact token: broadcast if the model's bytes allow,
    otherwise a shuffle join whose hot tokens adaptive execution splits.
    """
    keep_id = (ids or vocab_ids(vocab))[KEEP]
    m = model.select(F.col("token").alias("_mtok"), F.col("dist").alias("_dist"))
    j = long_tokens.join(m, F.col(token) == F.col("_mtok"), "left")
    # Default decided on the join key, not by coalesce(_dist, ...): Spark 4.1
    # pushes an extraction of coalesce(...) into the nullable side of the outer
    # join, which loses the default for unmatched rows (see tests).
    dist = F.when(F.col("_mtok").isNull(), _default_dist(keep_id)).otherwise(F.col("_dist"))
    return j.withColumn("dist", dist).drop("_mtok", "_dist")


def argmax_tag(dist="dist"):
    """Best (tag_id, tag): first entry of the best-first distribution."""
    d = F.col(dist) if isinstance(dist, str) else dist
    return F.get(d, 0)


def top_k(dist="dist", k=3, num_tags: int | None = None):
    """k best entries, clamped to [1, num_tags]; ``k`` may be a column.

    ``k`` None or 0 gives the whole distribution (P15).  The count tagger's
    distribution lists the tags it has seen for the token (all others are 0).
    """
    d = F.col(dist) if isinstance(dist, str) else dist
    if k is None or (isinstance(k, int) and k == 0):
        return d
    kk = k if not isinstance(k, int) else F.lit(k)
    kk = F.greatest(kk, F.lit(1))
    if num_tags is not None:
        kk = F.least(kk, F.lit(num_tags))
    return F.slice(d, 1, kk)


def probs_map(entries):
    """``map<tag, prob>`` of a list of distribution entries (P15 for the full list)."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["tag"], e["prob"])))


def softmax(logits):
    """Softmax of an ``array<double>`` (P12), max-shifted for stability."""
    x = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def sentence_tokens(sentences: DataFrame, key: str, text: str = "sentence", *carry) -> DataFrame:
    """``(key, pos, token, _text, *carry)``; a sentence without tokens keeps one
    row with NULL pos.  The sentence text rides only on its first row (so it is
    shuffled once, not once per token) and comes back with the regroup."""
    ex = sentences.select(key, F.col(text).alias("_text"), *carry,
                          F.posexplode_outer(tokenize(text)).alias("pos", "token"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    return ex.withColumn("_text", F.when(first, F.col("_text")))


def correct_batch(sentences: DataFrame, model: DataFrame, vocab: DataFrame,
                  key: str = "line_no", text: str = "sentence") -> DataFrame:
    """``(key, sentence, corrected)`` (M3): tokenise, score, argmax, apply tags.

    Only tokens whose best tag is not KEEP can change a sentence, so the model
    is cut to those before the join and only matching tokens travel; their tags
    come back to the sentence as a small map from position to tag.  Every row of
    ``sentences`` is a sentence of its own, also where keys repeat.
    """
    best = argmax_tag().getField("tag")
    change = model.select(F.col("token").alias("_mtok"), best.alias("_tag")).where(F.col("_tag") != KEEP)
    rows = numbered_sentences(sentences, key, text)
    toks = rows.select("_id", F.posexplode(tokenize(text)).alias("pos", "token"))
    return apply_found_tags(rows, toks.join(change, F.col("token") == F.col("_mtok")), key, text)


def numbered_sentences(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, _id)``, written, so that every row is a sentence of its own, also where keys repeat."""
    return materialize(sentences.select(key, text).withColumn("_id", F.monotonically_increasing_id()), "sentences")


def apply_found_tags(rows: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, corrected)``: the ``found (_id, pos, _tag)`` applied to the numbered sentences, KEEP elsewhere.

    The tags come back to a sentence as a small map from position to tag.
    """
    hits = found.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "_tag"))).alias("_hits"))
    tags = F.transform(F.col("_t"), lambda x, i: F.coalesce(F.col("_hits")[i], F.lit(KEEP)))
    j = rows.join(hits, "_id", "left").withColumn("_t", tokenize(text))
    fixed = F.when(F.col("_hits").isNull(), F.array_join("_t", " ")).otherwise(apply_tags(F.col("_t"), tags))
    return j.select(key, text, fixed.alias("corrected"))


def full_distribution(sentences: DataFrame, model: DataFrame, vocab: DataFrame, key: str = "line_no",
                      text: str = "sentence") -> DataFrame:
    """``(key, pos, token, tag_id, tag, prob)``: every tag of the vocabulary for every token, 0 where never seen.

    The result has tokens x tags rows by definition: meant for requested sentences.
    """
    scored = score_tokens(sentence_tokens(sentences, key, text).where("pos is not null"), model, vocab)
    entry = lambda e: F.struct(e["tag_id"], e["prob"])
    # the best entry, all there is for most tokens, is compared; the map holds the others
    seen = F.when(F.size("dist") > 1, F.map_from_entries(F.transform(F.slice("dist", 2, F.size("dist") - 1), entry)))
    every = vocab.agg(F.array_sort(F.collect_list(F.struct("tag_id", "tag"))).alias("_tags"))  # one row, the vocabulary
    rows = scored.select(key, "pos", "token", F.get("dist", F.lit(0)).alias("_best"), seen.alias("_seen")).join(F.broadcast(every), F.lit(True))
    others = F.when(F.col("_seen").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("_seen")[F.col("tag_id")], F.lit(0.0)))
    return (rows.select(key, "pos", "token", F.col("_best.tag_id").alias("_first"), F.col("_best.prob").alias("_prob"), "_seen", F.inline("_tags"))
            .select(key, "pos", "token", "tag_id", "tag", F.when(F.col("tag_id") == F.col("_first"), F.col("_prob")).otherwise(others).alias("prob")))


def correct_verbose(sentences: DataFrame, model: DataFrame, vocab: DataFrame,
                    key: str = "line_no", text: str = "sentence", top_k_col=None,
                    default_k: int = 3, clamp: bool = True, pass_through: str | None = None,
                    num_tags: int | None = None, ids: dict | None = None, row_id: str | None = None) -> DataFrame:
    """As ``correct_batch`` plus per-token details.

    ``token_details`` = array of ``struct(token, pred_tag, top_probs map, top
    array)`` in token order; ``top`` keeps the ranked order the map loses.
    ``top_k`` (per row, or ``default_k``) is clamped to [1, vocabulary size].
    As there, every row of ``sentences`` is a sentence of its own: rows are
    numbered and written first, unless ``row_id`` names a number that the rows
    of a written table already carry.
    """
    if clamp and num_tags is None:
        num_tags = vocab.count()
    full = not top_k_col and not default_k
    k_col = (F.col(top_k_col) if top_k_col else F.lit(default_k or 0)).alias("_k")
    carry = [k_col, F.col(key).alias("_name")] + ([F.col(pass_through).alias("_pass")] if pass_through else [])
    cols = dict.fromkeys(c for c in (key, text, top_k_col, pass_through) if c)
    rows = (sentences.select(*cols, F.col(row_id).alias("_sid")) if row_id
            else materialize(sentences.select(*cols).withColumn("_sid", F.monotonically_increasing_id()), "sentences"))
    toks = sentence_tokens(rows, "_sid", text, *carry)
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    for c in ["_name"] + ["_pass"] * bool(pass_through):  # like the text: one copy per sentence, back with the regroup
        toks = toks.withColumn(c, F.when(first, F.col(c)))
    scored = score_tokens(toks, model, vocab, ids=ids)
    top = top_k("dist", None if full else F.col("_k"), num_tags)
    # maps are not orderable: collect the ranked array, build the map after sorting
    entry = F.struct(
        F.col("pos"), F.col("token"), argmax_tag().getField("tag").alias("pred_tag"),
        F.transform(top, lambda e: F.struct(e["tag"].alias("tag"), e["prob"].alias("prob"))).alias("top"))
    extra = [F.max("_pass").alias(pass_through)] if pass_through else []
    per = scored.groupBy("_sid").agg(
        F.max("_name").alias(key), F.max("_text").alias(text), *extra,
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("items"))
    details = F.transform("items", lambda e: F.struct(
        e["token"].alias("token"), e["pred_tag"].alias("pred_tag"),
        probs_map(e["top"]).alias("top_probs"), e["top"].alias("top")))
    out = per.select(key, text, *([pass_through] if pass_through else []),
                     apply_tags(F.col("items.token"), F.col("items.pred_tag")).alias("corrected"),
                     details.alias("token_details"))
    return out.withColumn("corrections_made", py_strip("corrected") != py_strip(text))
