"""Dataset build from any pair table: filter, tag, vocabulary, splits, encoding, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import texts_to_tags
from ..operators.encode import MAX_LENGTH, encode_examples, subword_pieces
from ..operators.joins import materialize
from ..operators.metrics import evaluate_tagger
from ..operators.pairs import drop_null_pairs, minimal_edit_filter
from ..operators.split import row_hash, with_split
from ..operators.tagger import fit_count_tagger
from ..operators.vocab import build_tag_vocab
from .fixtures import derived_pairs


@dataclass
class Corpus:
    """A built dataset; the caller holds it, the tables lie in the shared folder."""

    tagged: DataFrame   # key, orig_tokens, corr_tokens, tags, gap_tags, split
    vocab: DataFrame    # tag, tag_id
    pairs: DataFrame    # key, original_text, corrected_text: the pairs read, before any filter
    key: str = "pair_id"

    @property
    def n_pairs(self) -> int:
        """Pairs read, counted when asked for."""
        return self.pairs.count()

    def split(self, name: str) -> DataFrame:
        return self.tagged.where(F.col("split") == name).drop("split")

    def encoded(self, max_length: int = MAX_LENGTH, subword_fn=subword_pieces) -> DataFrame:
        """``key, input_ids, attention_mask, labels, split`` of every pair."""
        return encode_examples(self.tagged, self.vocab, self.key, max_length, subword_fn, carry=("split",))

    def stats(self) -> DataFrame:
        """One row: pairs read and kept, vocabulary size, split sizes (A5)."""
        return self.tagged.agg(
            F.lit(self.n_pairs).cast("long").alias("n_pairs"), F.count("*").alias("n_kept"),
            F.count_if(F.col("split") == "train").alias("n_train"),
            F.count_if(F.col("split") == "validation").alias("n_validation"),
            F.lit(self.vocab.count()).cast("long").alias("n_tags"))


def build_dataset(pairs: DataFrame, threshold: float = 0.30, val_split: float | None = 0.05, seed: int = 42,
                  key: str = "pair_id") -> Corpus:
    """Pairs (``key, original_text, corrected_text``) -> F1 -> F2 -> L2 -> P1 -> P3; vocabulary over all kept pairs (A1).

    F1, F2, P1 and P3 run in one pass over the pairs, which writes the tagged
    rows alone; the split's cut-off is found from their keys, and a row's side
    is a predicate on its key from then on.
    """
    kept = minimal_edit_filter(drop_null_pairs(pairs), threshold).select(key, "original_text", "corrected_text")
    rows = materialize(texts_to_tags(kept.withColumn("_row", row_hash(kept.columns)))
                       .select(key, "orig_tokens", "corr_tokens", "tags", "gap_tags", "_row"), "tagged")
    tagged = with_split(rows, val_split, seed, key, row="_row").select(key, "orig_tokens", "corr_tokens", "split", "tags", "gap_tags")
    return Corpus(tagged, build_tag_vocab(rows), pairs, key)


def build_corpus(spark: SparkSession, sf_dir: str, threshold: float = 0.30, val_split: float | None = 0.05,
                 seed: int = 42) -> Corpus:
    """The dataset of the pairs derived from the documents table."""
    return build_dataset(derived_pairs(spark, sf_dir), threshold, val_split, seed)


def count_tagger(corpus: Corpus) -> DataFrame:
    """Count tagger fitted on the corpus's train split."""
    return fit_count_tagger(corpus.split("train"), corpus.vocab)


def fit_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: build, fit the count tagger on train, evaluate on validation."""
    c = build_corpus(spark, sf_dir)
    return evaluate_tagger(c.split("validation"), count_tagger(c), c.vocab)
