"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.  The
dataset is built once and held; each step is timed on its written inputs, from
DataFrame construction to a full collect-free materialisation
(``write.format("noop")``), so no step is served from an earlier one's result.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from redline.operators import align, metrics, pairs, tagger, vocab  # noqa: E402
from redline.operators.joins import materialize  # noqa: E402
from redline.plans.corpus import build_dataset, count_tagger  # noqa: E402
from redline.plans.fixtures import derived_pairs  # noqa: E402
from redline.session import get_spark  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times, made = {}, {}

    def step(name, make, sink=True):
        t0 = time.time()
        made[name] = make()
        if sink:
            made[name].write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
        return made[name]

    p = step("derived_pairs", lambda: materialize(derived_pairs(spark, sf_dir), "pairs"), sink=False)
    step("minimal_edit_filter", lambda: pairs.minimal_edit_filter(pairs.drop_null_pairs(p)))
    c = step("corpus_build", lambda: build_dataset(p), sink=False)
    toks = c.tagged.select("pair_id", "orig_tokens", "corr_tokens")
    step("diff_to_tags", lambda: align.diff_to_tags(toks))
    step("build_tag_vocab", lambda: vocab.build_tag_vocab(c.tagged))
    step("encode_examples", c.encoded)
    m = step("fit_count_tagger", lambda: count_tagger(c))
    val = c.split("validation").select("pair_id", F.array_join("orig_tokens", " ").alias("sentence"),
                                       F.array_join("corr_tokens", " ").alias("reference"))
    step("correct_batch", lambda: tagger.correct_batch(val, m, c.vocab, key="pair_id"))
    step("correct_verbose", lambda: tagger.correct_verbose(val, m, c.vocab, key="pair_id"))
    step("token_accuracy", lambda: metrics.evaluate_tagger(c.split("validation"), m, c.vocab))
    step("sentence_metrics", lambda: metrics.sentence_metrics(
        made["correct_batch"].withColumnRenamed("corrected", "prediction").join(val.select("pair_id", "reference"), "pair_id")))
    n_val = val.count()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus), "eval_examples": n_val,
                      "eval_samples_per_sec": round(n_val / max(times["token_accuracy"], 1e-9), 1)}))


if __name__ == "__main__":
    main()
