"""Check-typos as a Structured Streaming job.

The request/response service becomes a stream: rows with a JSON ``body`` and any
other columns arrive through a file source (explicit schema), each micro-batch
runs the *same* DataFrame functions as the batch path (parse -> route -> score
-> respond) inside ``foreachBatch``, and writes Parquet to
``<out>/batch_id=<id>`` with overwrite, so a replayed batch (after a failure)
replaces its own output: idempotent.

The scoring model and vocabulary are static tables joined per batch; what a
plan needs of the vocabulary (base ids, number of tags) is looked up once.  The
stream is stateless -- no aggregation across batches -- so no watermark is
involved.  Per-request latency (T2) is the batch's own wall time, measured around
its write and written beside its responses, spread over its requests.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import MSG_OK, check_typos, parse_requests, route_requests
from ..operators.vocab import vocab_ids
from ..session import scratch_path
from ..sources import artifacts

BODY_SCHEMA = "request_id string, body string"


def respond(requests: DataFrame, model: DataFrame | None, vocab: DataFrame | None, keys=("conv_id", "turn"),
            num_tags: int | None = None, ids: dict | None = None) -> DataFrame:
    """Responses of a batch of ``(*keys, body)`` rows; without a model every row gets 503."""
    routed = route_requests(parse_requests(requests), model_ready=model is not None)
    if model is None:
        return routed.select(*keys, "status", "error")
    return check_typos(routed, model, vocab, keys, num_tags, ids)


def run_correct_stream(spark: SparkSession, source: str, model: DataFrame | None, vocab: DataFrame | None, schema=BODY_SCHEMA,
                       keys=("request_id",), to_requests: Callable[[DataFrame], DataFrame] | None = None,
                       file_format: str = "json", out_dir: str | None = None, checkpoint: str | None = None,
                       max_files_per_trigger: int = 1, model_path: str | None = None):
    """Run the stream to completion (``availableNow``); returns (responses, latency).

    With ``model_path`` each micro-batch uses the newest whole version published
    there (``sources.artifacts``) and says so in ``model_version``; a version
    that appears while the stream runs is taken up with the next batch.  Without
    a model every request is answered 503.

    ``to_requests`` turns rows of the source into ``(*keys, body)``; by default
    the source's rows have these columns.
    """
    out_dir = out_dir or scratch_path(spark, "stream_out")
    checkpoint = checkpoint or scratch_path(spark, "stream_ckpt")
    times = scratch_path(spark, "stream_times")
    held: dict = {"version": None}

    def hold(version, model, vocab):
        # what a plan needs of the vocabulary is looked up once a version
        held.update(version=version, model=model, vocab=vocab, ids=None if model is None else vocab_ids(vocab), num_tags=None if model is None else vocab.count())

    hold(None, model, vocab)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        began = time.perf_counter()
        if model_path and artifacts.newest(spark, model_path) != held["version"]:
            found = artifacts.load(spark, model_path, "model", "vocab")
            if found:
                hold(*found)
        requests = to_requests(batch) if to_requests else batch
        at = f"{out_dir}/batch_id={batch_id}"
        out = respond(requests, held["model"], held["vocab"], keys, held["num_tags"], held["ids"])
        if model_path:
            out = out.withColumn("model_version", F.lit(held["version"]).cast("string"))
        out.write.mode("overwrite").parquet(at)
        n = spark.read.parquet(at).count()
        took = (time.perf_counter() - began) * 1000
        (spark.createDataFrame([(n, took)], "n_requests long, duration_ms double").coalesce(1)
         .write.mode("overwrite").parquet(f"{times}/batch_id={batch_id}"))

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .format(file_format).load(source))
    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # batches answered without a model have fewer columns
    return spark.read.option("mergeSchema", True).parquet(out_dir), spark.read.parquet(times)


def latency_summary(timed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``n_scored, n_batches, fastest, p50, p95, slowest`` of the scored rows' times.

    Quantiles come from a sketch a micro-batch, merged: batches can be summed up
    one by one, and their sketches kept beside their responses.
    """
    ms = F.col("processing_time_ms")
    per = (timed.where(F.col("message") == MSG_OK).groupBy(batch)
           .agg(F.count(ms).alias("n"), F.min(ms).alias("low"), F.max(ms).alias("high"), F.kll_sketch_agg_double(ms).alias("sketch")))
    all_ = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_scored"), F.count("*").alias("n_batches"), F.min("low").alias("fastest"),
                   F.max("high").alias("slowest"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda q: F.when(F.col("n_scored") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return all_.select("n_scored", "n_batches", "fastest", at(0.5).alias("p50"), at(0.95).alias("p95"), "slowest")


def with_latency(responses: DataFrame, latency: DataFrame) -> DataFrame:
    """Fill ``processing_time_ms`` of scored rows from their micro-batch."""
    per_row = latency.select(
        "batch_id", F.round(F.col("duration_ms") / F.greatest(F.col("n_requests"), F.lit(1)), 2).alias("_ms"))
    j = responses.join(per_row, "batch_id", "left")
    ms = F.when(F.col("message") == MSG_OK, F.col("_ms")).otherwise(F.col("processing_time_ms"))
    return j.withColumn("processing_time_ms", ms).drop("_ms")
