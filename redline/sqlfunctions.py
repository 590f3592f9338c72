"""The library's operators as SQL functions.

``register(spark)`` makes them known to a session:

* ``edit_tags(TABLE(SELECT key, original_tokens, corrected_tokens ...))`` -- one
  row a token: ``pair_id, pos, token, tag``; an Arrow table function that aligns
  a whole batch of pairs at once;
* ``align_tokens(original, corrected)`` -- ``struct(tags, gap_tags)``;
* ``word_distance(a, b)`` and ``common_length(a, b)`` of token arrays;
* ``tag_argument(tag)`` and ``apply_tags(tokens, tags)`` -- SQL all the way, so
  the optimizer sees through them.

Null arrays give no rows in ``edit_tags`` and null elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.bitvectors import common_length, word_distance
from .functions.blocks import align_batch
from .functions.tags import DELETE, KEEP, REPLACE
from .operators.align import _align_udf, align_tokens


@F.arrow_udtf(returnType="pair_id long, pos int, token string, tag string")
class EditTags:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        key, orig, corr = (batch.column(i) for i in range(3))
        tags = align_batch(orig, corr, align_tokens)
        here = np.flatnonzero(tags.is_valid().to_numpy(zero_copy_only=False))
        if len(here) < len(tags):
            orig, tags = orig.take(pa.array(here)), tags.take(pa.array(here))
        tags = tags.field("tags")
        n = np.diff(orig.offsets.to_numpy())
        row = np.repeat(here, n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.table({"pair_id": key.take(pa.array(row)).cast(pa.int64()), "pos": pa.array(pos.astype(np.int32)), "token": orig.flatten(), "tag": tags.flatten()})


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; again and again if need be."""
    spark.udtf.register("edit_tags", EditTags)
    for name, f in (("align_tokens", _align_udf), ("word_distance", word_distance), ("common_length", common_length)):
        spark.udf.register(name, f)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION tag_argument(tag STRING) RETURNS STRING
                 RETURN CASE WHEN instr(tag, '_') > 0 THEN substr(tag, instr(tag, '_') + 1) ELSE '' END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION apply_tags(tokens ARRAY<STRING>, tags ARRAY<STRING>) RETURNS STRING
                  RETURN array_join(filter(zip_with(tokens, tags, (x, t) -> CASE
                      WHEN x IS NULL OR t IS NULL OR t = '{DELETE}' THEN NULL WHEN t = '{KEEP}' THEN x
                      WHEN startswith(t, '{REPLACE}') THEN substr(t, {len(REPLACE) + 1}) ELSE x END), x -> x IS NOT NULL), ' ')""")
