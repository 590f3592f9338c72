"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames and returns DataFrames.  ``get_spark`` is a convenience for
tests, benchmarks and scripts; on a cluster the session comes from the
platform and only the SQL settings below are applied.
"""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on.  AQE re-plans shuffles at
# runtime (coalescing small partitions, splitting skewed join partitions);
# Arrow is the transport for the few pandas-backed operators.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bounds what a Python worker holds at once, however long the texts are
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "redline") -> SparkSession:
    """Local/test session with the library defaults and the UI switched off."""
    master = master or os.environ.get("REDLINE_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("REDLINE_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in SQL_DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file
    system or object store); without one there is an error, since a folder of
    the driver's own machine would lose the executors' files.  Only a local
    session gets a folder of its own, removed when the process ends.
    """
    sc = spark.sparkContext
    cp = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        cp = tempfile.mkdtemp(prefix="redline-ckpt-")
        atexit.register(shutil.rmtree, cp, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cp)
    return cp.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions started where it is not installed."""
    root = pathlib.Path(__file__).resolve().parent
    out = pathlib.Path(tempfile.mkdtemp(prefix="redline-pkg-")) / "redline_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    atexit.register(shutil.rmtree, out.parent, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory name under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
