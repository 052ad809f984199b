"""Spark session and shared-folder helpers.

On a cluster the session is created by the caller and ``spark.checkpoint.dir``
names a shared folder; we only read it.  Tests and the local bench create
their own session and point the checkpoint folder at a fresh scratch
directory, because nothing else sets it there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lexmesh", driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        # Only reached in tests / local runs: no cluster folder is configured.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexmesh-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "lexmesh-tables", f"{name}-{uuid.uuid4().hex[:12]}")


#: Shuffle files of a query go when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that are run within leave no shuffle files: what they write is read from then on."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def discard(df) -> None:
    """Delete the files of a table below the shared checkpoint folder that nothing reads any more."""
    spark = df.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), "lexmesh-tables", "")
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet below the shared checkpoint folder and read
    it back: the lineage is cut and the table survives executor loss.

    Used for fitted, reused tables (vocabulary, word vectors, training
    scores) so later actions read them instead of recomputing the corpus
    pass.  One job (``Dataset.checkpoint`` would compute the plan twice
    without a cache), and the parquet copy is columnar, so later readers
    prune columns and push filters."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
