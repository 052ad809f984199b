"""Resumable batch scoring (B1) and scoring over an arriving file stream (B2).

B1: rows are assigned to ``n_batches`` by a hash of their key and the input
is staged once, partitioned by batch (so a batch reads only its own
partition); each batch's result is written to its own folder under the
output path and is complete once its ``_SUCCESS`` marker exists.  A rerun skips finished batches
(``do_load_cp``), so a job that lost executors or was killed resumes where
it stopped.  All of a run lies in a folder named by its input, key and
batch count, so nothing stale is taken up.  The result is one
``spark.read.parquet`` over the run's batch folders (partition column
``batch``).  Batches are independent distributed jobs; ``n_jobs`` of them run
at a time.

B2: the same scorer as a Structured Streaming query: files that arrive in
a folder are scored per micro-batch (``foreachBatch``) and written to one
parquet folder per epoch; the checkpoint location records progress and a
replayed epoch overwrites its own folder, so output is exactly-once
(``availableNow`` processes everything present, then stops).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_folder(data: DataFrame, out_path: str, n_batches: int, key_col: str) -> str:
    """The folder of this run below ``out_path``.  Its name holds the batch
    count, the key and a fingerprint of the input (row count and an
    order-free sum of row hashes), so batches of another input or another
    split are never taken for this one's."""
    n, total = data.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)"))).first()
    name = hashlib.md5(f"{n_batches}|{key_col}|{data.schema.simpleString()}|{n}|{total}".encode()).hexdigest()
    return os.path.join(out_path, f"run-{name}")


def finished_batches(spark: SparkSession, run_path: str, n_batches: int) -> list[int]:
    """Batch ids whose folder has a ``_SUCCESS`` marker (works on any
    Hadoop file system, e.g. the cluster's shared storage)."""
    done = []
    for b in range(n_batches):
        p, fs = _hadoop_path(spark, os.path.join(run_path, f"batch={b}", "_SUCCESS"))
        if fs.exists(p):
            done.append(b)
    return done


def score_in_batches(spark: SparkSession, data: DataFrame, score: Callable[[DataFrame], DataFrame],
                     out_path: str, n_batches: int = 10, key_col: str = "doc_id",
                     do_load_cp: bool = True, stop_after: int | None = None,
                     n_jobs: int = 1) -> DataFrame:
    """Score ``data`` in ``n_batches`` hash batches with checkpoints (B1).

    ``score`` maps a DataFrame of input rows to result rows keeping
    ``key_col``.  A run resumes only from batches of the same input, key and
    batch count (:func:`run_folder`); ``do_load_cp=False`` writes all of them
    anew.  ``n_jobs`` batches run at a time.  ``stop_after`` (tests) stops
    after that many new batches to simulate an interrupted run.  Returns the
    results of the finished batches of this run."""
    run = run_folder(data, out_path, n_batches, key_col)
    batch_of = F.pmod(F.xxhash64(F.col(key_col)), F.lit(n_batches)).cast("int")
    # stage the input once, partitioned by batch, so each batch reads only
    # its own partition instead of filtering the whole input again
    staged = os.path.join(run, "_input")
    marker, fs = _hadoop_path(spark, os.path.join(staged, "_SUCCESS"))
    if not (do_load_cp and fs.exists(marker)):
        data.withColumn("_batch", batch_of).write.mode("overwrite") \
            .partitionBy("_batch").parquet(staged)
    schema = StructType([*data.schema.fields, StructField("_batch", IntegerType())])
    keyed = spark.read.schema(schema).parquet(staged)
    done = set(finished_batches(spark, run, n_batches)) if do_load_cp else set()
    left = [b for b in range(n_batches) if b not in done][:stop_after]

    def one(b: int) -> None:
        part = score(keyed.where(F.col("_batch") == b).drop("_batch"))   # partition pruning
        part.write.mode("overwrite").parquet(os.path.join(run, f"batch={b}"))

    if n_jobs > 1:
        with ThreadPool(n_jobs) as pool:
            pool.map(one, left)
    else:
        for b in left:
            one(b)
    ready = sorted(done.union(left))
    return spark.read.option("basePath", run).parquet(*[os.path.join(run, f"batch={b}") for b in ready])


def score_stream(spark: SparkSession, in_path: str, schema: StructType,
                 score: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """Score an arriving folder of files (B2) with a stateless scorer and
    write an append-only parquet sink; returns the finished query."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(in_path)

    def write_epoch(batch_df: DataFrame, epoch_id: int) -> None:
        # a document is one input row, so per-document aggregates are
        # complete inside a micro-batch; overwriting the epoch folder makes
        # a replayed epoch idempotent (exactly-once output)
        score(batch_df).write.mode("overwrite").parquet(
            os.path.join(out_path, f"epoch={epoch_id}"))

    q = (stream.writeStream.foreachBatch(write_epoch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
