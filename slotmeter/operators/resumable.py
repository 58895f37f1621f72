"""Scoring that can stop at any time: an append-only result table with a ledger of batches.

Under a path, ``results/batch=<n>`` has the scored rows of a batch and ``ledger/batch=<n>`` one row once
these are all there. Only batches of the ledger count. A batch that was cut off has no ledger row, so
the next run takes its number, writes over what it left, and scores its rows again; rows of finished
batches are never scored again, also where the next run is given more or other rows. One writer at a
time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotmeter.sources.work import written

_LEDGER = "rows long, run long, batch long"


def _there(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(rows, run, batch) of all finished batches; empty before the first."""
    if not _there(spark, f"{path}/ledger"):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of finished batches, of the DDL ``schema``, with batch and run."""
    done = ledger(spark, path).select("batch", "run")
    if not _there(spark, f"{path}/results"):
        return spark.createDataFrame([], f"{schema}, batch long, run long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/results")
    return rows.join(F.broadcast(done), "batch").select(*rows.columns, "run")  # a row for each batch; see batch_rows


def score_resumable(todo: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame], path: str, batch_rows: int = 1_000_000, stop_after: int | None = None) -> int:
    """Score the rows of ``todo`` whose keys no finished batch has; how many batches this run finished.

    ``score`` takes rows and gives a DataFrame with the keys and whatever is to be kept. Rows are dealt to
    batches of about ``batch_rows`` by a hash of the keys. Null keys are keys. Of rows with equal keys in
    ``todo`` all are scored, together. ``stop_after`` ends the run after so many batches.
    """
    spark = todo.sparkSession
    before = ledger(spark, path).agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("batch"), F.coalesce(F.max("run"), F.lit(0)).alias("run")).head()
    pending = todo
    if before["batch"] >= 0:
        done = ledger(spark, path).select("batch")
        key_types = ", ".join(f"`{k}` {todo.schema[k].dataType.simpleString()}" for k in keys)
        seen = spark.read.schema(f"{key_types}, batch long").parquet(f"{path}/results").join(F.broadcast(done), "batch", "left_semi")
        seen = seen.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= todo[k].eqNullSafe(seen[f"_k{i}"])
        pending = todo.join(seen.hint("merge"), same, "left_anti")
    dealt = written(pending.withColumn("_h", F.xxhash64(*[F.col(f"`{k}`") for k in keys])))
    n = dealt.count()
    batches = -(-n // batch_rows)
    finished = 0
    for part in range(batches):
        if stop_after is not None and finished >= stop_after:
            break
        number = before["batch"] + 1 + finished
        rows = dealt.where(F.pmod("_h", F.lit(batches)) == part).drop("_h")
        score(rows).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        kept = spark.read.parquet(f"{path}/results/batch={number}").count()
        spark.range(1).select(F.lit(kept).cast("long").alias("rows"), F.lit(before["run"] + 1).cast("long").alias("run")).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
        finished += 1
    return finished
