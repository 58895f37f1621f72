"""Shared helpers: scratch tables in the folder that all executors see, Arrow maps, column rules.

Column rule of all operators: a result column replaces an input column of the same name, and
helper columns travel inside a struct, so extra input columns can have any name.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local folder of our own only where none is configured and Spark runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder of tables between steps, under the shared folder."""
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's tables between steps; results that were not written yet cannot be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; Spark's cleaner removes it once the frame is garbage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema, rows: int | None = 1000, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function of one batch, cut to ``rows``; Spark bounds a batch by rows and bytes.

    ``after`` runs when a partition is done, for what a worker should not keep between stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows):
                yield from fn(batch.slice(at, rows) if rows else batch)
        if after:
            after()

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def replaced(base: list[str], new: dict[str, Column], row: str = "row") -> list[Column]:
    """The fields of struct column ``row`` in order, with ``new`` replacing equal names and the rest appended."""
    kept = [new[c].alias(c) if c in new else F.col(f"{row}.`{c}`").alias(c) for c in base]
    return kept + [v.alias(k) for k, v in new.items() if k not in base]
