"""Running totals over a stream, kept as files of its micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_kinds(compared: DataFrame) -> DataFrame:
    """(kind) of compared slots (kind, more): S, D and I as they are, and a repetition where more values stand than should."""
    kinds = F.array_compact(F.array(F.when(F.col("kind") != "M", F.col("kind")), F.when(F.col("more"), F.lit("repetition"))))
    return compared.select(F.explode(kinds).alias("kind"))


def running_totals(stream: DataFrame, key: str, place: str) -> DataFrame:
    """(key, n): how often each key came, over all that is there now; a later call with the same ``place`` goes on from it.

    Each micro-batch gives the new totals, which foreachBatch writes as files under the batch's number, so nothing
    is held on the driver and a repeated batch overwrites itself. The newest totals are the result; without rows, none.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    counted = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def keep(totals: DataFrame, number: int) -> None:
        totals.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.range(0).select(F.lit(None).cast(kind).alias(key), F.col("id").alias("n")).write.mode("append").parquet(f"{place}/out/batch=-1")
    every = spark.read.schema(f"{key} {kind}, n long, batch long").parquet(f"{place}/out")
    return every.groupBy(key).agg(F.max_by("n", "batch").alias("n"))
