"""Numbers and totals inside groups of any size, in two passes.

Rows are dealt by ranges of (group, order), so a large group is many tasks. The first pass counts
the rows of each group in each range; running sums of these counts are where a range begins. The
second numbers the rows of each (group, range). Only groups that reach over a range's border need a
beginning or a total from outside: at most two rows for each range, which is what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.sources.work import written


def numbered(df: DataFrame, group: list[str], order: list[Column | str], name: str = "k", total: str | None = None) -> DataFrame:
    """``df`` with ``name``, the row's place from 1 in its group by ``order``, and ``total``, the group's rows.

    ``order`` should tell all rows of a group apart; equal rows get different places in any order.
    Null is a group of its own. The ranges are written once, so both passes see the same ones.
    """
    keys = [F.col(f"`{g}`") for g in group]
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(all_.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = counts.select(*[k.alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(all_).alias("_total"), F.col("_n").alias("_own"))
    wide = wide.where("_total > _own").drop("_own")
    own = Window.partitionBy(*keys, "_range")
    placed = ranged.withColumns({"_k": F.row_number().over(own.orderBy(*order)), "_all": F.count(F.lit(1)).over(own)})
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= k.eqNullSafe(F.col(f"_g{i}"))
    new = [(F.col("_k") + F.coalesce("_before", F.lit(0))).alias(name)]
    if total:
        new.append(F.coalesce("_total", "_all").alias(total))
    return placed.join(F.broadcast(wide), same, "left").select(*[f"`{c}`" for c in df.columns if c not in (name, total)], *new)
