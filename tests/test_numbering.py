"""Two-pass numbering against one window a group, with a group of a third of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotmeter.operators import sampling
from slotmeter.operators.numbering import numbered


def test_same_numbers_and_totals_as_one_window(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.col("id") % 40)).alias("grp"), (F.col("id") * 7919 % 1000).alias("size"), F.lit("x").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(rows, ["grp"], [F.desc("size"), "id"], "k", "n")
        w = Window.partitionBy("grp")
        want = rows.withColumns({"k": F.row_number().over(w.orderBy(F.desc("size"), "id")), "n": F.count(F.lit(1)).over(w)})
        assert sorted(map(tuple, got.select("id", "k", "n").collect())) == sorted(map(tuple, want.select("id", "k", "n").collect()))
        assert got.columns == ["id", "grp", "size", "k", "n"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_is_numbered_by_all_tasks(spark):
    rows = spark.range(8000).select("id", F.lit("one").alias("grp"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = numbered(rows, ["grp"], ["id"])
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) >= 2 and placed.where("k = id + 1").count() == 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows_and_null_groups(spark):
    none = numbered(spark.range(0).withColumn("g", F.lit(1)), ["g"], ["id"], "k", "n")
    assert none.count() == 0 and none.columns == ["id", "g", "k", "n"]
    nulls = numbered(spark.range(5).withColumn("g", F.lit(None).cast("string")), ["g"], ["id"], "k", "n")
    assert sorted(map(tuple, nulls.select("id", "k", "n").collect())) == [(i, i + 1, 5) for i in range(5)]


def test_split_balance_and_hard_pool(spark):
    rows = spark.range(101).select("id", F.lit("a").alias("g"), (F.col("id") % 5).alias("label"), F.col("id").alias("size"))
    sides = {r["side"]: r["count"] for r in sampling.split(rows, ["g"], 0.5, "s", "id").groupBy("side").count().collect()}
    assert sides == {"dev": 50, "test": 51}
    labels = {r["label"]: r["count"] for r in sampling.balance(rows, "g", "label", 0, 30, "s", "id").groupBy("label").count().collect()}
    assert labels == {0: 21, 1: 20, 2: 20, 3: 20, 4: 20}
    assert sampling.balance(rows.where("label <> 0"), "g", "label", 0, 30, "s", "id").count() == 0
    pool = sampling.hard_pool(rows, ["g"], "size", 0.1, 4, "s", "id").collect()
    assert len(pool) == 4 and all(r["size"] >= 91 for r in pool)
