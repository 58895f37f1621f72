"""Splits, caps, quotas and picks. Random draws are hash-ordered: md5(seed || key), whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.operators.numbering import numbered


def draw(seed: str, *keys: str) -> Column:
    return F.md5(F.concat(F.lit(seed), *[F.concat(F.lit("|"), F.col(k).cast("string")) for k in keys]))


def ranked_in(df: DataFrame, group: list[str], order: list, name: str = "k") -> DataFrame:
    """``name`` is the row's place in its group; only for places that a constant bounds, which Spark then applies before the shuffle.

    ``numbering.numbered`` numbers whole groups.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def cap(df: DataFrame, group: list[str], n: int, seed: str, key: str) -> DataFrame:
    """At most n hash-chosen rows of each group."""
    return ranked_in(df, group, [draw(seed, key), key]).where(F.col("k") <= n).drop("k")


def split(df: DataFrame, strata: list[str], dev: float, seed: str, key: str) -> DataFrame:
    """Add side: the first floor(n * dev) hash-ordered rows of each stratum are dev, the rest test."""
    placed = numbered(df, strata, [draw(seed, key), key], "k", "n")
    return placed.withColumn("side", F.when(F.col("k") <= F.floor(F.col("n") * dev), "dev").otherwise("test")).drop("k", "n")


def hard_pool(df: DataFrame, group: list[str], size: str, share: float, n: int, seed: str, key: str) -> DataFrame:
    """Of the largest ``share`` of each group (one at least), n hash-chosen rows."""
    pool = numbered(df, group, [F.desc(size), key], "k", "total").where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("total") * share)))
    return cap(pool.drop("k", "total"), group, n, seed, key)


def quota(df: DataFrame, group: str, sub: str, n: int, seed: str, key: str) -> DataFrame:
    """n rows of each group spread evenly over its sub-sources, the remainder to the first ones, capped by what there is."""
    subs = df.select(group, sub).distinct()
    w = Window.partitionBy(group)
    subs = subs.withColumns({"j": F.row_number().over(w.orderBy(sub)), "m": F.count(F.lit(1)).over(w)})
    subs = subs.withColumn("want", F.floor(F.lit(n) / F.col("m")) + (F.col("j") <= n % F.col("m")).cast("int"))
    ranked = ranked_in(df, [group, sub], [draw(seed, key), key]).where(F.col("k") <= n)
    return ranked.join(subs.select(group, sub, "want"), [group, sub]).where(F.col("k") <= F.col("want")).drop("k", "want")


def balance(df: DataFrame, group: str, label: str, anchor: int, most: int, seed: str, key: str) -> DataFrame:
    """Each label of a group cut to the group's number of ``anchor`` labels, at most ``most``; none of those, nothing."""
    anchors = df.where(F.col(label) == anchor).groupBy(group).agg(F.count(F.lit(1)).alias("n_anchor"))
    few = ranked_in(df, [group, label], [draw(seed, key), key]).where(F.col("k") <= most)
    return few.join(anchors, group).where(F.col("k") <= F.col("n_anchor")).drop("k", "n_anchor")


def precedence(df: DataFrame, key: str) -> DataFrame:
    """One part for each key of (key, part): train wins over test, test over dev."""
    order = F.when(F.col("part") == "train", 0).when(F.col("part") == "test", 1).otherwise(2)
    return df.groupBy(key).agg(F.min_by("part", order).alias("part"))
