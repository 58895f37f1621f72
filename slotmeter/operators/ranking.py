"""Ranking metrics over graded lists, as windows and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, query: str, score: str, tie: str, relevant) -> DataFrame:
    """(query, rank, rel, grade): one-based ranks by falling score, ties by ``tie``."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return rows.select(query, F.row_number().over(w).alias("rank"), relevant.cast("int").alias("rel"), "grade")


def reciprocal(rows: DataFrame, query: str) -> DataFrame:
    """(query, rr): the reciprocal of the first relevant rank, 0 without any."""
    first = rows.groupBy(query).agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    return first.select(query, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def average_precision(rows: DataFrame, query: str) -> DataFrame:
    """(query, ap): mean precision at the relevant ranks, 0 without any."""
    w = Window.partitionBy(query).orderBy("rank")
    hits = rows.withColumn("hits", F.sum("rel").over(w))
    return hits.groupBy(query).agg(F.coalesce(F.avg(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("ap"))


def precision(rows: DataFrame, query: str, cuts: tuple[int, ...]) -> DataFrame:
    """(query, n, p1.., p_all, r_precision): null where the list is shorter than the cut; precision through the last relevant."""
    at = [F.when(F.max("rank") >= k, F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / k).alias(f"p{k}") for k in cuts]
    last = F.max(F.when(F.col("rel") == 1, F.col("rank")))
    return rows.groupBy(query).agg(F.count(F.lit(1)).alias("n"), *at, F.avg("rel").alias("p_all"), F.coalesce(F.sum("rel") / last, F.lit(0.0)).alias("r_precision"))


def _dcg(rank, k: int | None, classic: bool):
    discount = F.when(rank == 1, 1.0).otherwise(F.log2(rank)) if classic else F.log2(rank + 1)
    gain = F.col("grade") / discount
    return F.sum(gain if k is None else F.when(rank <= k, gain).otherwise(0.0))


def _ideal(query: str):
    return F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), "rank"))


def ndcg(rows: DataFrame, query: str, k: int, classic: bool) -> DataFrame:
    """(query, ndcg): the classic discount leaves rank 1 and divides by log2(rank) after; the other divides by log2(rank + 1)."""
    both = rows.withColumn("ideal", _ideal(query)).groupBy(query).agg(_dcg(F.col("rank"), k, classic).alias("got"), _dcg(F.col("ideal"), k, classic).alias("best"))
    return both.select(query, F.coalesce(F.try_divide("got", "best"), F.lit(0.0)).alias("ndcg"))


def summary(rows: DataFrame, query: str, cuts: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row of means over all queries: reciprocal rank, average precision, precision and classic NDCG at each cut and over whole lists.

    A list shorter than a cut does not count at that cut, whose number of lists is ``p<k>_n``. One
    shuffle by query serves all measures; without any list every mean is 0.
    """
    last = F.max(F.when(F.col("rel") == 1, F.col("rank")))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    long = lambda k, c: F.when(F.max("rank") >= k, c)
    gain = lambda k: or_zero(F.try_divide(_dcg(F.col("rank"), k, True), _dcg(F.col("ideal"), k, True)))
    each = {
        "mrr": or_zero(1 / F.min(F.when(F.col("rel") == 1, F.col("rank")))),
        "map": or_zero(F.avg(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")))),
        "r_precision": or_zero(F.sum("rel") / last),
        **{f"p{k}": long(k, F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / k) for k in cuts},
        "p_all": F.avg("rel"),
        **{f"ndcg{k}": long(k, gain(k)) for k in cuts},
        "ndcg_all": gain(None),
        "mean_candidates": F.count(F.lit(1)),
    }
    hits = F.sum("rel").over(Window.partitionBy(query).orderBy("rank"))
    lists = rows.withColumns({"hits": hits, "ideal": _ideal(query)}).groupBy(query).agg(*[c.alias(n) for n, c in each.items()])
    numbers = [F.count(F.lit(1)).alias("n_queries"), *[F.count(f"p{k}").alias(f"p{k}_n") for k in cuts]]
    return lists.agg(*numbers, *[or_zero(F.avg(n)).alias(n) for n in each])
