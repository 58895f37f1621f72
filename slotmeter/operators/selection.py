"""Selections: greedily by facility location, and pools drawn one after the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.operators.sampling import draw, ranked_in
from slotmeter.sources.work import written


def facility_location(kernel: DataFrame, k: int) -> DataFrame:
    """(topic, place, j, gain): k candidates of each topic, chosen greedily.

    kernel (topic, i, j, k): similarity of row i to candidate j. A round adds to each topic the candidate
    with the largest sum of max(k_ij - best so far of i, 0), the smallest of equal ones; one job a round.
    """
    spark, picks = kernel.sparkSession, None
    best = kernel.select("topic", "i").distinct().withColumn("best", F.lit(0.0))
    for place in range(1, k + 1):
        open_ = kernel if picks is None else kernel.join(picks.select("topic", "j").hint("merge"), ["topic", "j"], "left_anti")
        gains = open_.join(best.hint("merge"), ["topic", "i"]).groupBy("topic", "j").agg(F.round(F.sum(F.greatest(F.col("k") - F.col("best"), F.lit(0.0))), 6).alias("gain"))
        top = written(gains.groupBy("topic").agg(F.max(F.struct("gain", -F.col("j"))).alias("m")).select("topic", F.lit(place).alias("place"), (-F.col("m.col2")).alias("j"), "m.gain"))
        picks = top if picks is None else picks.unionByName(top)
        chosen = kernel.join(top.select("topic", "j").hint("merge"), ["topic", "j"]).select("topic", "i", "k")
        best = written(best.join(chosen.hint("merge"), ["topic", "i"], "left").select("topic", "i", F.greatest("best", F.coalesce("k", F.lit(0.0))).alias("best")))
    return picks


#: Rows and candidates that a cell holds on average; a task compares one cell at a time.
BLOCK = 2048
#: Similarities are whole multiples of 1 / UNIT, so that their sums do not depend on their order.
UNIT = 10**9


def _directions(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a direction."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    x = np.stack([np.asarray(v, float) for v in rows["v"]])
    most = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(most) & (most > 0)
    x = x[good] / most[good, None]
    return rows["i"].to_numpy()[good], x / np.sqrt((x * x).sum(axis=1))[:, None]


def _similar(i: np.ndarray, x: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = np.rint((x @ w.T + 1) / 2 * UNIT).astype(np.int64)
    k[i[:, None] == j[None, :]] = UNIT
    return k


def _cell_gains(rows: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """What each open candidate of a cell adds for the cell's rows."""
    (i, x), (j, w), (p, u) = _directions(rows), _directions(candidates[~candidates["picked"]]), _directions(candidates[candidates["picked"]])
    gain = np.zeros(len(j), np.int64)
    if len(i) and len(j):
        best = _similar(i, x, p, u).max(axis=1) if len(p) else np.zeros(len(i), np.int64)
        gain = np.maximum(_similar(i, x, j, w) - best[:, None], 0).sum(axis=0)
    return pd.DataFrame({"topic": candidates["topic"].iloc[:1].repeat(len(j)).to_numpy() if len(j) else [], "j": j, "gain": gain})


def facility_location_of_vectors(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(topic, place, j, gain): ``facility_location`` with the kernel (cosine + 1) / 2, to nine decimals, 1 of a row with itself.

    vectors (topic, i, v, candidate): ids are whole numbers, unique in a topic. The kernel is nowhere stored: rows and candidates
    of a topic meet in a grid of cells of about ``block`` times ``block``, and a candidate's gain leaves a cell as
    one number. Vectors of other lengths add nothing to each other; null, zero or not finite ones stand for nothing
    and are not chosen.
    """
    known, picks = vectors.where("topic is not null and v is not null").withColumn("d", F.size("v")), None
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    sizes = written(known.groupBy("topic", "d").agg(blocks(F.count(F.lit(1))).alias("n_rows"), blocks(F.count_if("candidate")).alias("n_cands")))
    rows = known.join(F.broadcast(sizes), ["topic", "d"])
    cell, every = ["topic", "d", "a", "b"], lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    left = rows.select("topic", "d", own("n_rows").alias("a"), F.explode(every("n_cands")).alias("b"), "i", "v")
    for place in range(1, k + 1):
        cands = rows.where("candidate")
        cands = cands.withColumn("picked", F.lit(False)) if picks is None else cands.join(F.broadcast(picks.select("topic", F.col("j").alias("i"), F.lit(True).alias("picked"))), ["topic", "i"], "left").fillna(False, ["picked"])
        right = cands.select("topic", "d", "i", "v", "picked", "n_rows", F.explode(F.when(F.col("picked"), every("n_cands")).otherwise(F.array(own("n_cands")))).alias("b"))
        # both sides come from one table: columns of the same id would be ambiguous in cogroup
        right = right.select(F.explode(every("n_rows")).alias("a"), *[F.col(c).alias(c) for c in ("topic", "d", "b", "i", "v", "picked")])
        made = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_cell_gains, f"topic {known.schema['topic'].dataType.simpleString()}, j long, gain long")
        gains = made.groupBy("topic", "j").agg(F.round(F.sum("gain") / UNIT, 6).alias("gain"))
        top = written(gains.groupBy("topic").agg(F.max(F.struct("gain", -F.col("j"))).alias("m")).select("topic", F.lit(place).alias("place"), (-F.col("m.col2")).alias("j"), "m.gain"))
        picks = top if picks is None else picks.unionByName(top)
    return picks


def pool_sizes(train_k: int, dev_k: int, prompts: int = 4, inference: int = 5) -> list[tuple[str, int]]:
    """The pools of a training set, in the order in which they are drawn: prompts have ``prompts`` times their side's size."""
    return [("train", train_k), ("dev", dev_k), ("train_prompts", prompts * train_k), ("dev_prompts", prompts * dev_k), ("inference", inference)]


def draw_pools(rows: DataFrame, group: str, key: str, sizes: list[tuple[str, int]], seed: str, kernel: DataFrame | None = None, chosen: str = "train") -> DataFrame:
    """(key, group, pool): pools drawn from each group one after the other, each from what earlier ones left.

    Draws go by hash order. With ``kernel`` (topic, i, j, k) the pool ``chosen`` is taken first, greedily by
    facility location among the kernel's candidates j, which are keys; the others are drawn from the rest. A
    group that runs out leaves later pools short or empty. At most the sum of the sizes leaves a group's partitions.
    """
    taken = None
    if kernel is not None:
        picks = facility_location(kernel, dict(sizes)[chosen])
        taken = picks.select(F.col("j").alias(key), F.col("topic").alias(group), F.lit(chosen).alias("pool"))
        sizes = [(name, n) for name, n in sizes if name != chosen]
        rows = rows.join(taken.select(key, group).hint("merge"), [key, group], "left_anti")
    total, pool, end = sum(n for _, n in sizes), F.lit(None).cast("string"), 0
    for name, n in sizes:
        pool = F.when((F.col("k") > end) & (F.col("k") <= end + n), name).otherwise(pool)
        end += n
    drawn = ranked_in(rows.select(key, group), [group], [draw(seed, key), key]).where(F.col("k") <= total).select(key, group, pool.alias("pool"))
    return drawn if taken is None else taken.unionByName(drawn)
