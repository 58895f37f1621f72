"""Significance of paired outcomes, as expressions on counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Discordant pairs below which the exact binomial is taken; significance marks.
EXACT_BELOW = 25
FLIPS = 10_000
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def _erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by its series up to 3 and its continued fraction beyond."""
    series = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.struct(F.lit(0.0).alias("s"), x.alias("t")), lambda a, n: F.struct((a["s"] + a["t"] / (2 * n + 1)).alias("s"), (-a["t"] * x * x / (n + 1)).alias("t")))["s"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: (k / 2.0) / (x + a))
    root_pi = 1.7724538509055159
    return F.when(x < 3, 1 - 2 / root_pi * series).otherwise(F.exp(-x * x) / (root_pi * (x + fraction)))


def chi2_p(chi2: Column) -> Column:
    """P(X >= chi2) with one degree of freedom."""
    return _erfc(F.sqrt(chi2 / 2))


def binomial_p(k: Column, n: Column) -> Column:
    """Two-sided exact p of k of n at a half: all outcomes that are not likelier than k."""
    choose = lambda j: F.aggregate(F.when(j > 0, F.sequence(F.lit(1), j.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (n - j + i) / i)
    own = choose(k)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda j: choose(j)), F.lit(0.0), lambda a, c: a + F.when(c <= own * (1 + 1e-7), c).otherwise(0.0))
    return F.least(total / F.pow(F.lit(2.0), n), F.lit(1.0))


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """The p-value of paired outcomes: exact under 25 discordant pairs, else of the corrected chi-square; 1 without any."""
    n = a_only + b_only
    chi2 = F.pow((F.abs(a_only - b_only) - 1).cast("double"), F.lit(2.0)) / n
    return F.when(n == 0, 1.0).when(n < EXACT_BELOW, binomial_p(a_only, n)).otherwise(chi2_p(chi2))


def stars(p: Column) -> Column:
    out = F.when(p < STARS[0][0], STARS[0][1])
    for cut, mark in STARS[1:]:
        out = out.when(p < cut, mark)
    return out.otherwise("n.s.")


def outcome_patterns(rows: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """(right, given, n): how many keys have the outcomes ``right`` of the methods ``given``, as bits in the order of ``methods``.

    rows: keys, method, ok (0, 1 or boolean; null: not given); of repeated outcomes one that is right counts.
    One row a key is all that is shuffled; what comes out has at most 4 ** len(methods) rows, whatever the input.
    """
    if len(methods) > 62:
        raise ValueError("at most 62 methods")
    bit = F.lit(None).cast("long")
    for k, m in reversed(list(enumerate(methods))):
        bit = F.when(F.col("method") == m, F.lit(1 << k)).otherwise(bit)
    known = rows.where(F.col("method").isin(*methods) & F.col("ok").isNotNull()).withColumn("_bit", bit)
    each = known.groupBy(*keys).agg(F.coalesce(F.bit_or(F.when(F.col("ok").cast("boolean"), F.col("_bit"))), F.lit(0)).alias("right"), F.bit_or("_bit").alias("given"))
    return each.groupBy("right", "given").agg(F.count(F.lit(1)).alias("n"))


def method_pairs(patterns: DataFrame, methods: list[str]) -> DataFrame:
    """One row for each two methods, in order: accuracies, the table of paired outcomes, chi-square, p-values and stars.

    Counts only the keys that both methods have. statistic is the corrected chi-square (0 without discordant
    keys), p_value its p, p_exact the binomial below 25 discordant keys and p_value else; stars go by p_exact.
    """
    both = [F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.lit(1 << i).alias("x"), F.lit(1 << j).alias("y")) for i, a in enumerate(methods) for j, b in enumerate(methods) if i < j]
    each = patterns.select("right", "given", "n", F.inline(F.array(*both))).where((F.col("given").bitwiseAND(F.col("x")) > 0) & (F.col("given").bitwiseAND(F.col("y")) > 0))
    a, b = (F.col("right").bitwiseAND(F.col(c)) > 0 for c in "xy")
    cell = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    out = each.groupBy("method_a", "method_b").agg(F.sum("n").alias("n"), cell(a & b, "both_correct"), cell(a & ~b, "a_only"), cell(~a & b, "b_only"), cell(~a & ~b, "both_wrong"))
    off = F.col("a_only") + F.col("b_only")
    chi2 = F.when(off > 0, F.pow((F.abs(F.col("a_only") - F.col("b_only")) - 1).cast("double"), F.lit(2.0)) / off).otherwise(0.0)
    share = lambda c: F.round((F.col("both_correct") + F.col(c)) / F.col("n"), 6)
    out = out.withColumns({"a_acc": share("a_only"), "b_acc": share("b_only"), "n_discordant": off, "statistic": chi2})
    out = out.withColumns({"p_value": F.when(off > 0, chi2_p(F.col("statistic"))).otherwise(1.0), "p_exact": mcnemar_p(F.col("a_only"), F.col("b_only"))})
    return out.withColumn("stars", stars(F.col("p_exact")))


def signs(keys: np.ndarray, flips: int) -> np.ndarray:
    """Signs (+1, -1) of each key in each flip: bits of a hash of key and flip, the same wherever a row lies."""
    words = np.arange(-(-flips // 64), dtype=np.uint64)
    x = (keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[None] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(keys), -1), axis=1)[:, :flips]
    return bits.astype(np.int8) * 2 - 1


def permutation_test(diffs: DataFrame, flips: int = FLIPS) -> DataFrame:
    """n, mean and p of (key, diff): the share of sign flips whose mean is at least as far from 0.

    Each partition gives one partial sum for every flip, whatever its rows; only these meet.
    """
    diffs = diffs.where("key is not null and diff is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(flips)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                total += part["diff"].to_numpy(float) @ signs(part["key"].to_numpy(), flips)
        yield pd.DataFrame({"k": np.arange(flips), "s": total})

    totals = diffs.select("key", "diff").mapInPandas(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
    seen = diffs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("diff"), F.lit(0.0)).alias("seen"))
    both = totals.join(F.broadcast(seen))  # one row
    out = both.groupBy("n", "seen").agg(F.avg((F.abs("s") >= F.abs("seen") - 1e-9).cast("double")).alias("p"))
    return out.select("n", F.round(F.col("seen") / F.greatest("n", F.lit(1)), 6).alias("mean"), F.round("p", 6).alias("p"))
