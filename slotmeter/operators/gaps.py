"""Reference values beside the first predicted value of their slot, and what tells real gaps from other wordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarity above which two values count as one in other words, and probability above which a text confirms a value.
ALIKE, CONFIRMED = 0.85, 0.5


def value_gaps(refs: DataFrame, preds: DataFrame, keys: list[str], similarity: Callable[[Column, Column], Column], entailment: Column) -> DataFrame:
    """One row per reference value: (refs' columns, want, got, exact, missing, mismatch, sim, entailed).

    ``refs`` and ``preds`` are slot tables; ``got`` is null where the slot was not predicted. ``sim``
    and ``entailed``, a column of ``refs``, are given for mismatches only and may be null there.
    """
    first = preds.select(*keys, "slot", F.element_at("vals", 1).alias("got"))
    both = refs.withColumn("want", F.explode("vals")).join(first.hint("merge"), [*keys, "slot"], "left")
    plain = lambda c: F.lower(F.trim(c))
    missing = F.col("got").isNull()
    exact = ~missing & (plain("got") == plain("want"))
    both = both.withColumns({"missing": missing, "exact": exact, "mismatch": ~missing & ~exact})
    return both.withColumns({"sim": F.when(F.col("mismatch"), similarity(F.col("want"), F.col("got"))), "entailed": F.when(F.col("mismatch"), entailment)})


def gap_table(gaps: DataFrame, *sets: list[str]) -> DataFrame:
    """Counts by each grouping set: values, exact, missing, mismatched; of these alike, confirmed, and neither."""
    names = sorted({c for s in sets for c in s})
    alike, confirmed = F.coalesce(F.col("sim") > ALIKE, F.lit(False)), F.coalesce(F.col("entailed") > CONFIRMED, F.lit(False))
    marks = {"exact": F.col("exact"), "missing": F.col("missing"), "mismatch": F.col("mismatch"), "alike": alike, "confirmed": confirmed, "both_low": F.col("mismatch") & ~alike & ~confirmed}
    grouped = gaps.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in marks.items()])


def gap_features(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Six features per key: mean and least entailment and similarity, 0.5 where nothing was scored; alike and confirmed values."""
    or_half = lambda c: F.coalesce(c, F.lit(0.5))
    return gaps.groupBy(*keys).agg(
        or_half(F.avg("entailed")).alias("mean_entailed"),
        or_half(F.min("entailed")).alias("min_entailed"),
        or_half(F.avg("sim")).alias("mean_sim"),
        or_half(F.min("sim")).alias("min_sim"),
        F.count_if(F.col("sim") > ALIKE).alias("n_alike"),
        F.count_if(F.col("entailed") > CONFIRMED).alias("n_confirmed"),
    )
