"""Verification and fusion: sentences from facts, recovered records, slot fusion, agreement, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.functions.values import canon_value, grade_ser
from slotmeter.operators import slots

PAIR = ["example_id", "neg_id"]


def best_candidate(scores: DataFrame, keys: list[str], latest: bool = True) -> DataFrame:
    """(keys, cand_idx, score) of the highest score; ties go to the later or the earlier index."""
    order = F.col("cand_idx") if latest else -F.col("cand_idx")
    return scores.groupBy(*keys).agg(F.max_by("cand_idx", F.struct("score", order)).alias("cand_idx"), F.max("score").alias("score"))


def recover(probs: DataFrame, keys: list[str], threshold: float | Column) -> DataFrame:
    """Slot table of the facts whose probability is above the threshold; values stay lists."""
    kept = probs.where(F.col("prob") > threshold)
    table = slots.slot_table(kept, keys).withColumn("is_list", F.lit(True))
    return table.withColumn("canon", canon_value(F.col("vals"), F.col("is_list")))


def slot_probability(probs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, prob): the last probability of each value, then the largest of the slot."""
    last = probs.groupBy(*keys, "slot", "value").agg(F.max_by("prob", F.struct("pos", "vpos")).alias("prob"))
    return last.groupBy(*keys, "slot").agg(F.max("prob").alias("prob"))


def fuse(extracted: DataFrame, given: DataFrame, probability: DataFrame, keys: list[str], reject: float = 0.15, add: float = 0.5) -> DataFrame:
    """Keep an extracted slot at ``reject`` or more, add a missing one at ``add`` or more, pass slots outside the record."""
    x = extracted.select(*keys, "slot", F.col("vals").alias("xv"), F.col("canon").alias("xc"))
    g = given.select(*keys, "slot", F.col("vals").alias("gv"), F.col("canon").alias("gc")).join(probability.hint("merge"), [*keys, "slot"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.5)))
    both = x.join(g, [*keys, "slot"], "full_outer")
    keep = F.col("gv").isNull() | (F.col("xv").isNotNull() & (F.col("prob") >= reject)) | (F.col("xv").isNull() & (F.col("prob") >= add))
    return both.where(keep).select(*keys, "slot", F.coalesce("xv", "gv").alias("vals"), F.when(F.col("xv").isNotNull(), F.col("xc")).otherwise(F.col("gc")).alias("canon"))


def method_counts(pairs: DataFrame, methods: dict[str, DataFrame], given: DataFrame) -> DataFrame:
    """Error counts of every method's record against the pair's own record: (pair, topic, method, s, d, i, m, n_ref, ser)."""
    names = list(methods)
    every = pairs.select(*PAIR, "topic", F.explode(F.array(*map(F.lit, names))).alias("method"))
    pred = None
    for name, table in methods.items():
        part = table.select(*PAIR, "slot", "vals", "canon", F.lit(name).alias("method"))
        pred = part if pred is None else pred.unionByName(part)
    ref = given.select(*PAIR, "slot", "vals", "canon", F.explode(F.array(*map(F.lit, names))).alias("method"))
    keys = [*PAIR, "method"]
    counted = slots.error_counts(every, slots.slot_join(pred, ref, keys), keys)
    return counted.join(pairs.select(*PAIR, "topic").hint("merge"), PAIR)


def agreement(counts: DataFrame) -> DataFrame:
    """(pair, topic, method, s_ok, d_ok, i_ok, all_ok, err, label) of each method against method 'gold'."""
    gold = counts.where("method = 'gold'").select(*PAIR, *[F.col(c).alias(f"g_{c}") for c in ("s", "d", "i", "ser")])
    both = counts.where("method <> 'gold'").join(gold.hint("merge"), PAIR)
    same = {c: F.col(c) == F.col(f"g_{c}") for c in "sdi"}
    flags = {f"{c}_ok": same[c].cast("int") for c in "sdi"} | {"all_ok": (same["s"] & same["d"] & same["i"]).cast("int")}
    out = both.withColumns(flags | {"err": F.col("g_ser") - F.col("ser"), "label": grade_ser(F.col("g_ser"))})
    return out.select(*PAIR, "topic", "method", *flags, "err", "label")


def tally(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Means of the agreement flags, MAE and MSE over grouping sets of columns."""
    columns = sorted({c for s in sets for c in s})
    aggs = [F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f"{c}_ok").cast("double")), 6).alias(f"{c}_acc") for c in ("s", "d", "i", "all")]]
    aggs += [F.round(F.avg(F.abs("err")), 6).alias("ser_mae"), F.round(F.avg(F.col("err") * F.col("err")), 6).alias("ser_mse")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggs)


def score_features(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top_score, score_gap, score_spread); gap and spread are 0 for a single candidate."""
    sorted_ = scores.groupBy(*keys).agg(F.sort_array(F.collect_list("score"), asc=False).alias("sc"))
    many = F.size("sc") > 1
    top = F.element_at("sc", 1)
    return sorted_.select(*keys, top.alias("top_score"), F.when(many, top - F.try_element_at("sc", F.lit(2))).otherwise(0.0).alias("score_gap"), F.when(many, top - F.element_at("sc", -1)).otherwise(0.0).alias("score_spread"))


def routed(rows: DataFrame, choice: Column) -> DataFrame:
    """Agreement rows of the routed method: choice 1 takes extraction, 0 verification."""
    return rows.withColumn("take", F.when(choice == 1, "extraction").otherwise("verification")).where("method = take").drop("take")


def first_best(grid: DataFrame, keys: list[str], metric: str, position: str) -> DataFrame:
    """The row of each key with the largest metric; of equal ones the first on the grid."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), F.asc(position)) if keys else None
    if w is None:
        return grid.orderBy(F.desc(metric), F.asc(position)).limit(1)
    return grid.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
