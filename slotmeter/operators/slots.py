"""Slot tables: from facts to one row per slot, between written forms, and the slot join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.functions.values import canon_value, strip, value_equal


def slot_table(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and slot: pos, values in order, is_list, and the canonical value."""
    grouped = facts.groupBy(*keys, "slot").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "vpos", "value"))).alias("v"))
    table = grouped.select(*keys, "slot", "pos", F.col("v.value").alias("vals"), (F.size("v") > 1).alias("is_list"))
    return table.withColumn("canon", canon_value(F.col("vals"), F.col("is_list")))


def flatten(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, slot, vpos, value) of a slot table; null values are skipped."""
    return table.select(*keys, "pos", "slot", F.posexplode("vals").alias("vpos", "value")).where("value is not null").withColumn("vpos", F.col("vpos") + 1)


def dedup_values(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts whose value was not seen before in the record, under whatever slot."""
    w = Window.partitionBy(*keys, "value").orderBy("pos", "vpos")
    return facts.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def write_record(table: DataFrame, keys: list[str], delimiters: bool = False) -> DataFrame:
    """(keys, mr): '(slot: v1; v2); (slot2: v)' in slot order."""
    one = F.concat(F.lit("("), F.col("slot"), F.lit(": "), F.array_join("vals", "; "), F.lit(")"))
    joined = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))).alias("v"))
    text = F.array_join(F.col("v.t"), "; ")
    return joined.select(*keys, (F.concat(F.lit("<LIST>"), text, F.lit("</LIST>")) if delimiters else text).alias("mr"))


def parse_record(df: DataFrame, keys: list[str], text: str = "mr", allowed: list[str] | None = None) -> DataFrame:
    """(keys, pos, slot, vpos, value) of a written record.

    Text through the first '>(' goes, '</List>' or a next '<LIST>' ends it; parts without a colon are
    skipped; repeated slots append; one trailing ')' goes and ' ,' becomes ','.
    """
    t = F.col(text)
    t = F.when(F.instr(t, ">(") > 0, F.substr(t, F.instr(t, ">(") + 2)).otherwise(t)
    for stop in ("</List>", "<LIST>"):
        t = F.substring_index(t, stop, 1)
    parts = df.select(*keys, F.posexplode(F.split(t, r"\); \(")).alias("part", "sv")).where(F.contains("sv", F.lit(":")))
    slot = strip(F.substring_index("sv", ":", 1))
    slot = F.when(F.startswith(slot, F.lit("(")), strip(F.substr(slot, F.lit(2)))).otherwise(slot)
    vals = strip(F.substr("sv", F.instr("sv", ":") + 1))
    found = parts.select(*keys, "part", slot.alias("slot"), F.posexplode(F.split(vals, ";")).alias("k", "value"))
    value = strip(F.col("value"))
    value = F.when(F.endswith(value, F.lit(")")), F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    found = found.withColumn("value", F.replace(value, F.lit(" ,"), F.lit(",")))
    if allowed is not None:
        found = found.where(F.col("slot").isin(allowed))
    w = Window.partitionBy(*keys, "slot").orderBy("part", "k")
    first = F.min("part").over(Window.partitionBy(*keys, "slot"))
    return found.select(*keys, first.alias("pos"), "slot", F.row_number().over(w).alias("vpos"), "value")


def slot_join(pred: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, kind, pred_vals, ref_vals): M match, S substitution, D deletion, I insertion."""
    on = [*keys, "slot"]
    p = pred.select(*on, F.col("vals").alias("pred_vals"), F.col("canon").alias("p"))
    r = ref.select(*on, F.col("vals").alias("ref_vals"), F.col("canon").alias("r"))
    kind = F.when(F.col("p").isNull(), "D").when(F.col("r").isNull(), "I").when(value_equal(F.col("p"), F.col("r")), "M").otherwise("S")
    return p.join(r.hint("merge"), on, "full_outer").select(*on, kind.alias("kind"), "pred_vals", "ref_vals")


def error_counts(every: DataFrame, joined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, d, i, m, n_ref, ser) for every key, also those without any slot."""
    n = lambda kinds: F.count_if(F.col("kind").isin(*kinds))
    counted = joined.groupBy(*keys).agg(*[n(k).alias(k.lower()) for k in "SDIM"])
    out = every.select(*keys).join(counted.hint("merge"), keys, "left").fillna(0, ["s", "d", "i", "m"])
    out = out.withColumn("n_ref", F.col("s") + F.col("d") + F.col("m"))
    return out.withColumn("ser", F.round((F.col("s") + F.col("d") + F.col("i")).cast("double") / F.greatest("n_ref", F.lit(1)), 6))


def slot_f1(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1); a wrong value counts in both fp and fn."""
    out = counts.select(*keys, F.col("m").alias("tp"), (F.col("s") + F.col("i")).alias("fp"), (F.col("s") + F.col("d")).alias("fn"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})
