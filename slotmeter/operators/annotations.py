"""Error notation, annotated errors and agreement with human counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.functions.values import strip


def parse_errors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, seq, type, slot, value) of 'D:slot, S:slot=v, I:slot=v'; parts that do not parse are skipped."""
    parts = df.select(*keys, F.posexplode(F.split(text, ",")).alias("seq", "part")).withColumn("part", strip(F.col("part")))
    kind, rest = F.substring_index("part", ":", 1), F.substr("part", F.instr("part", ":") + 1)
    slot, has = F.substring_index(rest, "=", 1), F.contains(rest, F.lit("="))
    value = F.substr(rest, F.instr(rest, "=") + 1)
    sound = F.contains("part", F.lit(":")) & kind.isin("D", "S", "I") & (slot != "") & ~slot.rlike(r"\W") & (~has | (value != ""))
    return parts.where(sound).select(*keys, "seq", kind.alias("type"), slot.alias("slot"), F.when(has, value).alias("value"))


def apply_errors(table: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, value) after deletions, substitutions and insertions in order; the last write of a slot counts."""
    base = table.select(*keys, "slot", F.lit(-1).alias("seq"), F.array_join("vals", ", ").alias("value"), F.lit("S").alias("type"))
    every = base.unionByName(errors.select(*keys, "slot", "seq", "value", "type"))
    w = Window.partitionBy(*keys, "slot").orderBy(F.desc("seq"))
    last = every.withColumn("k", F.row_number().over(w)).where("k = 1")
    return last.where("type <> 'D'").select(*keys, "slot", "value")


def gold_counts(every: DataFrame, errors: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, d, i, n_ref, ser) from annotated errors and record sizes."""
    n = lambda t: F.count_if(F.col("type") == t).alias(t.lower())
    counted = errors.groupBy(*keys).agg(n("S"), n("D"), n("I"))
    out = every.select(*keys).join(counted.hint("merge"), keys, "left").join(sizes.hint("merge"), keys, "left").fillna(0, ["s", "d", "i", "n_ref"])
    return out.withColumn("ser", F.round((F.col("s") + F.col("d") + F.col("i")).cast("double") / F.greatest("n_ref", F.lit(1)), 6))


def spans_shortest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of spans (keys, start, end, text): the shortest of each start, then the shortest of each end."""
    for edge in ("start", "end"):
        w = Window.partitionBy(*keys, edge).orderBy(F.length("text"), "start", "end", "text")
        spans = spans.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return spans
