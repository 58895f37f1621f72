"""Decision units of routing under two protocols, their features and labels, as one table.

Protocol ``text``: a unit is an example; the true record is what methods and features see. Protocol
``pair``: a unit is an example with one record; only that record is seen. What a method gets right is
counted over the unit's pairs either way. Both protocols share their columns, so that features,
routers and reports are written once, with ``protocol`` and ``unit`` (the record's number, -1 for text) as keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.operators import verify as v

UNIT = ["protocol", "example_id", "unit"]
#: The features besides the topics, in order.
BASE = ["top_score", "score_gap", "score_spread", "n_gold_slots", "n_lora_slots", "slot_ratio", "mean_nli_prob", "min_nli_prob", "nli_coverage"]
#: Topics that become columns, at most.
MOST_TOPICS = 1000


def features(scores: Column, seen: Column, extracted: Column) -> list[Column]:
    """BASE, from a unit's scores (score, ..) from the best on, slots seen with their probabilities (slot, prob, ..), and its extracted record.

    Without seen slots mean and least probability are 0.5 and coverage 0; gap and spread are 0 for a single candidate.
    """
    top, probs, n, m = F.element_at(scores, 1)["score"], seen["prob"], F.size(seen), F.size(extracted)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / n
    made = {
        "top_score": top,
        "score_gap": F.coalesce(top - F.try_element_at(scores, F.lit(2))["score"], F.lit(0.0)),
        "score_spread": top - F.element_at(scores, -1)["score"],
        "n_gold_slots": n,
        "n_lora_slots": m,
        "slot_ratio": m / F.greatest(n, F.lit(1)),
        "mean_nli_prob": F.when(n > 0, mean(probs)).otherwise(0.5),
        "min_nli_prob": F.coalesce(F.array_min(probs), F.lit(0.5)),
        "nli_coverage": F.when(n > 0, mean(F.transform(probs, lambda p: (p > 0.5).cast("double")))).otherwise(0.0),
    }
    return [F.round(made[c].cast("double"), 6).alias(c) for c in BASE]


def topics_of(rows: DataFrame, column: str = "topic") -> list[str]:
    """The fitted dictionary of topics, in order; too many are an error, not a cut."""
    found = sorted(r[0] for r in rows.select(F.coalesce(column, F.lit("unknown"))).distinct().limit(MOST_TOPICS + 1).collect())
    if len(found) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    return found


def with_topics(rows: DataFrame, topics: list[str], column: str = "topic") -> DataFrame:
    """Add topic_<name> for each topic, 1.0 or 0.0; a topic outside the dictionary has zeros."""
    own = F.coalesce(column, F.lit("unknown"))
    return rows.withColumns({f"topic_{t}": (own == t).cast("double") for t in topics})


def labels(agreed: DataFrame) -> DataFrame:
    """(UNIT, n_pairs, lora_count, nli_count, label) of agreement rows (UNIT, method, all_ok): 1 if extraction is right at least as often."""
    right = lambda m: F.sum(F.when(F.col("method") == m, F.col("all_ok")).otherwise(0)).cast("long")
    out = agreed.groupBy(*UNIT).agg(F.count_if(F.col("method") == "extraction").alias("n_pairs"), right("extraction").alias("lora_count"), right("verification").alias("nli_count"))
    return out.withColumn("label", (F.col("lora_count") >= F.col("nli_count")).cast("int"))


def compared(agreed: DataFrame, choices: DataFrame, routers: list[str], sets: list[list[str]]) -> DataFrame:
    """Means of the agreement flags of the plain methods and of every router, over grouping sets.

    choices: UNIT and for each router a column with 1 (extraction) or 0 (verification). ``agreed`` carries
    the columns of ``sets``; it is read once, each row with the names under which it counts.
    """
    both = agreed.join(choices.select(*UNIT, *routers).hint("merge"), UNIT)
    own = (F.col("method") == "extraction").cast("int")
    named = F.array_compact(F.array(F.col("method"), *[F.when(F.col(r) == own, F.lit(r)) for r in routers]))
    return v.tally(both.withColumn("method", F.explode(named)), sets)
