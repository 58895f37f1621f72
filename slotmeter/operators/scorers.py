"""Batch functions of a caller (scorers, generators, embedders) over distinct inputs, joined back to all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.sources.work import written


def _batched(distinct: DataFrame, fn: Callable[[pd.DataFrame], list], out: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: fn(b)})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInPandas(run, f"{columns}, {out} {kind}")


def score_batches(pairs: DataFrame, scorer, keys: list[str], columns: tuple[str, str] = ("premise", "hypothesis")) -> DataFrame:
    """(keys, prob): each distinct pair is scored once, in batches, by a function of two series."""
    scored = _batched(pairs.select(*columns).distinct(), lambda b: scorer(b[columns[0]], b[columns[1]]), "prob", "double")
    return pairs.join(scored.hint("shuffle_hash"), list(columns)).select(*keys, "prob")


#: How a candidate's prompt shows a reference: the true record, the pair's own, or none.
MODES = ("gold", "pair", "blank")


def score_candidates(candidates: DataFrame, scorer, keys: list[str], mode: str) -> DataFrame:
    """(keys, scores): candidate scores in index order.

    candidates: keys, cand_idx, text, mr, gold, pair; mode says which reference the prompt shows.
    ``scorer`` takes a series of prompts and gives numbers.
    """
    shown = F.lit("") if mode == "blank" else F.coalesce(F.col(mode), F.lit(""))
    prompts = candidates.select(*keys, "cand_idx", F.concat(F.lit("Text:\n"), "text", F.lit("\nMR:\n"), "mr", F.lit("\nReference:\n"), shown, F.lit("\nScore:\n")).alias("prompt"))
    scored = _batched(prompts.select("prompt").distinct(), lambda b: scorer(b["prompt"]), "score", "double")
    each = prompts.join(scored.hint("shuffle_hash"), "prompt")
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cand_idx", "score"))).alias("v")).select(*keys, F.col("v.score").alias("scores"))


def generate(prompts: DataFrame, generator: Callable[[str, int], list[str]], keys: list[str], k: int) -> DataFrame:
    """(keys, completions): at most k completions of column prompt; a prompt on which the generator fails has none."""

    def attempt(prompt: str) -> list[str]:
        try:
            return list(generator(prompt, k))[:k]
        except Exception:
            return []

    made = _batched(prompts.select("prompt").distinct(), lambda b: [attempt(p) for p in b["prompt"]], "completions", "array<string>")
    return prompts.join(made.hint("shuffle_hash"), "prompt").select(*keys, "completions")


def embed(texts: DataFrame, embedder, column: str = "text") -> DataFrame:
    """(text, vector): unit vectors of the distinct non-null texts; ``embedder`` takes a series and gives rows."""
    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    made = _batched(distinct, lambda b: [list(map(float, v)) for v in embedder(b["text"])], "vector", "array<double>")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return made.select("text", F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"))


#: Rows among which a pair of texts is looked up once.
CHUNK = 200_000


def similarities(pairs: DataFrame, embedder) -> DataFrame:
    """``pairs`` (a, b, ...) with ``similarity``, the cosine of their texts; 0 where a text is null. Each distinct text is embedded once.

    Rows are dealt to chunks of about ``CHUNK``. A chunk asks once for each of its texts and pairs, and all joins are
    by chunk, so a text that very many rows have is never one task; vectors meet distinct pairs only, not rows.
    """
    rows, own = written(pairs), pairs.columns
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(*own), F.lit(rows.count() // CHUNK + 1)))
    asked = written(dealt.where("a is not null and b is not null").select("chunk", "a", "b").distinct())
    texts = asked.select("chunk", F.explode(F.array("a", "b")).alias("text")).distinct()
    told = written(texts.join(written(embed(texts, embedder)).hint("merge"), "text"))
    named = lambda c: told.select("chunk", F.col("text").alias(c), F.col("vector").alias(f"v{c}")).hint("merge")
    found = asked.join(named("a"), ["chunk", "a"]).join(named("b"), ["chunk", "b"]).select("chunk", "a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity"))
    return dealt.join(found.hint("merge"), ["chunk", "a", "b"], "left").select(*own, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
