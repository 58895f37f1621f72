"""Writers of metric tables, decision records, worklists and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_tsv(df: DataFrame, path: str, digits: int = 4) -> None:
    """A table with tabs and a header; doubles with a fixed number of digits."""
    columns = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def details_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def details_with_summary(details: DataFrame, summary: DataFrame, path: str, **facts: str | float) -> None:
    """Decision records under ``path``/examples and one object under ``path``/summary: ``facts`` beside the summary's rows.

    The records are written by all tasks; the summary is a table of methods, of a row each.
    """
    details_json(details, f"{path}/examples")
    one = summary.agg(F.collect_list(F.struct(*[f"`{c}`" for c in summary.columns])).alias("summary"))
    one.select(*[F.lit(v).alias(k) for k, v in facts.items()], "summary").coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def readable_record(record: str = "record") -> Column:
    """'slot[value, value], slot[value]' of an array column of (pos, slot, vals)."""
    one = F.transform(F.array_sort(record), lambda x: F.concat(x["slot"], F.lit("["), F.array_join(x["vals"], ", "), F.lit("]")))
    return F.array_join(one, ", ")


def worklist_blocks(rows: DataFrame) -> DataFrame:
    """(id, block): a block of text for each row of (id, source, experiment, style, mr, text), with lines to fill in."""
    head = F.concat(F.lit("=== ID: "), F.col("id").cast("string"), F.lit(" ===\nSource: "), "source", F.lit(" | Experiment: "), "experiment", F.lit(" | Personality: "), "style")
    body = F.concat(F.lit("\n\nMR: "), "mr", F.lit("\n\nGenerated text:\n"), "text", F.lit("\n\nHas error (YES/NO): ______\nError details: ______\n\n===\n"))
    return rows.select("id", F.concat(head, body).alias("block"))


def worklist_text(rows: DataFrame, path: str, instructions: str = "") -> None:
    """The blocks of all rows as text files; ``instructions`` stand before each file's first block."""
    blocks = worklist_blocks(rows)
    kept = blocks.sortWithinPartitions("id").select(F.when(F.monotonically_increasing_id() % (1 << 33) == 0, F.concat(F.lit(instructions), "block")).otherwise(F.col("block")).alias("value"))
    kept.write.mode("overwrite").text(path)


def by_part(df: DataFrame, path: str, *parts: str) -> None:
    """One folder of JSON files for each value of the part columns."""
    df.write.mode("overwrite").partitionBy(*parts).json(path)


def feature_tsv(df: DataFrame, path: str, keys: list[str]) -> None:
    """Features in key order with six digits."""
    metric_tsv(df.sort(*keys), path, digits=6)
