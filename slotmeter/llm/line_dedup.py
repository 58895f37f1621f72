"""Line dedup over overlapping three-line windows, in DataFrame functions only.

A window is three consecutive lines. Each window is hashed to 128 bits; of all windows with one
hash only the first (smallest document id, then text hash, then position) stays. The positions that
later windows cover are merged to runs of lines, and those runs are removed from their texts.

Only hashes and positions are shuffled to find repeats: one partial aggregate per hash (a window
that a third of all rows share is combined before the shuffle) and one join that adaptive execution
can split. Texts move once, to meet the runs of their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import replaced


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """All columns of ``docs`` with the text replaced by its kept lines, plus n_lines and n_removed.

    Lines end at line feeds and are compared exactly. Texts of fewer than ``window`` lines have no
    window and stay as they are; a null text has no lines and stays null; an empty text has one
    line. A text whose lines all go becomes empty. Rows with equal id and text are one document and
    get the same result; null ids come before all others. Empty input gives an empty result.
    """
    columns = docs.columns
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col] or [F.lit(0).alias("_")]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
        F.col(f"`{text_col}`").alias("text"),
    )
    n = F.size(F.split("text", "\n", -1))
    shifted = [F.slice(F.split("text", "\n", -1), F.lit(k + 1), F.greatest(n - window + 1, F.lit(0))) for k in range(window)]
    found = base.where(F.col("text").isNotNull() & (n >= window)).select("id", "th", F.posexplode(F.arrays_zip(*[s.alias(f"l{k}") for k, s in enumerate(shifted)])).alias("pos", "w"))
    lines = [F.col(f"w.l{k}") for k in range(window)]
    hashed = found.select("id", "th", "pos", F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit("second"), *reversed(lines)).alias("h2"))
    at = F.struct("id", "th", "pos")
    first = hashed.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = hashed.join(first.hint("merge"), ["h1", "h2"]).where(at > F.col("first"))
    # sorted starts of removed windows; a run ends where the next start leaves a gap
    covered = later.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.expr(f"filter(p, (x, i) -> i = 0 or x - p[i - 1] > {window})")
    ends = F.expr(f"transform(filter(p, (x, i) -> i = size(p) - 1 or p[i + 1] - x > {window}), x -> x + {window - 1})")
    runs = covered.select(F.col("id").alias("rid"), F.col("th").alias("rth"), starts.alias("starts"), ends.alias("ends"))
    split = base.select("row", "id", "th", F.split("text", "\n", -1).alias("lines"))
    both = split.join(runs.hint("merge"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    both = both.select("row", "lines", "starts", "ends", F.when(F.col("starts").isNotNull(), _segments()).alias("segments"))
    text = F.when(F.col("starts").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.expr("transform(segments, s -> array_join(slice(lines, s.a + 1, s.b - s.a), '\\n'))"), "\n"))
    removed = F.coalesce(F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a + 1), 0, (s, x) -> s + x)"), F.lit(0))
    n_lines = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines"))
    new = {text_col: text, "n_lines": n_lines.cast("long"), "n_removed": removed.cast("long")}
    return both.select(*replaced(columns, new))


def _segments():
    """Kept runs [a, b) between the removed ones; empty ones are left out."""
    a = F.concat(F.array(F.lit(0)), F.transform("ends", lambda x: x + 1))
    b = F.concat(F.col("starts"), F.array(F.size("lines")))
    return F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda s: s["b"] > s["a"])
