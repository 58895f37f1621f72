"""Graded negatives: for each example the first record of a shuffled pool that hits each grade.

Records are packed to one row. The pool (of a topic, or of all) is numbered by hash and cut into chunks;
an example looks at a run of places from an offset of its own, so it meets two or three chunks. In a
(pool, chunk) group all its examples are compared with all the chunk's records at once, slot by slot,
as arrays; what leaves a group is at most one row for each example and grade. Groups have a bounded
number of records and, as offsets are spread evenly, of examples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.functions.values import F1_CUTS, SER_CUTS
from slotmeter.operators.numbering import numbered
from slotmeter.operators.sampling import draw

#: Records of a chunk, examples compared at once.
CHUNK, AT_ONCE = 1024, 512


def packed(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, record): the slots of each record in order, from a slot table."""
    one = F.struct("pos", "slot", "vals", F.col("canon.items").alias("items"), F.col("canon.multi").alias("multi"))
    return table.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("record"))


def _grades(x: np.ndarray, cuts: tuple) -> np.ndarray:
    out = np.zeros(x.shape, np.int8)
    for cut, grade in reversed(cuts):
        out[x >= cut] = grade
    return out


def _equal(refs: list[tuple], preds: list[tuple]) -> np.ndarray:
    """Which values (items, multi) are equal: sets as sets, a scalar with a set by containment."""
    out = np.zeros((len(refs), len(preds)), bool)
    at = {v: j for j, v in enumerate(preds)}
    scalars: tuple[dict, dict] = ({}, {})
    for side, values in zip(scalars, (refs, preds), strict=True):
        for k, (items, multi) in enumerate(values):
            if not multi:
                side[items[0]] = k
    for i, v in enumerate(refs):
        if v in at:
            out[i, at[v]] = True
        if v[1]:
            out[i, [scalars[1][x] for x in v[0] if x in scalars[1]]] = True
    for j, v in enumerate(preds):
        if v[1]:
            out[[scalars[0][x] for x in v[0] if x in scalars[0]], j] = True
    return out


def _by_slot(records: list[list[dict]]) -> dict[str, tuple[np.ndarray, list[tuple]]]:
    """For each slot, the number of each record's value (-1: it lacks the slot), and the values."""
    found: dict[str, tuple[np.ndarray, dict]] = {}
    for k, record in enumerate(records):
        for x in record:
            place, values = found.setdefault(x["slot"], (np.full(len(records), -1, np.int64), {}))
            value = (tuple(x["items"] or ()) or (None,), bool(x["multi"]))
            place[k] = values.setdefault(value, len(values))
    return {s: (place, list(values)) for s, (place, values) in found.items()}


def compare(refs: list[list[dict]], preds: list[list[dict]]) -> Iterator[tuple[slice, np.ndarray]]:
    """For portions of refs: counts (4, refs, preds) of matches, substitutions, deletions and insertions."""
    own, other = _by_slot(refs), _by_slot(preds)
    slots = sorted({*own, *other})
    pairs = {s: _equal(own[s][1], other[s][1]) for s in slots if s in own and s in other}
    for a in range(0, len(refs), AT_ONCE):
        part = slice(a, min(a + AT_ONCE, len(refs)))
        n = np.zeros((4, part.stop - a, len(preds)), np.int16)
        for s in slots:
            r = own[s][0][part] if s in own else np.full(part.stop - a, -1)
            p = other[s][0] if s in other else np.full(len(preds), -1)
            has_r, has_p = (r >= 0)[:, None], (p >= 0)[None]
            if s in pairs:
                same = pairs[s][r][:, p] & has_r & has_p
                n[0] += same
                n[1] += has_r & has_p & ~same
            n[2] += has_r & ~has_p
            n[3] += has_p & ~has_r
        yield part, n


def graded_negatives(records: DataFrame, rubric: str = "ser", pool: str | None = "topic", tries: int = 1001, seed: str = "pool", labels: tuple[int, ...] | None = None) -> DataFrame:
    """(example_id, label, try, source_id, s, d, i, record) of records (example_id, topic, record), by ``packed``.

    Each example looks at ``tries`` places of the pool (or all of a smaller one) from example_id * 13 on, and keeps
    the first record of each grade: 0 to 4 from 1 - SER (rubric ser) or 0 to 6 from slot F1 (rubric f1), those
    in ``labels`` if given. ``pool`` names the column whose equal values share a pool; None: all rows.
    The example is the reference and may meet itself. ``tries`` is at most CHUNK.
    """
    if tries > CHUNK:
        raise ValueError(f"at most {CHUNK} tries")
    group = [pool] if pool else []
    placed = numbered(records.select("example_id", *group, "record"), group, [draw(seed, "example_id"), "example_id"], "rn", None if not pool else "n")
    if pool:
        placed = placed.withColumn("g", F.col(pool).cast("string"))
    else:
        placed = placed.withColumns({"g": F.lit(""), "n": F.lit(records.count())})
    placed = placed.select("g", "example_id", "n", (F.col("rn") - 1).alias("rn"), "record")
    members = placed.select("g", F.floor(F.col("rn") / CHUNK).alias("chunk"), "rn", "example_id", "record").toDF("g", "chunk", "rn", "example_id", "record")  # columns of its own for the cogroup
    start = (F.col("example_id") * 13) % F.col("n")
    end = start + F.least(F.lit(tries), F.col("n")) - 1
    places = F.array(start, F.least(end, F.col("n") - 1), F.when(end >= F.col("n"), F.lit(0)), F.when(end >= F.col("n"), end - F.col("n")))
    chunks = F.array_distinct(F.transform(F.filter(places, lambda x: x.isNotNull()), lambda x: F.floor(x / CHUNK)))
    looking = placed.select("g", F.explode(chunks).alias("chunk"), "example_id", "n", start.alias("start"), "record")

    def first_of_each(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n, start = (left.column(c).to_numpy() for c in ("example_id", "n", "start"))
        rn, source = (right.column(c).to_numpy() for c in ("rn", "example_id"))
        rows = []
        for part, (m, s, d, i) in compare(left.column("record").to_pylist(), right.column("record").to_pylist()):
            turn = (rn[None] - start[part][:, None]) % n[part][:, None]
            if rubric == "ser":
                label = _grades(1 - (s.astype(np.int64) + d + i) / np.maximum(m.astype(np.int64) + s + d, 1), SER_CUTS)
            else:
                p, r = (m / np.maximum(m + s + x, 1) for x in (i, d))
                label = _grades(np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0), F1_CUTS)
            for grade in np.unique(label).tolist():
                if labels is not None and grade not in labels:
                    continue
                own = np.where((label == grade) & (turn < tries), turn, np.iinfo(np.int64).max)
                best = own.argmin(1)
                k = np.arange(len(best))
                here = np.flatnonzero(own[k, best] < tries)
                b = best[here]
                rows.append((ids[part][here], np.full(len(here), grade, np.int32), own[here, b], source[b], *(x[here, b].astype(np.int64) for x in (s, d, i))))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 7
        columns[1] = columns[1].astype(np.int32)
        return pa.table(dict(zip(("example_id", "label", "try", "source_id", "s", "d", "i"), columns, strict=True)))

    found = looking.groupBy("g", "chunk").cogroup(members.groupBy("g", "chunk")).applyInArrow(first_of_each, "example_id long, label int, try long, source_id long, s long, d long, i long")
    best = found.groupBy("example_id", "label").agg(F.min(F.struct("try", "source_id", "s", "d", "i")).alias("b")).select("example_id", "label", "b.*")
    return best.join(records.select(F.col("example_id").alias("source_id"), "record").hint("merge"), "source_id").select("example_id", "label", "try", "source_id", "s", "d", "i", "record")
