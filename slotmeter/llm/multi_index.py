"""Embedding near-dedup with an inverted multi-index.

Vectors are normalised and cut in two halves; each half has its own codebook, and a pair of
codewords is a cell of the product grid. A vector lives in the cell of its nearest codewords. As a
query it visits cells in the order of a lower bound: the distance to a codeword's Voronoi region is
at least that to the bisecting hyperplane, and the bounds of both halves add up as squares. The
multi-sequence traversal pops cells from a heap in that order and stops where no resident can be
near enough any more: with ``slack`` 1, the default, no link can be missed, whatever the data. A
smaller ``slack`` visits fewer cells and misses links across the borders of codewords.

Visited cells are verified by blocked matrix products in double precision. A cell's residents and
visitors are cut into chunks of bounded size, so a hot cell becomes many tasks; a task returns link
counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, staged
from slotmeter.llm.components import components

#: Codewords of a half, bound of the sample that codebooks are fitted on, and chunk sizes of a cell.
CODEWORDS, SAMPLE, RESIDENTS, VISITORS = 16, 4096, 1000, 2000


def unit(vectors: list, dim: int) -> np.ndarray:
    """Normalised rows in double precision, padded with zeros to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    scale = np.abs(out).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    out /= scale
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centres; fewer where there are fewer distinct points."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]]
    for _ in range(rounds):
        near = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.stack([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return np.unique(centres, axis=0)


def bounds(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest codeword, and a lower bound of its distance to every codeword's region."""
    far = (half**2).sum(1)[:, None] - 2 * half @ centres.T + (centres**2).sum(1)
    own = far.argmin(1)
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[own]
    rise = np.maximum(far - far[np.arange(len(own)), own][:, None], 0)
    return own, np.divide(rise, 2 * gaps, out=np.zeros_like(rise), where=gaps > 0)


def traverse(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by rising a[i]**2 + b[j]**2 until that exceeds ``limit``."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y = a[first] ** 2, b[second] ** 2
    heap, seen = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        yield int(first[i]), int(second[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(x) and n[1] < len(y) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (x[n[0]] + y[n[1]], *n))


def _verify(queries: np.ndarray, residents: np.ndarray, weight: np.ndarray, same: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the queries, and the local component of queries and of residents (as index of a query, -1: none)."""
    hit = queries @ residents.T >= least
    hit &= ~same
    counts = hit @ weight
    q, r = np.nonzero(hit)
    of_q, of_r = np.full(len(queries), -1), np.full(len(residents), len(queries))
    of_q[q] = q
    while True:
        before = of_q.copy()
        np.minimum.at(of_r, r, of_q[q])
        np.minimum.at(of_q, q, of_r[r])
        if (of_q == before).all():
            return counts, of_q, np.where(of_r == len(queries), -1, of_r)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, slack: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``.

    Vectors link when labels are equal and not null and their cosine is at least ``cosine``; only
    vectors of one length are compared. Null or zero vectors, and those with null or non-finite
    components, link with nothing, as do rows with a null id: n_links 0, own component, kept. Equal
    vectors of a label are one class until the end, each counting the others; rows that repeat an id
    and its vector are one vector, and rows with one id and several vectors share their links. Other columns are not read; empty input gives an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
    sound &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = base.where(F.coalesce(sound, F.lit(False)))
    classes = staged(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("m")))
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    if n:
        share = min(1.0, SAMPLE / n)
        sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(2 * SAMPLE)
        points = unit([r["v"] for r in sample.collect()] or [r["v"] for r in classes.select("v").limit(1).collect()], dim)
        half = dim // 2 or 1
        books = spark.sparkContext.broadcast((codebook(points[:, :half], CODEWORDS), codebook(points[:, half:], CODEWORDS) if dim > 1 else np.zeros((1, 0))))
        radius = (2 - 2 * cosine) * slack**2 + 1e-9
        id_type, element = base.schema["id"].dataType.simpleString(), base.schema["v"].dataType.simpleString()

        def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raw = batch.column("v").to_pylist()
            rows = unit(raw, dim)
            first, second = books.value
            own1, a = bounds(rows[:, :half], first)
            own2, b = bounds(rows[:, half:], second)
            at, cell, home = [], [], []
            for k in range(len(rows)):
                for i, j in traverse(a[k], b[k], radius):
                    at.append(k)
                    cell.append(i * len(second) + j)
                    home.append(i == own1[k] and j == own2[k])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(cell, pa.int64()), pa.array(home)], names=[*batch.schema.names, "cell", "home"])

        label_type = base.schema["label"].dataType.simpleString()
        numbered = classes.select("label", F.size("v").alias("dim"), "rep", "m", "v")
        visits = staged(arrow_map(numbered, place, f"label {label_type}, dim int, rep {id_type}, m long, v {element}, cell long, home boolean"))
        where = ["label", "dim", "cell"]
        size = visits.groupBy(where).agg(F.ceil(F.count_if("home") / RESIDENTS).alias("r"), F.ceil(F.count(F.lit(1)) / VISITORS).alias("q")).where("r > 0")
        dealt = visits.join(size.hint("merge"), where)
        # a resident goes to its chunk in every column of visitors, a visitor to its column in every chunk
        residents = dealt.where("home").select(*where, "rep", "m", "v", F.pmod(F.xxhash64("rep"), F.col("r")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("y"), F.lit(True).alias("home"))
        visitors = dealt.select(*where, "rep", "m", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("x"), F.pmod(F.xxhash64("rep"), F.col("q")).alias("y"), F.lit(False).alias("home"))
        blocks = residents.unionByName(visitors).groupBy(*where, "x", "y")

        def verify(table: pa.Table) -> pa.Table:
            home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
            ids, m = np.array(table.column("rep").to_pylist(), dtype=object), table.column("m").to_numpy()
            rows = unit(table.column("v").to_pylist(), dim)
            out: dict[str, list] = {"id": [], "n": [], "other": []}
            r_ids, q_ids = ids[home], ids[~home]
            for s in range(0, len(r_ids), 2 * RESIDENTS):
                for t in range(0, len(q_ids), 2 * VISITORS):
                    rr, qq = r_ids[s : s + 2 * RESIDENTS], q_ids[t : t + 2 * VISITORS]
                    place = {i: k for k, i in enumerate(rr)}
                    same = np.zeros((len(qq), len(rr)), bool)
                    for k, i in enumerate(qq):
                        if i in place:
                            same[k, place[i]] = True
                    counts, of_q, of_r = _verify(rows[~home][t : t + 2 * VISITORS], rows[home][s : s + 2 * RESIDENTS], m[home][s : s + 2 * RESIDENTS], same, cosine)
                    for names, number, group in ((qq, counts, of_q), (rr, np.zeros(len(rr), np.int64), of_r)):
                        k = np.flatnonzero(group >= 0)
                        out["id"] += names[k].tolist()
                        out["n"] += number[k].tolist()
                        out["other"] += qq[group[k]].tolist()
            return pa.table({"id": pa.array(out["id"], table.schema.field("rep").type), "n": pa.array(out["n"], pa.int64()), "other": pa.array(out["other"], table.schema.field("rep").type)})

        found = staged(blocks.applyInArrow(verify, f"id {id_type}, n long, other {id_type}"))
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    else:
        counts = classes.select(F.col("rep").alias("id"), F.col("m").alias("n")).limit(0)
        groups = classes.select(F.col("rep").alias("id"), F.col("rep").alias("component")).limit(0)
    rows = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    named = classes.join(counts.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").join(groups.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    named = named.select("label", "v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("sound"))
    out = rows.join(named.hint("merge"), ["label", "v", "sound"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
