"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each text becomes its set of shingle hashes. One permutation (the hash itself) is cut into
   ``BINS`` bins; a bin's value is its smallest hash; an empty bin copies the bin that a 2-universal
   hash of (bin, attempt) names first. ``ROWS`` bins make a band; a band's values make a bucket.
2. Texts with equal sets are one class with its smallest id as representative, so any number of
   copies costs one row from here on.
3. A bucket tests its members against one centre only (star edges), on full sets. The second round
   takes, in buckets that are still in several components, the member with the most links as centre.
4. What may still be missed is a link between members of one star that lie in different components.
   Jaccard distance is a metric and both distances to the centre are known, so only pairs whose
   distances differ by at most 1 - threshold are tested.
Links are confirmed on full sets: 100 * |A n B| >= percent * |A u B|. Pairs below that never link. A
pair at the threshold shares no bucket with probability (1 - 0.8**6)**40, about 5 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, as_bytes, staged
from slotmeter.llm.components import components, spanning_forest
from slotmeter.llm.wordhash import mix, shingle_sets

BINS, ROWS = 240, 6
#: Documents in a block of a star: those outside the centre's component, and those they are tested against.
OUTSIDE, INSIDE = 256, 1024
ATTEMPTS = 4096
_DONORS: dict[int, np.ndarray] = {}


def _donors(attempts: int) -> np.ndarray:
    """Which bin an empty bin looks at, by attempt and bin."""
    if attempts not in _DONORS:
        rng, prime = np.random.default_rng(5), 2**31 - 1
        a, b = rng.integers(1, prime, (attempts, 1)), rng.integers(0, prime, (attempts, 1))
        _DONORS[attempts] = ((a * (np.arange(BINS) + 1) + b) % prime % BINS).astype(np.int32)
    return _DONORS[attempts]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each non-empty set."""
    values = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for k, s in enumerate(sets):  # sets are sorted, and bins follow the hash's upper half
        bins = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        values[k, bins[at].astype(np.int64)] = s[at]
        full[k, bins[at].astype(np.int64)] = True
    rows, cols = np.nonzero(~full)
    table = _donors(ATTEMPTS)
    for t in range(ATTEMPTS):
        if not len(rows):
            break
        donor = table[t, cols]
        ok = full[rows, donor]
        values[rows[ok], cols[ok]] = values[rows[ok], donor[ok]]
        rows, cols = rows[~ok], cols[~ok]
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):  # not reached in practice: the next full bin
        values[r, c] = values[r, (c + np.flatnonzero(np.roll(full[r], -c))[0]) % BINS]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """Bucket numbers, one for each band of a signature; the band's place is part of them."""
    grouped = values.reshape(len(values), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + grouped[:, :, r], r + 1)
    return key


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, f1, f2, buckets) of columns (id, text); f1, f2 identify the shingle set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(1))
        step = 512
        for a in range(0, len(texts), step):
            sets = shingle_sets(texts[a : a + step], n)
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            buckets: list = [None] * len(sets)
            if len(some):
                joined = np.concatenate([sets[k] for k in some])
                at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                f1[some], f2[some] = np.add.reduceat(mix(joined, 11), at), np.add.reduceat(mix(joined, 12), at)
                found = bands(signatures([sets[k] for k in some])).view(np.int64)
                for k, row in zip(some.tolist(), found, strict=True):
                    buckets[k] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, len(sets)), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(buckets, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "f1", "f2", "buckets"],
            )

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, buckets array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, s) with the sorted distinct shingle hashes of columns (id, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, step = as_bytes(batch.column(1)), 512
        for a in range(0, len(texts), step):
            sets = [s.view(np.int64) for s in shingle_sets(texts[a : a + step], n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, s array<long>")


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with d, their Jaccard distance on full sets, and whether they link."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u"))
    return both.select("a", "b", (1 - F.col("i") / F.col("u")).alias("d"), (F.lit(100) * F.col("i") >= F.lit(percent) * F.col("u")).alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept for each row of ``docs``.

    A text with fewer than n words has its whole sequence as its only shingle; a null text, or one
    without words, has an empty set, links with nothing and is kept. Rows with one id are one
    document (the ids link them); a row with a null id links with nothing, has a null component and
    is kept. Ties do not arise: the smallest id reachable names a component. Other columns are not
    read; empty input gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = staged(sketch(docs, n))
    usable = sketches.where("n_shingles > 0 and id is not null")
    classes = staged(usable.groupBy("f1", "f2").agg(F.min("id").alias("rep")))
    reps = usable.join(classes.select("f1", "f2", F.col("rep").alias("id")).hint("merge"), ["f1", "f2", "id"], "left_semi")
    members = reps.select("id", F.explode("buckets").alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("centre")).where("m > 1").select("bucket", "centre")
    members = staged(members.join(shared.hint("merge"), "bucket").select("bucket", "id", "centre"))
    wanted = members.select("id").distinct()
    texts = docs.join(wanted.hint("merge"), "id", "left_semi")
    # rows that repeat an id may differ in text: each of their sets stands for the id
    sets = staged(full_sets(texts, n))
    tested = staged(_tested(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), sets, percent))
    links = tested.where("linked").select("a", "b")

    open_ = staged(_open_buckets(members, links))
    if not open_.isEmpty():
        degree = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        ranked = open_.join(degree.hint("merge"), "id", "left").withColumn("rank", F.struct(-F.coalesce("degree", F.lit(0)), F.col("id")))
        hubs = ranked.groupBy("bucket").agg(F.min("rank").getField("id").alias("centre"))
        stars = open_.join(hubs.hint("merge"), "bucket").select("centre", "id").distinct()
        stars = staged(_tested(stars.where("centre <> id").select(F.col("centre").alias("a"), F.col("id").alias("b")), sets, percent))
        links = links.unionAll(stars.where("linked").select("a", "b"))
        links = links.unionAll(_residual(stars, links, sets, percent))
    # an id on rows with different sets joins their classes
    links = links.unionAll(usable.join(classes.hint("merge"), ["f1", "f2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))) if _repeats(usable) else links
    found = components(links)
    named = sketches.join(classes.hint("merge"), ["f1", "f2"], "left").withColumn("node", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")))
    named = named.join(found.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("id"))
    out = named.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _repeats(usable: DataFrame) -> bool:
    """Whether an id has rows with different sets."""
    return not usable.groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").isEmpty()


def _open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, id, component) of buckets whose members are still in several components."""
    found = components(links)
    placed = members.select("bucket", "id").join(found.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return placed.join(several.hint("merge"), "bucket", "left_semi")


def _residual(stars: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one star that are in different components, as a spanning forest.

    Each member's set moves once to a grid of bounded blocks of its star (members outside the
    centre's component against all), where the pairs are tested without becoming rows.
    """
    found = components(links)
    centre = found.select(F.col("id").alias("a"), F.col("component").alias("main"))
    placed = stars.select("a", F.col("b").alias("id"), "d").join(found.hint("merge"), "id", "left").join(centre.hint("merge"), "a", "left")
    placed = placed.select("a", "id", "d", F.coalesce("component", "id").alias("component"), F.coalesce("main", "a").alias("main"))
    placed = placed.withColumn("out", F.col("component") != F.col("main"))
    size = placed.groupBy("a").agg(F.count_if("out").alias("n_out"), F.count(F.lit(1)).alias("n")).where("n_out > 0 and n > 1")
    size = size.select("a", F.ceil(F.col("n_out") / OUTSIDE).alias("rows"), F.ceil(F.col("n") / INSIDE).alias("cols"))
    placed = placed.join(size.hint("merge"), "a").join(sets.hint("merge"), "id")
    columns = ["a", "id", "d", "component", "s"]
    left = placed.where("out").select(*columns, F.pmod(F.xxhash64("id"), F.col("rows")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("y"), F.lit(True).alias("left"))
    right = placed.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols")).alias("y"), F.lit(False).alias("left"))
    id_type = placed.schema["id"].dataType.simpleString()

    def test(table: pa.Table) -> pa.Table:
        is_left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        d, names, parts = table.column("d").to_numpy(), table.column("id"), table.column("component").to_pylist()
        component = np.unique(np.array(parts, dtype=object), return_inverse=True)[1]
        lists = table.column("s").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        coded = np.unique(flat, return_inverse=True)[1]
        ls, rs = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        sizes = np.diff(offsets)
        rs = rs[sizes[rs] > 0]
        right_codes = np.concatenate([coded[offsets[r] : offsets[r + 1]] for r in rs]) if len(rs) else coded[:0]
        starts = np.concatenate(([0], np.cumsum(sizes[rs])[:-1])).astype(np.int64)
        mark, hits = np.zeros(len(coded) + 1, np.int64), []
        for l in ls:
            may = (component[rs] != component[l]) & (np.abs(d[rs] - d[l]) <= 1 - percent / 100 + 1e-9)
            if not may.any():
                continue
            own = coded[offsets[l] : offsets[l + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[right_codes], starts)
            mark[own] = 0
            ok = np.flatnonzero(may & (100 * common >= percent * (sizes[rs] + sizes[l] - common)))
            hits.append((np.full(len(ok), component[l]), component[rs[ok]], np.full(len(ok), l), rs[ok]))
        if not hits:
            return pa.table({"a": names.slice(0, 0), "b": names.slice(0, 0)})
        x, y, l, r = (np.concatenate(h) for h in zip(*hits, strict=True))
        keep = spanning_forest(x, y, component.max() + 1)
        return pa.table({"a": names.take(pa.array(l[keep])), "b": names.take(pa.array(r[keep]))})

    return left.unionByName(right).groupBy("a", "x", "y").applyInArrow(test, f"a {id_type}, b {id_type}")
