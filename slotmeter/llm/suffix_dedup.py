"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

1. Anchors. The smallest k-mer hash in a string of ``LENGTH`` bytes is its anchor, so equal strings
   have equal anchors. Runs of string starts with one anchor are its region. Regions with equal
   anchor and bytes are one: all but the first of them are repeats in whole (within a batch this is
   settled before the shuffle, so a hot text costs one row a batch).
2. Regions that share an anchor with a different region may share some strings. Their texts are dealt
   to buckets by anchor; an anchor with very many regions gets a grid of buckets in which each two of
   its chunks meet.
3. In a bucket only runs of starts whose rolling hash over ``LENGTH`` bytes occurs twice go on. They
   form shards of bounded size. Each shard has its transform; the interleave of all shards is refined
   step by step (two letters each) until it is the order by the first ``LENGTH`` bytes. Interval borders arise on the way, so intervals without a border share a prefix
   of that length: they are the repeated strings. No suffix is sorted across shards.
Removal is judged on the input: every byte of every string that also starts earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, as_bytes, staged
from slotmeter.llm.wordhash import _BASE, _BASE_INVERSE, _VALUE, _powers, mix

LENGTH, KMER = 100, 32
#: Bytes hashed at once, bytes of a bucket and of a shard, and regions of an anchor that share a bucket.
SEGMENT, BUCKET, SHARD, CHUNK = 1 << 19, 2 << 20, 1 << 18, 8000
NULL_ID = -(2**63)


def regions(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, region hash, first string start, number of starts) for the texts raw[start:end]."""
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, n), out=total[1:])
    inverse = _powers(_BASE_INVERSE, n)
    k = n - KMER + 1
    if k <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    kmers = mix((total[KMER:] - total[:k]) * inverse[:k], 21)
    width = LENGTH - KMER + 1  # k-mers of a string
    low = (kmers & ~np.uint64(0xFFFFFF)) | np.arange(k, dtype=np.uint64)  # ties go to the left
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    valid = np.zeros(n + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor = (low[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    s = at[first]
    e = s + count - 1 + LENGTH
    whole = mix((total[e] - total[s]) * inverse[s], 22) ^ (count.astype(np.uint64) << np.uint64(1))
    return kmers[anchor[first]].view(np.int64), whole.view(np.int64), s, count


def _segments(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (text numbers, offsets, bytes); segments of one text overlap by LENGTH - 1 bytes."""
    who, where, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t or b"") - LENGTH + 1, 0), SEGMENT):
            part = t[at : at + SEGMENT + LENGTH - 1]
            who.append(k)
            where.append(at)
            parts.append(part)
            size += len(part)
            if size >= SEGMENT:
                yield who, where, parts
                who, where, parts, size = [], [], [], 0
    if parts:
        yield who, where, parts


_FOUND = "kind int, h long, ctx long, id long, s long, n long"


def find_regions(docs: DataFrame) -> DataFrame:
    """Columns (id, text): kind 0 is a region, kind 1 a run of starts whose strings are known repeats."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for who, where, pieces in _segments(as_bytes(batch.column(1))):
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            ends = np.cumsum([len(p) for p in pieces])
            starts = ends - [len(p) for p in pieces]
            h, ctx, s, n = regions(raw, starts, ends)
            piece = np.searchsorted(ends, s, side="right")
            parts.append((h, ctx, ids[np.array(who, np.int64)[piece]], s - starts[piece] + np.array(where, np.int64)[piece], n))
        if not parts:
            return
        h, ctx, doc, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, doc, ctx, h))
        h, ctx, doc, s, n = h[order], ctx[order], doc[order], s[order], n[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        same = ~new & (doc == doc[first]) & (s == s[first])
        kind = np.where(new, 0, 1)
        out = [x[~same] for x in (kind.astype(np.int32), h, ctx, doc, s, n)]
        out[1][out[0] == 1] = mix(out[3][out[0] == 1].view(np.uint64)).view(np.int64)  # repeats are dealt by document
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["kind", "h", "ctx", "id", "s", "n"])

    return arrow_map(docs, run, _FOUND, rows=None)


def settle(found: DataFrame) -> DataFrame:
    """kind 1: known repeats, kind 2: regions that share their anchor with a different one."""
    # an anchor lies in one partition, in order; only its first region waits for another to come
    dealt = found.repartition("h").sortWithinPartitions("h", "kind", "ctx", "id", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h, ctx, id, s, n) of the region before, and whether it was given out
        told = True
        for batch in batches:
            kind, h, ctx, doc, s, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield _rows(1, h[kind == 1], doc[kind == 1], s[kind == 1], n[kind == 1])
            h, ctx, doc, s, n = (x[kind == 0] for x in (h, ctx, doc, s, n))
            if not len(h):
                continue
            extra = last is not None
            if extra:
                h, ctx, doc, s, n = (np.concatenate(([v], x)) for v, x in zip(last, (h, ctx, doc, s, n), strict=True))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            repeat = ~new & ~((doc == doc[first]) & (s == s[first]))
            yield _rows(1, h[repeat], doc[repeat], s[repeat], n[repeat])
            heads = np.flatnonzero(new)
            hh = h[heads]
            shared = np.concatenate((hh[1:] == hh[:-1], [False])) | np.concatenate(([False], hh[1:] == hh[:-1]))
            give = shared.copy()
            if extra and told:
                give[0] = False
            k = heads[give]
            yield _rows(2, h[k], doc[k], s[k], n[k])
            told = bool(shared[-1]) or (len(heads) == 1 and extra and told)
            last = tuple(x[heads[-1]] for x in (h, ctx, doc, s, n))

    return dealt.mapInArrow(run, "kind int, h long, id long, s long, n long")


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=["kind", "h", "id", "s", "n"])


def shard_transform(parts: list[bytes], code: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of parts in lexicographic order: pairs of letters before each suffix, its part and offset."""
    lengths = np.array([len(p) + 1 for p in parts])
    text = np.zeros(lengths.sum(), np.int64)
    ends = np.cumsum(lengths) - 1
    begin = ends - lengths + 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = code[np.frombuffer(b"".join(parts), np.uint8)]
    part = np.repeat(np.arange(len(parts)), lengths)
    n = len(text)
    left = ends[part] - np.arange(n)  # letters until the part's end mark
    rank, width = np.zeros(n, np.int64), 7
    for k in range(width):
        rank *= letters
        shifted = np.zeros(n, np.int64)
        shifted[: n - k] = text[k:]
        rank += np.where(left >= k, shifted, 0)
    while True:
        order = np.argsort(rank)
        ranked = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if width > lengths.max() or dense[order[-1]] == n - 1:
            break
        further = np.zeros(n, np.int64)
        further[: n - width] = dense[width:] + 1
        rank = dense * (n + 2) + np.where(left >= width, further, 0)
        width *= 2
    order = np.argsort(dense * n + np.arange(n))  # equal suffixes in the order of their parts
    before = np.arange(n) - 1
    before = np.where(before < begin[part], ends[part], before)
    second = before - 1
    second = np.where(second < begin[part], ends[part], second)
    pairs = (text[second] * letters + text[before]).astype(np.uint16)
    return pairs[order], part[order], (np.arange(n) - begin[part])[order]


def repeat_runs(parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces of parts, with part and offset, that hold every string of LENGTH bytes that occurs twice.

    A string that occurs once, as its rolling hash tells, starts in no piece; a hash that two
    different strings share only keeps more.
    """
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, n), out=total[1:])
    valid = np.zeros(n + 1, np.int64)
    long = ends - begins >= LENGTH
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return [], at, at
    hashes = (total[at + LENGTH] - total[at]) * _powers(_BASE_INVERSE, n)[at]
    ordered = np.sort(hashes)
    at = at[np.isin(hashes, ordered[1:][ordered[1:] == ordered[:-1]])]
    if not len(at):
        return [], at, at
    part = np.searchsorted(ends, at, side="right")
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    joined = raw.tobytes()
    return [joined[a:b] for a, b in zip(at[first].tolist(), (at[last] + LENGTH).tolist(), strict=True)], part[first], at[first] - begins[part[first]]


def repeated_strings(parts: list[bytes], shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes with at least LENGTH bytes left that share these with another: (interval, part, offset)."""
    used = np.zeros(256, bool)
    for p in parts:
        used[np.frombuffer(p, np.uint8)] = True
    letters = int(used.sum()) + 1
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, letters)
    order = sorted(range(len(parts)), key=parts.__getitem__)
    chunks, size = [[]], 0
    for k in order:
        if size > shard:
            chunks.append([])
            size = 0
        chunks[-1].append(k)
        size += len(parts[k])
    made = [shard_transform([parts[k] for k in c], code, letters) for c in chunks if c]
    transform = np.concatenate([m[0] for m in made])
    owner = np.concatenate([np.array(c)[m[1]] for c, m in zip([c for c in chunks if c], made, strict=True)])
    offset = np.concatenate([m[2] for m in made])
    # the interleave: which shard each place of the merged order comes from; at first shard after shard
    z = np.repeat(np.arange(len(made), dtype=np.uint8 if len(made) <= 256 else np.uint16), [len(m[0]) for m in made])
    interval = np.zeros(len(z), np.int32)
    ends = np.zeros(1 << 16, bool)
    ends[:letters] = True
    ends[np.arange(letters) * letters] = True
    merged = np.empty_like(transform)
    for _ in range(LENGTH // 2):
        merged[np.argsort(z, kind="stable")] = transform
        source = np.argsort(merged, kind="stable")
        z, keys, before = z[source], merged[source], interval[source]
        border = (keys[1:] != keys[:-1]) | (before[1:] != before[:-1]) | ends[keys[1:]]
        interval[0] = 0
        np.cumsum(border, out=interval[1:])
    place = np.argsort(z, kind="stable")  # of each suffix, shard after shard, its place in the merged order
    of = np.empty(len(z), np.int32)
    of[:] = interval[place]
    length = np.array([len(p) for p in parts])
    full = length[owner] - offset >= LENGTH
    many = np.bincount(of[full], minlength=int(interval[-1]) + 1)
    keep = full & (many[of] > 1)
    return of[keep], owner[keep], offset[keep]


def _join_regions(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, id, s, n, part) with the bytes of each open region."""
    wanted = open_.groupBy("id").agg(F.collect_list(F.struct("h", "s", "n")).alias("want"))
    both = docs.join(wanted.hint("merge"), "id").select("id", "text", "want")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, wants = batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()
        out = [(w["h"], i, w["s"], w["n"], t[w["s"] : w["s"] + w["n"] - 1 + LENGTH]) for i, t, want in zip(ids, texts, wants, strict=True) for w in want]
        for a in range(0, len(out), 20_000):
            h, i, s, n, part = zip(*out[a : a + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(i), pa.array(s), pa.array(n), pa.array(part, pa.binary())], names=["h", "id", "s", "n", "part"])

    return arrow_map(both, cut, "h long, id long, s long, n long, part binary")


def _merge_buckets(parts: DataFrame) -> DataFrame:
    """(id, s, n): starts of strings that start earlier in another region of the same anchor."""
    size = parts.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    bytes_ = parts.agg(F.coalesce(F.sum(F.length("part")), F.lit(0))).head()[0]
    buckets = max(1, -(-int(bytes_) // BUCKET))
    few = parts.join(size.where("chunks = 1").hint("merge"), "h").select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), "id", "s", "n", "part")
    hot = parts.join(size.where("chunks > 1").hint("merge"), "h").withColumn("c", F.pmod(F.xxhash64("id", "s"), F.col("chunks")))
    hot = hot.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    hot = hot.select(F.col("h").alias("x"), (F.least("c", "d") + 1).alias("y"), (F.greatest("c", "d") + 1).alias("z"), "id", "s", "n", "part")

    def merge(table: pa.Table) -> pa.Table:
        texts = table.column("part").to_pylist()
        doc, start = table.column("id").to_numpy(), table.column("s").to_numpy()
        pieces, owner, place = repeat_runs(texts)
        if not pieces:
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "s", "n")})
        interval, piece, offset = repeated_strings(pieces)
        d, s = doc[owner[piece]], start[owner[piece]] + place[piece] + offset
        order = np.lexsort((s, d, interval))
        interval, d, s = interval[order], d[order], s[order]
        new = np.concatenate(([True], interval[1:] != interval[:-1])) if len(d) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0)) if len(d) else np.zeros(0, np.int64)
        later = ~((d == d[first]) & (s == s[first]))
        d, s = d[later], s[later]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        # starts that follow each other closely are one run of covered bytes
        head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + LENGTH)))) if len(d) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(d)) - 1
        return pa.table({"id": pa.array(d[head], pa.int64()), "s": pa.array(s[head], pa.int64()), "n": pa.array(s[tail] - s[head] + 1 if len(d) else s[:0], pa.int64())})

    return few.unionAll(hot).groupBy("x", "y", "z").applyInArrow(merge, "id long, s long, n long")


def _numbered(base: DataFrame) -> DataFrame:
    """(own, text) with a document number in the order of own, null first, then text hash; equal rows share it."""
    base = base.withColumn("th", F.xxhash64("text"))
    integral = base.schema["own"].dataType.typeName() in ("byte", "short", "integer", "long")
    if integral and base.groupBy("own").agg(F.min("th").alias("x"), F.max("th").alias("y")).where("x <> y").isEmpty():
        return base.select("own", "text", F.coalesce(F.col("own").cast("long"), F.lit(NULL_ID)).alias("id"))
    # row numbers within sorted ranges rise from range to range; writing them fixes them
    keys = base.select("own", "th").distinct().repartitionByRange("own", "th").sortWithinPartitions("own", "th")
    keys = staged(keys.withColumn("id", F.monotonically_increasing_id())).withColumnsRenamed({"own": "o", "th": "t"})
    return base.join(keys.hint("merge"), F.col("own").eqNullSafe(F.col("o")) & (F.col("th") == F.col("t"))).select("own", "text", "id")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (binary) for each row of ``docs``.

    Ids may be of any ordered type; a null id comes before all others. A null or empty text has no
    bytes. Rows that repeat an id and its text are one document and get one result; rows with one id
    and different texts are documents of their own, in the order of their texts' hashes. Other
    columns are not read; empty input gives an empty result.
    """
    taking = _numbered(docs.select(F.col(f"`{id_col}`").alias("own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    rows, taking = taking, taking.select("id", "text")
    settled = staged(settle(find_regions(taking)))
    parts = staged(_join_regions(settled.where("kind = 2"), taking))
    runs = settled.where("kind = 1").select("id", "s", "n").unionAll(_merge_buckets(parts))
    # runs of one document, bounded by its length
    runs = runs.groupBy("id").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    both = rows.join(runs.hint("merge"), "id", "left").select("own", "text", "runs")

    def remove(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, runs = as_bytes(batch.column(1)), batch.column(2).to_pylist()
        n_bytes, removed, spans, kept = [], [], [], []
        for text, found in zip(texts, runs, strict=True):
            gone = 0
            merged: list[list[int]] = []
            for s, e in sorted((r["s"], r["s"] + r["n"] - 1 + LENGTH) for r in found or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            out, at = [], 0
            for s, e in merged:
                out.append(text[at:s])
                gone += e - s
                at = e
            n_bytes.append(len(text))
            removed.append(gone)
            spans.append(len(merged))
            kept.append(b"".join(out) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_map(both, remove, f"own {id_type}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("own", id_col)
