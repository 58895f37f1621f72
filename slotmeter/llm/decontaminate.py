"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark words.

The automaton's alphabet is the benchmark's vocabulary: each word has a number, every other word
is 0. Its patterns are the windows of ten consecutive item words (a shorter item is one window).
A document is scanned once, word by word; hits are mapped back to offsets in the original text.

The automaton is built in each Python worker from broadcast item texts, once for all its batches. An
automaton has at most ``SHARD_BYTES`` of text, which bounds what is collected, broadcast and built at
once. A larger benchmark has several, one after the other: each is a pass of its own over the texts,
gives rows only for texts that it hits, and is released before the next; the hits meet by text hash.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, as_bytes, staged

SHARD_BYTES = 2 << 20
#: A-Z become a-z; 0-9, a-z and all bytes of other characters stay; the rest separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BUILT: dict[tuple, tuple] = {}


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_TABLE).split() if text else []


def windows(item: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """All n-word windows; an item of fewer words, but not none, is one window."""
    return [tuple(item[i : i + n]) for i in range(max(1, len(item) - n + 1))] if item else []


def build(items: list[tuple[str | None, bytes]], n: int) -> tuple[dict[bytes, int], ahocorasick.Automaton, list[tuple[int, tuple[str, ...]]]]:
    """Vocabulary, automaton and, per pattern, its length and the items that have it."""
    owners: dict[tuple[bytes, ...], set] = {}
    for item_id, text in items:
        for w in windows(words(text), n):
            owners.setdefault(w, set()).add(item_id)
    vocab: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    patterns = []
    for window, ids in owners.items():
        automaton.add_word(tuple(vocab.setdefault(w, len(vocab) + 1) for w in window), len(patterns))
        patterns.append((len(window), tuple(sorted(i for i in ids if i is not None))))
    if patterns:
        automaton.make_automaton()
    return vocab, automaton, patterns


def spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as character offsets [start, end) of the original text."""
    raw = np.frombuffer(text, np.uint8)
    sep = np.concatenate(([True], np.frombuffer(text.translate(_TABLE), np.uint8) == 32, [True]))
    starts, ends = np.flatnonzero(sep[:-1] & ~sep[1:]), np.flatnonzero(~sep[:-1] & sep[1:])
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b]])} for a, b in zip(first, last, strict=True)]


def scan(text: bytes | None, built: tuple) -> tuple[int, np.ndarray | None, list[str]]:
    """Number of words, which words are hit (None: none) and the items of one text."""
    found = words(text)
    vocab, automaton, patterns = built
    if not patterns or not found:
        return len(found), None, []
    get, hit, items = vocab.get, None, set()
    for end, k in automaton.iter(tuple([get(w, 0) for w in found])):
        if hit is None:
            hit = np.zeros(len(found) + 1, np.int64)
        length, ids = patterns[k]
        hit[end - length + 1] += 1
        hit[end + 1] -= 1
        items.update(ids)
    return len(found), None if hit is None else np.cumsum(hit[:-1]) > 0, sorted(items)


def _shards(items: DataFrame, item_id: str, item_text: str, n: int) -> Iterator[tuple[int, int, Callable[[], tuple]]]:
    """For each shard, one after the other, its number, the number of shards, and a function that gives its automaton in a worker."""
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    n_shards = max(1, math.ceil(size / SHARD_BYTES))
    for k in range(n_shards):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_shards)) == k).collect()  # about SHARD_BYTES of text
        sent, name = items.sparkSession.sparkContext.broadcast([(r["i"], r["t"].encode()) for r in rows]), uuid.uuid4().hex

        def automaton(sent=sent, name=name) -> tuple:
            if name not in _BUILT:
                _BUILT.clear()  # a worker holds one automaton at a time
                _BUILT[name] = build(sent.value, n)
            return _BUILT[name]

        yield k, n_shards, automaton
        if n_shards > 1:
            sent.unpersist()


_KEY = "h1 long, h2 long"


def _hits(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, n: int) -> DataFrame:
    """(h1, h2, hit, items) of the distinct texts that any of several shards hits; hit is a byte for each word."""
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), text.alias("text")).where("text is not null")
    parts = []
    for _, _, automaton in _shards(items, item_id, item_text, n):

        def run(batch: pa.RecordBatch, automaton=automaton) -> Iterator[pa.RecordBatch]:
            found = [scan(t, automaton())[1:] for t in as_bytes(batch.column(2))]
            rows = pa.array([k for k, f in enumerate(found) if f[0] is not None], pa.int64())
            hit, ids = [f[0].tobytes() for f in found if f[0] is not None], [f[1] for f in found if f[0] is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hit, pa.binary()), pa.array(ids, pa.list_(pa.string()))], names=["h1", "h2", "hit", "items"])

        parts.append(staged(arrow_map(keyed, run, f"{_KEY}, hit binary, items array<string>").dropDuplicates(["h1", "h2"])))
    every = functools.reduce(DataFrame.unionAll, parts)

    def merge(table: pa.Table) -> pa.Table:
        hit = np.any([np.frombuffer(x, bool) for x in table.column("hit").to_pylist()], axis=0)
        ids = sorted(set().union(*table.column("items").to_pylist()))
        return pa.table({"h1": table.column("h1").slice(0, 1), "h2": table.column("h2").slice(0, 1), "hit": pa.array([hit.tobytes()], pa.binary()), "items": pa.array([ids], pa.list_(pa.string()))})

    return every.groupBy("h1", "h2").applyInArrow(merge, f"{_KEY}, hit binary, items array<string>")  # a row for each shard at most


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _columns(texts: list[bytes | None], found: list[tuple]) -> list[pa.Array]:
    return [
        pa.array([f[0] for f in found], pa.int64()),
        pa.array([0 if f[1] is None else int(f[1].sum()) for f in found], pa.int64()),
        pa.array([f[2] for f in found], pa.list_(pa.string())),
        pa.array([[] if f[1] is None else spans(t, f[1]) for t, f in zip(texts, found, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted strings) and spans of hit words.

    Null and empty texts have no words. Rows with a null or repeated id are scanned like others.
    Items with null text have no windows; items with a null id hit words but are not listed; an item
    id on several rows is one item. An empty benchmark hits nothing. Other columns are not read.
    """
    names = ["id", "n_words", "n_hit", "items", "spans"]
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {base.schema['id'].dataType.simpleString()}, {_FOUND}"
    _, n_shards, automaton = next(_shards(items, item_id, item_text, n))
    if n_shards == 1:

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(texts, [scan(t, automaton()) for t in texts])], names=names)

        return arrow_map(base, run, schema).withColumnRenamed("id", id_col)

    def unite(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(1))
        found = [(len(words(t)), None if h is None else np.frombuffer(h, bool), i or []) for t, h, i in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(texts, found)], names=names)

    hits = _hits(docs, items, text_col, item_id, item_text, n)
    keyed = base.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})
    return arrow_map(keyed.join(hits.hint("merge"), ["h1", "h2"], "left").select("id", "text", "hit", "items"), unite, schema).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """The rows of ``docs`` whose text has no window of any item, with all their columns.

    Each row is judged by its own text, so rows that share an id, or have none, are independent. Null
    and empty texts stay, as do all rows if the benchmark is empty. Other columns are not read.
    """
    at = docs.columns.index(text_col)
    _, n_shards, automaton = next(_shards(items, item_id, item_text, n))
    if n_shards == 1:

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array([scan(t, automaton())[1] is None for t in as_bytes(batch.column(at))], pa.bool_()))

        return arrow_map(docs, run, docs.schema)
    hits = _hits(docs, items, text_col, item_id, item_text, n).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    text = F.col(f"`{text_col}`")
    return docs.join(hits.hint("merge"), (F.xxhash64(text) == F.col("_h1")) & (F.xxhash64(F.lit("second"), text) == F.col("_h2")), "left_anti")
