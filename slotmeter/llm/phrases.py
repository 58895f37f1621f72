"""Frequent phrases by direct-address tiling.

1. Texts become blocks, one row for a language of a slice of texts: its distinct words, and its words
   as numbers with gaps where a piece ends.
2. Words that occur often enough are numbered by language and falling frequency, so frequent words
   have small numbers within their language. Each level then counts pairs of neighbouring numbers: a
   block's pairs are dealt to square tiles of the plane (left number, right number). A tile with many
   pairs is counted in a dense table by bincount, others as sorted coordinates. The cells are summed
   over all blocks by Spark, after a partial sum.
3. Pairs that are frequent are numbered again in the same way, and a level up two overlapping phrases
   of k words are a phrase of k + 1 words. A phrase is frequent only if both its parts are, so nothing
   is missed.

Words get their numbers by a join of each block's distinct words, so no hash stands for a word. Pairs
get theirs by packed rows: keys are dealt to ranges of a hash, in which each block's packed keys meet
the sorted table of frequent ones. No dictionary is held as a whole by one machine, and a key that all
blocks have costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.llm.class_lm import pack, unpack
from slotmeter.llm.common import arrow_map, as_bytes, staged
from slotmeter.llm.wordhash import mix
from slotmeter.llm.words import byte_set, text_slices, words_of
from slotmeter.operators.numbering import numbered

BLANK, ENDS = byte_set(b" \t"), byte_set(b".,;:!?\n\x0b\x0c\r")
#: Bytes of text of a block, side of a tile, and pairs of a tile from which a dense table counts them.
BLOCK, TILE, DENSE = 8 << 20, 512, 1 << 15
#: Keys of a hash range, and numbers of a level (a pair is two of 31 bits).
KEYS, MOST = 1 << 18, 1 << 31
GAP = -1


def encode_blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, words, counts, codes): columns (text, lang) as blocks of one language each."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, langs = as_bytes(batch.column(0)), batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda k: langs[k])
        edges = [k for k in range(len(order)) if not k or langs[order[k]] != langs[order[k - 1]]] + [len(order)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            own = [texts[k] for k in order[x:y]]
            for a, b in text_slices(own, BLOCK):
                words, _, piece = words_of(own[a:b], BLANK, ENDS, lower=True)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                counts = np.bincount(codes, minlength=len(coded.dictionary))
                last = np.flatnonzero(piece[1:] != piece[:-1]) + 1
                columns = [pa.array([langs[order[x]]]), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([pack(np.insert(codes, last, GAP))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts", "codes"])

    found = arrow_map(docs, run, "lang string, words array<string>, counts array<long>, codes binary", rows=None)
    return found.withColumn("block", F.monotonically_increasing_id())


def count_cells(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the pairs; a code is left << 32 | right. Tiles with many pairs are dense tables."""
    tile = (left // TILE << 32) | (right // TILE)
    order = np.argsort(tile)
    tile, left, right = tile[order], left[order], right[order]
    edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True]))) if len(tile) else np.zeros(0, np.int64)
    codes, counts = [], []
    sparse = np.ones(len(tile), bool)
    for k in np.flatnonzero(np.diff(edges) >= DENSE).tolist():
        x, y = int(edges[k]), int(edges[k + 1])
        sparse[x:y] = False
        low_l, low_r = left[x] // TILE * TILE, right[x] // TILE * TILE
        table = np.bincount((left[x:y] - low_l) * TILE + right[x:y] - low_r, minlength=TILE * TILE)
        cell = np.flatnonzero(table)
        codes.append((low_l + cell // TILE << 32) | (low_r + cell % TILE))
        counts.append(table[cell])
    code, n = np.unique((left[sparse] << 32) | right[sparse], return_counts=True)
    return np.concatenate([*codes, code]), np.concatenate([*counts, n])


def _pairs(ids: np.ndarray) -> np.ndarray:
    """The code of each pair of neighbours of which both have a number; GAP elsewhere."""
    if not len(ids):
        return ids
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return np.where(both, (ids[:-1] << 32) | ids[1:], GAP)


def _cells(blocks: DataFrame) -> DataFrame:
    """(code, n): pairs of neighbouring numbers of all blocks, summed."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for value in batch.column(0).to_pylist():
            ids = unpack(value, np.int64)[0]
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            code, n = count_cells(ids[both], ids[both + 1])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return arrow_map(blocks.select("ids"), run, "code long, n long", rows=1).groupBy("code").agg(F.sum("n").alias("a"))


def _dealt(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(order by hash range, the ranges there are, borders of each range in that order)."""
    where = (mix(keys.view(np.uint64), 31) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where = where[order]
    edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True]))) if len(where) else np.zeros(1, np.int64)
    return order, where[edges[:-1]], edges.tolist()


def _pair_keys(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a block's numbers, and which of them begins at each place (-1: none)."""
    keys, place = np.unique(_pairs(unpack(value, np.int64)[0]), return_inverse=True)
    return (keys[1:], place - 1) if len(keys) and keys[0] == GAP else (keys, place)


def _resolve(requests: DataFrame, table: DataFrame, ranges: int) -> DataFrame:
    """(block, part, ids) of requests (block, part, body): the number in ``table`` (key, id) of each key, or GAP.

    A range's table rows come first and are kept; then its requests pass one by one.
    """

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, ids = (np.ascontiguousarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
        order, parts, edges = _dealt(key, ranges)
        bodies = [pack(key[order[a:b]], ids[order[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "body"])

    known = arrow_map(table.select("key", "id"), deal, "part long, body binary", rows=None)
    both = known.select("part", F.lit(None).cast("long").alias("block"), "body").unionAll(requests.select("part", "block", "body"))
    dealt = both.repartitionById(ranges, F.col("part").cast("int")).sortWithinPartitions(F.col("part"), F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, none = None, [], np.zeros(0, np.int64)
        key = ids = none
        for batch in batches:
            for part, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, found, key, ids = part, [], none, none
                if block is None:
                    found.append(unpack(body, np.int64, np.int64))
                    continue
                if found:
                    key, ids = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(key)
                    key, ids, found = key[order], ids[order], []
                wanted = unpack(body, np.int64)[0]
                out = np.full(len(wanted), GAP, np.int64)
                if len(key):
                    place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                    same = key[place] == wanted
                    out[same] = ids[place[same]]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int64()), pa.array([pack(out)], pa.binary())], names=["block", "part", "ids"])

    return dealt.mapInArrow(run, "block long, part long, ids binary")


def _without_long_gaps(ids: np.ndarray) -> np.ndarray:
    """Of places without a number in a row one is enough, and none at the ends."""
    stays = ids >= 0
    stays[1:] |= ids[:-1] >= 0
    return ids[stays]


def _pairs_numbered(blocks: DataFrame, table: DataFrame, ranges: int) -> DataFrame:
    """(block, ids) a level up: each pair of neighbours as the number that ``table`` (key, id) has for it."""

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys, _ = _pair_keys(value)
            order, parts, edges = _dealt(keys, ranges)
            bodies = [pack(keys[order[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [pa.array([block] * len(bodies), pa.int64()), pa.array(parts, pa.int64()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "body"])

    answers = _resolve(arrow_map(blocks, ask, "block long, part long, body binary", rows=1), table, ranges)

    def translate(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        got, out = right.sort_by("part").column("ids").to_pylist(), []
        for block, value in zip(left.column("block").to_pylist(), left.column("ids").to_pylist(), strict=True):
            keys, place = _pair_keys(value)
            ids = np.full(len(keys) + 1, GAP, np.int64)
            if got:
                ids[_dealt(keys, ranges)[0]] = np.concatenate([unpack(x, np.int64)[0] for x in got])
            ids = _without_long_gaps(ids[place])
            if len(ids):
                out.append((block, pack(ids)))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "ids": pa.array([x[1] for x in out], pa.binary())})

    return staged(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(translate, "block long, ids binary"))


def _words_numbered(blocks: DataFrame, level: DataFrame) -> DataFrame:
    """(block, ids): each block's words as numbers of ``level`` (lang, phrase, id)."""
    asked = blocks.select("block", "lang", F.posexplode("words").alias("place", "phrase"))
    # every word of a block gets its number or none, so what the join gives follows the text, not how many words are frequent
    found = asked.join(level.select("lang", "phrase", "id").hint("merge"), ["lang", "phrase"], "left")
    told = found.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))
    both = blocks.select("block", "codes").join(told.hint("merge"), "block").select("block", "codes", "known.place", "known.id")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = unpack(batch.column(1)[0].as_py(), np.int32)[0]
        place, known = batch.column(2)[0].values.to_numpy(), batch.column(3)[0].values.fill_null(GAP).to_numpy()
        ids = np.full(len(place), GAP, np.int64)
        ids[place] = known
        out = _without_long_gaps(np.where(codes >= 0, ids[codes], GAP))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(out)], pa.binary())], names=["block", "ids"])

    return staged(arrow_map(both, run, "block long, ids binary", rows=1))


def _ranked(level: DataFrame) -> DataFrame:
    """Written, with id: the place by language and falling frequency."""
    found = staged(numbered(level, [], ["lang", F.desc("a"), "phrase"], "id").withColumn("id", F.col("id") - 1))
    if not found.where(F.col("id") >= MOST).isEmpty():
        raise ValueError(f"more than {MOST} phrases of one length are frequent; raise the least frequency")
    return found


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to ``longest`` words the phrases that occur ``least`` times, and (lang, n), the words of each language.

    A level has lang, phrase, id, a (how often), pre and suf (how often its first and its last 1, 2, ...
    words occur) and, from two words on, left and right: the ids of its two parts a word shorter.

    A-Z are lower-cased; texts are cut at .,;:!? and line ends into pieces, pieces at spaces and tabs
    into words; phrases do not cross pieces, and overlapping occurrences count. Counts are per language
    (null: 'und') over all rows, repeated ones too. Null and empty texts have no words. Other columns
    are not read. Empty input gives empty levels.
    """
    base = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    blocks = staged(encode_blocks(base))
    pairs = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = staged(pairs.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a")))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    level = _ranked(words.where(F.col("a") >= least).select("*", F.array("a").alias("pre"), F.array("a").alias("suf")))
    levels, ids = [level], _words_numbered(blocks, level)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(2, longest + 1):
        cells = _cells(ids).where(F.col("a") >= least).select("a", F.shiftright("code", 32).alias("left"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("right"))
        cells = staged(cells)
        first = level.select(F.col("id").alias("left"), "lang", "phrase", "pre")
        second = level.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("last"), "suf")
        grown = cells.join(first.hint("merge"), "left").join(second.hint("merge"), "right")
        one = F.array("a")
        level = _ranked(grown.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "a", F.concat("pre", one).alias("pre"), F.concat("suf", one).alias("suf"), "left", "right"))
        levels.append(level)
        if k < longest:
            table = level.select((F.shiftleft("left", 32) + F.col("right")).alias("key"), "id")
            ids = _pairs_numbered(ids, table, max(partitions, -(-level.count() // KEYS)))
    return levels, totals


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in 38 digits: exact for counts below 10**17."""
    wide = lambda c: c.cast("decimal(17,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(1000), wide(l) * wide(r))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    A phrase of two words or more is cut in two where floor(1000 a n / (l r)) is lowest, at ties
    after the fewest words; l and r are the counts of the parts. A phrase that a longer one of the
    same frequency contains is left out (a longer one is never more frequent, and one in between is as
    frequent as both, so phrases one word longer tell). Ranks go by score, then a, then the phrase's
    bytes, so there are no ties. See frequent_phrases for words, languages, nulls and repeated rows.
    """
    levels, totals = frequent_phrases(docs, text_col, lang_col, least, longest)
    kept = []
    for k in range(2, longest + 1):
        level = levels[k - 1]
        if k < longest:
            longer = levels[k]
            inside = longer.select(F.col("left").alias("id"), "a").unionAll(longer.select(F.col("right").alias("id"), "a")).distinct()
            level = level.join(inside.hint("merge"), ["id", "a"], "left_anti")
        kept.append(level.select("lang", "phrase", "a", "pre", "suf", F.lit(k).alias("k")))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionAll(more)
    cuts = every.join(totals.hint("merge"), "lang").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    l, r = F.element_at("pre", F.col("cut")), F.element_at("suf", F.col("k") - F.col("cut"))  # noqa: E741
    cuts = cuts.select("lang", "phrase", "a", "n", F.struct(_score(F.col("a"), F.col("n"), l, r).alias("score"), "cut", l.alias("l"), r.alias("r")).alias("c"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
