"""Runs: stretches of words that repeat with a period, found in an enhanced suffix array.

Texts of a batch share one suffix array whose order is by text first, so each text is a block of
it. It grows by prefix doubling; only words that still tie take part in a round. A run of the
least length and exponent holds two equal strings of ``(exponent - 1) / exponent`` of its length,
so a text without two equal strings of that many words leaves after the first rounds; the others get
their LCP values from the ranks of the rounds.

Branching tandems: for each LCP interval of depth d the suffixes i of all its children but the
largest are looked at: where ISA[i + d] or ISA[i - d] lies in the interval too, the two suffixes d
apart share d words, a square, and it branches if the next words differ. Intervals are bounds in the
array (previous and next smaller LCP value); there are no tree nodes. Each branching square is
rotated to the left as far as its words allow, in blocks of 2**k words whose ranks agree, and becomes
the run it ends. A stretch that several periods explain keeps the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, as_bytes, replaced
from slotmeter.llm.words import byte_set, text_slices, words_of

SPACE = byte_set(b" \t\n\x0b\x0c\r")
#: Bytes of text whose suffixes are sorted together, and suffixes of smaller children looked at together.
SLICE, LEAVES = 4 << 20, 1 << 21


class Ranks:
    """Ranks of the 2**k-word strings at all positions, for each round k; texts do not mix."""

    def __init__(self, codes: np.ndarray, text: np.ndarray, least: int) -> None:
        """``least``: texts whose strings of that many words all differ are dropped on the way."""
        self.n = n = len(codes)
        self.stop = np.searchsorted(text, text, side="right")
        order = np.argsort(text.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
        t, c = text[order], codes[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]))) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, width = [rank], 1
        open_ = self._tied(order, new)
        while len(open_):
            if 2 * width > least and width <= least:  # only texts in which strings of ``width`` words repeat go on
                alive = np.zeros(int(text[-1]) + 1, bool)
                alive[text[open_]] = True
                self.alive = alive[text]
            ahead = np.where(open_ + width < self.stop[open_], rank[np.minimum(open_ + width, n - 1)] + 1, 0)
            by = np.argsort(rank[open_] * (n + 1) + ahead)
            open_, ahead = open_[by], ahead[by]
            old = rank[open_]
            k = np.arange(len(open_))
            group = np.concatenate(([True], old[1:] != old[:-1]))
            new = group | np.concatenate(([True], ahead[1:] != ahead[:-1]))
            rank = rank.copy()
            rank[open_] = old + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(group, k, 0))
            self.levels.append(rank)
            open_ = self._tied(open_, new)
            width *= 2
        if width <= least:
            self.alive = np.zeros(n, bool)

    @staticmethod
    def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        return order[~(new & np.append(new[1:], True))] if len(order) else order

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j of one text share; i and j differ."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i + found, j + found
            inside = np.flatnonzero((a < self.stop[i]) & (b < self.stop[j]))
            found[inside[rank[a[inside]] == rank[b[inside]]]] += 1 << k
        return found

    def common_before(self, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i agree; i's text begins at ``start``."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - found - (1 << k), j - found - (1 << k)
            inside = np.flatnonzero(a >= start)
            found[inside[rank[a[inside]] == rank[b[inside]]]] += 1 << k
        return found


def _smaller(lcp: np.ndarray) -> np.ndarray:
    """For each index the nearest index before it with a smaller value, by jumps that double; else 0."""
    before = np.maximum(np.arange(len(lcp)) - 1, 0)
    todo = np.arange(len(lcp))[1:]
    while len(todo):
        todo = todo[(before[todo] > 0) & (lcp[before[todo]] >= lcp[todo])]
        before[todo] = before[before[todo]]
    return before


def find_runs(codes: np.ndarray, text: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs with at least ``least`` words and ``exponent`` periods.

    ``codes`` are word numbers and ``text`` the ascending text numbers of all words; starts and ends
    count over all words. Sorted by start, then period. ``exponent`` is 2 or more.
    """
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none
    # the first length - period words of a run occur twice
    ranks = Ranks(codes, text, least - least // exponent)
    isa = ranks.levels[-1]
    sa = np.empty(ranks.n, np.int64)
    sa[isa] = np.arange(ranks.n)
    sa = sa[ranks.alive[sa]]
    if not len(sa):
        return none, none, none
    place = np.full(ranks.n, -1, np.int64)
    place[sa] = np.arange(len(sa))
    lcp = np.zeros(len(sa) + 1, np.int64)  # lcp[k]: of the suffixes k - 1 and k
    same = np.flatnonzero(text[sa[1:]] == text[sa[:-1]]) + 1
    lcp[same] = ranks.common(sa[same - 1], sa[same])
    lcp[0] = lcp[-1] = -1
    low = _smaller(lcp)
    high = len(lcp) - 1 - _smaller(lcp[::-1])[::-1]
    inner = np.flatnonzero(lcp >= 1)
    inner = inner[np.lexsort((inner, lcp[inner], low[inner]))]
    if not len(inner):
        return none, none, none
    # an interval [low, high) of depth lcp has its children between the inner bounds
    depth, lo, hi = lcp[inner], low[inner], high[inner]
    first = np.concatenate(([True], (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])))
    last = np.append(first[1:], True)
    n_first = int(first.sum())
    left = np.concatenate((lo[first], inner))
    right = np.concatenate((inner[first], np.where(last, hi, np.append(inner[1:], 0))))
    of = np.concatenate((np.arange(n_first), np.cumsum(first) - 1))
    size = right - left
    by = np.lexsort((size, of))
    largest = by[np.append(of[by][1:] != of[by][:-1], True)]
    small = np.ones(len(left), bool)
    small[largest] = False
    child = np.flatnonzero(small)
    d, lo, hi = depth[first], lo[first], hi[first]
    squares = []
    for a, b in _portions(size[child], LEAVES):
        c = child[a:b]
        at = np.repeat(left[c] - np.cumsum(size[c]) + size[c], size[c]) + np.arange(int(size[c].sum()))
        v = np.repeat(of[c], size[c])
        i, p = sa[at], d[v]
        for x, y in ((i, i + p), (i - p, i)):
            other = y if x is i else x
            ok = (other >= 0) & (other < ranks.n)
            where = place[np.where(ok, other, 0)]
            ok &= (where >= lo[v]) & (where < hi[v])
            k = np.flatnonzero(ok)
            x, q = x[k], p[k]
            end = x + 2 * q
            inside = end < ranks.stop[x]
            branches = ~inside | (codes[x + q] != codes[np.where(inside, end, 0)])
            squares.append(np.stack((x[branches], q[branches])))
    i, p = np.unique(np.concatenate(squares, axis=1), axis=1) if squares else (none, none)
    begin = np.searchsorted(text, text[i], side="left")
    start, end = i - ranks.common_before(i, i + p, begin), i + 2 * p
    keep = end - start >= np.maximum(least, exponent * p)
    start, end, p = start[keep], end[keep], p[keep]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(start) else np.zeros(0, bool)
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _portions(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``most``."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """All columns of ``docs`` plus n_words, runs (start, length, period; word numbers from 0) and collapsed.

    Words are separated by white space and compared exactly. A run is a stretch of at least ``least``
    words and ``exponent`` periods, its period the smallest, that no neighbouring word extends.
    collapsed is the text, its words joined by one space, without the words that follow a run's first
    period in that run. Null and empty texts have no words, no runs and collapse to ''. Each row is
    judged alone, so repeated rows and ids do not matter; runs are ordered by start, then period, and
    of equal stretches one is given. Input columns named as a result are replaced. Empty input gives an
    empty result; nothing is shuffled.
    """
    kept = [c for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_")]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    row_type = base.schema["row"].dataType.simpleString()
    new = [("n_words", "bigint"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("collapsed", "string")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(1))
        for a, b in text_slices(texts, SLICE):
            words, text, _ = words_of(texts[a:b], SPACE)
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            start, end, period = find_runs(codes, text, least, exponent)
            counts = np.bincount(text, minlength=b - a)
            begin = np.cumsum(counts) - counts
            of = text[start]
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            stays = np.cumsum(gone[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(np.bincount(text[stays], minlength=b - a))))
            lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words if stays.all() else words.filter(pa.array(stays)))
            collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            found = pa.StructArray.from_arrays([pa.array(x) for x in (start - begin[of], end - start, period)], names=["start", "length", "period"])
            per = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=b - a))))
            columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts), pa.ListArray.from_arrays(pa.array(per, pa.int32()), found), collapsed]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", *(k for k, _ in new)])

    found = arrow_map(base, run, f"row {row_type}, text {base.schema['text'].dataType.simpleString()}, " + ", ".join(" ".join(x) for x in new), rows=None)
    values = {text_col: F.col("text")} | {k: F.col(k) for k, _ in new}
    return found.select(*replaced(docs.columns, values))
