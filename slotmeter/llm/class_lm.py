"""Class-based n-grams after Brown: p(word | previous) = p(class | previous class) * p(word | class).

Texts become blocks of token numbers over a block's own dictionary of word hashes, written once.
Words above a share of all tokens (at most 1 / SHARE of them, whatever the corpus) are clustered by
exchange: each round counts, over all training tokens, every such word's neighbours by class, and
then moves words one by one to the class that raises the class bigram likelihood most. All other
words take one exchange step given those classes, from exact counts of all their neighbours. Counts,
classes and transitions come from all training tokens and do not depend on how these are cut into
blocks. Dictionaries meet by hash range (64-bit hashes), never as a whole on one machine: a block
sends one packed row to each range and gets counts and classes back; its tokens move once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, as_bytes, staged
from slotmeter.llm.wordhash import word_hashes

#: Least share of the tokens of an exchanged word, classes (the last is the text end's own), exchange rounds.
SHARE, CLASSES, ROUNDS = 1 / 4096, 32, 6
#: Weight of the class model against the unigram; bytes of text and documents in a block; bytes of a hash range.
WEIGHT, BLOCK, DOCS, RANGE = 0.9, 8 << 20, 2500, 6 << 20
END = -0x1234567890ABCDEF
_BLOCKS = "block long, ids binary, train binary, counts binary, tokens binary, words binary, n_words long"
_ZSTD = pa.Codec("zstd")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one call in one compressed value; integers go by byte planes, which compress better."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64).tobytes()]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(value: bytes, *types: type) -> list[np.ndarray]:
    raw = memoryview(_ZSTD.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little")))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for (count, width), kind in zip(sizes, types, strict=True):
        planes = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += count * width
    return out


def is_training(ids: list, modulus: int = 5, remainder: int = 1) -> np.ndarray:
    """Whether crc32 of the id as text leaves another remainder; a null id counts as the empty string."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus != remainder for i in ids], bool)


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Columns (id, text) as blocks: ids (Arrow), training flags, token counts, token numbers, word hashes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(1))
        size = np.cumsum([len(t or b"") for t in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK)))
            hashes, counts = word_hashes(texts[at:to])
            with_end = np.full(len(hashes) + len(counts), END, np.int64)
            with_end[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes.view(np.int64)
            words, tokens = np.unique(with_end, return_inverse=True)
            ids = batch.column(0).slice(at, to - at)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
            binary = [sink.getvalue().to_pybytes(), is_training(ids.to_pylist()).tobytes(), (counts + 1).astype(np.int64).tobytes(), pack(tokens.astype(np.int32)), words.tobytes()]
            columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.array([x], pa.binary()) for x in binary), pa.array([len(words)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "train", "counts", "tokens", "words", "n_words"])
            at = to

    return arrow_map(docs, run, _BLOCKS, rows=DOCS)


class Block:
    """One row of blocks as arrays."""

    def __init__(self, row: dict) -> None:
        self.train = np.frombuffer(row["train"], bool)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.tokens = unpack(row["tokens"], np.int32)[0]
        self.words = np.frombuffer(row.get("words") or b"", np.int64)
        self.in_train = np.repeat(self.train, self.counts)
        self.starts = np.cumsum(self.counts) - self.counts

    def frequency(self) -> np.ndarray:
        return np.bincount(self.tokens[self.in_train], minlength=len(self.words))

    def before(self, classes: np.ndarray, end: int) -> np.ndarray:
        """The class before each token; the text end's before a first one."""
        out = np.empty(len(self.tokens), classes.dtype)
        out[1:] = classes[self.tokens[:-1]]
        out[self.starts] = end
        return out

    def after(self, classes: np.ndarray, end: int) -> np.ndarray:
        """The class after each token; the text end's after a last one."""
        out = np.empty(len(self.tokens), classes.dtype)
        out[:-1] = classes[self.tokens[1:]]
        out[self.starts + self.counts - 1] = end
        return out


def _each_block(blocks: DataFrame, fn, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            arrays = fn(Block(row), row)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    return arrow_map(blocks, run, schema, rows=1)


def _classes_of(words: np.ndarray, known: np.ndarray, classes: np.ndarray, rest: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, classes[at], rest)


def _summed(counted: DataFrame, size: int) -> np.ndarray:
    """The sums by code of (code, n), a table of ``size`` cells."""
    found = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return table


def _sparse(code: np.ndarray, size: int) -> list[np.ndarray]:
    n = np.bincount(code, minlength=size)
    some = np.flatnonzero(n)
    return [some, n[some]]


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, pairs: np.ndarray, movable: int) -> np.ndarray:
    """One round of exchange over words in order.

    before, after (n, K): each word's neighbours by class; pairs (K, K): class bigrams. A word moves
    among the first ``movable`` classes to where sum N log N of bigrams less that of both margins is largest.
    """

    def nlogn(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0)

    classes, pairs = classes.copy(), pairs.astype(float)
    k = np.arange(movable)
    for w in range(len(classes)):
        old = classes[w]
        if old >= movable:
            continue
        p, q = before[w].astype(float), after[w].astype(float)
        pairs[:, old] -= p
        pairs[old, :] -= q
        np.maximum(pairs, 0, out=pairs)  # a word beside itself is taken away twice
        rows, cols = pairs.sum(1), pairs.sum(0)
        gain = (nlogn(pairs[:, :movable] + p[:, None]) - nlogn(pairs[:, :movable])).sum(0)
        gain += (nlogn(pairs[:movable] + q[None]) - nlogn(pairs[:movable])).sum(1)
        gain -= nlogn(cols[k] + p.sum()) - nlogn(cols[k]) + nlogn(rows[k] + q.sum()) - nlogn(rows[k])
        new = int(gain.argmax())
        classes[w] = new
        pairs[:, new] += p
        pairs[new, :] += q
    return classes


def frequent_words(blocks: DataFrame, share: float) -> tuple[int, np.ndarray, np.ndarray]:
    """All training tokens, and the words with at least ``share`` of them with their counts, most frequent first.

    A word that a block leaves out has less than share / 8 of that block, so what the first pass finds
    is at least 7/8 of what such a word has: few candidates pass, and the second pass counts them exactly.
    """

    def large(b: Block, row: dict) -> list:
        n = b.frequency()
        keep = n >= share / 8 * max(1, n.sum())
        return [b.words[keep], n[keep], np.full(keep.sum(), n.sum())]

    def total(b: Block, row: dict) -> list:
        return [np.array([b.in_train.sum()])]

    n_train = _each_block(blocks, total, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    found = _each_block(blocks, large, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    may = found.where((F.col("n") + share / 8 * (n_train - F.col("t")) >= share * n_train) & (F.col("h") != END) & (F.lit(n_train) > 0))
    candidates = np.sort(np.array([r["h"] for r in may.select("h").collect()], np.int64))  # at most 8 / 7 / share

    def exact(b: Block, row: dict) -> list:
        at = np.flatnonzero(np.isin(b.words, candidates, assume_unique=True))
        return [b.words[at], b.frequency()[at]]

    if not len(candidates):
        return n_train, candidates, candidates
    counted = _each_block(blocks, exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n_train).toArrow()
    h, n = counted.column("h").to_numpy(), counted.column("n").to_numpy()
    order = np.lexsort((h, -n))
    return n_train, h[order], n[order]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and known_score for each row of ``docs``.

    Scores are log10 probabilities. A null or empty text is one end token. Words that the training
    texts lack have together the share of words seen once, dealt evenly to as many unseen words as
    Chao's estimate gives (seen once squared, over twice the number seen twice): the probabilities of
    all words sum to one. known_score is the part of score from known tokens. The class before an
    unknown word stands for it. Rows with repeated or null ids are separate texts. Without training
    texts every word is unknown. Other columns are not read; empty input, empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    stored = staged(encode_blocks(docs))
    blocks = stored.drop("ids")
    end, rest = classes - 1, classes  # the end's class, and the class of words without one yet
    k = classes + 1
    n_train, top, _ = frequent_words(blocks, SHARE)
    words = np.append(np.int64(END), top)
    order = np.argsort(words)
    known = words[order]
    found = np.concatenate(([end], np.arange(len(top)) % (classes - 1)))[order]

    def neighbours(b: Block, row: dict) -> list:
        number = _classes_of(b.words, known, np.arange(len(known)), len(known))
        cls = np.append(found, rest)[number]
        here = b.in_train
        code = number[b.tokens[here]] * (2 * k)
        return _sparse(np.concatenate([code + b.before(cls, end)[here], code + k + b.after(cls, end)[here]]), (len(known) + 1) * 2 * k)

    def pairs_of(table: np.ndarray) -> np.ndarray:
        pairs = np.zeros((k, k))
        np.add.at(pairs.T, np.append(found, rest), table[:, 0])
        return pairs

    pairs = np.ones((k, k))
    for again in range(rounds + 1 if len(top) else 0):
        table = _summed(_each_block(blocks, neighbours, "code long, n long"), (len(known) + 1) * 2 * k).reshape(-1, 2, k)
        pairs = pairs_of(table)
        moved = exchange(found, table[:-1, 0], table[:-1, 1], pairs, classes - 1) if again < rounds else found
        if (moved == found).all():
            break
        found = moved
    # what a neighbour's class says about a word's class: log p(a, b) / (p(a) p(b)); no class, nothing
    all_pairs = np.log(pairs.sum() + 0.5 * k * k)
    left, right = (np.log(pairs.sum(x) + 0.5 * k) - all_pairs for x in (1, 0))
    told = np.log(pairs + 0.5) - all_pairs - left[:, None] - right[None]
    gain = np.concatenate([told[:, : classes - 1], told[: classes - 1].T])  # neighbours before, then after
    gain[[rest, k + rest]] = 0

    ranges = max(1, -(-int(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).head()[0]) * 12 // RANGE))

    def deal(b: Block, row: dict) -> list:
        cls = _classes_of(b.words, known, found, rest)
        here = b.in_train & (cls == rest)[b.tokens]
        code = b.tokens[here].astype(np.int64) * (2 * k)
        code, n = np.unique(np.concatenate([code + b.before(cls, end)[here], code + k + b.after(cls, end)[here]]), return_counts=True)
        word, code = np.divmod(code, 2 * k)
        per_word, count = np.bincount(word, minlength=len(b.words)), b.frequency()
        codes_at = np.concatenate(([0], np.cumsum(per_word)))
        part = (((b.words >> 32) + (1 << 31)) * ranges) >> 32
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        bodies = []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            c = slice(codes_at[x], codes_at[y])
            bodies.append(pack(b.words[x:y], count[x:y].astype(np.int32), per_word[x:y].astype(np.int32), code[c].astype(np.uint8), n[c].astype(np.int32)))
        return [part[edges[:-1]], np.full(len(bodies), row["block"]), pa.array(bodies, pa.binary())]

    def decide(table: pa.Table) -> pa.Table:
        """A hash range: the count and class of each word, for every block that has it."""
        bodies = [unpack(x.as_py(), np.int64, np.int32, np.int32, np.uint8, np.int32) for x in table.column("body")]
        h, count, per_word, code, n = (np.concatenate(x) for x in zip(*bodies, strict=True))
        distinct, of = np.unique(h, return_inverse=True)
        total = np.bincount(of, count, len(distinct)).astype(np.int64)
        seen = np.bincount(np.repeat(of, per_word) * (2 * k) + code, n, len(distinct) * 2 * k).reshape(-1, 2 * k)
        cls = np.round(seen @ gain, 9).argmax(1)
        placed = _classes_of(distinct, known, found, -1)
        cls = np.where(placed >= 0, placed, cls)
        ends = np.cumsum([len(x[0]) for x in bodies])
        packed = [pack(total[of[e - len(x[0]) : e]], cls[of[e - len(x[0]) : e]].astype(np.uint8)) for e, x in zip(ends.tolist(), bodies, strict=True)]
        once = [[int((total == t).sum() if t else (total > 0).sum())] + [0] * (len(bodies) - 1) for t in (0, 1, 2)]
        columns = {"block": table.column("block"), "part": table.column("part"), "body": pa.array(packed, pa.binary())}
        return pa.table(columns | {name: pa.array(x, pa.int64()) for name, x in zip(("v", "once", "twice"), once, strict=True)})

    dealt = _each_block(blocks, deal, "part long, block long, body binary")
    decided = dealt.groupBy("part").applyInArrow(decide, "block long, part long, body binary, v long, once long, twice long")

    def resolve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        n, c = (np.concatenate(x) for x in zip(*[unpack(x.as_py(), np.int64, np.uint8) for x in right.column("body")], strict=True))
        out = {name: left.column(name) for name in ("ids", "train", "counts", "tokens")} | {"known": pa.array([pack(n, c)], pa.binary())}
        return pa.table(out | {name: pa.array([sum(right.column(name).to_pylist())], pa.int64()) for name in ("v", "once", "twice")})

    tokens = stored.drop("words", "n_words").groupBy("block")
    resolved = staged(tokens.cogroup(decided.groupBy("block")).applyInArrow(resolve, "ids binary, train binary, counts binary, tokens binary, known binary, v long, once long, twice long"))

    def transitions(b: Block, row: dict) -> list:
        cls = unpack(row["known"], np.int64, np.uint8)[1].astype(np.int64)
        return _sparse(b.before(cls, end)[b.in_train] * classes + cls[b.tokens[b.in_train]], classes * classes)

    pairs = _summed(_each_block(resolved.drop("ids"), transitions, "code long, n long"), classes * classes).reshape(classes, classes)
    v, once, twice = (x or 0 for x in resolved.agg(F.sum("v"), F.sum("once"), F.sum("twice")).head())
    unknown = min(0.5, max(once, 0.5) / max(n_train, 1))
    one_unknown = unknown / max(1.0, once * once / (2 * max(twice, 1)))
    p_class = (pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * classes)
    per_class = p_class / np.maximum(pairs.sum(0), 1)  # times a word's count: its probability given the class before

    def score(b: Block, row: dict) -> list:
        n, cls = unpack(row["known"], np.int64, np.uint8)
        count, here = n[b.tokens], cls.astype(np.int64)[b.tokens]
        # the last known word's class stands for unknown ones between
        last = np.where(count > 0, np.arange(len(count)), -1)
        run = np.maximum.accumulate(last)
        previous = np.full(len(count), end)
        previous[1:] = np.where(run[:-1] >= np.repeat(b.starts, b.counts)[1:], here[np.maximum(run[:-1], 0)], end)
        previous[b.starts] = end
        p = (1 - unknown) * count * (WEIGHT * per_class[previous, here] + (1 - WEIGHT) / max(n_train, 1))
        p = np.log10(np.where(count > 0, p, one_unknown))
        base = np.log10((count + 0.5) / (n_train + 0.5 * (v + 1)))
        ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
        sums = [np.add.reduceat(x, b.starts) for x in ((count > 0).astype(np.int64), base, p, np.where(count > 0, p, 0))]
        return [ids, ~b.train, b.counts, sums[0], np.full(len(b.counts), n_train, np.int64), *sums[1:]]

    out = _each_block(resolved, score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double")
    return out.withColumnRenamed("id", id_col)
