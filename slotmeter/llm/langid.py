"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads each word of a text in both directions and labels every byte; a text's probabilities
are the means over all bytes of its words. A word reads the same wherever it stands, so a batch reads
each of its distinct words once, and training needs only how often every language has a word: the words
of all labelled texts are counted, and the network is fitted here, in numpy, by backpropagation through
time on every counted word, shard by shard, with the shards' weights averaged after each round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, staged

#: Units of each direction, bytes of a window (longer words are cut), windows run at once.
HIDDEN, WINDOW, AT_ONCE = 8, 128, 4096
#: Words of a shard, words of a training step, least steps of the first shard, rounds over all shards.
SHARD, STEP, FIRST, ROUNDS = 100_000, 1024, 200, 1
#: Words that have more than this share of a language's words are learnt in every shard.
COMMON = 1e-4
#: A text is rejected below this part of the score that all but the lowest ``LOWEST`` of the labelled texts reach.
PART, LOWEST = 0.8, 0.005
#: Steps of a score in the distribution from which the latter is read; texts of a batch, words summed at once.
GRID, ROWS, SUMMED = 10_000, 4000, 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGru:
    """Weights: for each direction inputs w (256, 3h), state u (h, 3h), bias b (3h); output v (2h, classes), c.

    Gates are ordered update, reset, candidate. h' = (1 - z) * n + z * h, n = tanh(x + r * (h @ u_n)).
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 1) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.classes, self.h, self.least = classes, h, 0.0
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(3 * h, np.float32)
        self.p["v"] = rng.normal(0, 0.3, (2 * h, len(classes))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    # training

    def _forward(self, x: np.ndarray, d: str, there: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States after each step (T, B, h) of one direction, and what backpropagation needs; zero where ``there`` (T, B, 1) is."""
        h, p = self.h, self.p
        state, states, memory = np.zeros((x.shape[1], h), np.float32), [], []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = p[f"w{d}"][x[t]] + p[f"b{d}"]
            s = state @ p[f"u{d}"]
            g = _sigmoid(a[:, : 2 * h] + s[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * s[:, 2 * h :])
            memory.append((t, state, z, r, n, s[:, 2 * h :]))
            state = (1 - z) * n + z * state
            if there is not None:
                state = state * there[t]
            states.append(state)
        return np.stack(states if d == "f" else states[::-1]), memory

    def _backward(self, x: np.ndarray, d: str, memory: list, outer: np.ndarray, grad: dict, there: np.ndarray | None = None) -> None:
        h, p = self.h, self.p
        carry, inputs = np.zeros_like(outer[0]), []
        for t, before, z, r, n, sn in reversed(memory):
            g = outer[t] + carry if there is None else (outer[t] + carry) * there[t]
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (before - n) * z * (1 - z)
            dr = dn * sn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            ds = np.concatenate([dz, dr, dn * r], axis=1)
            inputs.append((x[t].astype(np.int64)[:, None] * (3 * h) + np.arange(3 * h), da))
            grad[f"b{d}"] += da.sum(0)
            grad[f"u{d}"] += before.T @ ds
            carry = g * z + ds @ p[f"u{d}"].T
        at, value = (np.concatenate([i[k].ravel() for i in inputs]) for k in (0, 1))
        grad[f"w{d}"] += np.bincount(at, value, 256 * 3 * h).reshape(256, 3 * h)

    def fit(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray, passes: int = 1, rate: float = 0.02, last: float = 0.0, seed: int = 2) -> ByteGru:
        """Adam on the weighted mean cross-entropy of all bytes of the words raw[offsets[k]:offsets[k + 1]], none above WINDOW bytes.

        Every pass takes every word once; the rate falls from ``rate`` to ``last``.
        """
        rng, length, n, done = np.random.default_rng(seed), np.diff(offsets), len(label), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps = passes * -(-n // STEP)
        for _ in range(passes):
            order, parts = rng.permutation(n), []
            for some in np.array_split(order, -(-n // (16 * STEP))):  # words of like length together
                parts += np.array_split(some[np.argsort(length[some], kind="stable")], -(-len(some) // STEP))
            for part in rng.permutation(len(parts)):
                rows, done = parts[part], done + 1
                at = np.arange(int(length[rows].max()))
                mask = at < length[rows][:, None]
                x = (raw[np.minimum(offsets[:-1][rows][:, None] + at, len(raw) - 1)] * mask).T
                m = (mask.T * weight[rows]).astype(np.float32)[..., None]
                grad = self._gradient(x, m / m.sum(), label[rows])
                now = max(rate - (rate - last) * done / steps, last)
                for k, g in grad.items():
                    np.clip(g, -1, 1, out=g)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= now * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, share: np.ndarray, y: np.ndarray) -> dict:
        """Of the cross-entropy of all positions of windows x (T, B), each with its share (T, B, 1), and labels y (B)."""
        there = (share > 0).astype(np.float32)  # backwards, padding comes before the word
        hf, mf = self._forward(x, "f")
        hb, mb = self._forward(x, "b", there)
        both = np.concatenate([hf, hb], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        prob = np.exp(logits - logits.max(2, keepdims=True))
        prob /= prob.sum(2, keepdims=True)
        prob[:, np.arange(len(y)), y] -= 1
        d_logits = prob * share
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["v"] = np.einsum("tbh,tbc->hc", both, d_logits)
        grad["c"] = d_logits.sum((0, 1))
        outer = d_logits @ self.p["v"].T
        self._backward(x, "f", mf, outer[..., : self.h], grad)
        self._backward(x, "b", mb, outer[..., self.h :], grad, there)
        return grad

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def copy(self, weights: np.ndarray | None = None) -> ByteGru:
        """The network again, with ``weights`` as ``packed`` gives them."""
        out, at, weights = ByteGru(self.classes, self.h), 0, self.packed() if weights is None else weights
        for k in sorted(out.p):
            out.p[k] = weights[at : at + out.p[k].size].reshape(out.p[k].shape).copy()
            at += out.p[k].size
        return out

    # inference

    def position_sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over the positions of each window (B, T) of the position probabilities."""
        h, p, n = self.h, self.p, len(x)
        steps = x.T.copy()
        kept = np.empty((len(steps), n, h), np.float32)
        tables = {d: p[f"w{d}"] + p[f"b{d}"] for d in "fb"}

        def advance(state: np.ndarray, t: int, d: str) -> np.ndarray:
            a = tables[d].take(steps[t], axis=0)
            s = state @ p[f"u{d}"]
            a[:, : 2 * h] += s[:, : 2 * h]
            g = a[:, : 2 * h]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            c = s[:, 2 * h :]
            c *= g[:, h:]
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            state -= c  # n + z * (h - n)
            state *= g[:, :h]
            state += c
            return state

        state = np.zeros((n, h), np.float32)
        for t in range(len(steps)):
            state = advance(state, t, "f")
            kept[t] = state
        sums = np.zeros((n, len(self.classes)), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in reversed(range(len(steps))):
            state = advance(state, t, "b")
            logits = kept[t] @ p["v"][:h] + state @ p["v"][h:] + p["c"]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1)[:, None]
            sums += logits
        return sums

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each word raw[offsets[k]:offsets[k + 1]] of their probabilities; windows have no padding."""
        length = np.diff(offsets)
        n = -(-length // WINDOW)
        owner = np.repeat(np.arange(len(length)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[:-1][owner] + inner * WINDOW
        left = np.minimum(length[owner] - inner * WINDOW, WINDOW)
        total = np.zeros((len(length), len(self.classes)))
        order = np.argsort(left, kind="stable")
        for width, begin, end in zip(*np.unique(left[order], return_index=True), [*np.flatnonzero(np.diff(left[order])) + 1, len(order)], strict=True):
            for k in range(begin, end, AT_ONCE):
                rows = order[k : min(k + AT_ONCE, end)]
                np.add.at(total, owner[rows], self.position_sums(raw[starts[rows][:, None] + np.arange(width)]))
        return total

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities of the bytes of all words of each text; each distinct word is read once."""
        words = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        coded = words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py()).dictionary_encode()
        raw, offsets = _bytes_of(coded.dictionary)
        each = np.hstack([self.sums(raw, offsets), np.diff(offsets)[:, None]])
        codes, ends = coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        total, a = np.zeros((len(texts), each.shape[1])), 0
        while a < len(texts):  # some texts at once
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SUMMED, "right")) - 1)
            some = [k for k in range(a, b) if ends[k + 1] > ends[k]]
            if some:
                total[some] = np.add.reduceat(each[codes[ends[a] : ends[b]]], ends[some] - ends[a])
            a = b
        return total[:, :-1] / np.maximum(total[:, -1:], 1)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins and ends."""
    blobs = strings.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    return (np.frombuffer(blobs.buffers()[2], np.uint8) if len(blobs) and blobs.buffers()[2] else np.zeros(0, np.uint8)), offsets


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n): the words of all texts (text, lang), with how often a language has them; words above WINDOW bytes are cut."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = batch.column(1).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(0).filter(pc.equal(langs.indices, code))
            found = pc.value_counts(pc.utf8_split_whitespace(texts.cast(pa.large_string())).flatten().cast(pa.large_binary()))
            words, n = found.field("values"), found.field("counts")
            long = pc.greater(pc.binary_length(words), WINDOW)
            if pc.any(long).as_py():
                cut = [(w[k : k + WINDOW], c) for w, c in zip(words.filter(long).to_pylist(), n.filter(long).to_pylist(), strict=True) for k in range(0, len(w), WINDOW)]
                words = pa.concat_arrays([words.filter(pc.invert(long)), pa.array([w for w, _ in cut], pa.large_binary())])
                n = pa.concat_arrays([n.filter(pc.invert(long)), pa.array([c for _, c in cut], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.binary()), n], names=["lang", "word", "n"])

    found = arrow_map(labelled.select("text", "lang"), run, "lang string, word binary, n long", rows=ROWS)
    return found.where("length(word) > 0").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _rows(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: bool = True) -> ByteGru | None:
    """Train on all words of all labelled texts; None without any.

    A word weighs the logarithm of its count, and every language the same. The first shard of words starts
    the network; then each round takes every word of every shard once, and the shards' weights are averaged.
    Shards go by hash, so the model does not depend on how texts are dealt. With ``threshold`` the score
    below which a text has no language is read from the scores of all labelled texts.
    """
    rows = _rows(labelled, text_col, lang_col)
    words = staged(count_words(rows))
    heavy = F.log2(F.col("n") + 1)
    told = {r["lang"]: r for r in words.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(heavy).alias("w"), F.count(F.lit(1)).alias("v")).collect()}
    if not told:
        return None
    shards, classes = -(-sum(r["v"] for r in told.values()) // SHARD), sorted(told)
    of = lambda f: F.element_at(F.create_map(*[F.lit(x) for lang, r in told.items() for x in (lang, f(r))]), F.col("lang"))
    common = F.col("n") > of(lambda r: COMMON * r["n"])
    own = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = words.select("lang", "word", (heavy / of(lambda r: r["w"])).alias("weight"), F.explode(F.when(common, everywhere).otherwise(F.array(own))).alias("shard"))
    model = ByteGru(classes)
    for k in range(ROUNDS + 1):
        model = _round(dealt.where("shard = 0") if k == 0 else dealt, model, k)
    return learn_least(rows, model) if threshold else model


def _round(dealt: DataFrame, model: ByteGru, k: int) -> ByteGru:
    """One round over all shards, each a task; round 0 has one shard, and passes enough to get the network started."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("word", "ascending"), ("lang", "ascending")]).combine_chunks()
        raw, offsets = _bytes_of(table.column("word").combine_chunks())
        label = np.searchsorted(model.classes, table.column("lang").to_pylist())
        weight = table.column("weight").to_numpy()
        steps = -(-len(label) // STEP)
        mine = model.copy()
        if k == 0:
            mine.fit(raw, offsets, label, weight, max(1, -(-FIRST // steps)), 0.02, 0.01)
        else:
            mine.fit(raw, offsets, label, weight, 1, 0.01 / k, 0.01 / k / 10)
        return pa.table({"weights": pa.array([mine.packed()], pa.list_(pa.float32()))})

    trained = dealt.groupBy("shard").applyInArrow(run, "weights array<float>")
    at = F.posexplode("weights").alias("at", "x")
    mean = trained.select(at).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()
    return model.copy(np.array([r["x"] for r in mean], np.float32))


def learn_least(labelled: DataFrame, model: ByteGru) -> ByteGru:
    """Set ``least``, the score below which a text has no language, from the scores of all labelled texts (text, lang) with a letter."""
    scored = identify(labelled.select(F.lit(None).cast("long").alias("doc_id"), "text"), model).where(F.col("lang_pred") != UNKNOWN)
    told = sorted((r["at"], r["count"]) for r in scored.select(F.floor(F.col("score") * GRID).alias("at")).groupBy("at").count().collect())
    if told:
        first = np.searchsorted(np.cumsum([n for _, n in told]), LOWEST * sum(n for _, n in told), "right")
        model.least = PART * told[first][0] / GRID
    return model


def identify(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, lang_pred and score (the winner's mean position probability) for each row of ``docs``.

    ``keep`` names further columns to carry along; they must not be called like a result column.
    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language
    was learned. Ties go to the first language by name. Ids may repeat or be null.
    """
    carried = keep or []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1)
        strings = texts.to_pylist()
        lettered = np.array([t is not None and bool(_LETTER.search(t)) for t in strings])
        names, scores = [UNKNOWN] * len(strings), np.zeros(len(strings))
        if model is not None and lettered.any():
            prob = model.predict(texts.filter(pa.array(lettered)))
            best = prob.argmax(1)
            for k, b in zip(np.flatnonzero(lettered).tolist(), best.tolist(), strict=True):
                names[k] = model.classes[b]
            scores[lettered] = np.clip(prob[np.arange(len(best)), best], 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(names), pa.array(scores)], names=["id", *carried, "lang_pred", "score"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in carried])
    schema = base.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return arrow_map(base, run, schema, rows=ROWS).withColumnRenamed("id", id_col)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def reject_unknown(docs: DataFrame, model: ByteGru | None, text_col: str = "text", lang_col: str | None = None, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` with an identified language, with all their columns.

    Null texts, texts without a letter and texts whose score is below ``least`` (default: what the
    model learnt from its labelled texts) go, and every text if no language was learned. Where the
    column ``lang_col`` is null, the identified language takes its place. Rows are judged by their own
    text, so repeated or null ids do not matter; other columns are carried along unread.
    """
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None
    bound = (model.least if model else 0.0) if least is None else least

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        strings = batch.column(at).to_pylist()
        good = np.array([t is not None and bool(_LETTER.search(t)) for t in strings], bool)
        names: list[str | None] = [None] * len(strings)
        if model is None:
            good[:] = False
        elif good.any():
            some = np.flatnonzero(good)
            prob = model.predict(batch.column(at).filter(pa.array(good)))
            for k, b in zip(some.tolist(), prob.argmax(1).tolist(), strict=True):
                names[k] = model.classes[b]
            good[some] = prob.max(1) >= bound
        columns = list(batch.columns)
        if lang_at is not None:
            columns[lang_at] = pc.coalesce(columns[lang_at], pa.array(names, columns[lang_at].type))
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(good))

    return arrow_map(docs, run, docs.schema, rows=ROWS)
