import collections
import math
import re
import zlib

import numpy as np

from slotmeter.llm import class_lm
from slotmeter.llm.class_lm import exchange, score_texts
from tests.llm import brute


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", brute.lower(text or "")) + [None]


def check(docs, rows):
    count = collections.Counter(t for i, x in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    left = collections.defaultdict(list)
    for r in rows:
        left[r["doc_id"]].append(r)
    assert len(rows) == len(docs)
    for i, x in docs:
        t = tokens(x)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert any(r["n_tokens"] == len(t) and r["n_known"] == sum(count[w] > 0 for w in t) and r["train_tokens"] == n and abs(r["base_score"] - base) < 1e-6 * max(1, -base) for r in left[i])


def test_counts_and_base_and_a_better_score(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    rows = score_texts(table).collect()
    check(docs, rows)
    out = [r for r in rows if r["held_out"]]
    score, base = (sum(r[c] for r in out) / sum(r["n_tokens"] for r in out) for c in ("score", "base_score"))
    assert score > base + 0.1
    # the gain comes from known words: base gives them what score - known_score cannot change
    count = collections.Counter(t for i, x in docs if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    known_base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for i, x in docs if zlib.crc32(str(i).encode()) % 5 == 1 for w in tokens(x) if count[w])
    assert sum(r["known_score"] for r in out) / sum(r["n_known"] for r in out) > known_base / sum(r["n_known"] for r in out) + 0.2
    # all unseen words of the held-out texts together have less than the share of unseen words
    unseen = {w for i, x in docs if zlib.crc32(str(i).encode()) % 5 == 1 for w in tokens(x) if not count[w]}
    one = next((r["score"] - r["known_score"]) / (r["n_tokens"] - r["n_known"]) for r in out if r["n_tokens"] > r["n_known"])
    assert 0 < len(unseen) * 10**one < sum(c == 1 for c in count.values()) / n


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r for r in score_texts(table.coalesce(1)).collect()}
    for name, value in (("BLOCK", 1 << 14), ("RANGE", 1 << 14)):
        monkeypatch.setattr(class_lm, name, value)
    got = score_texts(table.repartition(7)).collect()
    assert len(got) == len(want) and all(abs(r[c] - want[r["doc_id"]][c]) < 1e-6 for r in got for c in ("score", "base_score", "known_score"))


def test_frequent_words_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.3, 400)) for _ in range(60)] + ["burst " * 200]
    docs = [(i, x) for i, x in enumerate(texts)]
    count = collections.Counter(t for i, x in docs if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    monkeypatch.setattr(class_lm, "BLOCK", 1 << 10)
    n, words, counts = class_lm.frequent_words(class_lm.encode_blocks(spark.createDataFrame(docs, "id long, text string").repartition(4)), 1 / 200)
    want = sorted((c for w, c in count.items() if w is not None and c >= sum(count.values()) / 200), reverse=True)
    assert n == sum(count.values()) and counts.tolist() == want and len(set(words.tolist())) == len(want)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "x " * 50_000), (4, " \n")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as score", "text as block")
    check(docs, score_texts(table).collect())
    assert score_texts(table.limit(0)).collect() == []
    held = [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = score_texts(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(0)
    words, text = rng.permutation(40), []
    for _ in range(400):
        language = rng.integers(2)
        text += [*(words[language * 20 + rng.integers(20, size=10)])]
    text, classes = np.array(text), np.arange(40) % 4
    for _ in range(8):
        before, after = np.zeros((40, 4)), np.zeros((40, 4))
        np.add.at(before, (text[1:], classes[text[:-1]]), 1)
        np.add.at(after, (text[:-1], classes[text[1:]]), 1)
        pairs = np.zeros((4, 4))
        np.add.at(pairs, (classes[text[:-1]], classes[text[1:]]), 1)
        classes = exchange(classes, before, after, pairs, 4)
    assert not set(classes[words[:20]]) & set(classes[words[20:]])
