"""Runs against a scan of every period, and the edge rules."""

import random

import numpy as np
from pyspark.sql import functions as F

from slotmeter.llm import periodic


def scanned(w: list, least: int, exponent: int) -> list[tuple]:
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p) and j > i:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, p, e) for (s, e), p in found.items())


def drawn(rng: random.Random) -> list:
    n, letters = rng.choice([0, 1, 5, 30, 60, 120]), rng.choice([1, 2, 3, 20])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 3))
        w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
    return w


def test_find_runs_is_a_scan_of_all_periods(monkeypatch):
    rng = random.Random(7)
    for trial in range(300):
        monkeypatch.setattr(periodic, "LEAVES", rng.choice([1, 40, 1 << 21]))  # smaller children in many portions
        texts = [drawn(rng) for _ in range(rng.randint(0, 5))]
        codes = np.array([x for t in texts for x in t], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts]).astype(np.int64)
        for least, exponent in ((24, 3), (4, 2), (1, 2), (10, 4)):
            got = list(zip(*(v.tolist() for v in periodic.find_runs(codes, owner, least, exponent)), strict=True))
            want, at = [], 0
            for t in texts:
                want += [(s + at, e + at, p) for s, p, e in scanned(t, least, exponent)]
                at += len(t)
            assert got == want, (texts, least, exponent)


def test_fibonacci_words_and_one_long_period():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for w in (b, [5] * 3000, list(range(700)) * 4 + [9]):
        got = periodic.find_runs(np.array(w, np.int64), np.zeros(len(w), np.int64), 6, 2)
        assert [(s, p, e) for s, e, p in zip(*(v.tolist() for v in got), strict=True)] == scanned(w, 6, 2)


def test_texts_and_edge_rules(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 4000)
    long = " ".join(f"w{i}" for i in range(3000)) + " a b c" * 900
    texts = ["x " * 30, None, "", " \t\n", "one", long, "á b " * 24, " a\x0bb" * 12 + "\r\n c", "x " * 30]
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)] + [(None, "q " * 24, "n", 2), (0, "x " * 30, "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, extra int")
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "extra", "n_words", "collapsed"]
    found = [r.asDict(recursive=True) for r in got.orderBy(F.col("doc_id").asc_nulls_last(), "extra").collect()]
    assert len(found) == len(rows)
    for r in found:
        w = (r["text"] or "").encode().split()
        runs = scanned(w, 24, 3)
        assert [(x["start"], x["period"], x["start"] + x["length"]) for x in r["runs"]] == runs and r["n_words"] == len(w)
        gone = {i for s, p, e in runs for i in range(s + p, e)}
        assert r["collapsed"] == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
