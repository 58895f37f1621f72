"""Collocations against plain counting, tiles against a Counter, and the edge rules."""

import random
import re
from collections import Counter

import numpy as np

from slotmeter.llm import phrases
from tests.llm.brute import lower


def brute(rows, least, longest, top):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) == 1:
            continue
        inside = any(v == lang and len(x) > len(w) and 100 * b >= 100 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (v, x), b in f.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (f[lang, w[:j]] * f[lang, w[j:]]), j) for j in range(1, len(w))]
            score, j = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:j]], f[lang, w[j:]]))
    found = []
    for lang, x in out.items():
        found += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(x)[:top])]  # noqa: E741
    return sorted(found)


def test_dense_and_sparse_tiles_count_alike(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = rng.zipf(1.3, 20000) % 5000, rng.zipf(1.3, 20000) % 5000
    want = Counter(zip(left.tolist(), right.tolist(), strict=True))
    for dense in (1, 50, 1 << 30):
        monkeypatch.setattr(phrases, "DENSE", dense)
        monkeypatch.setattr(phrases, "TILE", 64)
        code, n = phrases.count_cells(left.astype(np.int64), right.astype(np.int64))
        assert {(c >> 32, c & 0xFFFFFFFF): k for c, k in zip(code.tolist(), n.tolist(), strict=True)} == want


def test_same_as_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 3000)
    monkeypatch.setattr(phrases, "TILE", 4)
    monkeypatch.setattr(phrases, "DENSE", 20)
    rng = random.Random(3)
    vocabulary = ["the", "The", "a", "ä", "Ä", "x\xa0y", "new", "york", "🙂", "z"]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n", " \t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (" .,;:!?\n", "fr"), ("new york city hall " * 700, "en"), ("one", "fr")] + [("a b c d e f", "es")] * 12
    docs = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "id int, text string, lang string, a int").repartition(3)
    got = phrases.collocations(docs, least=10, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5, 25)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9000000000000 as a", "10000000000000 as n", "9100000000000 as l", "9300000000000 as r")
    got = row.select(phrases._score(row.a, row.n, row.l, row.r).alias("s")).head()[0]
    assert got == 1000 * 9000000000000 * 10000000000000 // (9100000000000 * 9300000000000)
