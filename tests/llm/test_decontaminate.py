import re

import pytest

from slotmeter.llm import decontaminate
from slotmeter.llm.decontaminate import drop_contaminated, find_contamination
from tests.llm import brute

ITEMS = [("a", " ".join(f"w{k}" for k in range(14))), ("b", "Short ITEM, here"), ("b", "other words of item b"), ("c", None), ("d", ""), (None, "no id item"), ("e", "Short item here"), ("f", "été 日本 \u00a0x")]
CLEAN = "nothing of that kind"
DOCS = [
    (1, "x W0 w1, w2-w3 w4 w5 w6 w7 w8 w9 y w10"), (1, "x W0 w1, w2-w3 w4 w5 w6 w7 w8 w9 y w10"), (2, " ".join(f"w{k}" for k in range(14))), (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (4, None), (5, ""), (6, "short!item?HERE short item here"),
    (None, "a no id item"), (7, CLEAN), (8, "z " * 200_000 + "other words of item b"), (9, "ÉTÉ été 日本 \u00a0x"), (9, CLEAN), (10, "été 日本 \u00a0X"),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or ""))


def want(text, items, n=10):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        v = words(t)
        for k in range(max(1, len(v) - n + 1)) if v else ():
            window = v[k : k + n]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found |= {i} - {None}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard", [2 << 20, 40])
def test_same_as_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "text as items", "doc_id as n_hit", "text as hit").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id string, text string").selectExpr("*", "text as t", "item_id as i")
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in find_contamination(docs, items).collect()]
    assert sorted(got, key=key) == sorted([(i, *want(t, ITEMS)) for i, t in DOCS], key=key)
    texts = dict((i, t) for i, t in DOCS)
    for r in find_contamination(docs, items).where("doc_id in (1, 2, 6, 8)").collect():
        covered = " ".join(texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"])
        assert len(words(covered)) == r["n_hit"]
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted((str(i), t or "") for i, t in DOCS if not want(t, ITEMS)[1])


@pytest.mark.parametrize("shard", [2 << 20, 40])
def test_empty_tables(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert find_contamination(docs.limit(0), items).collect() == []
    assert all(r["n_hit"] == 0 and r["items"] == [] and r["spans"] == [] for r in find_contamination(docs, items.limit(0)).collect())
    assert drop_contaminated(docs, items.limit(0)).count() == len(DOCS)
