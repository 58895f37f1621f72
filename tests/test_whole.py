"""Queries whose results hold every row and character of their inputs."""

from itertools import permutations

import numpy as np

from slotmeter.plans import fixtures as fx
from slotmeter.plans import registry

SF = "/root/testdata/sf0.001"
STOPS = ("</LIST>", "\n\n###")


def answer(text):
    for stop in STOPS:
        text = text.split(stop, 1)[0]
    return text.strip(" \t\n\x0b\x0c\r")


def test_extract_response_reads_the_whole_text(spark, tmp_path):
    deep = "w " * 2000
    texts = ["short", deep, deep + "</LIST> after", deep + "\n\n### after", " \t" + deep + "\n", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["answer"] for r in registry.QUERIES["extract_response"](spark, str(tmp_path)).collect()}
    assert got == {i: answer(t) for i, t in enumerate(texts)}


def test_jaccard_pairs_have_the_tokens_of_all_slots(spark):
    sets = {}
    for r in fx.facts(spark, SF).collect():
        token = " ".join(f"{r['slot']}={r['value']}".split()).lower()
        sets.setdefault(r["topic"], {}).setdefault(r["example_id"], set()).add(token)
    want = {(a, b): round(len(s[a] & s[b]) / len(s[a] | s[b]), 6) for s in sets.values() for a, b in permutations(sorted(s), 2) if b % 50 == 0 and s[a] & s[b]}
    got = registry.QUERIES["jaccard_pairs"](spark, SF).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_cosine_pairs_compare_a_query_with_all_rows_of_its_label(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = 0.6 * (x @ x.T + 1) / 2
    np.fill_diagonal(k, 1)
    pairs = [(i, j) for j, b in enumerate(rows) if b["vec_id"] % 50 == 0 for i, a in enumerate(rows) if a["label"] == b["label"]]
    want = {(rows[i]["vec_id"], rows[j]["vec_id"]): k[i, j] for i, j in pairs}
    got = {(r["a"], r["b"]): r["k"] for r in registry.QUERIES["cosine_pairs"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)
