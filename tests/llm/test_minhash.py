import numpy as np
import pytest

from slotmeter.llm.components import components
from slotmeter.llm.minhash import bands, near_duplicates, signatures
from slotmeter.llm.wordhash import shingle_sets, word_hashes
from tests.llm import brute


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_same_as_brute_force_on_documents(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = result(near_duplicates(docs, n=n)), brute.near_duplicates(rows, n)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(1, "A b", "x"), (2, "a B", "y"), (3, None, "z"), (4, "", "z"), (5, " \n", "z"), (6, "solo", "z"), (7, "Solo", "z"), (8, long, None), (9, long + " more", None), (None, "a b", None), (2, "a B", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = near_duplicates(docs, n=2).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[4]["component_id"] == 4
    assert by[7]["component_id"] == 6 and by[9]["component_id"] == 8
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert near_duplicates(docs.limit(0), n=2).collect() == []


def test_a_chain_and_a_hub_are_found_whole(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words))]
    rng = np.random.default_rng(1)
    for i in range(1, 80):
        w = list(words)
        for k in rng.choice(60, rng.integers(1, 5), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows = [(79 - i, t) for i, t in rows]  # the hub has the largest id
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, n=2)) == brute.near_duplicates(rows, 2)


@pytest.mark.parametrize("texts", [[b"one two three"], [b"one two"], [b"one"], [b"one", b"", b"two"], [b""], [b"a b c", b"d e f g h i"]])
def test_slices_with_fewer_words_than_a_shingle(texts):
    got = shingle_sets(texts, 5)
    assert [len(x) for x in got] == [len(brute.shingles(t.decode(), 5)) for t in texts]
    # the same hashes as in a slice with longer texts
    longer = shingle_sets([*texts, b"p q r s t u v"], 5)
    assert all((x == y).all() for x, y in zip(got, longer, strict=False))


def test_one_short_document_alone(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert result(near_duplicates(docs)) == {1: (1, 1)}


def test_word_hashes_do_not_depend_on_place_or_case():
    a, n = word_hashes([b"The cat", None, b"", "Été the\n cat ".encode()])
    assert n.tolist() == [2, 0, 0, 3] and a[0] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 3
    long = b"ab " * 600_000
    hashes, n = word_hashes([long])
    assert n.tolist() == [600_000] and len(np.unique(hashes)) == 1


def test_equal_sets_have_equal_signatures_and_similar_ones_share_bins():
    a, b = shingle_sets([b"one two three four five six seven", b"one two three four five six seven eight"], 2)
    s = signatures([a, a, b])
    assert (s[0] == s[1]).all() and 0.6 < (s[0] == s[2]).mean() < 1 and bands(s).shape == (3, 40)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(51)) and found[101] == 100 and 7 in found
