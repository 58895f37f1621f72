import numpy as np
import pytest

from slotmeter.llm.multi_index import bounds, codebook, link_vectors, traverse
from tests.llm import brute


def test_same_as_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = [r["vec_id"] for r in rows], np.array([r["label"] for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    root = brute.closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)])
    for slack in (1.0, 0.6):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(table, slack=slack).collect()}
        assert got == {i: (int(h.sum()), root[i], root[i] == i) for i, h in zip(ids, hit, strict=True)}


def planted(dim, n):
    """Pairs at a cosine just above 0.98, a third of them with the difference in one half only."""
    rng = np.random.default_rng(dim)
    rows = []
    for k in range(n):
        a = rng.standard_normal(dim)
        a /= np.linalg.norm(a)
        d = rng.standard_normal(dim)
        d[: dim // 2] *= k % 3 != 0
        d -= (d @ a) * a
        b = a * 0.9805 + d / np.linalg.norm(d) * np.sqrt(1 - 0.9805**2)
        rows += [(2 * k, a.tolist(), k % 2), (2 * k + 1, b.tolist(), k % 2)]
    return rows


@pytest.mark.parametrize("dim", [4, 8, 64])
def test_links_across_codeword_borders_are_found_from_both_ends(spark, dim):
    rows = planted(dim, 400)
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    assert hit.sum() >= len(rows)
    half = dim // 2
    first, second = (bounds(y, codebook(y, 16))[0] for y in (x[:, :half], x[:, half:]))
    assert (hit & (first[:, None] != first[None])).any() and (hit & (second[:, None] != second[None])).any()
    root = brute.closure(range(len(x)), list(zip(*np.nonzero(hit), strict=True)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (int(h.sum()), root[i]) for i, h in enumerate(hit)}


def test_edge_cases(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None),
        (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 0.0, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, [None, 1.0, 0.0], 1),
        (11, [], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (13, [1e200, 0.0, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "vec_id as n_links", "label as v")
    got = link_vectors(table).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert [by[i]["n_links"] for i in (1, 2, 3, 13)] == [3] * 4 and {by[i]["component_id"] for i in (1, 2, 3, 13)} == {1}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(4, 13))
    assert by[None]["n_links"] == 0 and by[None]["kept"]
    assert link_vectors(table.limit(0)).collect() == []


def test_traversal_gives_cells_in_order_and_all_within_the_limit():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    cells = list(traverse(a, b, 0.7))
    costs = [a[i] ** 2 + b[j] ** 2 for i, j in cells]
    assert costs == sorted(costs) and set(cells) == {(i, j) for i in range(9) for j in range(7) if a[i] ** 2 + b[j] ** 2 <= 0.7}
    assert len(codebook(np.ones((5, 3)), 4)) == 1
