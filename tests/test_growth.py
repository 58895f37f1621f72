"""Work that grows with the input and no faster: what is shuffled, and how many tasks rows are dealt to."""

from itertools import permutations

import numpy as np

from slotmeter.plans import fixtures as fx
from slotmeter.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_jaccard_pairs_shuffle_no_pairs_and_keep_copies_and_ids_of_two_topics(spark, tmp_path):
    rows = [(i, "red bolt" if i % 3 else "blue ring", f"Brand#{i % 4}", f"T{i % 2}", i % 5 * 10) for i in range(1, 130)]
    folder = parts(spark, tmp_path, rows + [(50, "old nut", "Brand#9", "T1", 30), (51, "old nut", "Brand#9", "T0", 31), (52, "red nut", "Brand#9", "T0", 31)])
    sets, size = {}, {}
    for r in fx.facts(spark, folder).collect():
        token = " ".join(f"{r['slot']}={r['value']}".split()).lower()
        sets.setdefault(r["topic"], {}).setdefault(r["example_id"], set()).add(token)
    for s in sets.values():
        for i, ts in s.items():
            size[i] = size.get(i, 0) + len(ts)
    shared = {}
    for s in sets.values():
        for a, b in permutations(s, 2):
            if b % 50 == 0 and s[a] & s[b]:
                shared[a, b] = shared.get((a, b), 0) + len(s[a] & s[b])
    found = registry.QUERIES["jaccard_pairs"](spark, folder)
    got = found.collect()
    assert len(got) == len(shared) and {(r["a"], r["b"]): r["jaccard"] for r in got} == {(a, b): round(c / (size[a] + size[b] - c), 6) for (a, b), c in shared.items()}
    assert "hashpartitioning(a#" not in plan(registry.QUERIES["jaccard_pairs"](spark, SF))


def test_examples_are_dealt_to_tasks_before_they_become_facts(spark, monkeypatch):
    monkeypatch.setattr(fx, "EXAMPLES", 20)
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() < 10
    assert fx.facts(spark, SF).rdd.getNumPartitions() == 10 and fx.candidates(spark, SF).rdd.getNumPartitions() == 10
    assert "hashpartitioning(example_id#" in plan(fx.predictions(spark, SF)) and plan(fx.predictions(spark, SF)).count("Exchange") == 1


def test_agreement_counts_in_the_pairs_row_what_slot_joins_count(spark):
    """Packed records against slot tables, and no row of a slot in the plan's shuffles."""
    from slotmeter.operators import verify as v
    from slotmeter.plans import routing

    pairs = fx.negatives(spark, SF)
    want = v.agreement(v.method_counts(pairs, routing.methods(spark, SF), routing.given(spark, SF)))
    found = routing.agreed(spark, SF)
    got = found.select(want.columns)
    assert want.count() == got.count() == 3 * pairs.count() and want.exceptAll(got).isEmpty()
    assert "slot#" not in "".join(x for x in plan(found).splitlines() if "Exchange" in x)


def test_sweeps_count_in_the_pairs_row(spark):
    """No row of a slot and no point of a grid is in the plan's shuffles."""
    for name in ("fusion_sweep", "scorer_comparison"):
        found = registry.QUERIES[name](spark, SF)
        shuffles = [x for x in plan(found).splitlines() if "Exchange" in x]
        assert shuffles and not any("slot#" in x or "hashpartitioning(r#" in x or "hashpartitioning(t#" in x for x in shuffles)
        assert "Generate" not in "".join(plan(found).split("Exchange hashpartitioning(example_id")[1:])


def test_facility_location_stores_no_kernel(spark, tmp_path, monkeypatch):
    """Few cells and many choose the same, as brute force does; tables between steps have a row a topic, never a row a pair."""
    from slotmeter.operators import selection as sel
    from slotmeter.plans import scoring

    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i // 3 % 2 if i % 9 else None) for i in range(600)]
    odd = [(1000, [0.0] * 4, 0), (1050, None, 0), (1100, [1.0, float("nan"), 0.0, 0.0], 1), (1101, [1.0, None, 0.0, 0.0], 1)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, sizes = {}, []
    for t in (0, 1):
        ids = np.array([i for i, _, label in rows if label == t])
        x = np.array([v for _, v, label in rows if label == t], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        js = [n for n, i in enumerate(ids) if i % 50 == 0]
        k = np.round((x @ x[js].T + 1) / 2, 9)
        best, taken = np.zeros(len(ids)), []
        for place in range(1, 4):
            gain = [-1 if j in taken else round(np.maximum(k[:, j] - best, 0).sum(), 6) for j in range(len(js))]
            taken.append(int(np.argmax(gain)))
            best = np.maximum(best, k[:, taken[-1]])
            want[t, place] = (int(ids[js[taken[-1]]]), max(gain))
    for module in (sel, scoring):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", lambda df, write=module.written: (lambda t: sizes.append(t.count()) or t)(write(df)))
    for block in (7, 2048):
        monkeypatch.setattr(sel.facility_location_of_vectors, "__defaults__", (block,))
        got = {(r["topic"], r["place"]): (r["j"], r["gain"]) for r in scoring.facility_location_select(spark, str(tmp_path)).collect()}
        assert {at: j for at, (j, _) in got.items()} == {at: j for at, (j, _) in want.items()}
        assert all(abs(gain - want[at][1]) < 2e-6 for at, (_, gain) in got.items())
    assert sizes and max(sizes) <= 2


def test_a_frequent_text_is_no_hot_key_and_every_row_has_its_similarity(spark, monkeypatch):
    """Joins of rows are by chunk and pair, not by a text; each distinct text is embedded once."""
    from slotmeter.operators import scorers as sc

    found = registry.QUERIES["embed_texts"](spark, SF)
    shuffles = [x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and all("chunk#" in x for x in shuffles)
    monkeypatch.setattr(sc, "CHUNK", 30)
    texts = ["yes", "", None, "abc", "cab", "xyz"]
    rows = [(i, "yes" if i % 3 else texts[i % 6], texts[i // 6 % 6]) for i in range(200)]
    seen = spark.sparkContext.accumulator(0)

    def letters(batch):
        seen.add(len(batch))
        return [[float(t.count(c)) for c in "abcyes"] for t in batch]

    got = {r["id"]: r["similarity"] for r in sc.similarities(spark.createDataFrame(rows, "id long, a string, b string"), letters).collect()}
    vector = lambda t: np.array([t.count(c) for c in "abcyes"], float)
    norm = lambda t: 0.0 if t is None else np.linalg.norm(vector(t))
    want = {i: vector(a) @ vector(b) / norm(a) / norm(b) if norm(a) and norm(b) else 0.0 for i, a, b in rows}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert seen.value == 5


def test_packed_examples_are_the_slot_tables_made_in_the_examples_row(spark, tmp_path):
    """Records, candidates' records and facts of odd values, ids that repeat and null topics; one shuffle, no row of a candidate in it."""
    from pyspark.sql import functions as F

    from slotmeter.operators import records as rc

    names = ["red bolt", "a, b", "x and y", "  Yes. ", "'no'", "", None, "solo", "new zzz"]
    rows = [(i, names[i % 9], f"Brand#{i % 4}" if i % 5 else None, f"T{i % 3}" if i % 7 else None, i % 60) for i in range(200)]
    folder = parts(spark, tmp_path, rows + [(50, "old nut", "Brand#9", "T1", 30), (51, "old nut", "Brand#9", "T0", 31), (51, "old pin", "Brand#8", "T0", 31)])
    made = fx.packed_examples(spark, folder)
    assert plan(made).count("Exchange") == 1
    sets = lambda df, keys, c: df.select(*keys, F.explode(c).alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    topics, both = made.select("example_id", F.inline("topics")).drop("facts"), ["example_id", "cand_idx"]
    for got, want, keys in (
        (sets(topics, ["example_id", "topic"], "gold"), rc.packed(fx.references(spark, folder), ["example_id", "topic"], "x"), ["example_id", "topic"]),
        (sets(topics.select("example_id", F.inline("cands")), both, "record"), rc.packed(fx.predictions(spark, folder), both, "x"), both),
        (sets(made, ["example_id"], "facts"), rc.packed_facts(fx.facts(spark, folder), ["example_id"], "x"), ["example_id"]),
    ):
        want = want.select(*keys, F.sort_array("x").alias("x"))
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_sets_meet_queries_in_cells_of_bounded_size(spark, monkeypatch):
    """Many small cells find what one finds, as brute force does; lists of ids are cut, and no cell holds a whole topic."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from slotmeter.operators import overlaps as ov

    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        ts = sorted({f"t{x}" for x in rng.integers(0, 12, size=k % 4)})
        rows.append((f"T{k % 2}", ts, [1000 * k + j for j in range(1 + 40 * (k == 7))], len(ts), k % 5 == 0, k % 7 == 0))
    packs = spark.createDataFrame(rows, "topic string, ts array<string>, ids array<long>, n long, many boolean, query boolean")
    want = sorted((a, b, len({*r[1]} & {*q[1]}), r[3], q[3], r[4], q[4]) for r in rows for q in rows if q[5] and r[0] == q[0] and {*r[1]} & {*q[1]} for a in r[2] for b in q[2])
    flat = lambda df: df.withColumn("b", F.explode("ids_b")).withColumn("a", F.explode("ids_a")).select("a", "b", "c", "n_a", "n_b", "many_a", "many_b")
    cells, real = [], type(packs).groupBy

    def watched(df, *by):
        if "asks" in df.columns:
            cells.append([r["count"] for r in real(df, *by).count().collect()])
        return real(df, *by)

    monkeypatch.setattr(type(packs), "groupBy", watched)
    for sizes in ((4096, 16384, 2048), (10, 50, 3)):
        for name, size in zip(("SETS", "IDS", "QUERIES"), sizes, strict=True):
            monkeypatch.setattr(ov, name, size)
        assert sorted(map(tuple, flat(ov.overlaps(packs, "topic")).collect())) == want
    assert len(cells[0]) == 2 and len(cells[1]) > 20 and max(cells[1]) < min(cells[0]) / 2
    monkeypatch.setattr(ov, "BATCH", 30)
    one = pa.table({"ts": [r[1] for r in rows] + [r[1] for r in rows if r[5]], "ids": [r[2] for r in rows] + [r[2] for r in rows if r[5]], "n": [r[3] for r in rows] + [r[3] for r in rows if r[5]], "many": [r[4] for r in rows] + [r[4] for r in rows if r[5]], "asks": [False] * len(rows) + [True] * sum(r[5] for r in rows)})
    found = list(ov._counted(iter(one.to_batches(max_chunksize=17))))
    got = sorted((a, b, r["c"]) for t in found for r in t.to_pylist() for a in r["ids_a"] for b in r["ids_b"])
    assert len(found) > 5 and max(len(r["ids_b"]) for t in found for r in t.to_pylist()) <= ov.FEW
    assert got == sorted((a, b, len({*r[1]} & {*q[1]})) for r in rows for q in rows if q[5] and {*r[1]} & {*q[1]} for a in r[2] for b in q[2])


def test_entailment_sweep_counts_in_the_pairs_row(spark):
    """As recovered slot tables and slot joins count, threshold by threshold; no row of a slot or threshold in a shuffle."""
    from slotmeter.operators import verify as v
    from slotmeter.plans import routing

    found = registry.QUERIES["entailment_sweep"](spark, SF)
    shuffles = [x for x in plan(found).splitlines() if "Exchange" in x]
    assert shuffles and not any("slot#" in x or "hashpartitioning(t#" in x for x in shuffles)
    got, pairs = {r["t"]: r for r in found.collect()}, fx.negatives(spark, SF)
    for t in (0.1, 0.3, 0.5, 0.7):
        made = routing.methods(spark, SF, ("gold",)) | {"verification": v.recover(routing.probs(spark, SF), v.PAIR, t)}
        want = v.tally(v.agreement(v.method_counts(pairs, made, routing.given(spark, SF))), [["method"]]).drop("method").head().asDict()
        assert got[t].asDict() == {"t": t, **want}
