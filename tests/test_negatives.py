"""Graded negatives against a plain scan of the pool."""

import hashlib

from pyspark.sql import functions as F

from slotmeter.operators import negatives as ng
from slotmeter.operators import slots


def same(a, b):
    (x, m), (y, k) = a, b
    return x == y if m == k else (y[0] in x if m else x[0] in y)


def scan(records, rubric, by_topic, tries):
    out = {}
    for i, (topic, ref) in records.items():
        pool = sorted((j for j in records if not by_topic or records[j][0] == topic), key=lambda j: (hashlib.md5(f"pool|{j}".encode()).hexdigest(), j))
        for t in range(min(tries, len(pool))):
            j = pool[(i * 13 + t) % len(pool)]
            pred = records[j][1]
            m = sum(s in pred and same(pred[s], ref[s]) for s in ref)
            sub = sum(s in pred and not same(pred[s], ref[s]) for s in ref)
            d, n = sum(s not in pred for s in ref), sum(s not in ref for s in pred)
            if rubric == "ser":
                x, cuts = 1 - (sub + d + n) / max(m + sub + d, 1), [(0.9, 4), (0.75, 3), (0.5, 2), (0.25, 1)]
            else:
                p, r = m / max(m + sub + n, 1), m / max(m + sub + d, 1)
                x, cuts = (2 * p * r / (p + r) if p + r else 0), [(0.9, 6), (0.8, 5), (0.7, 4), (0.6, 3), (0.5, 2), (0.25, 1)]
            out.setdefault((i, next((g for c, g in cuts if x >= c), 0)), (t, j, sub, d, n))
    return {(*k, *v) for k, v in out.items()}


def test_same_as_a_scan_over_chunks_and_pools(spark, monkeypatch):
    facts, records = [], {}
    for i in range(90):
        topic = "big" if i % 3 else f"t{i % 4}"
        own = {}
        for s in range(4):
            if (i * 7 + s * 5) % 6:
                v = f"v{(i * (s + 3)) % 4}"
                own[f"s{s}"] = ((v,), False)
                facts.append((i, topic, s, f"s{s}", 1, v))
        if i % 2:
            vs = sorted({f"v{i % 3}", f"v{i % 5}"})
            own["s9"] = (tuple(vs), len(vs) > 1)
            facts += [(i, topic, 9, "s9", k, v) for k, v in enumerate(vs)]
        elif i % 4 == 0:
            own["s9"] = ((f"v{i % 3}",), False)
            facts.append((i, topic, 9, "s9", 1, f"v{i % 3}"))
        records[i] = (topic, own)
    table = slots.slot_table(spark.createDataFrame(facts, "example_id long, topic string, pos int, slot string, vpos int, value string"), ["example_id", "topic"])
    rows = ng.packed(table, ["example_id", "topic"])
    for chunk, tries in ((1024, 1001), (8, 8), (16, 11)):
        monkeypatch.setattr(ng, "CHUNK", chunk)
        monkeypatch.setattr(ng, "AT_ONCE", 5)
        for rubric, pool in (("ser", "topic"), ("f1", None)):
            got = ng.graded_negatives(rows, rubric, pool, tries)
            found = {(r["example_id"], r["label"], r["try"], r["source_id"], r["s"], r["d"], r["i"]) for r in got.collect()}
            assert found == scan({i: records[i] for i in records if records[i][1]}, rubric, bool(pool), tries)
    some = ng.graded_negatives(rows, tries=16, labels=(0, 4)).select(F.collect_set("label")).head()[0]
    assert set(some) == {0, 4} and ng.graded_negatives(rows.limit(0), tries=16).count() == 0
