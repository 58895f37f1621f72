import random

import numpy as np

from slotmeter.llm.suffix_dedup import LENGTH, drop_repeats, repeat_runs, repeated_strings


def brute(docs):
    """{id: (bytes, removed, spans, kept)} of [(id, text)]."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - LENGTH + 1):
            x = t[s : s + LENGTH]
            if x in seen:
                gone[s : s + LENGTH] = True
            seen.add(x)
        kept = bytes(b for k, b in enumerate(t) if not gone[k])
        out[i] = (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept)
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


def test_same_as_brute_force_on_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert result(drop_repeats(table.repartition(5))) == brute(docs)


def test_planted_repeats_and_edge_cases(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b = text(60), text(40)
    docs = [(1, a), (2, text(10) + a[20:180] + text(10)), (3, b + a + b), (4, None), (5, ""), (6, "x" * 99), (7, "x" * 150), (8, "x" * 150), (9, a[:100]), (10, a[1:100]), (None, b)]
    docs += [(20 + k, a[: 50 + k] + text(3) + a[50 + k :]) for k in range(30)]
    table = spark.createDataFrame([*docs, (9, a[:100])], "doc_id long, text string").selectExpr("*", "text as kept", "doc_id as id").repartition(7)
    rows = drop_repeats(table).collect()
    assert len(rows) == len(docs) + 1
    assert result(drop_repeats(table)) == brute(docs)
    two = spark.createDataFrame([(1, a), (1, b), (2, a + b)], "doc_id long, text string")
    rows = {bytes(r["kept"]): r for r in drop_repeats(two).collect()}
    assert a.encode() in rows and b.encode() in rows
    last = next(r for r in rows.values() if r["doc_id"] == 2)
    assert last["n_removed"] == last["n_bytes"] and last["n_spans"] == 1
    named = spark.createDataFrame([("b", a), (None, a), ("a", a + "!"), ("a", b)], "doc_id string, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in drop_repeats(named).collect()}
    assert got == {(None, len(a.encode())): 0, ("a", len(a.encode()) + 1): len(a.encode()), ("a", len(b.encode())): 0, ("b", len(a.encode())): len(a.encode())}
    assert drop_repeats(table.limit(0)).collect() == []


def test_merged_shards_give_the_repeated_strings():
    rng = random.Random(5)
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(400))
    parts = [base[k : k + 150] for k in (0, 10, 200, 240)] + [bytes(rng.choice(b"ab") for _ in range(140)), b"a" * 130]
    for shard in (10, 200, 10_000):
        interval, part, offset = repeated_strings(parts, shard)
        groups = {}
        for i, p, o in zip(interval, part, offset, strict=True):
            groups.setdefault(i, set()).add((p, o))
        want = {}
        for p, x in enumerate(parts):
            for o in range(len(x) - LENGTH + 1):
                want.setdefault(x[o : o + LENGTH], set()).add((p, o))
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_runs_hold_every_repeated_string():
    rng = random.Random(6)
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(400))
    parts = [base[:250], base[100:], bytes(rng.choice(b"ab") for _ in range(300)), b"", b"a" * 99, b"z" * 130]
    pieces, part, offset = repeat_runs(parts)
    count = {}
    for x in parts:
        for o in range(len(x) - LENGTH + 1):
            count[x[o : o + LENGTH]] = count.get(x[o : o + LENGTH], 0) + 1
    want = {(p, o) for p, x in enumerate(parts) for o in range(len(x) - LENGTH + 1) if count[x[o : o + LENGTH]] > 1}
    assert {(p, o + k) for x, p, o in zip(pieces, part, offset, strict=True) for k in range(len(x) - LENGTH + 1)} == want
    assert all(parts[p][o : o + len(x)] == x for x, p, o in zip(pieces, part, offset, strict=True))
    assert repeat_runs([b"short", b"y" * 100])[0] == []
