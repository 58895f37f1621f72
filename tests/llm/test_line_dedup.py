from slotmeter.llm.line_dedup import dedup_lines


def brute(rows, window=3):
    """{(id, text): (n_lines, n_removed, kept)}; documents in order of id, null first; equal rows are one document."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i, t] = (0, 0, None)
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - window + 1):
            w = tuple(lines[k : k + window])
            if w in seen:
                gone |= set(range(k, k + window))
            seen.add(w)
        out[i, t] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_same_as_brute_force_with_edge_cases(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "\n\n\n\n\n"), (7, "a\nb\nc\nd"), (7, "a\nb\nc\nd"), (None, "p\nq\nr"), (8, "p\nq\nr"), (9, "p\nq\nr\r"),
        (10, "\n".join(f"line {k % 50_000}" for k in range(100_000))), (11, "u\nv\nw\nu\nv\nw\nu"), (12, "a\nb\nc\nd\ne\nf\na\nb\nc"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as n_lines", "doc_id as starts", "text as lines", "doc_id as th").repartition(4)
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "starts", "lines", "th", "n_removed"]
    want, found = brute(rows), got.collect()
    assert len(found) == len(rows)
    assert sorted([(str(r["doc_id"]), r["n_lines"], r["n_removed"], str(r["text"])) for r in found]) == sorted([(str(i), *want[i, t][:2], str(want[i, t][2])) for i, t in rows])
    assert dedup_lines(docs.limit(0)).collect() == []


def test_two_texts_of_one_id_take_their_turn(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc\nd"), (2, "a\nb\nc")], "doc_id long, text string")
    found = dedup_lines(rows).collect()
    assert sum(r["n_removed"] == 0 for r in found) == 1 and sum(r["n_removed"] for r in found) == 6
