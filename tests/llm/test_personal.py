"""Fixed forms against their plain expressions, and what patterns find besides."""

import random
import re

from slotmeter.llm import personal
from slotmeter.llm.queries import QUERIES

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (16 <= len(digits) <= 19 and personal.luhn(digits)):
                continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if personal.luhn(body + c))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"


def test_fixed_forms_are_their_plain_expressions():
    rng = random.Random(1)
    parts = ["1", "25", ".", "@", "a", "é", "-", " ", "+", "(", ")", "x.y", "%", "1.2.3.4", "\n", "4111 1111-11111111", "+1 (212) 555-0199", "🙂"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert personal.base_spans(text) == plain(text), text
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1((" * 80_000, "a@" * 150_000):  # linear in the text
        personal.base_spans(long)


def planted(rng):
    words = ["the", "of", "and", "thea", "nion", "erly", "lamp", "door"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"{prose(rng.randint(1, 8))} contact {rng.choice([phone(rng), card(rng), f'u{k}@mail.example.com', f'10.0.{k % 250}.7'])} {prose(3)}") for k in range(200)]
    chain = {1000 + k: (phone(rng), card(rng)) for k in range(3)}
    rows += [(k, f"{prose(3)} {a} {b} {prose(2)}") for k, (a, b) in chain.items()]
    unseen = {2000 + k: f"QX-{k:05d}-B" for k in range(5)}
    rows += [(k, f"{prose(3)} contact {x} {prose(2)}") for k, x in unseen.items()]
    clean = [(3000 + k, t) for k, t in enumerate(["Version 2.0 of the License", "section 4 of 12", None, "", "no digits", "a@b", "the 1234567812345678 of", "999.1.2.3 nion", "AKIA4MD62HKU6VB the"])]
    return rows + clean, chain, unseen, clean


def test_patterns_find_what_the_forms_miss_and_leave_the_rest(spark):
    rows, chain, unseen, clean = planted(random.Random(5))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, instance string").repartition(3)
    got = {r["id"]: r for r in personal.find_personal(docs).collect()}
    texts = dict(rows)
    assert got.keys() == texts.keys()
    for i, text in rows:
        assert [(x["kind"], x["start"], x["end"]) for x in got[i]["base"]] == plain(text or "")
    spans = lambda i: {(x["kind"], texts[i][x["start"] : x["end"]]) for x in got[i]["added"]}
    for i, (a, b) in chain.items():
        assert not got[i]["base"] and spans(i) == {(3, a), (2, b)}
    for i, x in unseen.items():
        assert {t for _, t in spans(i)} == {x}
    assert not [i for i, _ in clean if got[i]["added"]]


def test_the_query_writes_spans_of_repeated_and_null_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, f"é {phone(rng)}, {card(rng)} z") for k in range(40)]
    twice = f"x {phone(rng)} {card(rng)} y"
    rows += [(7, twice), (7, twice), (None, twice), (8, None), (9, ""), (10, "u@v.w " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["spans"]) for r in got}
    end = len(twice) - 2
    want = f"card:{end - 16}:{end},phone:2:{end - 17}"
    assert (7, want) in by and (None, want) in by and sum(r["spans"] == want for r in got) == 3
    many = next(r for r in got if r["doc_id"] == 10 and r["n_email"] > 1)
    assert many["n_email"] == 3000 and many["n_added"] == 0 and many["spans"].startswith("email:0:5,email:6:11,")
    assert all(r["spans"] == "" and r["n_phone"] == 0 for r in got if r["doc_id"] in (8, 9) and r["n_added"] == 0 and r["n_card"] == 0)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_personal_data"](spark, f"{tmp_path}/none").count() == 0
