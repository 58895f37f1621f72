"""Rule matchers, loose records, dialog turns and significance on literal examples."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotmeter.operators import aligning as al
from slotmeter.operators import parsing as ps
from slotmeter.operators import significance as sg
from slotmeter.operators.routers import coefficients, load, logistic
from slotmeter.operators.selection import draw_pools, facility_location, pool_sizes

RESTAURANT = [("name", "verbatim", [], [], {}), ("eatType", "categorical", [], [], {}), ("food", "food", [], [], {}), ("priceRange", "scalar", ["price", "cost"], [], {"cheap": [["low"], ["inexpensive"]]}), ("familyFriendly", "boolean", ["family", "kids"], ["adult"], {}), ("release_year", "year", [], [], {})]
SCHEMA = "slot string, kind string, stems array<string>, antonyms array<string>, alternatives map<string, array<array<string>>>"


def found(spark, text, record):
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    facts = spark.createDataFrame([(1, s, 1, v) for s, v in record], "id long, slot string, vpos int, value string")
    return {r["slot"]: r["pos"] for r in al.realize(texts, facts, spark.createDataFrame(RESTAURANT, SCHEMA), ["id"]).collect() if r["pos"] >= 0}


PUB = [("name", "The Vaults"), ("eatType", "pub"), ("food", "Japanese"), ("priceRange", "cheap")]


@pytest.mark.parametrize(
    ("text", "record", "slots"),
    [
        ("The Vaults is a cheap Japanese pub.", PUB, {"name", "eatType", "food", "priceRange"}),
        ("The Vaults is a cheap pub.", PUB, {"name", "eatType", "priceRange"}),
        ("The Witcher 3 came out in 2015.", [("name", "The Witcher 3"), ("release_year", "2015")], {"name", "release_year"}),
        ("The Witcher 3 is a great game.", [("name", "The Witcher 3"), ("release_year", "2015")], {"name"}),
        ("It is a family place.", [("familyFriendly", "yes")], {"familyFriendly"}),
        ("It is not a family place.", [("familyFriendly", "yes")], set()),
        ("It is not a family place.", [("familyFriendly", "no")], {"familyFriendly"}),
        ("It is not cheap but a family place.", [("familyFriendly", "no")], set()),
        ("It is for adult guests.", [("familyFriendly", "no")], {"familyFriendly"}),
        ("The price is low.", [("priceRange", "cheap")], {"priceRange"}),
        ("British meals", [("food", "English")], {"food"}),
        ("dinner and sushi", [("food", "Greek")], {"food"}),
        ("No price given", [("priceRange", "dontcare"), ("food", "none")], {"priceRange"}),
    ],
)
def test_realized_slots(spark, text, record, slots):
    assert set(found(spark, text, record)) == slots


def one(spark, column, **values):
    base = spark.range(1).select(*[(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in values.items()])
    return base.select(column.alias("x")).head()["x"]


def test_tokens_and_helpers(spark):
    t = F.col("t")
    assert one(spark, ps.tokenize(t), t="Don't say it's well-known, é/à!") == ["Do", "n", "'", "t", "say", "it", "'", "s", "well-known", ",", "é/à", "!"]
    assert [one(spark, ps.plural(t), t=w) for w in ("knife", "leaf", "potato", "cactus", "phenomenon", "day", "bus", "wish", "woman", "pub")] == ["knives", "leaves", "potatoes", "cacti", "phenomena", "daies", "bi", "wishes", "women", "pubs"]
    assert one(spark, ps.normal_text(t), t="A-B/C  d") == "a b c d"
    words = ["a", ",", "b", "a", "."]
    assert one(spark, ps.last_place(t, F.lit("a")), t=words) == 3 and one(spark, ps.token_offset(t, F.lit(3)), t=words) == 5
    assert one(spark, ps.dialog_slot(t), t="trip.to.city.accept") == "trip.to.city" and one(spark, ps.dialog_slot(t), t="a.b.c.d") == "b.c.d" and one(spark, ps.dialog_slot(t), t="plain") == "plain"


def test_numbers_years_lists_and_keywords(spark):
    t, k = F.col("t"), F.col("k")
    assert [one(spark, al.numeric(t, F.lit(x)), t="it has two of 7 and ninety") for x in ("7", "2", "two", "90", "5")] == [14, 7, 7, 20, -1]
    assert one(spark, al.numeric_unit(k, F.lit("3.5 hour")), k=["a", "3.5", "h"]) == 2 and one(spark, al.numeric_unit(k, F.lit("some hour")), k=["some"]) == -1
    assert one(spark, al.year(t, k, F.lit("2015")), t="in '15", k=["in", "'", "15"]) == 3 and one(spark, al.year(t, k, F.lit("x")), t="x", k=["x"]) == -1
    nothing = F.array().cast("array<array<string>>")
    assert one(spark, al.list_items(t, k, F.lit("racing, puzzle"), nothing), t="a puzzle and racing game", k=["a"]) == 2 and one(spark, al.list_items(t, k, F.lit("racing, sport"), nothing), t="a racing game", k=["a"]) == -1
    two = F.array(F.lit("red"), F.lit("door"))
    assert one(spark, al.keywords(t, two)["pos"], t="a red old door") == 10 and one(spark, al.keywords(t, two)["pos"], t="door red") == -1 and one(spark, al.keywords(t, two, ordered=False)["pos"], t="door red") == 0
    assert one(spark, al.keywords(t, F.array(F.lit("ab")))["duplicate"], t="ab abc ab") is True


def test_loose_records(spark):
    rows = [
        (1, "name: Foo, cuisine: English, price: 20-25\nmore: x"), (2, '{"name": "Foo", "tags": ["a", "b"], "x": "None"}'), (3, "a: b and c, d: none, e: (x, y), f: 'p, q', no colon"), (4, '```\nname: A'), (5, None), (6, ""), (7, "a: 1, a: 2"), (8, 'k: ["x", " y"]'), (9, "a: x: y"),
    ]
    got = {}
    for r in ps.loose_record(spark.createDataFrame(rows, "id long, t string"), ["id"], "t").collect():
        got.setdefault(r["id"], {}).setdefault(r["slot"], []).append(r["value"])
    assert {i: {s: sorted(v) for s, v in d.items()} for i, d in got.items()} == {
        1: {"name": ["Foo"], "cuisine": ["English"], "price": ["20-25"]}, 2: {"name": ["Foo"], "tags": ["a", "b"]}, 3: {"a": ["b", "c"], "e": ["(x", "y)"], "f": ["'p", "q'"]}, 4: {"name": ["A"]}, 7: {"a": ["2"]}, 8: {"k": ["x", "y"]}, 9: {"a": ["x: y"]},
    }


def test_p_values(spark):
    k, n = F.col("k"), F.col("n")
    for x in (0.02, 1.0, 3.84, 10.83, 30.0):
        assert abs(one(spark, sg.chi2_p(k), k=x) - math.erfc(math.sqrt(x / 2))) < 1e-9
    for a, b in product((0, 1, 3, 7), (2, 5, 11)):
        want = min(1.0, sum(math.comb(a + b, j) for j in range(a + b + 1) if math.comb(a + b, j) <= math.comb(a + b, a)) / 2 ** (a + b))
        assert abs(one(spark, sg.mcnemar_p(k, n), k=a, n=b) - want) < 1e-9
    assert one(spark, sg.mcnemar_p(k, n), k=0, n=0) == 1.0 and one(spark, sg.stars(k), k=0.004) == "**"


def test_permutations(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(x)) for i, x in enumerate(rng.normal(0.2, 1, 90))]
    table = spark.createDataFrame(rows, "key long, diff double")
    got = [sg.permutation_test(table.repartition(p)).head() for p in (1, 5)]
    sums = np.array([x for _, x in rows]) @ sg.signs(np.array([i for i, _ in rows]), sg.FLIPS)
    seen = sum(x for _, x in rows)
    assert got[0] == got[1] and abs(got[0]["p"] - (np.abs(sums) >= abs(seen) - 1e-9).mean()) < 1e-6
    assert abs(sums.mean()) < 0.5 and 0.45 < (sums > 0).mean() < 0.55


def test_facility_location(spark):
    rng = np.random.default_rng(2)
    k = {t: np.round(rng.random((12, 5)), 3) for t in "ab"}
    rows = [(t, i, j, float(m[i, j])) for t, m in k.items() for i in range(12) for j in range(5)]
    got = {(r["topic"], r["place"]): r["j"] for r in facility_location(spark.createDataFrame(rows, "topic string, i long, j long, k double"), 3).collect()}
    for t, m in k.items():
        best, taken = np.zeros(12), []
        for place in range(1, 4):
            gain = [-1 if j in taken else round(np.maximum(m[:, j] - best, 0).sum(), 6) for j in range(5)]
            taken.append(int(np.argmax(gain)))
            best = np.maximum(best, m[:, taken[-1]])
            assert got[t, place] == taken[-1]


def test_pools_are_drawn_from_what_is_left(spark):
    sizes = pool_sizes(3, 2)
    assert sizes == [("train", 3), ("dev", 2), ("train_prompts", 12), ("dev_prompts", 8), ("inference", 5)]
    rows = spark.range(50).select("id", F.when(F.col("id") < 40, "a").otherwise("b").alias("topic"))
    got = draw_pools(rows, "topic", "id", sizes, "s").collect()
    assert len({r["id"] for r in got}) == len(got) == 40 and sorted(r["pool"] for r in got if r["topic"] == "b") == ["dev"] * 2 + ["train"] * 3 + ["train_prompts"] * 5
    assert all(sum(r["pool"] == name for r in got if r["topic"] == "a") == n for name, n in sizes)
    kernel = spark.createDataFrame([("a", i, j, float(i % 7 == j % 7)) for i in range(40) for j in (7, 8, 9, 14)], "topic string, i long, j long, k double")
    best = draw_pools(rows, "topic", "id", sizes, "s", kernel).collect()
    assert {r["id"] for r in best if r["pool"] == "train"} == {7, 8, 9} and len({r["id"] for r in best}) == len(best)


def test_saved_router(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, x), int(x[0] - x[1] > 0.2)) for i, x in enumerate(rng.normal(size=(200, 2)))]
    table = spark.createDataFrame(rows, "id long, a double, b double, label int")
    router = logistic(table, ["a", "b"])
    router.save(spark, str(tmp_path / "r"))
    first, again = ({r["id"]: (r["choice"], r["p"]) for r in x.route(table).collect()} for x in (router, load(spark, str(tmp_path / "r"))))
    assert first == again and np.mean([first[r[0]][0] == r[3] for r in rows]) > 0.9
    assert {n for n, _ in coefficients(router)} == {"a", "b"}
