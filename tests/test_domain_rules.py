"""Rules of three families on published examples and planted alternatives, masking and lists against plain versions."""

import re
from collections import Counter

from pyspark.sql import functions as F

from slotmeter.operators import rules as ru

CASES = [
    # topic, text, record, slots not found
    ("restaurants", "The Vaults is a cheap Japanese pub.", [("name", "The Vaults"), ("eattype", "pub"), ("food", "Japanese"), ("pricerange", "cheap")], set()),
    ("restaurants", "The Vaults is a cheap pub.", [("name", "The Vaults"), ("eattype", "pub"), ("food", "Japanese"), ("pricerange", "cheap")], {"food"}),
    ("restaurants", "Zizzi by the river is an affordable British place with five stars.", [("name", "Zizzi"), ("area", "riverside"), ("pricerange", "cheap"), ("food", "English"), ("customerrating", "5 out of 5")], set()),
    ("restaurants", "A place in the middle of the city, not for kids.", [("area", "city centre"), ("familyfriendly", "no"), ("food", "none"), ("pricerange", "")], {"food", "pricerange"}),
    ("restaurants", "A place for kids whose price varies.", [("familyfriendly", "yes"), ("pricerange", "dontcare"), ("customerrating", "high")], {"customerrating"}),
    ("restaurant", "Red Door Cafe is a cheap restaurant in Nob Hill.", [("name", "Red Door Cafe"), ("pricerange", "cheap"), ("area", "nob hill")], set()),
    ("restaurant", "Red Door Cafe is a cheap restaurant.", [("name", "Red Door Cafe"), ("pricerange", "cheap"), ("area", "nob hill")], {"area"}),
    ("restaurant", "what is the phone number , and does the area matter ?", [("phone", None), ("area", "dontcare"), ("food", "dont_care"), ("postcode", "?")], {"food", "postcode"}),
    ("hotel", "there are two hotel -s that have wi-fi and allow no dogs", [("count", "2"), ("type", "hotel"), ("hasinternet", "yes"), ("dogsallowed", "no"), ("kidsallowed", "yes")], {"hasinternet", "kidsallowed"}),
    ("laptop", "it is thin , portable and light with a 3.5 h battery and 7 h drive , not for business use , and costs little", [("design", "light, thin and portable"), ("battery", "3.5 hour"), ("isforbusinesscomputing", "false"), ("drive", "7 hour"), ("utility", "home or school")], {"battery", "utility"}),
    ("laptop", "it is for home use and its battery rating is good", [("isforbusinesscomputing", "false"), ("batteryrating", "good"), ("weightrange", "light weight")], {"weightrange"}),
    ("tv", "this tv has one hdmi port , a usb port and an a++ eco rating", [("hdmiport", "1"), ("hasusbport", "true"), ("ecorating", "a++"), ("type", "television")], set()),
    ("games", "The Witcher 3 came out in 2015.", [("name", "The Witcher 3"), ("release_year", "2015")], set()),
    ("games", "The Witcher 3 is a great game.", [("name", "The Witcher 3"), ("release_year", "2015")], {"release_year"}),
    ("games", "A top-down rpg from '98 that lets you shoot, rated T, with friends on Steam.", [("da", "inform"), ("player_perspective", "bird view"), ("genres", "role-playing, shooter"), ("release_year", "1998"), ("esrb", "T (for Teen)"), ("has_multiplayer", "yes"), ("available_on_steam", "yes"), ("has_mac_release", "no"), ("rating", "good")], {"has_mac_release", "rating"}),
    ("games", "It is single player and not on Linux. Any genre will do; an awesome game.", [("has_multiplayer", "no"), ("has_linux_release", "no"), ("genres1", "dontcare"), ("rating", "excellent"), ("platforms", "?")], {"platforms"}),
]


def tables(spark, cases):
    texts = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "id int, topic string, text string")
    facts = spark.createDataFrame([(k, n, s, v) for k, c in enumerate(cases) for n, (s, v) in enumerate(c[2])], "id int, pos int, slot string, value string")
    return texts, facts


def test_three_families(spark):
    texts, facts = tables(spark, CASES)
    found = ru.find_by_rules(texts, facts, ru.rule_table(spark), ["id"]).collect()
    lost = {k: set() for k in range(len(CASES))}
    for r in found:
        if r["at"] < 0:
            lost[r["id"]].add(r["slot"])
    assert lost == {k: c[3] for k, c in enumerate(CASES)}
    assert Counter(r["id"] for r in found) == Counter(k for k, c in enumerate(CASES) for s, _ in c[2] if s != "da")
    at = {(r["id"], r["slot"]): r["at"] for r in found}
    assert at[12, "release_year"] == CASES[12][1].index("2015") and at[5, "area"] == CASES[5][1].index("Nob") and at[12, "name"] == 0


def test_errors_per_text(spark):
    cases = [
        ("games", "Gold Rush has a map editor and a map editor.", [("name", "Gold Rush"), ("extra", "map editor"), ("genres", "puzzle"), ("genres", "sport")]),
        ("games", "Gold Rush, Gold Rush: a puzzle by Gold Rush.", [("name", "Gold Rush"), ("developer", "Gold Rush"), ("genres", "puzzle")]),
        ("games", "Rush by Gold and Gold.", [("name", "Rush"), ("developer", "Gold")]),
        ("unknown", "x", [("name", "x")]),
    ]
    texts, facts = tables(spark, cases)
    found = ru.find_by_rules(texts, facts, ru.rule_table(spark), ["id"])
    got = {r["id"]: r.asDict() for r in ru.text_errors(found, ["id"]).collect()}
    assert got == {
        0: {"id": 0, "n_slots": 4, "n_errors": 3, "missing": ["genres"], "duplicates": ["extra"]},
        1: {"id": 1, "n_slots": 3, "n_errors": 0, "missing": [], "duplicates": []},
        2: {"id": 2, "n_slots": 2, "n_errors": 1, "missing": [], "duplicates": ["developer"]},
    }
    assert ru.find_by_rules(texts.limit(0), facts, ru.rule_table(spark), ["id"]).count() == 0


def test_equal_texts_are_looked_at_once_and_every_key_has_its_rows(spark, monkeypatch):
    cases = [c[:3] for c in CASES] * 3 + [(CASES[0][0], CASES[0][1], CASES[2][2])]
    texts, facts = tables(spark, cases)
    monkeypatch.setattr(ru, "CHUNK", 20)
    found = ru.find_by_rules(texts, facts, ru.rule_table(spark), ["id"])
    assert any("text#" in x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["id"], Counter())[tuple(r)[1:]] += 1
    n = len(CASES)
    assert set(rows) == set(range(3 * n + 1)) and all(rows[k] == rows[k + n] == rows[k + 2 * n] for k in range(n))
    assert sum(rows[3 * n].values()) == len(CASES[2][2]) and all(sum(rows[k].values()) == sum(s != "da" for s, _ in CASES[k][2]) for k in range(n))


def masked(text, record, names):
    left, out = Counter(v for _, v in record), {}
    for k, (slot, value) in sorted(enumerate(record), key=lambda x: -len(x[1][1])):
        pattern = re.compile(rf"\b{re.escape(value)}\b")
        hit = pattern.search(text) if slot in names and value else None
        out[k] = (slot, value, hit.start() if hit else None, False)
        if hit:
            left[value] -= 1
            many = len(pattern.findall(text)) > 1 and slot != "name"
            out[k] = (slot, value, hit.start(), many)
            if left[value] < 1:
                text = pattern.sub("_" * len(value), text)
    return text, [out[k] for k in range(len(record))]


def test_masks_against_a_plain_fold(spark):
    names = ("name", "near", "developer")
    rows = [
        ("the red door by the door of red door", [("near", "door"), ("name", "red door"), ("developer", "red"), ("food", "door")]),
        ("gold rush and gold rush", [("name", "gold rush"), ("developer", "gold rush"), ("near", "rush")]),
        ("a+b (c) café x", [("name", "a+b"), ("near", "café"), ("developer", "(c)"), ("food", "x")]),
        ("a\\Eb and $1", [("name", "and"), ("near", "")]),
        ("", [("name", "x")]),
        ("x x", [("near", "x"), ("near", "x")]),
    ]
    table = spark.createDataFrame([(k, t, [(n, s, v) for n, (s, v) in enumerate(r)]) for k, (t, r) in enumerate(rows)], "id int, text string, record array<struct<pos:int,slot:string,value:string>>")
    got = table.select("id", ru.mask_names(F.col("text"), F.col("record"), F.array(*map(F.lit, names))).alias("m")).collect()
    for r in got:
        want = masked(*rows[r["id"]], names)
        assert (r["m"]["text"], [(f["slot"], f["value"], f["at"], f["duplicate"]) for f in r["m"]["found"]]) == want


def test_items_of_lists_in_prose(spark):
    rows = {"light, thin and portable": ["light", "thin", "portable"], "home or school": ["home", "school"], "a, and b": ["a", "and b"], "and": ["and"], "one with two": ["one", "two"], "": [""], "plain words": ["plain words"], "a and": ["a"]}
    table = spark.createDataFrame([(v,) for v in rows], "v string")
    assert {r["v"]: r["i"] for r in table.select("v", ru.conjunction_items(F.col("v")).alias("i")).collect()} == rows
