"""Sentences and naming schemes against literal examples."""

import pytest
from pyspark.sql import functions as F

from slotmeter.functions import sentences as st
from slotmeter.operators import naming as nm

#: fixed values
SENTENCES = [
    ("name", "The Vaults", "The name is The Vaults."),
    ("name", "dontcare", None),
    ("name", " dont_care", None),
    ("area", "city centre", "It is in the city centre area."),
    ("some_unknown_slot", "x", "The some unknown slot is x."),
    ("auto_repair.date", "x", "The date is x."),
    ("hotel_stars", "5", "The stars is 5."),
    ("family_suitability", "family-friendly", "It is family-friendly."),
    ("family_suitability", "not-family-friendly", "It is not family-friendly."),
    ("hotel_has_internet", "No_Internet", "It does not have internet."),
    ("hotel_has_internet", "perhaps", "It has internet."),
    ("restaurant_kidsallowed", "NO", "Kids are not allowed."),
    ("restaurant_kidsallowed", "maybe", None),
    ("pc_os_support", "macOS", "It is available on macOS."),
    ("pc_os_support", "BeOS", "The PC OS support is BeOS."),
    ("steam_availability", "yes", "It is not available on Steam."),
    ("large", "0", "Small."),
    ("tv_hdmi_port", "{value}", "It has {value} HDMI ports."),
    ("name", None, None),
]


def test_sentences(spark):
    rows = spark.createDataFrame([(i, s, v) for i, (s, v, _) in enumerate(SENTENCES)], "i int, slot string, value string")
    got = rows.select("i", st.sentence(F.col("slot"), F.col("value"), {"large": ("Large.", "Small.")}).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for *_, t in SENTENCES]


def test_every_registered_slot_has_a_sentence(spark):
    assert len(set(st.REGISTERED)) == len(st.REGISTERED) == 138
    rows = spark.createDataFrame([(s,) for s in st.TEXTS], "slot string")
    assert all("Xyz" in r["t"] and "{" not in r["t"] for r in rows.select(st.sentence(F.col("slot"), F.lit("Xyz")).alias("t")).collect())


@pytest.mark.parametrize("domain, want", [("e2e", "hm_e2e_nlg"), ("hm_x", "hm_x"), ("foo", "hm_foo"), ("tm1_auto_repair", "hm_tm1_auto_repair_appt")])
def test_schema_of_a_domain(spark, domain, want):
    assert spark.range(1).select(nm.schema_id(F.lit(domain)).alias("s")).head()["s"] == want


def test_restaurant_names_there_and_back(spark):
    text = "name[The Mill], eatType[pub], food[English, French], customer rating[high], familyFriendly[no], near[], area[riverside]"
    rows = nm.restaurant_record(spark.createDataFrame([(1, text)], "k int, mr string"), ["k"]).orderBy("pos", "vpos").collect()
    assert [(r["slot"], r["value"]) for r in rows] == [
        ("name", "The Mill"), ("venue_type", "pub"), ("cuisine_type", "English"), ("cuisine_type", "French"),
        ("customerRating", "high"), ("family_suitability", "not-family-friendly"), ("area_zone", "riverside"),
    ]
    slot, value = nm.translate(F.col("slot"), F.col("value"), nm.RESTAURANT_NATIVE, nm.RESTAURANT_NATIVE_WORDS)
    again = spark.createDataFrame(rows).select(slot.alias("slot"), value.alias("value")).collect()
    assert {tuple(r) for r in again} >= {("eatType", "pub"), ("familyFriendly", "no"), ("area", "riverside"), ("customerRating", "high")}
    names, words = nm.back(nm.RESTAURANT_NATIVE, nm.RESTAURANT_NATIVE_WORDS)
    assert names["eatType"] == "venue_type" and words["familyFriendly", "yes"] == "family-friendly"


def test_game_flags_merge(spark):
    text = "give_opinion(name[SpellForce 3], release_year[2017], has_linux_release[no], genres[RPG, strategy], has_mac_release[yes], has_multiplayer[yes], available_on_steam[no])"
    rows = nm.game_record(spark.createDataFrame([(1, text)], "k int, mr string"), ["k"]).orderBy("pos", "vpos").collect()
    assert {r["act"] for r in rows} == {"give_opinion"}
    assert [(r["slot"], r["vpos"], r["value"]) for r in rows] == [
        ("name", 1, "SpellForce 3"), ("released", 1, "2017"), ("pc_os_support", 1, "not_released_on_Linux"), ("pc_os_support", 2, "macOS"),
        ("genres", 1, "RPG"), ("genres", 2, "strategy"), ("multiplayer_mode", 1, "multiplayer"), ("steam_availability", 1, "not_on_steam"),
    ]


def test_act_records(spark):
    text = "inform(name='hotel x';dogs-allowed=dont_care;acceptscards=true;pricerange='';near;hasinternet='no')"
    rows = nm.act_record(spark.createDataFrame([(1, "hotel", text)], "k int, topic string, mr string"), ["k"], "topic").orderBy("pos").collect()
    assert [(r["slot"], r["value"]) for r in rows] == [
        ("hotel_name", "hotel x"), ("hotel_pets_allowed", "dontcare"), ("hotel_accepts_credit_cards", "accepts_credit_cards"), ("hotel_near", None), ("hotel_has_internet", "no_internet"),
    ]
