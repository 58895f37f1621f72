"""Names of slots, values and schemas in several schemes, and records brought from one scheme to another.

The tables are arguments: small dictionaries by slot, never by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.functions.sentences import lookup
from slotmeter.operators import parsing as ps

#: Domain names and their schemas.
SCHEMAS = {
    "e2e": "hm_e2e_nlg",
    "viggo": "hm_viggo",
    "rnnlg_hotel": "hm_rnnlg_hotel",
    "rnnlg_laptop": "hm_rnnlg_laptop",
    "rnnlg_restaurant": "hm_rnnlg_restaurant",
    "rnnlg_tv": "hm_rnnlg_tv",
    "tm1_auto_repair": "hm_tm1_auto_repair_appt",
    "tm1_coffee_ordering": "hm_tm1_coffee_ordering",
    "tm1_movie_tickets": "hm_tm1_movie_tickets",
    "tm1_pizza_ordering": "hm_tm1_pizza_ordering",
    "tm1_restaurant_table": "hm_tm1_restaurant_table",
    "tm1_uber_lyft": "hm_tm1_uber_lyft",
}

#: Slots of the restaurant corpus in the engine's names.
RESTAURANT = {"customer rating": "customerRating", "familyFriendly": "family_suitability", "eatType": "venue_type", "food": "cuisine_type", "near": "nearby_landmark", "area": "area_zone"}
#: The engine's names in the corpus' own, and two values.
RESTAURANT_NATIVE = {"venue_type": "eatType", "cuisine_type": "food", "area_zone": "area", "family_suitability": "familyFriendly", "nearby_landmark": "near"}
RESTAURANT_NATIVE_WORDS = {("family_suitability", "family-friendly"): "yes", ("family_suitability", "not-family-friendly"): "no"}
#: Slots of the games corpus, and its flags as (slot, value of yes, value of anything else).
GAMES = {"rating": "review_rating", "esrb": "esrb_rating", "player_perspective": "perspective", "release_year": "released"}
GAME_FLAGS = {
    "available_on_steam": ("steam_availability", "on_steam", "not_on_steam"),
    "has_linux_release": ("pc_os_support", "Linux", "not_released_on_Linux"),
    "has_mac_release": ("pc_os_support", "macOS", "not_released_on_macOS"),
    "has_multiplayer": ("multiplayer_mode", "multiplayer", "single-player"),
}
FAMILY_FLAG = {"familyFriendly": ("family_suitability", "family-friendly", "not-family-friendly")}
#: Slots of the act corpora.
ACTS = {
    "kids-allowed": "child_friendly",
    "hasinternet": "has_internet",
    "acceptscreditcards": "accepts_credit_cards",
    "acceptscards": "accepts_credit_cards",
    "dogs-allowed": "pets_allowed",
    "dogs_allowed": "pets_allowed",
    "dogsallowed": "pets_allowed",
    "isforbusinesscomputing": "is_for_business_computing",
    "hasusbport": "has_usb_port",
    "screensizerange": "screen_size_range",
    "ecorating": "eco_rating",
    "pricerange": "price_range",
    "powerconsumption": "power_consumption",
    "screensize": "screen_size",
    "hdmiport": "hdmi_port",
    "weightrange": "weight_range",
    "batteryrating": "battery_rating",
    "driverange": "drive_range",
    "goodformeal": "good_for_meal",
}
#: By new slot name, the values of yes and of no.
ACT_WORDS = {
    "child_friendly": ("child_friendly", "not_child_friendly"),
    "has_internet": ("has_internet", "no_internet"),
    "accepts_credit_cards": ("accepts_credit_cards", "no_credit_cards"),
    "pets_allowed": ("pets_allowed", "no_pets_allowed"),
    "is_for_business_computing": ("business_oriented", "not_business_oriented"),
    "has_usb_port": ("has_usb_port", "no_usb_port"),
}


def schema_id(domain: Column, aliases: dict[str, str] = SCHEMAS) -> Column:
    """The schema of a domain: by alias, itself where it is one already, else with the prefix."""
    return F.coalesce(lookup(aliases, domain), F.when(F.startswith(domain, F.lit("hm_")), domain), F.concat(F.lit("hm_"), domain))


def corpus_schema(corpus: Column, topic: Column) -> Column:
    """The schema of a corpus' example: one for the first two corpora, else one a topic."""
    return F.when(corpus.isin("e2e_nlg", "viggo"), F.concat(F.lit("hm_"), corpus)).otherwise(F.concat_ws("_", F.lit("hm"), corpus, topic))


def translate(slot: Column, value: Column, names: dict[str, str], words: dict[tuple[str, str], str]) -> tuple[Column, Column]:
    """Slot and value in another scheme; what the tables do not name stays. Values go by the slot's old name."""
    key = F.concat(slot, F.lit("\0"), value)
    return F.coalesce(lookup(names, slot), slot), F.coalesce(lookup({f"{s}\0{v}": new for (s, v), new in words.items()}, key), value)


def back(names: dict[str, str], words: dict[tuple[str, str], str]) -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    """The tables of the other direction; of two names with one translation the last wins."""
    return {new: old for old, new in names.items()}, {(names.get(s, s), new): v for (s, v), new in words.items()}


def flagged(rows: DataFrame, keys: list[str], names: dict[str, str], flags: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Parsed rows (keys, pos, slot, vpos, value) with new names, flags as values; a flag of several values counts as no.

    Slots that get one name become one slot: its values are numbered through, in the record's order.
    """
    slot = F.col("slot")
    several = rows.where(slot.isin(*flags)).groupBy(*keys, "pos").agg((F.max("vpos") == 1).alias("one"))
    table = lambda k: lookup({name: flag[k] for name, flag in flags.items()}, slot)
    yes = (F.col("value") == "yes") & F.col("one")
    flag = rows.where(slot.isin(*flags) & (F.col("vpos") == 1)).join(several.hint("merge"), [*keys, "pos"]).select(*keys, "pos", table(0).alias("slot"), "vpos", F.when(yes, table(1)).otherwise(table(2)).alias("value"))
    plain = rows.where(~slot.isin(*flags)).select(*keys, "pos", F.coalesce(lookup(names, slot), slot).alias("slot"), "vpos", "value")
    each = F.array_sort(F.collect_list(F.struct("pos", "vpos", "value")))
    merged = plain.unionByName(flag).groupBy(*keys, "slot").agg(each.alias("v"))
    return merged.select(*keys, F.element_at("v", 1)["pos"].alias("pos"), "slot", F.posexplode("v.value").alias("vpos", "value")).withColumn("vpos", F.col("vpos") + 1)


def restaurant_record(df: DataFrame, keys: list[str], text: str = "mr") -> DataFrame:
    """(keys, pos, slot, vpos, value) of the restaurant corpus' bracketed records in the engine's names."""
    return flagged(ps.bracket(df, keys, text), keys, RESTAURANT, FAMILY_FLAG)


def game_record(df: DataFrame, keys: list[str], text: str = "mr") -> DataFrame:
    """(keys, act, pos, slot, vpos, value) of the games corpus; both flags of systems are values of one slot."""
    return flagged(ps.act_bracket(df, keys, text), [*keys, "act"], GAMES, GAME_FLAGS)


def act_record(df: DataFrame, keys: list[str], topic: str, text: str = "mr") -> DataFrame:
    """(keys, topic, act, pos, slot, value) of the act corpora: new names behind the topic, yes, no and dontcare as values.

    A slot without value stays with null; an empty value is dropped.
    """
    rows = ps.act_assign(df, [*keys, topic], text).where("value is null or value <> ''")
    name = F.coalesce(lookup(ACTS, F.col("slot")), F.col("slot"))
    known = F.col("slot").isin(*[old for old, new in ACTS.items() if new in ACT_WORDS])
    table = lambda k: lookup({n: w[k] for n, w in ACT_WORDS.items()}, name)
    value = F.col("value")
    word = F.when(~known, value).when(value.isin("yes", "true"), table(0)).when(value.isin("no", "false"), table(1)).when(value.isin("dontcare", "dont_care"), "dontcare").otherwise(value)
    return rows.select(*keys, topic, "act", "pos", F.concat(F.col(topic), F.lit("_"), name).alias("slot"), word.alias("value"))


def native_first(rows: DataFrame, names: dict[str, str], words: dict[tuple[str, str], str]) -> DataFrame:
    """A slot table (…, slot, vals) as single values in another scheme: the first value of each slot."""
    rest = [c for c in rows.columns if c not in ("slot", "vals")]
    slot, value = translate(F.col("slot"), F.element_at("vals", 1), names, words)
    return rows.select(*rest, slot.alias("slot"), value.alias("value"))


def one_hot(column: Column, values: list[str], prefix: str) -> list[Column]:
    """1.0 or 0.0 for each of the values; a null is none of them."""
    return [F.coalesce((column == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]
