"""Queries of the rule matchers: values found in texts, records found by rules, their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.operators import aligning as al
from slotmeter.operators import parsing as ps
from slotmeter.operators import rules as ru
from slotmeter.operators import slots
from slotmeter.operators import verify as v
from slotmeter.plans import building, routing
from slotmeter.plans import fixtures as fx
from slotmeter.plans.registering import registry

QUERIES, ORACLES, query = registry()
#: The fixtures' slots: matcher, stems and antonyms; other writings of values by slot.
RULES = (("size", "numeric", ("size",), ()), ("large", "boolean", ("large", "big"), ("small", "little")), ("brand", "categorical", ("brand",), ()), ("traits", "scalar", ("by", "size"), ()), ("name", "verbatim", (), ()))
OTHERS = {"brand": {"brand#11": [["brand", "eleven"], ["first"]]}, "traits": {"cornflower": [["blue"]], "azure": [["sky"]]}}


def lexicon(spark, rules=RULES, others=OTHERS) -> DataFrame:
    """A schema's matchers as a table (slot, kind, stems, antonyms, alternatives)."""
    rows = [(slot, kind, list(stems), list(antonyms), others.get(slot, {})) for slot, kind, stems, antonyms in rules]
    return spark.createDataFrame(rows, "slot string, kind string, stems array<string>, antonyms array<string>, alternatives map<string, array<array<string>>>")


def _read(spark, sf_dir, slot: str):
    """The surface texts beside a slot's facts: example_id, vpos, text, tokens, low."""
    surface = building._surface(spark, sf_dir)
    low = ps.normal_text(F.col("text"))
    texts = surface.select("example_id", low.alias("text"), ps.normal_tokens(low).alias("tokens"))
    return fx.facts(spark, sf_dir).where(F.col("slot") == slot).select("example_id", "vpos", F.lower("value").alias("low")).join(texts.hint("merge"), "example_id")


def _alternatives(slot: str):
    known = OTHERS.get(slot, {})
    pairs = [x for k, lists in known.items() for x in (F.lit(k), F.array(*[al.texts(*one) for one in lists]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("low")), F.array().cast("array<array<string>>"))


_TEXT = building._SURFACE


@query("SELECT f.example_id, f.vpos, strpos(r.text, lower(f.value)) - 1 AS pos FROM facts f JOIN surf r USING (example_id) WHERE slot = 'brand'", **_TEXT)
def match_categorical(spark, sf_dir):
    """Brands are long enough to be found by substring; none has an alternative in these texts."""
    rows = _read(spark, sf_dir, "brand")
    return rows.select("example_id", "vpos", al.categorical(F.col("text"), F.col("tokens"), F.col("low"), _alternatives("brand")).cast("long").alias("pos"))


@query(None)
def match_scalar_near_stem(spark, sf_dir):
    rows = _read(spark, sf_dir, "traits")
    flat = F.transform(_alternatives("traits"), lambda a: F.element_at(a, 1))
    return rows.select("example_id", "vpos", al.scalar(F.col("text"), F.col("tokens"), F.concat(F.array("low"), flat), al.texts("by", "size")).cast("long").alias("pos"))


@query(None)
def match_boolean_negation(spark, sf_dir):
    """Whether documents speak of a family place: the stems, negations and antonyms of the restaurant rules, for yes and no."""
    low = ps.normal_text(F.col("text"))
    docs = fx.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", low.alias("text"), ps.normal_tokens(low).alias("tokens"))
    stems, antonyms = al.texts("the", "child", "children"), al.texts("adult", "adults")
    both = docs.select("doc_id", "text", "tokens", F.explode(al.texts("yes", "no")).alias("value"))
    return both.select("doc_id", "value", al.boolean(F.col("text"), F.col("tokens"), F.col("value"), stems, antonyms).cast("long").alias("pos"))


@query("SELECT f.example_id, f.vpos, CASE WHEN strpos(r.text, lower(f.value)) > 0 THEN strpos(r.text, lower(f.value)) - 1 ELSE -1 END AS pos FROM facts f JOIN surf r USING (example_id) WHERE slot = 'traits'", **_TEXT)
def match_food(spark, sf_dir):
    """The value by substring; these texts have none of the food words that would stand in for it."""
    rows = _read(spark, sf_dir, "traits")
    return rows.select("example_id", "vpos", al.food(F.col("text"), F.col("tokens"), F.col("low")).cast("long").alias("pos"))


@query(r"SELECT f.example_id, f.vpos, CASE WHEN regexp_matches(r.text, concat('\b', f.value, '\b')) THEN length(string_split_regex(r.text, concat('\b', f.value, '\b'))[1]) ELSE -1 END AS pos FROM facts f JOIN surf r USING (example_id) WHERE slot = 'size'", **_TEXT)
def match_numeric(spark, sf_dir):
    rows = _read(spark, sf_dir, "size")
    return rows.select("example_id", "vpos", al.numeric(F.col("text"), F.col("low")).cast("long").alias("pos"))


def found_facts(spark, sf_dir) -> DataFrame:
    return al.realize(building._surface(spark, sf_dir), fx.facts(spark, sf_dir), lexicon(spark), ["example_id"])


@query(None)
def realize_slots(spark, sf_dir):
    return found_facts(spark, sf_dir).select("example_id", "slot", "vpos", "pos", "duplicate")


@query(None)
def aligner_agreement(spark, sf_dir):
    """The record that rules find in each text, read once, against every pair's record: overall, by grade and topic."""
    found = found_facts(spark, sf_dir).where("pos >= 0").select("example_id", F.lit(1).alias("pos"), "slot", "vpos", "value")
    record = slots.slot_table(found, ["example_id"])
    pairs = fx.negatives(spark, sf_dir)
    gold = routing.methods(spark, sf_dir, ("gold",))["gold"]
    aligned = pairs.select(*v.PAIR).join(record.hint("merge"), "example_id")
    return v.tally(v.agreement(v.method_counts(pairs, {"gold": gold, "aligner": aligned}, routing.given(spark, sf_dir))), [[], ["label"], ["topic"]])


@query("SELECT event_id, key AS slot, CASE WHEN json_type(props, '$.' || key) = 'VARCHAR' THEN json_extract_string(props, '$.' || key) ELSE CAST(json_extract(props, '$.' || key) AS VARCHAR) END AS value, false AS is_list FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def parse_mr_loose(spark, sf_dir):
    return ps.loose_record(fx.read(spark, sf_dir, "events").select("event_id", "props"), ["event_id"], "props")


def _conversations(spark, sf_dir) -> DataFrame:
    """Conversations with spans: the first and the second word of each turn, annotated by role; a repeated span too."""
    c = fx.read(spark, sf_dir, "conversations").where("text is not null and conv_id is not null")
    n = F.length(F.substring_index("text", " ", 1))
    span = lambda a, b, name: F.struct(a.cast("int").alias("start_index"), b.cast("int").alias("end_index"), F.substr("text", a.cast("int") + 1, (b - a).cast("int")).alias("text"), F.array(F.struct(F.lit(name).alias("name"))).alias("annotations"))
    two = F.length(F.substring_index("text", " ", 2))
    segments = F.array(span(F.lit(0), n, "talk.word.accept"), span(F.lit(0), two, "talk.word.accept"), span(n, two, "talk.more"))
    turn = F.struct("turn", F.struct(F.col("role").alias("speaker"), "text", segments.alias("segments")).alias("u"))
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))  # a conversation's turns are one record
    return grouped.select(F.col("conv_id").cast("string").alias("conversation_id"), F.lit("talk").alias("topic"), F.col("t.u").alias("utterances"))


@query(None)
def unpack_dialog_turns(spark, sf_dir):
    return ps.dialog_turns(_conversations(spark, sf_dir)).select("conversation_id", "turn", "topic", "slot", F.array_join("values", "|").alias("value"))


@query("SELECT example_id, vpos, CASE WHEN example_id % 4 = 0 THEN concat('shop.', w) WHEN example_id % 4 = 1 THEN 'b.c.d' WHEN example_id % 4 = 2 THEN w ELSE 'b.b.b' END AS slot, concat('shop_', lower(w)) AS topic FROM (SELECT example_id, vpos, value AS w FROM facts WHERE slot = 'traits')")
def derive_slot_topic(spark, sf_dir):
    f = fx.facts(spark, sf_dir).where("slot = 'traits'")
    k, w = F.col("example_id") % 4, F.col("value")
    raw = F.when(k == 0, F.concat(F.lit("shop."), w, F.lit(".accept"))).when(k == 1, F.lit("shop.b.c.d")).when(k == 2, w).otherwise(F.lit("shop.b.b.b.reject"))
    return f.select("example_id", "vpos", ps.dialog_slot(raw).alias("slot"), ps.dialog_topic(F.concat(F.lit("shop-1-"), F.lower(w), F.lit("-2x")), F.lit(None).cast("string")).alias("topic"))


#: Each part as a restaurant, a laptop or a game: the topic, a text with planted alternatives, and its record.
_TOPICS = ("restaurants", "laptop", "games")


def domain_texts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(texts: example_id, topic, text; facts: example_id, pos, slot, value) of three families of corpora, from the parts' values."""
    part = fx.read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 3).withColumn("j", F.floor(F.col("p_partkey") / 3) % 4)
    pick = lambda *values: F.element_at(al.texts(*values), (F.col("j") + 1).cast("int"))
    first = F.substring_index("p_name", " ", 1)
    price, cost = pick("cheap", "high", "moderate", "cheap"), pick("an affordable", "a costly", "a reasonable", "an expensive")
    place = F.concat(F.lit("The "), "p_name", F.lit(" is "), cost, F.lit(" pub by the "), pick("river", "station", "river", "river"), F.lit(", with "), pick("Japanese", "british", "no", "Indian"), F.lit(" food near "), first, F.lit(". It is "), pick("", "not ", "", "never "), F.lit("family friendly."))
    goods = F.concat(F.lit("the "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" has a "), pick("3.5 hour", "7 hour", "3.5 hour", "9 hour"), F.lit(" battery , is "), pick("thin and light", "light , thin", "thin", "light"), F.lit(" , costs "), pick("little", "a budget price", "an average price", "a low price"), F.lit(" and is "), pick("not ", "", "", ""), F.lit("for business"))
    game = F.concat("p_name", F.lit(" came out in '"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit(" as "), pick("an rpg", "a racing game", "a shoot em up", "a tactical one"), F.lit(". "), "p_name", F.lit(" is "), pick("single player", "fun with friends", "without friends", "great"), F.lit(", rated "), pick("T", "M", "E", "T"), F.lit(" and "), pick("awesome", "dull", "okay", "solid"), F.lit("."))
    text = F.when(F.col("k") == 0, place).when(F.col("k") == 1, goods).otherwise(game)
    topic = F.element_at(al.texts(*_TOPICS), (F.col("k") + 1).cast("int"))

    def facts(*pairs):
        return F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(s).alias("slot"), v.alias("value")) for n, (s, v) in enumerate(pairs)])

    records = (
        F.when(F.col("k") == 0, facts(("name", F.lower("p_name")), ("near", F.lower(first)), ("pricerange", price), ("area", F.lit("riverside")), ("food", pick("Japanese", "English", "Thai", "Indian")), ("eattype", F.lit("pub")), ("familyfriendly", pick("yes", "no", "no", "yes"))))
        .when(F.col("k") == 1, facts(("name", F.concat(F.lower("p_name"), F.lit(" "), F.col("p_size").cast("string"))), ("battery", F.lit("3.5 hour")), ("design", F.lit("light and thin")), ("pricerange", F.lit("cheap")), ("isforbusinesscomputing", pick("false", "true", "false", "true")), ("warranty", F.lit("dontcare"))))
        .otherwise(facts(("name", F.col("p_name")), ("release_year", F.concat(F.lit("20"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"))), ("genres", pick("role-playing", "driving/racing", "shooter, tactical", "tactical")), ("has_multiplayer", pick("no", "yes", "no", "yes")), ("esrb", F.lit("T (for Teen)")), ("rating", pick("excellent", "poor", "good", "good"))))
    )
    return part.select(F.col("p_partkey").alias("example_id"), topic.alias("topic"), text.alias("text")), part.select(F.col("p_partkey").alias("example_id"), F.inline(records))


def ruled(spark, sf_dir) -> DataFrame:
    texts, facts = domain_texts(spark, sf_dir)
    return ru.find_by_rules(texts, facts, ru.rule_table(spark), ["example_id"])


@query(None)
def realize_domains(spark, sf_dir):
    """Where the rules of three families find each value; tests/test_domain_rules.py has a plain version."""
    return ruled(spark, sf_dir).select("example_id", "topic", "pos", "slot", "value", "at", "duplicate")


@query(None)
def errors_per_text(spark, sf_dir):
    """Slots of each text that are not found or stand twice, with their number."""
    found = ru.text_errors(ruled(spark, sf_dir), ["example_id"])
    return found.select("example_id", "n_slots", "n_errors", F.array_join("missing", "|").alias("missing"), F.array_join("duplicates", "|").alias("duplicates"))


_MASKING = {
    "named": """SELECT p_partkey AS example_id, lower(concat('The ', p_name, ' by ', p_brand, ' is near the ', split_part(p_name, ' ', 1), CASE WHEN p_partkey % 3 = 0 THEN concat(' of ', p_brand, ' and ', p_name) ELSE '' END)) AS text,
    list_sort([{'n': -length(p_name), 'pos': 0, 'slot': 'name', 'value': lower(p_name)}, {'n': -length(split_part(p_name, ' ', 1)), 'pos': 1, 'slot': 'near', 'value': lower(split_part(p_name, ' ', 1))}, {'n': -length(p_brand), 'pos': 2, 'slot': 'brand', 'value': lower(p_brand)}]) AS e FROM part""",
    "m0": "SELECT *, text AS t0 FROM named",
    **{
        f"m{k}": rf"SELECT *, regexp_matches(t{k - 1}, p{k}) AS hit{k}, CASE WHEN regexp_matches(t{k - 1}, p{k}) THEN length(string_split_regex(t{k - 1}, p{k})[1]) END AS at{k}, len(regexp_extract_all(t{k - 1}, p{k})) AS n{k}, regexp_replace(t{k - 1}, p{k}, repeat('_', length(e[{k}].value)), 'g') AS t{k} FROM (SELECT *, concat('\b', regexp_escape(e[{k}].value), '\b') AS p{k} FROM m{k - 1})"
        for k in (1, 2, 3)
    },
}


@query(
    """SELECT example_id, t3 AS text, e[k].slot AS slot, CASE k WHEN 1 THEN at1 WHEN 2 THEN at2 ELSE at3 END AS at,
  e[k].slot <> 'name' AND CASE k WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END > 1 AS duplicate FROM m3, (SELECT unnest([1, 2, 3]) AS k)""",
    **_MASKING,
)
def mask_entities(spark, sf_dir):
    """Names masked in texts, the longest first: where each is, whether it is there twice, and none inside another."""
    first = F.substring_index("p_name", " ", 1)
    again = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" of "), "p_brand", F.lit(" and "), "p_name")).otherwise("")
    text = F.lower(F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand", F.lit(" is near the "), first, again))
    one = lambda n, slot, v: F.struct(F.lit(n).alias("pos"), F.lit(slot).alias("slot"), F.lower(v).alias("value"))
    masked = ru.mask_names(text, F.array(one(0, "name", F.col("p_name")), one(1, "near", first), one(2, "brand", F.col("p_brand"))), al.texts("name", "near", "brand"))
    rows = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), masked.alias("m"))
    return rows.select("example_id", "m.text", F.inline("m.found")).select("example_id", "text", "slot", "at", "duplicate")


@query("SELECT example_id, value, array_to_string(items, '|') AS items, CASE WHEN len(list_filter(items, lambda x: strpos(text, x) = 0)) = 0 THEN list_min(list_transform(items, lambda x: strpos(text, x) - 1)) ELSE -1 END AS start FROM lists", lists="SELECT p_partkey AS example_id, lower(concat(p_name, ' by ', p_brand)) AS text, lower(concat(split_part(p_name, ' ', 1), CASE p_partkey % 4 WHEN 0 THEN ', ' WHEN 1 THEN ' and ' WHEN 2 THEN ' with ' ELSE ' or ' END, split_part(p_name, ' ', 2), CASE WHEN p_partkey % 5 = 0 THEN ' , and brass' ELSE '' END)) AS value, list_filter([lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), CASE WHEN p_partkey % 5 = 0 THEN 'and brass' ELSE '' END], lambda x: x <> '') AS items FROM part")
def match_list(spark, sf_dir):
    """Lists in prose: their items, and the leftmost where all are in the text."""
    a, b = F.substring_index("p_name", " ", 1), F.try_element_at(F.split("p_name", " "), F.lit(2))
    joint = F.element_at(F.array(*map(F.lit, (", ", " and ", " with ", " or "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    value = F.lower(F.concat(a, joint, b, F.when(F.col("p_partkey") % 5 == 0, " , and brass").otherwise("")))
    rows = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.lower(F.concat("p_name", F.lit(" by "), "p_brand")).alias("text"), value.alias("value"))
    return rows.select("example_id", "value", F.array_join(ru.conjunction_items(F.col("value")), "|").alias("items"), ru.conjunction(F.col("text"), F.col("value")).cast("long").alias("start"))
