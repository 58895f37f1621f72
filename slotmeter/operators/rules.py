"""Records found in texts by rule tables: names masked first, then each slot by its own matcher.

A topic belongs to a family of corpora (restaurants, acts, games), which says how texts and values are
normalised, what counts as a name and what empty, asked and indifferent values mean. A rule table has a
row for each topic and slot: the matcher, its stems, antonyms and alternatives, and the words that
mention the slot. Slots without a rule are looked for verbatim. Texts, records and rules meet once;
each text is one row until its slots are taken apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotmeter.functions.lexicons import FAMILY, INDIFFERENT, INDIFFERENT_ACTS, MENTIONS, NAMES, RULES
from slotmeter.operators import aligning as al
from slotmeter.operators.parsing import normal_text, normal_tokens, tokenize

_FACT = "struct<pos:int,slot:string,value:string>"
#: Texts among which equal ones with equal records are looked at once; no more keys than these are held in a row.
CHUNK = 2_000_000
#: Texts of a task; a small file of them, or few different ones, would else be one task.
TEXTS = 20_000
_MASKED = "array<struct<pos:int,slot:string,value:string,at:int,duplicate:boolean>>"
#: Words that divide a list written as prose.
DIVIDERS = (",", "and", "or", "with")


def rule_table(spark: SparkSession, rules: dict = RULES, mentions: dict = MENTIONS) -> DataFrame:
    """(topic, slot, kind, stems, antonyms, yes, no, alternatives, mentions), a row for each slot that has a rule or a mention."""
    rows = []
    for topic, own in rules.items():
        named = mentions[FAMILY[topic]]
        for slot in dict.fromkeys([*own, *named]):
            r = own.get(slot, {"kind": "verbatim"})
            values = {v: [a if isinstance(a, list) else [a] for a in words] for v, words in r.get("values", {}).items()}
            rows.append((topic, slot, r["kind"], r.get("stems", []), r.get("antonyms", []), r.get("yes", "yes"), r.get("no", "no"), values, named.get(slot, [slot])))
    return spark.createDataFrame(rows, "topic string, slot string, kind string, stems array<string>, antonyms array<string>, yes string, no string, alternatives map<string, array<array<string>>>, mentions array<string>")


def normal_act_text(text: Column) -> Column:
    """normal_text of a text that writes plurals as 'word -s' and hyphens after a space."""
    return normal_text(F.regexp_replace(F.regexp_replace(text, r"(?U) -s\b", "s"), " -", "-"))


def normal_value(value: Column, acts: Column) -> Column:
    """A value as it is looked for: normal text without edge punctuation."""
    raw = F.when(acts, F.regexp_replace(F.regexp_replace(value, r"(?U) -s\b", "s"), " -", "-")).otherwise(value)
    return F.regexp_replace(F.btrim(F.lower(F.regexp_replace(raw, "[-/]", " ")), F.lit(",.?! ")), r"(?U)\s+", " ")


def mask_names(text: Column, record: Column, names: Column, free: str = "name") -> Column:
    """struct(text, found): names masked in a text, the longest first, so none is found inside another.

    record: array of (pos, slot, value); ``names`` the slots whose values are names. found has the
    record's entries in their order with at, the first offset of a name (null: not a name or not there), and
    duplicate, whether it is there more than once (never for slot ``free``). A value that several entries
    have is masked when the last of them is found. Masked letters become underscores.
    """
    longest = F.array_sort(F.transform(record, lambda r: F.struct((-F.length(r["value"])).alias("n"), r["pos"].alias("pos"), r["slot"].alias("slot"), r["value"].alias("value"))))

    def step(acc: Column, x: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b\Q"), x["value"], F.lit(r"\E\b"))
        at = F.regexp_instr(acc["text"], pattern) - 1
        hit = F.array_contains(names, x["slot"]) & (x["value"] != "") & (at >= 0)
        others = F.size(F.filter(record, lambda r: r["value"] == x["value"])) - F.size(F.filter(acc["found"], lambda f: f["at"].isNotNull() & (f["value"] == x["value"])))
        many = hit & (F.regexp_count(acc["text"], pattern) > 1) & (x["slot"] != free)
        one = F.struct(x["pos"].alias("pos"), x["slot"].alias("slot"), x["value"].alias("value"), F.when(hit, at).alias("at"), F.coalesce(many, F.lit(False)).alias("duplicate"))
        masked = F.regexp_replace(acc["text"], pattern, F.repeat(F.lit("_"), F.length(x["value"])))
        return F.struct(F.when(hit & (others <= 1), masked).otherwise(acc["text"]).alias("text"), F.concat(acc["found"], F.array(one)).cast(_MASKED).alias("found"))

    done = F.aggregate(longest, F.struct(text.alias("text"), F.array().cast(_MASKED).alias("found")), step)
    return F.struct(done["text"].alias("text"), F.array_sort(done["found"]).alias("found"))


def conjunction_items(value: Column) -> Column:
    """The items of 'a, b and c'; a divider that follows no word belongs to the item it begins."""

    def step(acc: Column, t: Column) -> Column:
        ends = t.isin(*DIVIDERS) & (F.size(acc["now"]) > 0)
        empty = F.array().cast("array<string>")
        items = F.when(ends, F.concat(acc["items"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["items"])
        return F.struct(items.alias("items"), F.when(ends, empty).otherwise(F.concat(acc["now"], F.array(t))).alias("now"))

    empty = F.array().cast("array<string>")
    done = F.aggregate(tokenize(value), F.struct(empty.alias("items"), empty.alias("now")), step)
    items = F.when(F.size(done["now"]) > 0, F.concat(done["items"], F.array(F.array_join(done["now"], " ")))).otherwise(done["items"])
    return F.when(F.size(items) > 0, items).otherwise(F.array(value))


def _least_of_all(at: Column) -> Column:
    return F.when(F.forall(at, lambda p: p >= 0), F.array_min(at)).otherwise(-1)


def conjunction(text: Column, value: Column) -> Column:
    """The leftmost of the items of a list in prose, if all are in the text."""
    return _least_of_all(F.transform(conjunction_items(value), lambda item: al.find(text, item)))


def items(text: Column, tokens: Column, value: Column, alternatives: Column, mode: str) -> Column:
    """The leftmost of the items of 'a, b', each by itself or one of its own alternatives, if all are found."""
    none = F.array().cast("array<array<string>>")
    return _least_of_all(F.transform(F.split(value, ", "), lambda x: al.categorical(text, tokens, F.trim(x), F.coalesce(F.try_element_at(alternatives, F.trim(x)), none), mode)))


def _mention(text: Column, mentions: Column) -> Column:
    return al._first(F.transform(mentions, lambda s: al.keywords(text, F.array(s))["pos"]))


def find_by_rules(texts: DataFrame, facts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topic, pos, slot, value, at, duplicate): where each fact of a record is in its text, -1 without.

    texts: keys, topic, text; facts: keys, pos, slot, value (pos orders a record; a null value is asked
    for: '?'); rules: by rule_table, of bounded size. Topics without a family are not looked at. In
    games a slot's trailing digits go, and 'da' entries are acts, not slots. A duplicate is a value that stands
    more than once, unless its slot or value is repeated in the record. Offsets are zero-based characters of
    the normal text with names masked. Equal texts of a topic with equal records are looked at once in each
    ``CHUNK`` of them, and every key gets its rows.
    """
    family = F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])
    names = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), al.texts(*v))])
    known = texts.select(*keys, "topic", "text", F.try_element_at(family, F.col("topic")).alias("family")).where("family is not null")
    record = facts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "slot", F.coalesce("value", F.lit("?")).alias("value")))).alias("record"))
    n_texts = known.count()
    chunk, tasks = F.pmod(F.xxhash64(*keys), F.lit(n_texts // CHUNK + 1)).alias("chunk"), max(known.sparkSession.sparkContext.defaultParallelism, -(-n_texts // TEXTS))
    alike = known.join(record.hint("merge"), keys).groupBy(chunk, "topic", "family", "text", "record")
    both, keys = alike.agg(F.collect_list(F.struct(*keys)).alias("same")).repartition(tasks, "chunk", "text", "record"), ["same"]
    games, acts = F.col("family") == "games", F.col("family") == "acts"
    as_game = F.transform(F.filter("record", lambda r: r["slot"] != "da"), lambda r: F.struct(r["pos"].alias("pos"), F.regexp_replace(r["slot"], r"^<\|(.*?)\|>$", "$1").alias("slot"), normal_value(r["value"], F.lit(False)).alias("value")))
    text = F.when(acts, normal_act_text(F.col("text"))).otherwise(normal_text(F.col("text")))
    n_acts = F.size(F.filter("record", lambda r: r["slot"] == "da"))
    both = both.select(*keys, "topic", "family", text.alias("text"), n_acts.alias("n_acts"), F.when(games, as_game).otherwise(F.col("record")).cast(f"array<{_FACT}>").alias("record"))
    both = both.withColumn("masked", mask_names(F.col("text"), F.col("record"), F.element_at(names, F.col("family"))))
    tokens = normal_tokens(F.when(games, F.col("text")).otherwise(normal_text(F.col("masked.text"))))
    each = both.select(*keys, "topic", "family", "n_acts", "record", F.col("masked.text").alias("text"), tokens.alias("tokens"), F.explode("masked.found").alias("f"))
    slot = F.when(games, F.regexp_replace("f.slot", "[0-9]+$", "")).otherwise(F.col("f.slot"))
    times = lambda field: F.size(F.filter("record", lambda r: r[field] == F.col(f"f.{field}")))
    each = each.select(*keys, "topic", "family", "n_acts", "text", "tokens", "f", slot.alias("slot"), F.when(games, F.col("f.value")).otherwise(normal_value(F.col("f.value"), acts)).alias("low"), times("slot").alias("same_slot"), times("value").alias("same_value"))
    each = each.join(F.broadcast(rules), ["topic", "slot"], "left")
    text, tokens, low = F.col("text"), F.col("tokens"), F.col("low")
    none = F.array().cast("array<array<string>>")
    stems, mentions = F.coalesce("stems", al.texts()), F.coalesce("mentions", F.array("slot"))
    own = F.coalesce(F.try_element_at("alternatives", low), none)
    flat = F.transform(F.filter(own, lambda a: F.size(a) == 1), lambda a: F.element_at(a, 1))
    by_kind = {
        "boolean": F.when(F.col("yes") == "true", al.boolean(text, tokens, low, stems, F.col("antonyms"), "true", "false")).otherwise(al.boolean(text, tokens, low, stems, F.col("antonyms"))),
        "food": al.food(text, tokens, low),
        "substring": al.find(text, low),
        "categorical": al.categorical(text, tokens, low, own),
        "first_word": al.categorical(text, tokens, low, own, "first_word", plurals=True),
        "scalar": al.scalar(text, tokens, F.concat(F.array(low), flat), stems),
        "numeric": al.numeric(text, low),
        "unit": al.numeric_unit(tokens, low),
        "year": al.year(text, tokens, low),
        "conjunction": conjunction(text, low),
        "items": items(text, tokens, low, F.col("alternatives"), "exact_match"),
        "items_first_word": items(text, tokens, low, F.col("alternatives"), "first_word"),
    }
    clean = F.replace(F.lower(text), F.lit("'"), F.lit(""))
    says = lambda words: reduce(lambda a, b: a | b, [F.contains(clean, F.lit(w)) for w in words])
    any_act = F.exists(mentions, lambda s: F.contains(clean, s)) & says(INDIFFERENT_ACTS)
    any_game = F.exists(mentions, lambda s: F.array_contains(tokenize(clean), s)) & says(INDIFFERENT)
    indifferent = low.isin("dontcare", "don't care") | (acts & (low == "dont_care"))
    empty = (low == "") | (low == "none")
    special = (
        F.when(F.col("family") == "restaurants", F.when(indifferent | (low == ""), _mention(text, mentions)).when(low.isin("none", "?"), -1))
        .when(indifferent, F.when(F.when(acts, any_act).otherwise(any_game), 0).otherwise(-1))
        .when(empty | (acts & (low == "?")), _mention(text, mentions))
        .when(low == "?", -1)
    )
    ruled = reduce(lambda c, k: c.when(F.col("kind") == k, by_kind[k]), by_kind, F.when(F.lit(False), -1)).otherwise(-1)
    each = each.withColumns({"special": special, "ruled": F.when(F.col("f.at").isNull() & special.isNull(), ruled)})
    verbatim = al.keywords(text, F.array(low))
    fall = F.col("f.at").isNull() & F.col("special").isNull() & (F.col("ruled") < 0)
    at = F.coalesce("f.at", "special", F.when(fall, verbatim["pos"]).otherwise(F.col("ruled")))
    twice = F.when(F.col("f.at").isNotNull(), F.col("f.duplicate")).otherwise(fall & verbatim["duplicate"] & (F.col("same_slot") == 1))
    twice = twice & F.when(F.col("f.value") == "", F.col("n_acts") <= 1).otherwise(F.col("same_value") == 1)
    told = each.select(*keys, "topic", "f.pos", "f.slot", F.col("f.value").alias("value"), at.alias("at"), F.coalesce(twice, F.lit(False)).alias("duplicate"))
    return told.select(F.inline("same"), "topic", "pos", "slot", "value", "at", "duplicate")


def text_errors(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_slots, n_errors, missing, duplicates) of find_by_rules: slots not found, as often as they lack, and slots found twice."""
    by_slot = found.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") < 0).alias("lost"), F.bool_or("duplicate").alias("twice"))
    lists = [F.array_sort(F.collect_list(F.when(when, F.col("slot")))).alias(name) for when, name in ((F.col("lost") > 0, "missing"), (F.col("twice"), "duplicates"))]
    return by_slot.groupBy(*keys).agg(F.sum("n").alias("n_slots"), (F.sum("lost") + F.count_if("twice")).alias("n_errors"), *lists)
