"""Parsers of corpus notations: bracketed, act with brackets, act with assignments, dialog slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.functions.values import listed, strip
from slotmeter.operators.slots import parse_record


def bracket(df: DataFrame, keys: list[str], text: str = "mr") -> DataFrame:
    """(keys, pos, slot, vpos, value) of 'name[v], slot[v1, v2]'; empty values are dropped."""
    parts = df.select(*keys, F.posexplode(F.split(text, r"\],\s*")).alias("pos", "part"))
    slot, raw = strip(F.substring_index("part", "[", 1)), F.regexp_replace(F.substr("part", F.instr("part", "[") + 1), r"\]$", "")
    found = parts.where(F.contains("part", F.lit("["))).select(*keys, "pos", slot.alias("slot"), F.posexplode(F.split(raw, ", ")).alias("vpos", "value"))
    return found.where("value <> ''").withColumn("vpos", F.col("vpos") + 1)


def act_bracket(df: DataFrame, keys: list[str], text: str = "mr") -> DataFrame:
    """bracket() of 'act(slot[v], ...)', with the act."""
    body = F.regexp_extract(text, r"(?s)^\s*\w+\((.*)\)\s*$", 1)
    base = df.select(*keys, F.regexp_extract(text, r"^\s*(\w+)\(", 1).alias("act"), body.alias("body"))
    return bracket(base, [*keys, "act"], "body")


def act_assign(df: DataFrame, keys: list[str], text: str = "mr") -> DataFrame:
    """(keys, act, pos, slot, value) of "act(slot='v';slot2=v2;slot3)"; a slot without value stays with null."""
    body = F.regexp_extract(text, r"(?s)^\s*[?\w]+\((.*)\)\s*$", 1)
    base = df.select(*keys, F.regexp_extract(text, r"^\s*([?\w]+)\(", 1).alias("act"), F.posexplode(F.split(body, ";")).alias("pos", "part"))
    value = F.btrim(F.substr("part", F.instr("part", "=") + 1), F.lit("'\" "))
    return base.where("part <> ''").select(*keys, "act", "pos", strip(F.substring_index("part", "=", 1)).alias("slot"), F.when(F.contains("part", F.lit("=")), value).alias("value"))


def dialog_slot(name: Column) -> Column:
    """A dialog annotation's slot: without topic and a last accept or reject; one or two different tokens get the topic back."""
    parts = F.split(name, r"\.")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rest = F.when(F.element_at(parts, -1).isin("accept", "reject"), F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    few = (F.size(rest) <= 2) & (F.size(F.array_distinct(rest)) == F.size(rest))
    return F.when(F.contains(name, F.lit(".")), F.array_join(F.when(few, F.concat(F.slice(parts, 1, 1), rest)).otherwise(rest), ".")).otherwise(name)


def dialog_topic(instruction: Column, vertical: Column) -> Column:
    """The alphabetic tokens of an instruction's id, else the vertical with underscores."""
    tokens = F.filter(F.split(instruction, "-"), lambda t: t.rlike(r"^\p{L}+$"))
    return F.coalesce(F.array_join(tokens, "_"), F.replace(vertical, F.lit(" "), F.lit("_")))


def any_record(df: DataFrame, keys: list[str], text: str = "mr") -> DataFrame:
    """(keys, form, pos, slot, vpos, value, error): each row's record, whichever way it is written.

    form: json (begins with a brace), text (a parenthesised record) or rejected. A JSON object has a slot for
    each name, in order, with a value or a list of values (null stays null, an empty list gives a slot
    without value, what is nested stays JSON). Rows that are neither, or no valid JSON, or that repeat a name,
    give one row with error and no slot; a record without slots, one row with neither. Null is rejected.
    Every row is parsed by its own form only, and rejected rows stay.
    """
    t = strip(F.col(text))
    form = F.when(F.startswith(t, F.lit("{")), "json").when(F.startswith(t, F.lit("<LIST>")) | F.contains(t, F.lit("(")), "text").otherwise("rejected")
    read = df.select(*keys, t.alias("_t"), form.alias("form"))
    good = F.try_parse_json("_t").isNotNull()
    json = read.where("form = 'json'").select(*keys, "form", "_t", F.coalesce(good, F.lit(False)).alias("_good"))
    pairs = json.where("_good").select(*keys, "form", F.posexplode_outer(F.from_json("_t", "map<string,variant>")).alias("pos", "slot", "_v"))
    is_list = F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY"))
    several = F.when(is_list, F.try_variant_get("_v", "$", "array<string>"))
    values = F.when(F.size(several) > 0, several).when(is_list, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.try_variant_get("_v", "$", "string")))
    none = F.lit(None).cast("string")
    found = pairs.select(*keys, "form", "pos", "slot", F.posexplode(values).alias("vpos", "value")).select(*keys, "form", "pos", "slot", F.when(F.col("slot").isNotNull(), F.col("vpos") + 1).alias("vpos"), "value", none.alias("error"))
    written = read.where("form = 'text'").select(*keys, F.replace("_t", F.lit("</LIST>"), F.lit("")).alias("_t"))
    facts = parse_record(written, keys, "_t")
    same = [F.col(f"`{k}`") for k in keys]
    facts = written.select(*keys).join(facts.select(*[c.alias(f"_k{i}") for i, c in enumerate(same)], "pos", "slot", "vpos", "value").hint("merge"), [c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(same)], "left")
    facts = facts.select(*keys, F.lit("text").alias("form"), "pos", "slot", "vpos", "value", none.alias("error"))
    bad = json.where("not _good").select(*keys, "form", F.lit("not a JSON object").alias("error")).unionByName(read.where("form = 'rejected'").select(*keys, "form", F.lit("neither a JSON object nor a record").alias("error")))
    bad = bad.select(*keys, "form", F.lit(None).cast("int").alias("pos"), none.alias("slot"), F.lit(None).cast("int").alias("vpos"), none.alias("value"), "error")
    return found.unionByName(facts).unionByName(bad)


#: Clitics that become tokens of their own, in this order.
CLITICS = ("n't", "'s", "'re", "'ve", "'ll", "'d")
#: Punctuation at the edges of an utterance's tokens, and marks that offsets leave out.
EDGES, LIGHT = ".,!?", (".", ",")


def tokenize(text: Column) -> Column:
    """Word tokens: clitics apart, hyphen and slash words whole, every other mark a token."""
    for clitic in CLITICS:
        text = F.regexp_replace(text, rf"(?U)(\w)({clitic})\b", "$1 $2")
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+(?:[-/]\w+)*|[^\w\s])"), F.lit(1))


def _ends(word: Column, end: str) -> Column:
    return F.endswith(word, F.lit(end))


def plural(word: Column) -> Column:
    """A rule-made plural; the first ending that fits decides."""
    but = lambda n, new: F.concat(F.substr(word, F.lit(1), F.length(word) - n), F.lit(new))
    return (
        F.when(_ends(word, "fe"), but(2, "ves"))
        .when(_ends(word, "f"), but(1, "ves"))
        .when(_ends(word, "o"), but(0, "es"))
        .when(_ends(word, "us"), but(2, "i"))
        .when(_ends(word, "on"), but(2, "a"))
        .when(_ends(word, "y"), but(1, "ies"))
        .when(word.rlike("(s|x|sh|ch)$"), but(0, "es"))
        .when(_ends(word, "an"), but(2, "en"))
        .otherwise(but(0, "s"))
    )


def normal_text(text: Column) -> Column:
    """Lower case, hyphens and slashes as spaces, single white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[-/]", " "), r"(?U)\s+", " ")


def normal_tokens(text: Column) -> Column:
    """The tokens of a normal text; longer ones lose edge punctuation."""
    return F.transform(tokenize(text), lambda t: F.when(F.length(t) > 1, F.btrim(t, F.lit(EDGES))).otherwise(t))


def token_offset(tokens: Column, at: Column) -> Column:
    """The approximate character offset of the token before which ``at`` others stand."""
    before = F.slice(tokens, F.lit(1), at)
    light = F.size(F.filter(before, lambda t: t.isin(*LIGHT)))
    return F.length(F.array_join(before, " ")) + 1 - light


def places(tokens: Column, term: Column) -> Column:
    """All zero-based places of a token."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == term, i)), lambda i: i.isNotNull())


def last_place(tokens: Column, term: Column) -> Column:
    """The last place of a token, -1 without any: what the reference calls the first."""
    return F.coalesce(F.try_element_at(places(tokens, term), F.lit(-1)), F.lit(-1))


def loose_record(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, slot, value, is_list) of the first line of free output: a JSON object, or 'a: b, c: d'.

    Commas inside quotes or brackets do not part fields; fields without a colon and values that read
    'none' are dropped; 'a, b', 'a and b' and JSON lists become lists; of a repeated slot the last wins.
    """
    t = strip(F.col(text))
    body = F.when(F.startswith(t, F.lit("```")), F.element_at(F.split(t, "```", 3), -1)).otherwise(t)
    line = strip(F.substring_index(F.regexp_replace(strip(body), r"\r\n?", "\n"), "\n", 1))
    as_json = F.when(F.startswith(line, F.lit("{")) & F.contains(line, F.lit(":")), F.from_json(line, "map<string,string>"))
    quoted = r"'[^']*(?:'|$)|\"[^\"]*(?:\"|$)"
    group = rf"[\[{{](?:{quoted}|[^\]}}'\"])*[\]}}]?|\((?:{quoted}|[^)'\"])*\)?"
    fields = F.regexp_extract_all(line, F.lit(rf"((?:{quoted}|{group}|[^,])+)"), F.lit(1))
    pairs = F.transform(F.filter(fields, lambda f: F.contains(f, F.lit(":"))), lambda f: F.struct(strip(F.substring_index(f, ":", 1)).alias("slot"), strip(F.substr(f, F.instr(f, ":") + 1)).alias("raw")))
    given = F.transform(F.map_entries(as_json), lambda e: F.struct(strip(e["key"]).alias("slot"), e["value"].alias("raw")))
    each = df.select(*keys, as_json.isNotNull().alias("json"), F.posexplode(F.coalesce(given, pairs)).alias("k", "e")).select(*keys, "json", "k", "e.slot", "e.raw")
    each = each.where("raw is not null and lower(trim(raw)) <> 'none'")
    last = each.groupBy(*keys, "slot").agg(F.max_by(F.struct("json", "raw"), "k").alias("m")).select(*keys, "slot", "m.json", "m.raw")
    raw, parts = F.col("raw"), listed(F.col("raw"))
    array = F.when(F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]")), F.transform(F.from_json(raw, "array<string>"), strip))
    values = F.coalesce(array, F.when(~F.col("json"), parts))
    return last.select(*keys, "slot", values.isNotNull().alias("is_list"), F.explode(F.coalesce(values, F.array(raw))).alias("value"))


def dialog_turns(conversations: DataFrame, speaker: str = "assistant") -> DataFrame:
    """(conversation_id, turn, surface_form, topic, slot, values) of annotated turns of one speaker.

    conversations: conversation_id, topic, utterances array of (speaker, text, segments array of
    (start_index, end_index, text, annotations array of (name))). The first annotation names the slot;
    of spans with one start the shortest stays, then of those with one end.
    """
    turns = conversations.select("conversation_id", "topic", F.posexplode("utterances").alias("turn", "u")).where(F.lower("u.speaker") == speaker)
    spans = turns.select("conversation_id", "topic", "turn", F.col("u.text").alias("surface_form"), F.posexplode("u.segments").alias("k", "g"))
    spans = spans.where(F.size("g.annotations") > 0).withColumn("slot", dialog_slot(F.element_at("g.annotations", 1)["name"]))
    keys = ["conversation_id", "turn", "slot"]
    flat = spans.select(*keys, "topic", "surface_form", "k", F.col("g.start_index").alias("start"), F.col("g.end_index").alias("end"), F.col("g.text").alias("text"))
    for edge in ("start", "end"):
        flat = flat.groupBy(*keys, "topic", "surface_form", edge).agg(F.min(F.struct(F.length("text").alias("n"), "k", "start" if edge == "end" else "end", "text")).alias("m")).select(*keys, "topic", "surface_form", edge, "m.*")
    found = flat.groupBy(*keys, "topic", "surface_form").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("v"))
    return found.select(*keys, "topic", "surface_form", F.col("v.text").alias("values"))
