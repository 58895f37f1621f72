"""Rule matchers of slot values in texts, as expressions over a normal text and its tokens.

Each gives the zero-based character offset of the match, -1 without one. Lexicons (stems, cues,
alternatives) are arguments; the defaults are fixed values of the restaurant rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.operators.parsing import last_place, normal_text, normal_tokens, places, plural, token_offset

#: Cues of negation before and after a stem, and of contrast; bounds in tokens and letters.
BEFORE = ("no", "not", "non", "none", "neither", "nor", "never", "n't", "cannot", "excluded", "lack", "lacks", "lacking", "unavailable", "without", "zero")
BEFORE_PHRASE = "everything but"
AFTER = ("not", "nor", "never", "n't", "cannot", "excluded", "unavailable")
CONTRAST = ("but", "however", "although", "though", "nevertheless")
TRUE_TOKENS, TRUE_LETTERS, FALSE_TOKENS, FALSE_LETTERS, AFTER_TOKENS = 5, 15, 10, 30, 10
NEAR_TOKENS, NEAR_LETTERS = 10, 30
#: Words that name food.
FOOD = (
    "chinese", "english", "british", "french", "italian", "indian", "japanese", "thai", "mexican", "korean", "vietnamese", "greek", "spanish", "turkish", "american", "mediterranean", "asian", "european", "african",
    "pizza", "pasta", "sushi", "curry", "noodle", "noodles", "rice", "bread", "burger", "burgers", "steak", "seafood", "fish", "chicken", "vegetarian", "vegan", "organic", "halal", "kosher",
)
#: Small numbers as words.
SMALL = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
TENS = ("thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
NUMBERS = {str(k): w for k, w in enumerate(SMALL)} | {str(10 * k): w for k, w in enumerate(TENS, 3)}
#: Values that say nothing of a slot, and values that are never found.
ANY, NOTHING = ("dontcare", "don't care", ""), ("none", "?")


def texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def find(text: Column, term: Column) -> Column:
    return F.instr(text, term) - 1


def _whole(term: Column) -> Column:
    """A literal pattern, at word borders where the term begins and ends with a word character."""
    edge = F.when(term.rlike(r"(?U)^\w(.*\w)?$"), r"\b").otherwise("")
    return F.concat(F.lit("(?U)"), edge, F.lit(r"\Q"), term, F.lit(r"\E"), edge)


def keywords(text: Column, words: Column, ordered: bool = True) -> Column:
    """struct(pos, duplicate): the last keyword's offset if all occur (in order), and whether any occurs more than once."""

    def step(acc: Column, word: Column) -> Column:
        rest = F.substr(text, acc["end"] + 1) if ordered else text
        at = F.regexp_instr(rest, _whole(word))
        start = at - 1 + (acc["end"] if ordered else F.lit(0))
        found = acc["ok"] & (at > 0)
        more = acc["duplicate"] | (F.regexp_count(text, _whole(word)) > 1)
        return F.struct(found.alias("ok"), start.alias("pos"), (start + F.length(word)).alias("end"), more.alias("duplicate"))

    empty = F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("pos"), F.lit(0).alias("end"), F.lit(False).alias("duplicate"))
    done = F.aggregate(words, empty, step)
    return F.struct(F.when(done["ok"], done["pos"]).otherwise(-1).alias("pos"), (done["ok"] & done["duplicate"]).alias("duplicate"))


def _is_long(term: Column) -> Column:
    return (F.length(term) > 4) | F.contains(term, F.lit(" "))


def found(text: Column, tokens: Column, term: Column) -> Column:
    """A long term by substring, a short one by token."""
    at = last_place(tokens, term)
    return F.when(_is_long(term), find(text, term)).when(at >= 0, token_offset(tokens, at)).otherwise(-1)


def _first(positions: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(positions, lambda p: p >= 0), F.lit(1)), F.lit(-1))


def categorical(text: Column, tokens: Column, value: Column, alternatives: Column, mode: str = "exact_match", plurals: bool = False) -> Column:
    """The value, or the first of its alternatives (an array of arrays of words that must all occur)."""
    words = F.split(value, " ")
    own = {"first_word": F.array(F.slice(words, 1, 1)), "any_word": F.transform(words, lambda w: F.array(w)), "all_words": F.array(words)}.get(mode, F.array(F.array(value)))
    every = F.concat(own, F.coalesce(alternatives, F.array().cast("array<array<string>>")))
    if plurals:
        every = F.concat(every, F.transform(F.filter(every, lambda a: F.size(a) == 1), lambda a: F.array(plural(F.element_at(a, 1)))))

    def least(words: Column) -> Column:
        at = F.transform(words, lambda w: found(text, tokens, w))
        return F.when(F.forall(at, lambda p: p >= 0), F.array_min(at)).otherwise(-1)

    return _first(F.transform(every, least))


def _occurrences(text: Column, term: Column) -> Column:
    """Offsets of all separate occurrences."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")), -1)
    return F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - 1), lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), "")) + (k - 1) * F.length(term))


def scalar(text: Column, tokens: Column, values: Column, stems: Column) -> Column:
    """The first of ``values`` (in order of priority) near a stem of the slot, else the leftmost one anywhere."""
    clean = F.replace(text, F.lit("'"), F.lit(""))
    short = F.filter(stems, lambda s: ~_is_long(s))
    stem_places = F.flatten(F.transform(short, lambda s: places(tokens, s)))
    stem_letters = F.concat(F.flatten(F.transform(F.filter(stems, _is_long), lambda s: _occurrences(clean, s))), F.transform(stem_places, lambda i: token_offset(tokens, i)))

    def hits(v: Column) -> Column:
        letters = F.transform(_occurrences(clean, v), lambda p: F.struct(p.alias("pos"), F.exists(stem_letters, lambda q: F.abs(p - q) < NEAR_LETTERS).alias("near")))
        by_token = F.transform(places(tokens, v), lambda i: F.struct(token_offset(tokens, i).alias("pos"), F.exists(stem_places, lambda j: F.abs(i - j) < NEAR_TOKENS).alias("near")))
        return F.when(_is_long(v), letters).otherwise(by_token)

    every = F.flatten(F.transform(values, hits))
    near = F.try_element_at(F.filter(every, lambda h: h["near"]), F.lit(1))["pos"]
    return F.coalesce(near, F.array_min(F.transform(every, lambda h: h["pos"])), F.lit(-1))


def _negated(clean: Column, tokens: Column, at: Column, pos: Column, expect_true: bool) -> Column:
    """Whether the stem at token ``at`` and letter ``pos`` is negated; the first cue near enough decides, unless a contrast follows it."""
    most, letters = (TRUE_TOKENS, TRUE_LETTERS) if expect_true else (FALSE_TOKENS, FALSE_LETTERS)

    def between(j: Column) -> Column:
        return F.slice(tokens, j + 2, F.greatest(at - j - 1, F.lit(0)))

    def gap(j: Column) -> Column:
        return at - j - F.size(F.filter(between(j), lambda t: t == ","))

    cues = F.flatten(F.transform(texts(*BEFORE), lambda c: F.filter(places(tokens, c), lambda j: (j < at) & (gap(j) > 0) & (gap(j) <= most))))
    first = F.try_element_at(cues, F.lit(1))
    by_token = ~F.exists(between(first), lambda t: t.isin(*CONTRAST))
    phrase = F.instr(clean, BEFORE_PHRASE) - 1
    part = F.substr(clean, phrase + 1, F.greatest(pos - phrase, F.lit(0)))
    far = pos - phrase - (F.length(part) - F.length(F.replace(part, F.lit(","), F.lit(""))))
    after_phrase = F.substr(clean, phrase + 1 + len(BEFORE_PHRASE), F.greatest(pos - phrase - len(BEFORE_PHRASE), F.lit(0)))
    by_phrase = ~reduce(lambda a, b: a | b, [F.contains(after_phrase, F.lit(c)) for c in CONTRAST])
    later = F.lit(False) if expect_true else F.exists(texts(*AFTER), lambda c: F.exists(places(tokens, c), lambda j: (j > at) & (j - at < AFTER_TOKENS)))
    return F.when(first.isNotNull(), by_token).when((phrase >= 0) & (far > 0) & (far <= letters), by_phrase).otherwise(later)


def boolean(text: Column, tokens: Column, value: Column, stems: Column, antonyms: Column, yes: str = "yes", no: str = "no") -> Column:
    """A stem of the slot that is not negated (for yes), or is (for anything else); for no, an antonym too."""
    clean = F.replace(text, F.lit("'"), F.lit(""))

    def one(stem: Column) -> Column:
        at = last_place(tokens, stem)
        pos = token_offset(tokens, at)
        good = F.when(value == yes, ~_negated(clean, tokens, at, pos, True)).otherwise(_negated(clean, tokens, at, pos, False))
        return F.when((at >= 0) & good, pos).otherwise(-1)

    def other(word: Column) -> Column:
        at = last_place(tokens, word)
        return F.when(F.contains(word, F.lit(" ")), find(clean, word)).when(at >= 0, token_offset(tokens, at)).otherwise(-1)

    by_stem = _first(F.transform(stems, one))
    return F.when(by_stem >= 0, by_stem).when(value == no, _first(F.transform(antonyms, other))).otherwise(-1)


def food(text: Column, tokens: Column, value: Column) -> Column:
    """The value, its two synonyms, else any word that names food."""
    low = F.lower(value)
    word = F.try_element_at(F.filter(tokens, lambda t: F.lower(t).isin(*FOOD)), F.lit(1))
    return F.when(find(text, low) >= 0, find(text, low)).when(low == "english", find(text, F.lit("british"))).when(low == "fast food", find(text, F.lit("american style"))).otherwise(F.coalesce(find(text, word), F.lit(-1)))


def _word(text: Column, term: Column) -> Column:
    return F.regexp_instr(text, F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b"))) - 1


def numeric(text: Column, value: Column) -> Column:
    """A number as given, or one of its words in the other writing (digits or word)."""
    known = F.create_map(*[F.lit(x) for k, w in NUMBERS.items() for pair in ((k, w), (w, k)) for x in pair])
    other = F.filter(F.transform(F.split(value, " "), lambda w: F.try_element_at(known, w)), lambda w: w.isNotNull())
    return F.when(_word(text, value) >= 0, _word(text, value)).otherwise(_first(F.transform(other, lambda w: _word(text, w))))


def numeric_unit(tokens: Column, value: Column) -> Column:
    """The leading number of a value with a unit, as a token."""
    number = F.substring_index(value, " ", 1)
    at = last_place(tokens, number)
    return F.when(number.try_cast("double").isNotNull() & (at >= 0), token_offset(tokens, at)).otherwise(-1)


def year(text: Column, tokens: Column, value: Column) -> Column:
    """A year, or with four digits its last two, with an apostrophe or as a token."""
    short = F.substr(value, F.length(value) - 1)
    at = last_place(tokens, short)
    four = F.array(find(text, F.concat(F.lit("'"), short)), F.when(at >= 0, token_offset(tokens, at)).otherwise(-1))
    own = F.when(F.length(value) > 2, find(text, value)).otherwise(F.when(last_place(tokens, value) >= 0, token_offset(tokens, last_place(tokens, value))).otherwise(-1))
    return F.when(value.try_cast("int").isNull(), -1).when(own >= 0, own).when(F.length(value) == 4, _first(four)).otherwise(-1)


def list_items(text: Column, tokens: Column, value: Column, alternatives: Column, separator: str = ", ") -> Column:
    """The leftmost of the items of a list if all are found."""
    at = F.transform(F.split(value, separator), lambda item: categorical(text, tokens, F.trim(item), alternatives))
    return F.when(F.forall(at, lambda p: p >= 0), F.array_min(at)).otherwise(-1)


def realize(texts_: DataFrame, facts: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, vpos, value, pos, duplicate) for every fact of facts (keys, slot, vpos, value) and its text.

    lexicon (slot, kind, stems, antonyms, alternatives map<string, array<array<string>>>): a slot's
    matcher (boolean, food, categorical, scalar, numeric, unit, year, list; anything else is verbatim)
    and its words. Values that say nothing need a stem of the slot; other matchers fall back to the
    verbatim value. Texts are read once, whatever the number of their facts' records.
    """
    read = texts_.select(*keys, normal_text(F.col("text")).alias("text"), normal_tokens(normal_text(F.col("text"))).alias("tokens"))
    rows = facts.select(*keys, "slot", "vpos", F.lower("value").alias("low"), "value").join(F.broadcast(lexicon), "slot", "left")  # a row for each slot of a schema
    rows = rows.join(read.hint("merge"), keys)
    text, tokens, low, kind = F.col("text"), F.col("tokens"), F.col("low"), F.col("kind")
    stems, antonyms = F.coalesce("stems", texts()), F.coalesce("antonyms", texts())
    other = F.coalesce(F.try_element_at("alternatives", low), F.array().cast("array<array<string>>"))
    flat = F.transform(F.filter(other, lambda a: F.size(a) == 1), lambda a: F.element_at(a, 1))
    mention = _first(F.transform(F.when(F.size(stems) > 0, stems).otherwise(F.array("slot")), lambda s: keywords(text, F.array(s))["pos"]))
    by_kind = {
        "boolean": boolean(text, tokens, low, stems, antonyms),
        "food": food(text, tokens, low),
        "categorical": categorical(text, tokens, low, other),
        "scalar": scalar(text, tokens, F.concat(F.array(low), flat), stems),
        "numeric": numeric(text, low),
        "unit": numeric_unit(tokens, low),
        "year": year(text, tokens, low),
        "list": list_items(text, tokens, low, other),
    }
    pos = reduce(lambda c, k: c.when(kind == k, by_kind[k]), by_kind, F.when(low.isin(*ANY), mention).when(low.isin(*NOTHING), -1)).otherwise(-1)
    rows = rows.select(*keys, "slot", "vpos", "value", "low", "text", pos.alias("p"))
    verbatim = keywords(F.col("text"), F.array("low"))
    fall = (F.col("p") < 0) & ~F.col("low").isin(*ANY, *NOTHING)
    return rows.select(*keys, "slot", "vpos", "value", F.when(fall, verbatim["pos"]).otherwise(F.col("p")).alias("pos"), (fall & verbatim["duplicate"]).alias("duplicate"))
