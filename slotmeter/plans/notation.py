"""Queries of notations, annotations, tokens, method tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotmeter.operators import annotations as an
from slotmeter.operators import naming as nm
from slotmeter.operators import parsing as ps
from slotmeter.operators import resumable as rs
from slotmeter.operators import slots
from slotmeter.operators import verify as v
from slotmeter.plans import core, routing
from slotmeter.plans import fixtures as fx
from slotmeter.plans.registering import registry
from slotmeter.sources import writers
from slotmeter.sources.work import folder
from slotmeter.streaming import tallies as tl

QUERIES, ORACLES, query = registry()


_NOTES = {
    "notes": "SELECT p_partkey AS example_id, CASE p_partkey % 11 WHEN 1 THEN 'D:brand' WHEN 2 THEN 'S:size=9, I:color=red' WHEN 3 THEN 'I:color=blue, bad part, D:large' WHEN 4 THEN 'S:name=x y, S:name=z' ELSE '' END AS note FROM part",
    "errs": "SELECT example_id, seq, string_split(part, ':')[1] AS type, string_split(part[3:], '=')[1] AS slot, CASE WHEN contains(part, '=') THEN part[strpos(part, '=') + 1:] END AS value FROM (SELECT example_id, trim(unnest(string_split(note, ','))) AS part, unnest(range(len(string_split(note, ',')))) AS seq FROM notes) WHERE part[1:1] IN ('D', 'S', 'I') AND part[2:2] = ':'",
    "gold": "SELECT p.p_partkey AS example_id, p.p_type AS topic, count(*) FILTER (WHERE type = 'S') AS s, count(*) FILTER (WHERE type = 'D') AS d, count(*) FILTER (WHERE type = 'I') AS i, round(count(type) / 5.0, 6)::DOUBLE AS ser FROM part p LEFT JOIN errs e ON e.example_id = p.p_partkey GROUP BY ALL",
    "real": "SELECT example_id, slot, value FROM (SELECT *, row_number() OVER (PARTITION BY example_id, slot ORDER BY seq DESC) AS k FROM (SELECT example_id, slot, -1 AS seq, array_to_string(vals, ', ') AS value, 'S' AS type FROM refs UNION ALL SELECT example_id, slot, seq, value, type FROM errs)) WHERE k = 1 AND type <> 'D'",
}


def notes(spark, sf_dir):
    code, note = F.col("p_partkey") % 11, F.lit("")
    for k, text in ((4, "S:name=x y, S:name=z"), (3, "I:color=blue, bad part, D:large"), (2, "S:size=9, I:color=red"), (1, "D:brand")):
        note = F.when(code == k, text).otherwise(note)
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.col("p_type").alias("topic"), note.alias("note"))


def errors(spark, sf_dir):
    return an.parse_errors(notes(spark, sf_dir), ["example_id"], "note")


def gold(spark, sf_dir):
    sizes = fx.references(spark, sf_dir).groupBy("example_id").agg(F.count(F.lit(1)).alias("n_ref"))
    return an.gold_counts(notes(spark, sf_dir), errors(spark, sf_dir), sizes, ["example_id"])


@query("SELECT example_id, seq, type, slot, value FROM errs", **_NOTES)
def parse_error_notation(spark, sf_dir):
    return errors(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))


@query("SELECT example_id, slot, value FROM real", **_NOTES)
def apply_errors_to_mr(spark, sf_dir):
    return an.apply_errors(fx.references(spark, sf_dir), errors(spark, sf_dir), ["example_id"])


@query("SELECT example_id, s, d, i, ser FROM gold", **_NOTES)
def gold_ser(spark, sf_dir):
    return gold(spark, sf_dir).drop("n_ref")


_AGREE = {"bothm": "SELECT m.example_id, m.topic, m.cand_idx % 2 AS method, p.p_size % 5 AS style, CASE WHEN p.p_size % 2 = 0 THEN 'llm' ELSE 'seq2seq' END AS source, m.s AS ms, m.d AS md, m.i AS mi, m.ser AS mser, g.s, g.d, g.i, g.ser FROM sers m JOIN gold g USING (example_id) JOIN part p ON p.p_partkey = m.example_id WHERE cand_idx < 2"}


def _both(spark, sf_dir):
    m = core.counts(spark, sf_dir).where("cand_idx < 2").select("example_id", (F.col("cand_idx") % 2).cast("long").alias("method"), *[F.col(c).alias(f"m{c}") for c in ("s", "d", "i", "ser")])
    style = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), (F.col("p_size") % 5).alias("style"), F.when(F.col("p_size") % 2 == 0, "llm").otherwise("seq2seq").alias("source"))
    return m.join(gold(spark, sf_dir).hint("merge"), "example_id").join(style.hint("merge"), "example_id")


@query("SELECT method, source, style, count(*) AS n, round(avg(CAST(ms = s AS INT)), 6) AS s_acc, round(avg(CAST(md = d AS INT)), 6) AS d_acc, round(avg(CAST(mi = i AS INT)), 6) AS i_acc, round(avg(CAST(ms = s AND md = d AND mi = i AS INT)), 6) AS all_acc, round(avg(abs(mser - ser)), 6) AS ser_mae FROM bothm GROUP BY GROUPING SETS ((method), (method, source), (method, style))", **_NOTES, **_AGREE)
def gold_agreement(spark, sf_dir):
    same = [F.col(f"m{c}") == F.col(c) for c in "sdi"]
    mean = lambda x: F.round(F.avg(x.cast("double")), 6)
    aggs = [F.count(F.lit(1)).alias("n"), *[mean(x).alias(f"{c}_acc") for c, x in zip("sdi", same, strict=True)], mean(same[0] & same[1] & same[2]).alias("all_acc"), F.round(F.avg(F.abs(F.col("mser") - F.col("ser"))), 6).alias("ser_mae")]
    m, so, st = F.col("method"), F.col("source"), F.col("style")
    return _both(spark, sf_dir).groupingSets([[m], [m, so], [m, st]], m, so, st).agg(*aggs)


@query("SELECT method, type, count(*) AS n, round(avg(CAST(got = want AS INT)), 6) AS rate FROM (SELECT method, unnest(['S', 'D', 'I']) AS type, unnest([s, d, i]) AS want, unnest([ms, md, mi]) AS got FROM bothm) WHERE want > 0 GROUP BY ALL", **_NOTES, **_AGREE)
def error_type_detection(spark, sf_dir):
    one = lambda t, c: F.struct(F.lit(t).alias("type"), F.col(c).alias("want"), F.col(f"m{c}").alias("got"))
    rows = _both(spark, sf_dir).select("method", F.inline(F.array(one("S", "s"), one("D", "d"), one("I", "i")))).where("want > 0")
    return rows.groupBy("method", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("got") == F.col("want")).cast("double")), 6).alias("rate"))


@query("SELECT slot, cand_idx AS method, count(*) AS n, count(*) FILTER (WHERE kind = 'M') AS correct FROM kinds GROUP BY slot, cand_idx")
def slot_correctness(spark, sf_dir):
    """Each candidate is a method; of the slots that it or the reference has, those with equal values."""
    return core.joined(spark, sf_dir).groupBy("slot", F.col("cand_idx").cast("long").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "M").alias("correct"))


@query("SELECT p_partkey AS example_id, pos, slot, vpos, value FROM (SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest(['cuisine_type', 'traits', 'family_suitability']) AS slot, unnest([[p_brand], string_split(p_name, ' '), [CASE WHEN p_size > 25 THEN 'family-friendly' ELSE 'not-family-friendly' END]]) AS v FROM part), LATERAL (SELECT unnest(v) AS value, unnest(range(1, len(v) + 1)) AS vpos)")
def unpack_bracket_mr(spark, sf_dir):
    text = F.concat(F.lit("food["), "p_brand", F.lit("], traits["), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit("], familyFriendly["), F.when(F.col("p_size") > 25, "yes").otherwise("no"), F.lit("]"))
    return nm.restaurant_record(fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), text.alias("mr")), ["example_id"])


@query("SELECT p_partkey AS example_id, 'inform' AS act, unnest(['review_rating', 'pc_os_support', 'pc_os_support']) AS slot, CAST(unnest([1, 1, 2]) AS INT) AS vpos, unnest([p_brand, CASE WHEN p_size > 25 THEN 'Linux' ELSE 'not_released_on_Linux' END, CASE WHEN p_size > 25 THEN 'not_released_on_macOS' ELSE 'macOS' END]) AS value FROM part")
def unpack_act_bracket_mr(spark, sf_dir):
    flag = lambda name, on: F.concat(F.lit(f"], {name}["), F.when(on, "yes").otherwise("no"))
    text = F.concat(F.lit("inform(rating["), "p_brand", flag("has_linux_release", F.col("p_size") > 25), flag("has_mac_release", F.col("p_size") <= 25), F.lit("])"))
    return nm.game_record(fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), text.alias("mr")), ["example_id"]).select("example_id", "act", "slot", "vpos", "value")


@query("SELECT p_partkey AS example_id, 'inform' AS act, unnest(['hotel_price_range', 'hotel_has_internet', 'hotel_near']) AS slot, unnest([p_brand, CASE p_size % 3 WHEN 0 THEN 'has_internet' WHEN 1 THEN 'no_internet' ELSE 'dontcare' END, NULL]) AS value FROM part")
def unpack_act_assign_mr(spark, sf_dir):
    said = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("dont_care")), F.col("p_size") % 3 + 1)
    text = F.concat(F.lit("inform(pricerange='"), "p_brand", F.lit("';hasinternet="), said, F.lit(";near)"))
    rows = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.lit("hotel").alias("topic"), text.alias("mr"))
    return nm.act_record(rows, ["example_id"], "topic").drop("pos", "topic")


@query(
    """SELECT event_id, 'json' AS form, 0 AS pos, 'k' AS slot, 1 AS vpos, json_extract_string(props, '$.k') AS value, NULL AS error FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 'json', p, s, v, x, NULL FROM (SELECT event_id, unnest([0, 1, 1, 2]) AS p, unnest(['kind', 'tags', 'tags', 'none']) AS s, unnest([1, 1, 2, 1]) AS v, unnest([event_type, event_type, '[x', NULL]) AS x FROM events WHERE event_id % 5 = 1)
  UNION ALL SELECT event_id, 'text', p, s, v, x, NULL FROM (SELECT event_id, unnest([0, 1, 1]) AS p, unnest(['kind', 'user', 'user']) AS s, unnest([1, 1, 2]) AS v, unnest([event_type, CAST(user_id AS VARCHAR), 'x']) AS x FROM events WHERE event_id % 5 = 2)
  UNION ALL SELECT event_id, 'json', NULL, NULL, NULL, NULL, 'not a JSON object' FROM events WHERE event_id % 5 = 3
  UNION ALL SELECT event_id, 'rejected', NULL, NULL, NULL, NULL, 'neither a JSON object nor a record' FROM events WHERE event_id % 5 = 4"""
)
def parse_mr_auto(spark, sf_dir):
    """Events written in five ways, two of them wrong: the record of each row, or why it has none."""
    way, kind = F.col("event_id") % 5, F.col("event_type")
    text = (
        F.when(way == 0, F.concat(F.lit("  "), "props"))
        .when(way == 1, F.concat(F.lit('{"kind": "'), kind, F.lit('", "tags": ["'), kind, F.lit('", "[x"], "none": null}')))
        .when(way == 2, F.concat(F.lit("<LIST>(kind: "), kind, F.lit("); (user: "), F.col("user_id").cast("string"), F.lit("; x)</LIST>")))
        .when(way == 3, F.substr("props", F.lit(1), F.length("props") - 1))
        .otherwise(kind)
    )
    return ps.any_record(fx.read(spark, sf_dir, "events").select("event_id", text.alias("mr")), ["event_id"])


@query("SELECT p_partkey AS example_id, CASE p_size % 3 WHEN 0 THEN 'hm_viggo' WHEN 1 THEN concat('hm_rnnlg_', lower(p_type)) ELSE concat('hm_tm1_', lower(p_type)) END AS hint_map_id, CASE WHEN p_size % 2 = 0 THEN 'llm' ELSE 'seq2seq' END AS source FROM part")
def assign_hint_map_id(spark, sf_dir):
    corpus = F.element_at(F.array(F.lit("viggo"), F.lit("rnnlg"), F.lit("tm1")), F.col("p_size") % 3 + 1)
    source = F.when(F.col("p_size") % 2 == 0, "llm").otherwise("seq2seq")
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), nm.corpus_schema(corpus, F.lower("p_type")).alias("hint_map_id"), source.alias("source"))


@query("SELECT example_id, cand_idx, count(*) AS n_slots FROM preds GROUP BY ALL HAVING count(*) >= 5")
def min_slots_filter(spark, sf_dir):
    return fx.predictions(spark, sf_dir).groupBy("example_id", "cand_idx").agg(F.count(F.lit(1)).alias("n_slots")).where("n_slots >= 5")


@query("SELECT example_id, CASE slot WHEN 'brand' THEN 'manufacturer' WHEN 'size' THEN 'extent' ELSE slot END AS slot, CASE WHEN slot = 'large' AND value = 'yes' THEN 'is large' WHEN slot = 'large' AND value = 'no' THEN 'is not large' ELSE value END AS value, vpos FROM facts")
def translate_slots(spark, sf_dir):
    words = {("large", "yes"): "is large", ("large", "no"): "is not large"}
    slot, value = nm.translate(F.col("slot"), F.col("value"), {"brand": "manufacturer", "size": "extent"}, words)
    return fx.facts(spark, sf_dir).select("example_id", slot.alias("slot"), value.alias("value"), "vpos")


@query("SELECT example_id, t FROM (SELECT DISTINCT example_id, lower(regexp_replace(trim(concat(slot, '=', value)), '\\s+', ' ', 'g')) AS t FROM facts)")
def flatten_mr_tokens(spark, sf_dir):
    token = F.lower(F.regexp_replace(F.trim(F.concat("slot", F.lit("="), "value")), r"\s+", " "))
    return fx.facts(spark, sf_dir).select("example_id", token.alias("t")).distinct()


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def subset_filter(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


_TASKS = {"tasks": """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'llm' ELSE 'seq2seq' END AS source, concat('run', p_size % 3) AS experiment, concat('style', p_size % 5) AS style, mr, concat('The ', p_name, ' by ', p_brand, '.') AS text
  FROM part JOIN (SELECT example_id, string_agg(concat(slot, '[', array_to_string(vals, ', '), ']'), ', ' ORDER BY pos) AS mr FROM refs GROUP BY example_id) r ON r.example_id = p_partkey"""}


def _tasks(spark, sf_dir):
    record = fx.references(spark, sf_dir).groupBy("example_id").agg(F.collect_list(F.struct("pos", "slot", "vals")).alias("record"))
    name = lambda prefix, n: F.concat(F.lit(prefix), (F.col("p_size") % n).cast("string"))
    text = F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand", F.lit("."))
    part = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.when(F.col("p_size") % 2 == 0, "llm").otherwise("seq2seq").alias("source"), name("run", 3).alias("experiment"), name("style", 5).alias("style"), text.alias("text"))
    return part.join(record.hint("merge"), "example_id").select(F.col("example_id").alias("id"), "source", "experiment", "style", writers.readable_record().alias("mr"), "text")


@query("SELECT CAST(id AS VARCHAR) AS id, source, experiment, style, mr, text, NULL AS has_error, NULL AS error_details FROM tasks", **_TASKS)
def export_annotation_tasks(spark, sf_dir):
    """Worklists with tabs and empty answers, written and read back."""
    path = folder(spark)
    _tasks(spark, sf_dir).withColumns({"has_error": F.lit(""), "error_details": F.lit("")}).write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.option("header", True).option("sep", "\t").csv(path)


@query("SELECT id, concat('=== ID: ', id, ' ===', chr(10), 'Source: ', source, ' | Experiment: ', experiment, ' | Personality: ', style, chr(10), chr(10), 'MR: ', mr, chr(10), chr(10), 'Generated text:', chr(10), text, chr(10), chr(10), 'Has error (YES/NO): ______', chr(10), 'Error details: ______', chr(10), chr(10), '===', chr(10)) AS block FROM tasks", **_TASKS)
def export_annotation_blocks(spark, sf_dir):
    """The same worklists as blocks of text, written, read back as whole files and taken apart."""
    path = folder(spark)
    writers.worklist_text(_tasks(spark, sf_dir), path)
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)(?<=^===\n)\n")).alias("block")).where("block <> ''")
    return blocks.select(F.regexp_extract("block", r"^=== ID: (\d+) ===", 1).cast("long").alias("id"), "block")


@query("SELECT example_id, vpos, CASE WHEN w LIKE '%fe' THEN w[:-3] || 'ves' WHEN w LIKE '%f' THEN w[:-2] || 'ves' WHEN w LIKE '%o' THEN w || 'es' WHEN w LIKE '%us' THEN w[:-3] || 'i' WHEN w LIKE '%on' THEN w[:-3] || 'a' WHEN w LIKE '%y' THEN w[:-2] || 'ies' WHEN regexp_matches(w, '(s|x|sh|ch)$') THEN w || 'es' WHEN w LIKE '%an' THEN w[:-3] || 'en' ELSE w || 's' END AS plural FROM (SELECT example_id, vpos, lower(value) AS w FROM facts WHERE slot = 'traits')")
def plural_forms(spark, sf_dir):
    return fx.facts(spark, sf_dir).where("slot = 'traits'").select("example_id", "vpos", ps.plural(F.lower("value")).alias("plural"))


@query("SELECT conv_id, turn, CAST((length(text) * 7) % 300 AS DOUBLE) AS score, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM conversations WHERE role = 'assistant'")
def resumable_scoring(spark, sf_dir):
    """A first run scores every third conversation; the second is given all turns and scores, in batches, what is not there.

    A formula stands for the model. run says which run scored a turn.
    """
    turns = fx.read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    place, keys = folder(spark), ["conv_id", "turn"]
    score = lambda rows: rows.select(*keys, (F.length("text") * 7 % 300).cast("double").alias("score"))
    rs.score_resumable(turns.where("conv_id % 3 = 0"), keys, score, place)
    rs.score_resumable(turns, keys, score, place, batch_rows=-(-turns.count() // 3))
    kinds = ", ".join(f"{k} {turns.schema[k].dataType.simpleString()}" for k in keys)
    return rs.results(spark, place, f"{kinds}, score double").select(*keys, "score", F.col("run").cast("int").alias("run"))


_TYPES = {"sums": "SELECT unnest(['S', 'D', 'I', 'repetition']) AS kind, unnest([count(*) FILTER (WHERE kind = 'S'), count(*) FILTER (WHERE kind = 'D'), count(*) FILTER (WHERE kind = 'I'), count(*) FILTER (WHERE len(pred_vals) > len(ref_vals))]) AS n FROM kinds"}


@query("SELECT kind, n FROM sums WHERE n > 0", **_TYPES)
def streaming_error_tallies(spark, sf_dir):
    """Running counts of substitutions, deletions, insertions and repetitions over a stream of compared slots, to the end of what is there."""
    place = folder(spark)
    compared = core.joined(spark, sf_dir).select("kind", (F.size("pred_vals") > F.size("ref_vals")).alias("more"))
    compared.write.parquet(f"{place}/in")
    return tl.running_totals(tl.error_kinds(spark.readStream.schema(compared.schema).parquet(f"{place}/in")), "kind", place)


@query("SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 1.0::DOUBLE ELSE round(0.6 * (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 5) END AS k FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 50 = 0")
def cosine_pairs(spark, sf_dir):
    """Each query (b, ids divisible by 50) with all rows of its label, itself with 1; the text part of the kernel."""
    e = fx.read(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    e = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), norm.alias("norm"))
    a, b = e.select("label", F.col("vec_id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = a.join(b.hint("merge"), "label").where("a is not null")
    k = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(0.6 * (dot / (F.col("na") * F.col("nb")) + 1) / 2, 5))
    return both.select("a", "b", k.alias("k"))
