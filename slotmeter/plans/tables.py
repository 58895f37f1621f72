"""Queries of small table assemblies: records as JSON, pools, joins with defaults, picks and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotmeter.operators import annotations as an
from slotmeter.operators import gaps as gp
from slotmeter.operators import naming as nm
from slotmeter.operators import sampling as sm
from slotmeter.operators import selection as sel
from slotmeter.operators import slots
from slotmeter.operators import units as un
from slotmeter.operators import verify as v
from slotmeter.plans import building, core, notation, protocols, routing
from slotmeter.plans import fixtures as fx
from slotmeter.plans.registering import registry
from slotmeter.sources import readers, writers

QUERIES, ORACLES, query = registry()


@query("SELECT example_id, slot, value, slot = 'traits' AS is_list FROM facts")
def read_examples(spark, sf_dir):
    """Records as JSON objects with scalar and list values, read back to facts."""
    raw = F.when(F.col("is_list"), F.to_json("vals")).otherwise(F.concat(F.lit('"'), F.element_at("vals", 1), F.lit('"')))
    entry = F.concat(F.lit('"'), "slot", F.lit('": '), raw)
    rows = fx.references(spark, sf_dir).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("t")))).alias("e"))
    rows = rows.select("example_id", F.concat(F.lit("{"), F.array_join("e.t", ", "), F.lit("}")).alias("mr"))
    return readers.example_facts(rows, ["example_id"])


@query("SELECT topic, CAST(sum(s + d + i) AS BIGINT) AS errors, round(CAST(sum(s + d + i) AS DOUBLE) / greatest(sum(n_ref), 1), 6) AS slot_ser, round(avg(CAST(s + d + i > 0 AS INT)), 6) AS utterance_ser FROM sers GROUP BY topic")
def slot_utterance_ser(spark, sf_dir):
    wrong = F.col("s") + F.col("d") + F.col("i")
    out = core.counts(spark, sf_dir).groupBy("topic").agg(F.sum(wrong).alias("errors"), F.sum("n_ref").alias("n"), F.round(F.avg((wrong > 0).cast("double")), 6).alias("utterance_ser"))
    return out.select("topic", "errors", F.round(F.col("errors").cast("double") / F.greatest("n", F.lit(1)), 6).alias("slot_ser"), "utterance_ser")


@query(
    r"SELECT f.example_id, f.slot, f.vpos, len(regexp_extract_all(s.text, concat('\b', regexp_escape(lower(f.value)), '\b'))) > 1 AND n = 1 AS duplicate FROM (SELECT *, count(*) OVER (PARTITION BY example_id, value) AS n FROM facts) f JOIN surf s USING (example_id)",
    **building._SURFACE,
)
def duplicate_mentions(spark, sf_dir):
    from pyspark.sql import Window

    shared = F.count(F.lit(1)).over(Window.partitionBy("example_id", "value"))
    both = fx.facts(spark, sf_dir).withColumn("n", shared).join(building._surface(spark, sf_dir).hint("merge"), "example_id")
    found = F.regexp_count("text", F.concat(F.lit(r"\b\Q"), F.lower("value"), F.lit(r"\E\b")))
    return both.select("example_id", "slot", "vpos", ((found > 1) & (F.col("n") == 1)).alias("duplicate"))


@query("SELECT topic, cand_idx, acc FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY acc DESC, cand_idx) AS k FROM (SELECT topic, cand_idx, round(avg(CAST(s + d + i = 0 AS INT)), 6) AS acc FROM sers GROUP BY topic, cand_idx)) WHERE k = 1")
def argmax_first(spark, sf_dir):
    acc = core.counts(spark, sf_dir).groupBy("topic", "cand_idx").agg(F.round(F.avg((F.col("s") + F.col("d") + F.col("i") == 0).cast("double")), 6).alias("acc"))
    return v.first_best(acc, ["topic"], "acc", "cand_idx")


@query("SELECT example_id, topic, pool FROM (SELECT p_partkey AS example_id, p_type AS topic, CASE WHEN k <= 8 THEN 'train' WHEN k <= 12 THEN 'dev' WHEN k <= 44 THEN 'train_prompts' WHEN k <= 60 THEN 'dev_prompts' WHEN k <= 65 THEN 'inference' END AS pool FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat('pool|', p_partkey)), p_partkey) AS k FROM part)) WHERE pool IS NOT NULL")
def select_pool(spark, sf_dir):
    """Eight train and four dev examples of each topic, four times as many prompts, five for inference; none twice."""
    part = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.col("p_type").alias("topic"))
    return sel.draw_pools(part, "topic", "example_id", sel.pool_sizes(8, 4), "pool")


@query("SELECT p_partkey AS example_id, CAST(p_size % 5 = 0 AS DOUBLE) AS style_0, CAST(p_size % 5 = 1 AS DOUBLE) AS style_1, CAST(p_size % 5 = 2 AS DOUBLE) AS style_2, CAST(p_size % 5 = 3 AS DOUBLE) AS style_3, CAST(p_size % 5 = 4 AS DOUBLE) AS style_4, CAST(p_partkey % 2 = 0 AS DOUBLE) AS source_llm, CAST(p_partkey % 2 <> 0 AS DOUBLE) AS source_seq2seq FROM part")
def style_features(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part")
    source = F.when(F.col("p_partkey") % 2 == 0, "llm").otherwise("seq2seq")
    styles, sources = nm.one_hot((F.col("p_size") % 5).cast("string"), list("01234"), "style"), nm.one_hot(source, ["llm", "seq2seq"], "source")
    return p.select(F.col("p_partkey").alias("example_id"), *styles, *sources)


@query("SELECT slot, count(DISTINCT value) AS n_all, count(DISTINCT CASE WHEN example_id % 10 = 0 THEN value END) AS n_covered FROM facts GROUP BY slot")
def token_coverage(spark, sf_dir):
    chosen = F.when(F.col("example_id") % 10 == 0, F.col("value"))
    each = fx.facts(spark, sf_dir).groupBy("slot", "value").agg(F.max(chosen.isNotNull()).alias("hit"))
    return each.groupBy("slot").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("hit").alias("n_covered"))


@query("SELECT DISTINCT topic, mr FROM (SELECT topic, string_agg(concat('(', slot, ': ', array_to_string(vals, '; '), ')'), '; ' ORDER BY pos) AS mr FROM refs GROUP BY example_id, topic UNION ALL SELECT topic, string_agg(concat('(', slot, ': ', array_to_string(vals, '; '), ')'), '; ' ORDER BY pos) FROM preds GROUP BY example_id, topic, cand_idx)")
def pool_mr_build(spark, sf_dir):
    a = slots.write_record(fx.references(spark, sf_dir), ["example_id", "topic"]).select("topic", "mr")
    b = slots.write_record(fx.predictions(spark, sf_dir), core.KEYS).select("topic", "mr")
    return a.unionByName(b).distinct()


@query("SELECT p_partkey AS example_id, coalesce(n, 0) AS n_errors, coalesce(n, 0) > 0 AS has_error FROM part LEFT JOIN (SELECT example_id, count(*) AS n FROM errs GROUP BY example_id) e ON e.example_id = p_partkey", **notation._NOTES)
def annotation_left_join(spark, sf_dir):
    n = an.parse_errors(notation.notes(spark, sf_dir), ["example_id"], "note").groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0))
    return notation.notes(spark, sf_dir).join(n.hint("merge"), "example_id", "left").select("example_id", count.alias("n_errors"), (count > 0).alias("has_error"))


#: Domain names that stand for schemas.
ALIASES = {"STANDARD BRASS": "hm_brass", "SMALL TIN": "hm_tin"}


@query("SELECT p_partkey AS example_id, CASE p_type WHEN 'STANDARD BRASS' THEN 'hm_brass' WHEN 'SMALL TIN' THEN 'hm_tin' ELSE CASE WHEN starts_with(p_type, 'hm_') THEN p_type ELSE concat('hm_', p_type) END END AS hint_map_id FROM part")
def resolve_domain(spark, sf_dir):
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), nm.schema_id(F.col("p_type"), {**nm.SCHEMAS, **ALIASES}).alias("hint_map_id"))


@query("SELECT example_id, CASE slot WHEN 'brand' THEN 'manufacturer' ELSE slot END AS slot, CASE WHEN slot = 'large' AND vals[1] = 'yes' THEN 'is large' ELSE vals[1] END AS value FROM preds JOIN best USING (example_id, cand_idx)")
def best_mr_native_first(spark, sf_dir):
    best = v.best_candidate(fx.scores(spark, sf_dir), ["example_id"]).select("example_id", "cand_idx")
    rows = fx.predictions(spark, sf_dir).join(best.hint("merge"), ["example_id", "cand_idx"]).select("example_id", "slot", "vals")
    return nm.native_first(rows, {"brand": "manufacturer"}, {("large", "yes"): "is large"})


@query(
    """SELECT example_id, "start", "end", text FROM (SELECT *, row_number() OVER (PARTITION BY example_id, "end" ORDER BY length(text), "start", "end", text) AS k FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, "start" ORDER BY length(text), "start", "end", text) AS j FROM spans) WHERE j = 1)) WHERE k = 1""",
    spans="SELECT example_id, pos % 3 AS \"start\", pos % 3 + vpos AS \"end\", value AS text FROM facts",
)
def span_dedupe(spark, sf_dir):
    spans = fx.facts(spark, sf_dir).select("example_id", (F.col("pos") % 3).alias("start"), (F.col("pos") % 3 + F.col("vpos")).alias("end"), F.col("value").alias("text"))
    return an.spans_shortest(spans, ["example_id"])


@query("SELECT p_partkey AS example_id, lower(concat('The ', p_name, ' by ', p_brand)) AS surface_form, p_brand AS manufacturer, p_size % 5 AS style FROM part")
def preprocess_style_examples(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part")
    text = F.lower(F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand"))
    return p.select(F.col("p_partkey").alias("example_id"), text.alias("surface_form"), F.col("p_brand").alias("manufacturer"), (F.col("p_size") % 5).alias("style"))


_COLUMNS = ["top_score", "score_gap", "score_spread", "n_gold_slots", "n_lora_slots", "slot_ratio", "mean_nli_prob", "min_nli_prob", "nli_coverage"]


@query("SELECT CAST(example_id AS VARCHAR) AS example_id, CAST(unit AS VARCHAR) AS neg_id, CAST(label AS VARCHAR) AS label, CAST(lora_count AS VARCHAR) AS lora_correct, CAST(nli_count AS VARCHAR) AS nli_correct, " + ", ".join(f"printf('%.6f', {c}) AS {c}" for c in _COLUMNS) + " FROM ufeats JOIN ulabels USING (protocol, example_id, unit) WHERE protocol = 'pair'", **protocols._UNITS)
def write_feature_table(spark, sf_dir):
    """The features and labels of all pairs as a table with tabs and six digits, in key order, read back."""
    features, agreed = protocols.unit_tables(spark, sf_dir)
    rows = features.join(un.labels(agreed).hint("merge"), un.UNIT).where("protocol = 'pair'")
    path = building.folder(spark)
    writers.feature_tsv(rows.select("example_id", F.col("unit").alias("neg_id"), "label", F.col("lora_count").alias("lora_correct"), F.col("nli_count").alias("nli_correct"), *_COLUMNS), path, ["example_id", "neg_id"])
    return spark.read.option("header", True).option("sep", "\t").csv(path)


#: A published table to compare with, by topic.
PUBLISHED = {"STANDARD BRASS": 0.5, "SMALL TIN": 0.25}


@query("SELECT topic, basis, acc, round(abs(acc - CASE topic WHEN 'STANDARD BRASS' THEN 0.5 WHEN 'SMALL TIN' THEN 0.25 END), 6)::DOUBLE AS delta FROM (SELECT topic, 'full' AS basis, round(avg(CAST(s + d + i = 0 AS INT)), 6) AS acc FROM sers GROUP BY topic UNION ALL SELECT topic, 'first' AS basis, round(avg(CAST(s + d + i = 0 AS INT)), 6) AS acc FROM sers WHERE cand_idx = 0 GROUP BY topic)")
def table_assembly(spark, sf_dir):
    rows = core.counts(spark, sf_dir).withColumn("ok", (F.col("s") + F.col("d") + F.col("i") == 0).cast("double"))
    acc = lambda df, basis: df.groupBy("topic").agg(F.round(F.avg("ok"), 6).alias("acc")).withColumn("basis", F.lit(basis))
    both = acc(rows, "full").unionByName(acc(rows.where("cand_idx = 0"), "first"))
    known = F.create_map(*[F.lit(x) for pair in PUBLISHED.items() for x in pair])
    return both.select("topic", "basis", "acc", F.round(F.abs(F.col("acc") - F.try_element_at(known, F.col("topic"))), 6).alias("delta"))


@query("SELECT example_id, round(coalesce(avg(entailed), 0.5), 6) AS mean_entailed, coalesce(min(entailed), 0.5)::DOUBLE AS min_entailed, round(coalesce(avg(sim), 0.5), 6) AS mean_sim, round(coalesce(min(sim), 0.5), 6) AS min_sim, count(*) FILTER (WHERE sim > 0.85) AS n_alike, count(*) FILTER (WHERE entailed > 0.5) AS n_confirmed FROM gaps WHERE cand_idx = 0 GROUP BY example_id", **building._GAPS)
def expanded_features(spark, sf_dir):
    out = gp.gap_features(building.gaps(spark, sf_dir).where("cand_idx = 0"), ["example_id"])
    return out.select("example_id", *[F.round(c, 6).alias(c) for c in ("mean_entailed", "min_entailed", "mean_sim", "min_sim")], "n_alike", "n_confirmed")
