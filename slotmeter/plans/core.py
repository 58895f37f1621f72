"""Queries of the metric core: records, values, slot join, error rates, F1."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotmeter.functions import values
from slotmeter.operators import slots
from slotmeter.plans import fixtures as fx
from slotmeter.plans.registering import registry

QUERIES, ORACLES, query = registry()
KEYS = ["example_id", "topic", "cand_idx"]


@query("SELECT example_id, pos, slot, vpos, value FROM facts")
def mr_flatten(spark, sf_dir):
    return slots.flatten(fx.references(spark, sf_dir), ["example_id"])


@query("SELECT example_id, slot, vpos, value FROM (SELECT *, row_number() OVER (PARTITION BY example_id, value ORDER BY pos, vpos) AS k FROM facts) WHERE k = 1")
def mr_global_value_dedup(spark, sf_dir):
    return slots.dedup_values(fx.facts(spark, sf_dir), ["example_id"]).select("example_id", "slot", "vpos", "value")


@query("SELECT example_id, cand_idx, string_agg(concat('(', slot, ': ', array_to_string(vals, '; '), ')'), '; ' ORDER BY pos) AS mr FROM preds GROUP BY ALL")
def build_mr_string(spark, sf_dir):
    return slots.write_record(fx.predictions(spark, sf_dir), ["example_id", "cand_idx"])


@query("SELECT example_id, cand_idx, slot, CAST(row_number() OVER (PARTITION BY example_id, cand_idx, slot ORDER BY pos, vpos) AS INT) AS vpos, CASE WHEN value LIKE '%)' THEN value[:-2] ELSE value END AS value FROM cands")
def parse_mr_string(spark, sf_dir):
    keys = ["example_id", "cand_idx"]
    return slots.parse_record(slots.write_record(fx.predictions(spark, sf_dir), keys), keys).drop("pos")


@query("SELECT example_id, cand_idx, slot, array_to_string(items, '|') AS items, multi FROM preds")
def canon_value(spark, sf_dir):
    return fx.predictions(spark, sf_dir).select("example_id", "cand_idx", "slot", F.array_join("canon.items", "|").alias("items"), "canon.multi")


@query(
    """SELECT example_id, cand_idx, slot, vpos, CASE WHEN s IN ('yes','y','true','1') THEN 'yes' WHEN s IN ('no','n','false','0') THEN 'no' ELSE trim(s, ' ;,.') END AS value
  FROM (SELECT *, lower(trim(trim(trim(value), '"'), '''')) AS s FROM cands)"""
)
def canon_value_loose(spark, sf_dir):
    return fx.candidates(spark, sf_dir).select("example_id", "cand_idx", "slot", "vpos", values.canon_scalar_loose(F.col("value")).alias("value"))


@query(f"SELECT p.example_id, p.cand_idx, p.slot, {fx.equal_sql('p', 'r')} AS same FROM preds p JOIN refs r ON p.example_id = r.example_id AND p.slot = r.slot")
def value_equal(spark, sf_dir):
    p, r = fx.predictions(spark, sf_dir), fx.references(spark, sf_dir).select("example_id", "slot", F.col("canon").alias("other"))
    return p.join(r.hint("merge"), ["example_id", "slot"]).select("example_id", "cand_idx", "slot", values.value_equal(F.col("canon"), F.col("other")).alias("same"))


@query("""SELECT doc_id, trim(split_part(split_part(concat('Q### Response:', chr(10), text), concat('### Response:', chr(10)), 2), '</LIST>', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS answer
  FROM (SELECT doc_id, split_part(split_part(concat(text, '</LIST> tail'), '</LIST>', 1), chr(10) || chr(10) || '###', 1) AS text FROM documents)""")
def extract_response(spark, sf_dir):
    raw = fx.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Q### Response:\n"), "text", F.lit("</LIST> tail")).alias("raw"))
    t, marker = F.col("raw"), "### Response:\n"
    t = F.when(F.instr(t, marker) > 0, F.substr(t, F.instr(t, marker) + len(marker))).otherwise(t)
    for stop in ("</LIST>", "\n\n###"):
        t = F.substring_index(t, stop, 1)
    return raw.select("doc_id", values.strip(t).alias("answer"))


def _wanted(spark, sf_dir):
    return fx.references(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cand_idx"))


def joined(spark, sf_dir):
    return slots.slot_join(fx.predictions(spark, sf_dir), _wanted(spark, sf_dir), KEYS)


def counts(spark, sf_dir):
    return slots.error_counts(fx.scores(spark, sf_dir), joined(spark, sf_dir), KEYS)


@query("SELECT example_id, cand_idx, slot, kind FROM kinds")
def slot_outer_join(spark, sf_dir):
    return joined(spark, sf_dir).select("example_id", "cand_idx", "slot", "kind")


@query("SELECT example_id, cand_idx, s, d, i, n_ref, ser, errors FROM sers LEFT JOIN (SELECT example_id, cand_idx, string_agg(concat(kind, ':', slot), ',' ORDER BY kind, slot) AS errors FROM kinds WHERE kind <> 'M' GROUP BY ALL) USING (example_id, cand_idx)")
def ser_counts(spark, sf_dir):
    both = joined(spark, sf_dir)
    named = both.where("kind <> 'M'").groupBy("example_id", "cand_idx").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(":"), "slot"))), ",").alias("errors"))
    counted = slots.error_counts(fx.scores(spark, sf_dir), both, KEYS)
    return counted.join(named.hint("merge"), ["example_id", "cand_idx"], "left").select("example_id", "cand_idx", "s", "d", "i", "n_ref", "ser", "errors")


@query("SELECT example_id, cand_idx, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, f1 FROM prf")
def slot_prf(spark, sf_dir):
    return slots.slot_f1(counts(spark, sf_dir), KEYS).drop("topic")


@query(
    """SELECT coalesce(topic, '*') AS topic, count(*) AS n, CAST(sum(s + d + i) AS BIGINT) AS errors, CAST(sum(n_ref) AS BIGINT) AS n_ref, round(CAST(sum(s + d + i) AS DOUBLE) / greatest(sum(n_ref), 1), 6) AS ser,
  round(2.0 * sum(m) / greatest(2 * sum(m) + sum(2 * s + d + i), 1), 6) AS f1 FROM sers WHERE cand_idx = 0 GROUP BY GROUPING SETS ((), (topic))"""
)
def micro_scores(spark, sf_dir):
    rows = counts(spark, sf_dir).where("cand_idx = 0")
    total = [F.count(F.lit(1)).alias("n"), F.sum(F.col("s") + F.col("d") + F.col("i")).alias("errors"), F.sum("n_ref").alias("n_ref"), F.sum("m").alias("m"), F.sum(2 * F.col("s") + F.col("d") + F.col("i")).alias("wrong")]
    out = rows.groupingSets([[], [F.col("topic")]], F.col("topic")).agg(*total)
    ser = F.round(F.col("errors").cast("double") / F.greatest("n_ref", F.lit(1)), 6)
    f1 = F.round(2.0 * F.col("m") / F.greatest(2 * F.col("m") + F.col("wrong"), F.lit(1)), 6)
    return out.select(F.coalesce("topic", F.lit("*")).alias("topic"), "n", "errors", "n_ref", ser.alias("ser"), f1.alias("f1"))


@query("SELECT sers.topic, count(*) AS n, round(avg(ser), 6) AS mean_ser, round(avg(f1), 6) AS mean_f1 FROM sers JOIN prf USING (example_id, cand_idx) GROUP BY sers.topic")
def batch_means(spark, sf_dir):
    counted = counts(spark, sf_dir)
    both = slots.slot_f1(counted.withColumn("keep", F.col("ser")), [*KEYS, "keep"])
    return both.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("keep"), 6).alias("mean_ser"), F.round(F.avg("f1"), 6).alias("mean_f1"))


@query(
    """SELECT slot, tp, fp, fn, round(coalesce(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END, 0), 4) AS precision, round(coalesce(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END, 0), 4) AS recall,
  round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 0), 4) AS f1
  FROM (SELECT slot, count(*) FILTER (WHERE kind = 'M') AS tp, count(*) FILTER (WHERE kind IN ('S', 'I')) AS fp, count(*) FILTER (WHERE kind IN ('S', 'D')) AS fn FROM kinds GROUP BY slot)"""
)
def attribute_scores(spark, sf_dir):
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    out = joined(spark, sf_dir).groupBy("slot").agg(n("M").alias("tp"), n("S", "I").alias("fp"), n("S", "D").alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


@query(
    """SELECT kind, slot, what, count(*) AS n FROM (SELECT kind, slot, CASE WHEN kind = 'S' THEN concat(slot, '::', array_to_string(pred_vals, ','), '→', array_to_string(ref_vals, ',')) END AS what FROM kinds) GROUP BY ALL"""
)
def attribute_error_counts(spark, sf_dir):
    what = F.when(F.col("kind") == "S", F.concat("slot", F.lit("::"), F.array_join("pred_vals", ","), F.lit("→"), F.array_join("ref_vals", ",")))
    return joined(spark, sf_dir).groupBy("kind", "slot", what.alias("what")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, example_id, cand_idx, slot, k FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY example_id, cand_idx, slot) AS k FROM kinds WHERE kind <> 'M') WHERE k <= 5")
def failure_samples(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy("example_id", "cand_idx", "slot")
    return joined(spark, sf_dir).where("kind <> 'M'").withColumn("k", F.row_number().over(w)).where("k <= 5").select("kind", "example_id", "cand_idx", "slot", "k")


@query("SELECT coalesce(topic, '*') AS topic, count(*) AS n, count(*) FILTER (WHERE m > 0 AND s + d + i = 0) AS perfect, round(100.0 * count(*) FILTER (WHERE m > 0 AND s + d + i = 0) / count(*), 4) AS percent FROM sers GROUP BY GROUPING SETS ((), (topic))")
def perfect_rate(spark, sf_dir):
    good = (F.col("m") > 0) & (F.col("s") + F.col("d") + F.col("i") == 0)
    out = counts(spark, sf_dir).groupingSets([[], [F.col("topic")]], F.col("topic")).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("perfect"))
    return out.select(F.coalesce("topic", F.lit("*")).alias("topic"), "n", "perfect", F.round(100.0 * F.col("perfect") / F.col("n"), 4).alias("percent"))


@query("SELECT example_id, cand_idx, count(*) FILTER (WHERE kind IN ('M', 'S')) AS tp, count(*) FILTER (WHERE kind = 'I') AS fp, count(*) FILTER (WHERE kind = 'D') AS fn FROM kinds GROUP BY ALL")
def slot_presence_overlap(spark, sf_dir):
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return joined(spark, sf_dir).groupBy("example_id", "cand_idx").agg(n("M", "S").alias("tp"), n("I").alias("fp"), n("D").alias("fn"))


@query(
    """SELECT s.example_id, s.cand_idx, CASE WHEN 1 - ser >= 0.9 THEN 4 WHEN 1 - ser >= 0.75 THEN 3 WHEN 1 - ser >= 0.5 THEN 2 WHEN 1 - ser >= 0.25 THEN 1 ELSE 0 END AS ser_grade,
  CASE WHEN f1 >= 0.9 THEN 6 WHEN f1 >= 0.8 THEN 5 WHEN f1 >= 0.7 THEN 4 WHEN f1 >= 0.6 THEN 3 WHEN f1 >= 0.5 THEN 2 WHEN f1 >= 0.25 THEN 1 ELSE 0 END AS f1_grade FROM sers s JOIN prf USING (example_id, cand_idx)"""
)
def grade_bins(spark, sf_dir):
    both = slots.slot_f1(counts(spark, sf_dir).withColumn("keep", F.col("ser")), [*KEYS, "keep"])
    return both.select("example_id", "cand_idx", values.grade_ser(F.col("keep")).alias("ser_grade"), values.grade_f1(F.col("f1")).alias("f1_grade"))


@query(
    """SELECT example_id, round((w[5] + 2 * w[6] + 3 * w[7]) / t, 6) AS score, round((w[2] + 2 * w[3] + 3 * w[4] + 4 * w[5] + 5 * w[6] + 6 * w[7]) / t, 6) AS expected
  FROM (SELECT example_id, w, CAST(list_sum(w) AS DOUBLE) AS t FROM (SELECT p_partkey AS example_id, list_transform(range(7), lambda d: (p_partkey + 3 * d) % 7 + 1) AS w FROM part))"""
)
def rubric_score(spark, sf_dir):
    weight = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: ((F.col("p_partkey") + 3 * d) % 7 + 1).cast("double"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    dist = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), weight.alias("w")).select("example_id", "w", total.alias("t"))
    p = F.transform("w", lambda x: x / F.col("t"))
    return dist.select("example_id", F.round(values.rubric_score(p), 6).alias("score"), F.round(values.rubric_expectation(p), 6).alias("expected"))


def _legacy(spark, sf_dir):
    """Reference values beside the predicted values of their slot."""
    p = fx.predictions(spark, sf_dir).select("example_id", "cand_idx", "slot", F.col("vals").alias("pred_vals"))
    r = _wanted(spark, sf_dir).select("example_id", "cand_idx", "slot", F.col("vals").alias("ref_vals"))
    return r.join(p.hint("merge"), ["example_id", "cand_idx", "slot"], "left")


#: The punctuation that is taken off the edges of reference values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _affix(value, pred_vals):
    return F.exists(pred_vals, lambda p: F.startswith(p, value) | F.startswith(value, p) | F.endswith(p, value) | F.endswith(value, p))


_SQL_EDGE = "trim(v, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')"
_SQL_AFFIX = "len(list_filter(pred_vals, lambda p: starts_with(p, val) OR starts_with(val, p) OR suffix(p, val) OR suffix(val, p))) > 0"
_LEGACY = {"leg": "SELECT r.example_id, r.cand_idx, r.slot, r.vals AS ref_vals, p.vals AS pred_vals FROM wanted r LEFT JOIN preds p ON p.example_id = r.example_id AND p.cand_idx = r.cand_idx AND p.slot = r.slot", "legv": f"SELECT *, {_SQL_EDGE} AS val FROM (SELECT *, unnest(ref_vals) AS v FROM leg)"}


@query("SELECT p.slot, count(*) AS n FROM preds p WHERE p.slot IN ('extra', 'name') AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.example_id = p.example_id AND r.slot = p.slot) GROUP BY p.slot")
def legacy_hallucination(spark, sf_dir):
    wanted = fx.predictions(spark, sf_dir).where(F.col("slot").isin("extra", "name"))
    return wanted.join(fx.references(spark, sf_dir).hint("merge"), ["example_id", "slot"], "left_anti").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT slot, sum(n)::BIGINT AS n FROM (SELECT slot, count(*) AS n FROM leg WHERE pred_vals IS NULL GROUP BY slot UNION ALL SELECT slot, count(*) AS n FROM legv WHERE pred_vals IS NOT NULL AND NOT ({_SQL_AFFIX}) GROUP BY slot) GROUP BY slot", **_LEGACY)
def legacy_deletion(spark, sf_dir):
    rows = _legacy(spark, sf_dir)
    wrong = F.size(F.filter(F.transform("ref_vals", lambda v: F.btrim(v, F.lit(PUNCTUATION))), lambda v: ~_affix(v, F.col("pred_vals"))))
    n = F.when(F.col("pred_vals").isNull(), 1).otherwise(wrong)
    return rows.groupBy("slot").agg(F.sum(n).alias("n")).where("n > 0")


@query(f"SELECT slot, count(*) AS n, sum(len(pred_vals))::BIGINT AS n_values FROM legv WHERE pred_vals IS NOT NULL AND NOT ({_SQL_AFFIX}) GROUP BY slot", **_LEGACY)
def legacy_substitution(spark, sf_dir):
    rows = _legacy(spark, sf_dir).where("pred_vals is not null")
    wrong = F.size(F.filter(F.transform("ref_vals", lambda v: F.btrim(v, F.lit(PUNCTUATION))), lambda v: ~_affix(v, F.col("pred_vals"))))
    return rows.withColumn("w", wrong).where("w > 0").groupBy("slot").agg(F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * F.size("pred_vals")).alias("n_values"))


@query("SELECT slot, count(*) AS n FROM leg WHERE len(pred_vals) > len(ref_vals) GROUP BY slot", **_LEGACY)
def legacy_repetition(spark, sf_dir):
    return _legacy(spark, sf_dir).where(F.size("pred_vals") > F.size("ref_vals")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
