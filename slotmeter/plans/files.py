"""Queries of readers and writers: tables written in each form and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.plans import core, notation, routing
from slotmeter.plans import fixtures as fx
from slotmeter.plans import routing
from slotmeter.plans.registering import registry
from slotmeter.sources.work import folder, written
from slotmeter.sources import readers, writers

QUERIES, ORACLES, query = registry()


def _documents(rows: DataFrame) -> str:
    """One file for each row's JSON text, as these forms have one root a file."""
    path = folder(rows.sparkSession)
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT concat('hm_', p_type) AS hint_map_id, slot, description FROM (SELECT DISTINCT p_type, unnest(['brand', 'size']) AS slot, unnest(['new maker', concat('extent of ', p_type)]) AS description FROM part)")
def read_hint_maps(spark, sf_dir):
    """Two sets of schema files of the topics; the later one wins."""
    topics = fx.read(spark, sf_dir, "part").select(F.col("p_type").alias("t")).distinct()

    def files(brand: str) -> str:
        slots = F.create_map(F.lit("brand"), F.lit(brand), F.lit("size"), F.concat(F.lit("extent of "), "t"))
        one = F.struct(F.concat(F.lit("hm_"), "t").alias("hint_map_id"), slots.alias("hint_map"))
        return _documents(topics.select(F.to_json(F.create_map(F.col("t"), one))))

    return readers.hint_maps(spark, [files("old maker"), files("new maker")])


_PART = "CASE p_size % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END"


@query(f"SELECT p_name AS surface_form, p_type AS topic, concat('b', p_size % 6) AS file, part FROM part p, LATERAL (SELECT {_PART} AS part UNION ALL SELECT 'prompt' AS part WHERE p_size % 6 = 5)")
def read_manifest(spark, sf_dir):
    """Examples in six files, three parts and one that shares a file, read in one scan and tagged by the manifest."""
    place = folder(spark)
    mr = F.to_json(F.struct(F.lit("inform").alias("dact"), F.create_map(F.lit("brand"), F.array("p_brand")).alias("slots")))
    part = fx.read(spark, sf_dir, "part").select(F.concat(F.lit("b"), (F.col("p_size") % 6).cast("string")).alias("f"), F.struct(F.col("p_name").alias("surface_form"), mr.alias("mr"), F.col("p_type").alias("topic")).alias("e"))
    lists = part.groupBy("f", F.pmod(F.xxhash64("e.surface_form", "e.mr"), F.lit(64))).agg(F.to_json(F.collect_list("e")).alias("value"))
    lists.select("f", "value").write.partitionBy("f").option("maxRecordsPerFile", 1).text(f"{place}/files")
    files = {"train": ["b0", "b3"], "dev": ["b1", "b4"], "test": ["b2", "b5"], "prompt": ["b5"]}
    rows = spark.createDataFrame([(json.dumps({k: [f"f={x}" for x in v] for k, v in files.items()}),)], "value string")
    found = readers.tagged_examples(spark, _documents(rows), f"{place}/files")
    return found.select("surface_form", "topic", F.replace("file", F.lit("f="), F.lit("")).alias("file"), "part")


@query("SELECT example_id, neg_id, CAST(row_number() OVER (PARTITION BY example_id, neg_id ORDER BY pos, vpos) - 1 AS INT) AS idx, slot, value, prob FROM probs")
def read_keyed_entailment(spark, sf_dir):
    """Entailment results of every pair, written as files of records and read back."""
    triple = F.array("slot", "value", F.col("prob").cast("string"))
    per = routing.probs(spark, sf_dir).groupBy("example_id", "neg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vpos", triple.alias("t")))).alias("r"))
    one = F.struct(F.col("example_id").alias("ex_idx"), F.col("neg_id").alias("neg_idx"), F.col("r.t").alias("results"))
    parts = per.groupBy(F.pmod(F.xxhash64("example_id"), F.lit(64))).agg(F.collect_list(one).alias("records"))
    return readers.keyed_entailment(spark, _documents(parts.select(F.to_json(F.struct("records")))))


@query("SELECT concat('name[', p_name, '], brand[', p_brand, ']') AS mr, concat('It says \"', p_name, '\", twice') AS ref FROM part")
def read_corpus_csv(spark, sf_dir):
    path = folder(spark)
    mr = F.concat(F.lit("name["), "p_name", F.lit("], brand["), "p_brand", F.lit("]"))
    ref = F.concat(F.lit('It says "'), "p_name", F.lit('", twice'))
    fx.read(spark, sf_dir, "part").select(mr.alias("mr"), ref.alias("ref")).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return readers.corpus_csv(spark, path, sep=";")


@query("SELECT example_id, CAST(0 AS INT) AS neg_id, cand_idx AS idx, score FROM scored")
def read_keyed_records(spark, sf_dir):
    scores = fx.scores(spark, sf_dir).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("cand_idx", "score"))).alias("s"))
    one = F.struct(F.col("example_id").alias("ex_idx"), F.lit(0).alias("neg_idx"), F.col("s.score").alias("pred_scores"))
    # a file of records for each part of the ids
    parts = scores.groupBy(F.pmod(F.xxhash64("example_id"), F.lit(64))).agg(F.collect_list(one).alias("records"))
    return readers.keyed_scores(spark, _documents(parts.select(F.to_json(F.struct("records"))))).withColumn("idx", F.col("idx").cast("long"))


@query("SELECT CAST(example_id AS VARCHAR) AS id, CASE WHEN note = '' THEN 'no' ELSE 'yes' END AS has_error, note AS error_details FROM notes", **notation._NOTES)
def read_annotations(spark, sf_dir):
    path = folder(spark)
    rows = notation.notes(spark, sf_dir).select(F.col("example_id").cast("string").alias("id"), F.when(F.col("note") == "", "no").otherwise("yes").alias("has_error"), F.col("note").alias("error_details"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.annotations(spark, path)


@query("SELECT CAST(cand_idx AS VARCHAR) AS run, max(CAST(example_id % 3 AS BIGINT)) * 100 AS checkpoint, count(*) FILTER (WHERE example_id % 3 = (SELECT max(example_id % 3) FROM scored)) AS n FROM scored GROUP BY cand_idx")
def read_run_sweep(spark, sf_dir):
    """Runs and checkpoints as folders; of each run the newest checkpoint with predictions is read."""
    base = folder(spark)
    rows = fx.scores(spark, sf_dir).select("example_id", "score", F.concat(F.lit("lr"), F.col("cand_idx").cast("string")).alias("run"), ((F.col("example_id") % 3) * 100).alias("checkpoint"))
    rows.write.partitionBy("run", "checkpoint").json(base)
    found = readers.run_sweep(spark, base, "example_id long, score double")
    return found.groupBy("run", "checkpoint").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT topic, CAST(count(*) AS VARCHAR) AS n, printf('%.4f', avg(score)) AS mean FROM scored GROUP BY topic")
def write_metric_tsv(spark, sf_dir):
    path = folder(spark)
    writers.metric_tsv(fx.scores(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")), path)
    return spark.read.option("header", True).option("sep", "\t").csv(path)


@query("SELECT example_id, cand_idx, s, d, i, CAST(round(mean, 6) AS DOUBLE) AS mean_ser, 0.5::DOUBLE AS threshold FROM sers JOIN (SELECT cand_idx, avg(ser) AS mean FROM sers GROUP BY cand_idx) USING (cand_idx)")
def write_details_json(spark, sf_dir):
    """Decision records and a summary object, written and read back, each record beside its candidate's summary."""
    path = folder(spark)
    counts = written(core.counts(spark, sf_dir).select("example_id", "cand_idx", "s", "d", "i", "ser"))
    summary = counts.groupBy("cand_idx").agg(F.round(F.avg("ser"), 6).alias("mean_ser"))
    writers.details_with_summary(counts.drop("ser"), summary, path, threshold=0.5)
    told = spark.read.schema("threshold double, summary array<struct<cand_idx:int,mean_ser:double>>").json(f"{path}/summary").select("threshold", F.inline("summary"))
    rows = spark.read.schema("example_id long, cand_idx int, s long, d long, i long").json(f"{path}/examples")
    return rows.join(told.hint("merge"), "cand_idx").select("example_id", "cand_idx", "s", "d", "i", "mean_ser", "threshold")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def write_partitioned(spark, sf_dir):
    path = folder(spark)
    writers.by_part(fx.read(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang"), path, "lang")
    return spark.read.schema("doc_id long, lang string").json(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
