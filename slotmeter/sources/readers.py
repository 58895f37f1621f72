"""Readers of the written forms: examples, schema maps, manifests, corpora, keyed records, annotations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "surface_form string, mr string, topic string, dataset string, hint_map_id string"


def examples(spark: SparkSession, path: str) -> DataFrame:
    """(surface_form, mr, topic, dataset, hint_map_id) of a JSON list of examples; mr stays JSON text.

    An mr of the form {dact, slots} gives its slots and the act beside them.
    """
    rows = spark.read.schema(EXAMPLE).option("multiLine", True).json(path)
    slots = F.coalesce(F.get_json_object("mr", "$.slots"), F.col("mr"))
    return rows.withColumns({"dact": F.get_json_object("mr", "$.dact"), "mr": slots})


def topic_examples(spark: SparkSession, path: str) -> DataFrame:
    """examples() of a file that maps topics to lists of examples."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string, array<struct<{EXAMPLE.replace(' string', ': string')}>>>")).alias("key", "list"))
    flat = rows.select("key", F.inline("list"))
    slots = F.coalesce(F.get_json_object("mr", "$.slots"), F.col("mr"))
    return flat.withColumns({"topic": F.coalesce("topic", "key"), "dact": F.get_json_object("mr", "$.dact"), "mr": slots}).drop("key")


def example_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, value, is_list) of the mr column of examples(); null values are skipped."""
    each = rows.select(*keys, F.explode(F.from_json("mr", "map<string,string>")).alias("slot", "raw")).where("raw is not null")
    listed = F.from_json("raw", "array<string>")
    is_list = F.startswith("raw", F.lit("["))
    return each.select(*keys, "slot", F.explode(F.when(is_list, listed).otherwise(F.array("raw"))).alias("value"), is_list.alias("is_list")).where("value is not null")


def hint_maps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(hint_map_id, slot, description) of schema files; of one schema in several files the last file's wins."""
    order = {p: k for k, p in enumerate(paths)}
    found = None
    for p, k in order.items():
        text = spark.read.text(p, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", "map<string, struct<hint_map_id: string, hint_map: map<string,string>>>")).alias("key", "m"))
        rows = rows.select(F.coalesce("m.hint_map_id", "key").alias("hint_map_id"), F.col("m.hint_map").alias("hint_map"), F.lit(k).alias("place"))
        found = rows if found is None else found.unionByName(rows)
    last = found.groupBy("hint_map_id").agg(F.max_by("hint_map", "place").alias("hint_map"))
    return last.select("hint_map_id", F.explode("hint_map").alias("slot", "description"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, file) of a manifest that maps parts to lists of files."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("part", "files")).select("part", F.explode("files").alias("file"))


def _uri(spark: SparkSession, path: str) -> str:
    """A path as the scan names it, with one slash after the scheme."""
    known = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", known.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(known).toUri().toString())


def tagged_examples(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """examples() of all files of a manifest in one scan, with part and file as the manifest names them.

    A row's part comes from the file that holds it; a file of several parts gives its rows to each. Files may be
    folders of files; relative ones are under ``base``. The list of files is on the driver, which plans the scan.
    """
    listed = [(r["part"], r["file"]) for r in manifest(spark, path).collect()]
    full = {f: f if re.match(r"^(/|[a-z0-9]+:)", f) or not base else f"{base.rstrip('/')}/{f}" for _, f in listed}
    if not listed:
        return spark.createDataFrame([], EXAMPLE + ", dact string, part string, file string")
    names = spark.createDataFrame([(p, f, _uri(spark, full[f])) for p, f in listed], "part string, file string, uri string")
    rows = spark.read.schema(EXAMPLE).option("multiLine", True).json(sorted(set(full.values()))).select("*", F.regexp_replace("_metadata.file_path", r"^([a-z0-9]+):/+", "$1:/").alias("held"))
    held = rows.select("*", F.explode(F.array("held", F.regexp_replace("held", "/[^/]*$", ""))).alias("uri"))
    slots = F.coalesce(F.get_json_object("mr", "$.slots"), F.col("mr"))
    found = held.join(F.broadcast(names), "uri").withColumns({"dact": F.get_json_object("mr", "$.dact"), "mr": slots})  # a row for each listed file
    return found.select(*[c.split()[0] for c in EXAMPLE.split(", ")], "dact", "part", "file")


def corpus_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(mr, ref) of a corpus file with a header."""
    return spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("escape", '"').csv(path).select("mr", "ref")


def keyed_scores(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, neg_id, idx, score) of a file of per-pair candidate scores."""
    rows = spark.read.option("multiLine", True).schema("records array<struct<ex_idx long, neg_idx int, pred_scores array<double>>>").json(path)
    each = rows.select(F.inline("records"))
    return each.select(F.col("ex_idx").alias("example_id"), F.col("neg_idx").alias("neg_id"), F.posexplode("pred_scores").alias("idx", "score"))


def keyed_entailment(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, neg_id, idx, slot, value, prob) of a file of per-pair entailment results: triples of slot, value, probability.

    Pairs without results are absent.
    """
    rows = spark.read.option("multiLine", True).schema("records array<struct<ex_idx long, neg_idx int, results array<array<string>>>>").json(path)
    each = rows.select(F.inline("records")).select(F.col("ex_idx").alias("example_id"), F.col("neg_idx").alias("neg_id"), F.posexplode("results").alias("idx", "r"))
    part = lambda k: F.try_element_at("r", F.lit(k))
    return each.select("example_id", "neg_id", "idx", part(1).alias("slot"), part(2).alias("value"), part(3).try_cast("double").alias("prob"))


def run_sweep(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The predictions of each run's newest checkpoint under ``base``/run=<name><parameter>/checkpoint=<number>.

    Adds run (the parameter in the folder's name) and checkpoint, both from the path.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(base).select("*", F.col("_metadata.file_path").alias("path"))
    run = F.regexp_extract("path", r"/run=[A-Za-z_-]*([^/]+)/", 1)
    rows = rows.select("*", run.alias("run"), F.regexp_extract("path", r"/checkpoint=(\d+)/", 1).cast("long").alias("checkpoint")).drop("path")
    newest = rows.groupBy("run").agg(F.max("checkpoint").alias("checkpoint"))
    return rows.join(F.broadcast(newest), ["run", "checkpoint"], "left_semi")  # a row for each run


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id, has_error, error_details) of completed annotations, as a table with tabs or as blocks of 'key: value' lines."""
    if "\t" in (spark.read.text(path).head() or [""])[0]:
        return spark.read.option("header", True).option("sep", "\t").csv(path).select("id", "has_error", F.coalesce("error_details", F.lit("")).alias("error_details"))
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^-{3,}\s*$")).alias("b"))
    field = lambda name: F.trim(F.regexp_extract("b", rf"(?mi)^{name}:[ \t]*(.*)$", 1))
    return blocks.select(field("id").alias("id"), field("has_error").alias("has_error"), field("error_details").alias("error_details")).where("id <> ''")
