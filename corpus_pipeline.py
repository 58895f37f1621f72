"""Five stages from raw documents to token ids, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotmeter.llm.bpe import encode_texts
from slotmeter.llm.common import scratch
from slotmeter.llm.decontaminate import drop_contaminated
from slotmeter.llm.langid import fit_languages, held_out, reject_unknown
from slotmeter.llm.line_dedup import dedup_lines
from slotmeter.llm.minhash import near_duplicates

TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; where ``lang`` is null, the identified one takes its place.

    That is texts that are null or have no letter, and texts whose score is below what the network
    learnt from labelled windows. Rows are judged alone: repeated and null ids do not matter. An empty
    table stays empty; without any labelled text every document goes.
    """
    return reject_unknown(docs, fit_languages(docs.where(~held_out(F.col("doc_id"), 4, 2))), lang_col="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows leave the texts; n_chars follows the kept text.

    Null texts stay null, short ones as they are; a text whose lines all go becomes empty. Rows that
    repeat an id and a text are one document; null ids come first. An empty table stays empty.
    """
    kept = dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): the smallest id.

    Of several rows with that id one stays, that with the smallest text hash. Rows with a null id and
    texts without words have no copies and stay. An empty table stays empty.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep_id")).distinct()
    rows = docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    many = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if many.isEmpty():
        return rows
    several = rows.join(many.hint("merge"), "doc_id", "left_semi").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = F.struct(F.xxhash64("row.text"), F.xxhash64("row.lang", "row.source", "row.n_chars"))
    one = several.groupBy("doc_id").agg(F.min_by("row", order).alias("row")).select("row.*")
    return rows.join(many.hint("merge"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go.

    Rows are judged by their own text; null and empty texts stay, as all do beside an empty benchmark.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with the text they decode to; null and empty texts have none and decode to ''."""
    coded = encode_texts(docs, public_tokenizers.path(TOKENIZER), keep=("lang", "source"), decoded_col="decoded", as_text=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: A trained network and the tokens are not expressible in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
