"""Literal examples and properties of the metric core."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from slotmeter.functions.values import canon_value, grade_f1, rubric_score, value_equal
from slotmeter.operators import ranking, slots
from slotmeter.operators import verify as v
from slotmeter.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem documents conversations labels benchmark embeddings events pages".split()


def record(spark, rows):
    """(id, slot, value or list) rows as a slot table."""
    flat = [(i, p, s, k, x) for p, (i, s, val) in enumerate(rows) for k, x in enumerate(val if isinstance(val, list) else [val])]
    lists = {(i, s) for i, s, val in rows if isinstance(val, list)}
    table = slots.slot_table(spark.createDataFrame(flat, "id long, pos int, slot string, vpos int, value string"), ["id"])
    is_list = F.concat_ws("|", F.col("id").cast("string"), "slot").isin([f"{i}|{s}" for i, s in lists])
    return table.withColumn("is_list", is_list).withColumn("canon", canon_value(F.col("vals"), F.col("is_list")))


def ser(spark, pred, ref, ids=(1,)):
    every = spark.createDataFrame([(i,) for i in ids], "id long")
    return slots.error_counts(every, slots.slot_join(record(spark, pred), record(spark, ref), ["id"]), ["id"])


def test_worked_example(spark):
    pred = [(1, "name", "Vaults"), (1, "eatType", "pub"), (1, "priceRange", "cheap"), (1, "area", "riverside")]
    ref = [(1, "name", "vaults."), (1, "priceRange", "Cheap"), (1, "near", "Cafe")]
    got = ser(spark, pred, ref)
    row = got.head()
    assert (row["s"], row["d"], row["i"], row["ser"]) == (0, 1, 2, 1.0)
    assert round(slots.slot_f1(got, ["id"]).head()["f1"], 4) == 0.5714


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("yes", "true", True), ("no", "0", True), ("yes", "no", False), ("A and B", ["b", "a"], True), (["A and B"], "A and B", False), ("a", ["a", "b"], True), (" 'X' ", "x", True), ("x ;", "X", True)],
)
def test_values(spark, a, b, same):
    one = lambda x: canon_value(F.array(*map(F.lit, x if isinstance(x, list) else [x])), F.lit(isinstance(x, list)))
    assert spark.range(1).select(value_equal(one(a), one(b)).alias("x")).head()["x"] is same


def test_empty_sides_and_identity(spark):
    rows = [(1, "a", "x"), (1, "b", ["y", "z"]), (2, "a", "x")]
    got = {r["id"]: r for r in ser(spark, rows, [r for r in rows if r[0] == 1], ids=(1, 2, 3)).collect()}
    assert got[1]["ser"] == 0 and got[1]["m"] == got[1]["n_ref"] == 2
    assert got[2]["ser"] == 1 and got[2]["n_ref"] == 0 and got[3]["ser"] == 0


def test_written_records(spark):
    text = "noise >(a: x; y ,z); (b: q)); no colon); (a: last)</LIST>".replace("</LIST>", "</List>")
    got = slots.parse_record(spark.createDataFrame([(1, text)], "id long, mr string"), ["id"]).orderBy("slot", "vpos").collect()
    assert [(r["slot"], r["vpos"], r["value"]) for r in got] == [("a", 1, "x"), ("a", 2, "y,z"), ("a", 3, "last"), ("b", 1, "q)"), ("b", 2, "no colon")]


def test_rank_metrics(spark):
    # published values, fixed
    rows = spark.createDataFrame([(1, k + 1, g) for k, g in enumerate([2, 1, 2, 0])], "q long, rank int, grade int").withColumn("rel", (F.col("grade") > 0).cast("int"))
    assert round(ranking.ndcg(rows, "q", 4, classic=True).head()["ndcg"], 4) == 0.9203
    marks = spark.createDataFrame([(1, k + 1, g) for k, g in enumerate([1, 1, 0, 1, 0, 1, 0, 0, 0, 1])], "q long, rank int, grade int").withColumn("rel", F.col("grade"))
    assert round(ranking.average_precision(marks, "q").head()["ap"], 4) == 0.7833
    lists = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1), (3, 1, 1)], "q long, rank int, grade int").withColumn("rel", F.col("grade"))
    assert round(ranking.reciprocal(lists, "q").agg(F.avg("rr")).head()[0], 4) == 0.6111


def test_grades_ties_and_fusion(spark):
    got = spark.createDataFrame([(0.9,), (0.89,), (0.25,), (0.1,)], "x double").select(grade_f1(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in got] == [6, 5, 1, 0]
    p = spark.range(1).select(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.5)]).alias("p"))
    assert p.select(rubric_score(F.col("p")).alias("s")).head()["s"] == 1.5
    scores = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, 1.0)], "id long, cand_idx int, score double")
    assert v.best_candidate(scores, ["id"]).head()["cand_idx"] == 1
    assert v.best_candidate(scores, ["id"], latest=False).head()["cand_idx"] == 0


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 1


@pytest.mark.parametrize("name", ["ser_counts", "fuse_mr", "agreement_tally", "quota_sample", "rank_precision"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    norm = lambda rows: sorted((tuple(None if x is None else round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)
    got = registry.QUERIES[name](spark, SF).select(*columns)
    assert norm(map(tuple, got.repartition(3).collect())) == norm(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_every_query_has_a_stable_name():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
