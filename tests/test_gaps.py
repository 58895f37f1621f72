"""Value gaps and the ranking summary on literal rows."""

import pytest
from pyspark.sql import functions as F

from slotmeter.operators import gaps as gp
from slotmeter.operators import ranking as rk

REFS = "id int, slot string, vals array<string>, prob double"


def alike(a, b):
    return F.when(b == "near by", 0.9).otherwise(0.2)


def test_value_gaps(spark):
    refs = spark.createDataFrame([(1, "area", ["nearby"], 0.1), (1, "food", [" Thai"], 0.9), (1, "name", ["Ada", "Bo"], 0.8), (2, "area", ["far"], None), (3, "food", ["fish"], 0.7)], REFS)
    preds = spark.createDataFrame([(1, "area", ["near by"]), (1, "food", ["thai "]), (1, "name", ["ada", "Bo"]), (2, "area", ["x"]), (2, "more", ["y"])], "id int, slot string, vals array<string>")
    gaps = gp.value_gaps(refs, preds, ["id"], alike, F.col("prob"))
    # a second value is compared with the first prediction too, a slot without prediction is missing
    whole = gp.gap_table(gaps, [], ["slot"]).where("slot is null").head().asDict()
    assert whole == {"slot": None, "n": 6, "exact": 2, "missing": 1, "mismatch": 3, "alike": 1, "confirmed": 1, "both_low": 1}
    found = {r["id"]: r for r in gp.gap_features(gaps, ["id"]).collect()}
    assert (found[1]["mean_entailed"], found[1]["min_entailed"]) == (pytest.approx(0.45), 0.1)
    assert (found[1]["mean_sim"], found[1]["min_sim"], found[1]["n_alike"], found[1]["n_confirmed"]) == (pytest.approx(0.55), 0.2, 1, 1)
    # an unscored text counts as one half, and nothing scored at all as one half everywhere
    assert (found[2]["mean_entailed"], found[2]["mean_sim"]) == (0.5, 0.2)
    assert tuple(found[3])[1:] == (0.5, 0.5, 0.5, 0.5, 0, 0)


def test_gaps_of_empty_tables(spark):
    none = spark.createDataFrame([], REFS)
    gaps = gp.value_gaps(none, none.drop("prob"), ["id"], alike, F.col("prob"))
    assert gp.gap_features(gaps, ["id"]).count() == 0


def test_rank_summary(spark):
    rows = [(1, 1, 2, 1), (1, 2, 1, 1), (1, 3, 2, 1), (1, 4, 0, 0), (2, 1, 0, 0)]
    out = rk.summary(spark.createDataFrame(rows, "q int, rank int, grade int, rel int"), "q").head()
    # the second query is too short for two or three places
    assert (out["n_queries"], out["p1_n"], out["p2_n"], out["p3_n"]) == (2, 2, 1, 1)
    assert (out["mrr"], out["map"], out["r_precision"], out["p1"], out["p2"]) == (0.5, 0.5, 0.5, 0.5, 1.0)
    # 0.9203 is the classic value of grades 2 1 2 0 over four places
    assert out["ndcg_all"] == pytest.approx(0.9203 / 2, abs=1e-4)
    assert out["mean_candidates"] == 2.5


def test_rank_summary_of_nothing(spark):
    out = rk.summary(spark.createDataFrame([], "q int, rank int, grade int, rel int"), "q").head()
    assert (out["n_queries"], out["mrr"], out["ndcg_all"]) == (0, 0.0, 0.0)
