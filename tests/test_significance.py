"""All method pairs from one bit vector a key, against published values of the tests."""

from slotmeter.operators import significance as sg


def test_pairs_of_three_methods(spark):
    outcome = [("a", "b")] * 30 + [("a",)] * 10 + [("b",)] * 2 + [()] * 8
    rows = [(k, m, m in right) for k, right in enumerate(outcome) for m in "ab"] + [(k, "c", True) for k in range(40)] + [(99, "z", True), (0, "a", None)]
    patterns = sg.outcome_patterns(spark.createDataFrame(rows, "id int, method string, ok boolean"), ["id"], ["a", "b", "c"])
    assert patterns.count() <= 64
    got = {(r["method_a"], r["method_b"]): r.asDict() for r in sg.method_pairs(patterns, ["a", "b", "c"]).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    ab = got["a", "b"]
    assert (ab["n"], ab["both_correct"], ab["a_only"], ab["b_only"], ab["both_wrong"], ab["n_discordant"]) == (50, 30, 10, 2, 8, 12)
    assert (ab["a_acc"], ab["b_acc"]) == (0.8, 0.64)
    assert abs(ab["statistic"] - 49 / 12) < 1e-12 and abs(ab["p_value"] - 0.0433081) < 1e-6 and abs(ab["p_exact"] - 158 / 4096) < 1e-12 and ab["stars"] == "*"
    ac = got["a", "c"]
    assert (ac["n"], ac["both_correct"], ac["n_discordant"], ac["statistic"], ac["p_value"], ac["p_exact"], ac["stars"]) == (40, 40, 0, 0.0, 1.0, 1.0, "n.s.")
    bc = got["b", "c"]
    assert (bc["b_only"], bc["stars"]) == (10, "**") and abs(bc["p_exact"] - 2 / 1024) < 1e-12
    many = spark.createDataFrame([(k, m, (m == "a") == (k < 40)) for k in range(60) for m in "ab"], "id int, method string, ok boolean")
    one = sg.method_pairs(sg.outcome_patterns(many, ["id"], ["a", "b"]), ["a", "b"]).head()
    assert one["n_discordant"] == 60 and one["p_exact"] == one["p_value"] and abs(one["statistic"] - 361 / 60) < 1e-12
