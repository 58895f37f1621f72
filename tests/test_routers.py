"""The boosted panel: configurations, weights, the winner's importances, and choices against the labels."""

import numpy as np

from slotmeter.operators import routers as ro


def test_a_panel_of_boosted_routers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, x), int(x[0] * x[1] > 0), float(abs(x[0]) + 0.1), "dev" if i % 2 else "test") for i, x in enumerate(rng.normal(size=(240, 3)))]
    table = spark.createDataFrame(rows, "id long, a double, b double, c double, label int, cost double, side string").coalesce(1)
    panel = ro.boosted_panel(table.where("side = 'dev'"), ["a", "b", "c"], "cost", ((2, 4, 0.3), (3, 8, 0.3)))
    assert [name for name, _ in panel] == ["depth 2, 4 trees, step 0.3, plain", "depth 2, 4 trees, step 0.3, weighted", "depth 3, 8 trees, step 0.3, plain", "depth 3, 8 trees, step 0.3, weighted"]
    told = ro.panel_accuracy(panel, table)
    for _, router, acc in told:
        got = {r["id"]: r["choice"] for r in router.route(table).collect()}
        for side in ("dev", "test"):
            own = [r for r in rows if r[6] == side]
            assert abs(acc[side] - sum(got[r[0]] == r[4] for r in own) / len(own)) < 1e-9
    last = ro.importances(told[2][1])
    assert told[2][2]["dev"] > 0.85 and told[2][2]["test"] > 0.7
    assert abs(sum(x for _, x in last) - 1) < 1e-9 and last[-1][0] == "c" and [x for _, x in last] == sorted((x for _, x in last), reverse=True)
    assert len(ro.BOOSTED) == 3 and {trees for _, trees, _ in ro.BOOSTED} == {100, 150, 200}


def test_equal_rows_are_fitted_as_one_that_weighs_what_they_weigh(spark, monkeypatch):
    """The fits read a row for each different row, in few tasks, and route as fits on all rows do."""
    rng = np.random.default_rng(8)
    kinds = [(float(a), float(b), int(a * b > 6 or (a + b) % 4 == 0), 0.1 + float((a + b) % 2)) for a, b in rng.integers(0, 6, size=(25, 2))]
    rows = [(i, *kinds[k], "dev" if i % 3 else "test") for i, k in enumerate(rng.integers(0, 25, size=900))]
    table = spark.createDataFrame(rows, "id long, a double, b double, label int, cost double, side string").repartition(40)
    seen, real = [], ro.GBTClassifier

    class Fit:
        def __init__(self, **how):
            self.own = real(**how)

        def fit(self, rows):
            seen.append((rows.count(), rows.rdd.getNumPartitions()))
            return self.own.fit(rows)

    monkeypatch.setattr(ro, "GBTClassifier", Fit)
    panel = ro.boosted_panel(table, ["a", "b"], "cost", ((2, 5, 0.3),))
    assert seen == [(len(set(kinds)), 1)] * 2
    base, scaled, _, _ = ro._prepared(table, ["a", "b"])
    for (_, router), weight in zip(panel, ("1.0", "_row.cost"), strict=True):
        whole = scaled.selectExpr("features", "cast(_row.label as double) as label", f"cast({weight} as double) as weight")
        base.model = ro.PipelineModel([real(weightCol="weight", maxDepth=2, maxIter=5, stepSize=0.3, seed=42).fit(whole)])
        want = {r["id"]: (r["choice"], round(r["p"], 9)) for r in base.route(table).collect()}
        assert {r["id"]: (r["choice"], round(r["p"], 9)) for r in router.route(table).collect()} == want
    acc = ro.panel_accuracy(panel, table)[0][2]
    chosen = {r["id"]: r["choice"] for r in panel[0][1].route(table).collect()}
    assert all(abs(acc[s] - np.mean([chosen[r[0]] == r[3] for r in rows if r[5] == s])) < 1e-12 for s in ("dev", "test"))


def test_router_rows_are_the_units_of_pairs(spark):
    """Features, label and cost of every pair as the unit tables have them, without a shuffle of slots or facts."""
    from slotmeter.operators import units as un
    from slotmeter.plans import building, protocols, routing

    folder = "/root/testdata/sf0.001"
    features, agreed = protocols.unit_tables(spark, folder)
    units = features.join(un.labels(agreed), un.UNIT).where("protocol = 'pair'").withColumnRenamed("unit", "neg_id")
    want = units.join(routing.sides(spark, folder), "example_id").selectExpr("example_id", "neg_id", *un.BASE, "topic", "label", "abs(lora_count - nli_count) + 0.1 as cost", "side")
    rows, inputs = building.router_rows(spark, folder)
    got = rows.selectExpr("example_id", "neg_id", *un.BASE, "topic", "label", "cast(cost as double) as cost", "side", "topic_PROMO")
    assert got.count() == want.count() > 0 and inputs[:9] == un.BASE and got.where("(topic = 'PROMO') <> (topic_PROMO = 1)").isEmpty()
    same = lambda df: df.withColumn("cost", df["cost"].cast("double"))
    assert same(want).exceptAll(same(got.drop("topic_PROMO"))).isEmpty()
    shuffles = [x for x in protocols.pair_units(spark, folder)[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert shuffles and not any("neg_id#" in x.split("hashpartitioning(")[-1].split(")")[0] for x in shuffles)
