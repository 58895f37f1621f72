"""Learnt routers between two methods: fitting, choosing, saving and loading."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotmeter.sources.work import written

#: Configurations of the boosted panel: depth, trees, step.
BOOSTED = ((3, 100, 0.1), (4, 150, 0.1), (3, 200, 0.05))
#: Different rows of a task while trees are fitted, at least, and at most once every core has one: each level of a tree is a job.
ROWS, MOST_ROWS = 50_000, 1_000_000


@dataclass
class Router:
    """A fitted model with its inputs in order and their means and population deviations."""

    model: PipelineModel
    inputs: list[str]
    means: list[float]
    deviations: list[float]

    def _scaled(self, rows: DataFrame) -> DataFrame:
        own = [((F.col(c) - m) / (d or 1.0)).alias(c) for c, m, d in zip(self.inputs, self.means, self.deviations, strict=True)]
        return VectorAssembler(inputCols=self.inputs, outputCol="features").transform(rows.select(F.struct("*").alias("_row"), *own))

    def route(self, rows: DataFrame) -> DataFrame:
        """``rows`` with choice (1 extraction, 0 verification) and p, the probability of 1."""
        out = self.model.transform(self._scaled(rows))
        return out.select("_row.*", F.col("prediction").cast("int").alias("choice"), vector_to_array("probability")[1].alias("p"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = [(k, c, m, d) for k, (c, m, d) in enumerate(zip(self.inputs, self.means, self.deviations, strict=True))]
        spark.createDataFrame(meta, "place int, name string, mean double, deviation double").coalesce(1).write.mode("overwrite").json(f"{path}/inputs")


def load(spark: SparkSession, path: str) -> Router:
    meta = spark.read.schema("place int, name string, mean double, deviation double").json(f"{path}/inputs").orderBy("place").collect()
    return Router(PipelineModel.load(f"{path}/model"), [r["name"] for r in meta], [r["mean"] for r in meta], [r["deviation"] for r in meta])


def _prepared(rows: DataFrame, inputs: list[str]) -> tuple[Router, DataFrame, int, int]:
    """A router without a model, its scaled rows with label, the number of rows and of ones."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), *[F.avg(c).alias(f"m_{c}") for c in inputs], *[F.stddev_pop(c).alias(f"s_{c}") for c in inputs]).head()
    if not stats["n"]:
        raise ValueError("no rows to fit a router on")
    router = Router(None, inputs, [stats[f"m_{c}"] for c in inputs], [stats[f"s_{c}"] for c in inputs])
    return router, router._scaled(rows), stats["n"], stats["ones"]


def logistic(rows: DataFrame, inputs: list[str]) -> Router:
    """L2 logistic regression on z-scores with balanced classes."""
    router, table, n, ones = _prepared(rows, inputs)
    weight = F.when(F.col("_row.label") == 1, n / (2 * max(ones, 1))).otherwise(n / (2 * max(n - ones, 1)))
    table = table.select("features", F.col("_row.label").cast("double").alias("label"), weight.alias("weight"))
    fitted = LogisticRegression(weightCol="weight", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=50).fit(table)
    router.model = PipelineModel([fitted])
    return router


def coefficients(router: Router) -> list[tuple[str, float]]:
    """Inputs and coefficients of a logistic router by falling size."""
    found = zip(router.inputs, router.model.stages[0].coefficients.toArray().tolist(), strict=True)
    return sorted(found, key=lambda x: -abs(x[1]))


def importances(router: Router) -> list[tuple[str, float]]:
    """Inputs and importances of a boosted router by falling size, then name."""
    found = zip(router.inputs, router.model.stages[0].featureImportances.toArray().tolist(), strict=True)
    return sorted(found, key=lambda x: (-x[1], x[0]))


def grouped(rows: DataFrame, inputs: list[str], *sums: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(inputs, label, ``by``, n, sums): rows with equal inputs and label as one, with their number and the sums of other columns."""
    keys = [F.col(f"`{c}`") for c in (*inputs, "label", *by)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])


def boosted_panel(rows: DataFrame, inputs: list[str], cost: str, configs=BOOSTED) -> list[tuple[str, Router]]:
    """(name, router) of each configuration, plain and weighted by the column ``cost``, fitted side by side on ``rows``.

    Rows with equal inputs and label have equal gradients in every round, so they are fitted as one row that weighs what
    they weigh together; no row is left out. These rows are written once, dealt to no more tasks than they need and kept in
    memory or on disk while the fits read them; each fit is its own chain of jobs.
    """
    base, _, _, _ = _prepared(rows, inputs)
    kinds = written(grouped(rows, inputs, cost))
    table = base._scaled(kinds).select("features", F.col("_row.label").cast("double").alias("label"), F.col("_row.n").cast("double").alias("plain"), F.col(f"_row.{cost}").cast("double").alias("weighted"))
    n = kinds.count()
    tasks = max(min(-(-n // ROWS), rows.sparkSession.sparkContext.defaultParallelism), -(-n // MOST_ROWS))
    table = table.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(one: tuple) -> tuple[str, Router]:
        (depth, trees, step), kind = one
        fitted = GBTClassifier(weightCol=kind, maxDepth=depth, maxIter=trees, stepSize=step, seed=42).fit(table)
        return f"depth {depth}, {trees} trees, step {step}, {kind}", Router(PipelineModel([fitted]), inputs, base.means, base.deviations)

    wanted = [(c, kind) for c in configs for kind in ("plain", "weighted")]
    try:
        with ThreadPoolExecutor(len(wanted)) as pool:
            return list(pool.map(fit, wanted))
    finally:
        table.unpersist()


def panel_accuracy(panel: list[tuple[str, Router]], rows: DataFrame, side: str = "side") -> list[tuple[str, Router, dict[str, float]]]:
    """(name, router, accuracy by side) of each router of a panel; rows with equal inputs and label are scored once."""
    out, kinds = [], {}
    for name, router in panel:
        at = tuple(router.inputs)
        if at not in kinds:
            kinds[at] = written(grouped(rows, router.inputs, by=(side,)))
        right = F.sum(F.when(F.col("choice") == F.col("label"), F.col("n")).otherwise(0))
        found = router.route(kinds[at]).groupBy(side).agg((right / F.sum("n")).alias("acc")).collect()  # a row for each side
        out.append((name, router, {r[side]: r["acc"] for r in found}))
    return out
