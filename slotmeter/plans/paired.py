"""Queries of methods side by side: outcomes of routed and plain methods, their significance, what routers choose."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotmeter.operators import significance as sg
from slotmeter.operators import verify as v
from slotmeter.plans import fixtures as fx
from slotmeter.plans import routing
from slotmeter.plans.registering import registry
from slotmeter.sources.work import written

QUERIES, ORACLES, query = registry()

METHODS = ["extraction", "verification", "score", "oracle"]
_VECTORS = {
    "per": "SELECT example_id, topic, method, count(*) AS n, CAST(sum(all_ok) AS BIGINT) AS n_ok FROM agree WHERE method IN ('extraction', 'verification') GROUP BY ALL",
    "decided": """SELECT l.example_id, l.topic, CASE WHEN t.top >= 2.5 THEN 'extraction' ELSE 'verification' END AS score, CASE WHEN l.n_ok >= n.n_ok THEN 'extraction' ELSE 'verification' END AS oracle
  FROM per l JOIN per n ON n.example_id = l.example_id AND n.method = 'verification' JOIN (SELECT example_id, max(score) AS top FROM scored GROUP BY example_id) t ON t.example_id = l.example_id WHERE l.method = 'extraction'""",
    "vectors": """SELECT method, example_id, n, n_ok FROM per UNION ALL SELECT 'score', p.example_id, n, n_ok FROM per p JOIN decided d ON d.example_id = p.example_id AND d.score = p.method
  UNION ALL SELECT 'oracle', p.example_id, n, n_ok FROM per p JOIN decided d ON d.example_id = p.example_id AND d.oracle = p.method""",
}


def per_example(spark, sf_dir):
    """(example_id, topic, method, n, n_ok) of the two plain methods, written once."""
    rows = routing.agreed(spark, sf_dir, ("gold", "extraction", "verification"))
    return written(rows.groupBy("example_id", "topic", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("all_ok").cast("long").alias("n_ok")))


def decisions(spark, sf_dir, per):
    """(example_id, topic, score, oracle): the method that a score threshold and hindsight choose for each example."""
    ok = lambda m: F.max(F.when(F.col("method") == m, F.col("n_ok")))
    best = per.groupBy("example_id", "topic").agg((ok("extraction") >= ok("verification")).alias("better"))
    top = v.score_features(fx.scores(spark, sf_dir), ["example_id"]).select("example_id", "top_score")
    name = lambda c: F.when(c, "extraction").otherwise("verification")
    return best.join(top.hint("merge"), "example_id").select("example_id", "topic", name(F.col("top_score") >= 2.5).alias("score"), name(F.col("better")).alias("oracle"))


def vectors(spark, sf_dir):
    """(method, example_id, n, n_ok) of the plain methods and of those that choose between them."""
    per = per_example(spark, sf_dir)
    chosen = decisions(spark, sf_dir, per).select("example_id", F.inline(F.array(*[F.struct(F.lit(r).alias("router"), F.col(r).alias("method")) for r in ("score", "oracle")])))
    routed = per.join(chosen.hint("merge"), ["example_id", "method"]).select(F.col("router").alias("method"), "example_id", "n", "n_ok")
    return per.select("method", "example_id", "n", "n_ok").unionByName(routed)


@query("SELECT method, example_id, n, n_ok, CAST(n_ok = n AS INT) AS all_right, round(n_ok / CAST(n AS DOUBLE), 6) AS fraction FROM vectors", **_VECTORS)
def routing_method_vectors(spark, sf_dir):
    """Each method's outcome on each example: how many of its records are right, whether all are, and their share."""
    return vectors(spark, sf_dir).select("*", (F.col("n_ok") == F.col("n")).cast("int").alias("all_right"), F.round(F.col("n_ok") / F.col("n"), 6).alias("fraction"))


#: 1 - erf by its series; beyond 4.5 it is 0 in six digits.
_P = "CASE WHEN d = 0 THEN 1.0 WHEN chi2 = 0 THEN 1.0 WHEN sqrt(chi2 / 2) > 4.5 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(sqrt(chi2 / 2)) - lgamma(k + 1)) / (2 * k + 1))) END"
_EXACT = "least(1.0, list_sum(list_filter(list_transform(range(0, d + 1), lambda j: exp(lgamma(d + 1) - lgamma(j + 1) - lgamma(d - j + 1))), lambda c: c <= exp(lgamma(d + 1) - lgamma(a_only + 1) - lgamma(d - a_only + 1)) * (1 + 1e-7))) / power(2.0, d))"


@query(
    f"""SELECT method_a, method_b, n, a_acc, b_acc, both_correct, a_only, b_only, both_wrong, d AS n_discordant, round(chi2, 6) AS statistic, round(p, 6) + 0.0 AS p_value, round(e, 6) + 0.0 AS p_exact,
  CASE WHEN e < 0.001 THEN '***' WHEN e < 0.01 THEN '**' WHEN e < 0.05 THEN '*' ELSE 'n.s.' END AS stars
  FROM (SELECT *, CASE WHEN d = 0 THEN 1.0 WHEN d < 25 THEN {_EXACT} ELSE p END AS e FROM (SELECT *, {_P} AS p FROM cells))""",
    **_VECTORS,
    order_="SELECT unnest(['extraction', 'verification', 'score', 'oracle']) AS method, unnest([1, 2, 3, 4]) AS o",
    marked="SELECT method, o, example_id, n_ok = n AS ok FROM vectors JOIN order_ USING (method)",
    cells="""SELECT *, a_only + b_only AS d, round((both_correct + a_only) / CAST(n AS DOUBLE), 6) AS a_acc, round((both_correct + b_only) / CAST(n AS DOUBLE), 6) AS b_acc, CASE WHEN a_only + b_only > 0 THEN power(abs(a_only - b_only) - 1, 2) / CAST(a_only + b_only AS DOUBLE) ELSE 0 END AS chi2
  FROM (SELECT a.method AS method_a, b.method AS method_b, count(*) AS n, count(*) FILTER (WHERE a.ok AND b.ok) AS both_correct, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS a_only, count(*) FILTER (WHERE NOT a.ok AND b.ok) AS b_only, count(*) FILTER (WHERE NOT a.ok AND NOT b.ok) AS both_wrong
  FROM marked a JOIN marked b ON a.example_id = b.example_id AND a.o < b.o GROUP BY ALL)""",
)
def mcnemar(spark, sf_dir):
    """Every two methods, routed ones among them, by whether all records of an example are right."""
    rows = vectors(spark, sf_dir).select("example_id", "method", (F.col("n_ok") == F.col("n")).alias("ok"))
    out = sg.method_pairs(sg.outcome_patterns(rows, ["example_id"], METHODS), METHODS)
    return out.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value", "p_exact")})


@query(
    """SELECT topic, router, count(*) AS n, count(*) FILTER (WHERE method = 'extraction') AS n_extraction, count(*) FILTER (WHERE method = 'verification') AS n_verification,
  round(avg(CAST(method = 'extraction' AS INT)), 6) AS share_extraction, count(*) FILTER (WHERE method <> oracle) AS n_against_oracle, round(avg(CAST(method <> oracle AS INT)), 6) AS share_against_oracle
  FROM (SELECT topic, unnest(['score', 'oracle']) AS router, unnest([score, oracle]) AS method, oracle FROM decided) GROUP BY GROUPING SETS ((topic, router), (router))""",
    **_VECTORS,
)
def routing_counts(spark, sf_dir):
    """What each router chooses, by topic and over all (null), and how often hindsight would choose otherwise."""
    chosen = decisions(spark, sf_dir, per_example(spark, sf_dir))
    each = chosen.select("topic", "oracle", F.inline(F.array(*[F.struct(F.lit(r).alias("router"), F.col(r).alias("method")) for r in ("score", "oracle")])))
    first, other = F.col("method") == "extraction", F.col("method") != F.col("oracle")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    cells = [F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n_extraction"), F.count_if(~first).alias("n_verification"), share(first).alias("share_extraction"), F.count_if(other).alias("n_against_oracle"), share(other).alias("share_against_oracle")]
    return each.groupingSets([["topic", "router"], ["router"]], "topic", "router").agg(*cells)
