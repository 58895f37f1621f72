"""Queries of ranking metrics, splits, samples, sets, significance and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotmeter.operators import ranking as rk
from slotmeter.operators import sampling as sm
from slotmeter.operators.numbering import numbered
from slotmeter.operators.overlaps import overlaps
from slotmeter.plans import fixtures as fx
from slotmeter.plans.registering import registry
from slotmeter.sources.work import written

QUERIES, ORACLES, query = registry()
#: Ids of equal token sets in a row of jaccard_pairs, at most.
PACK = 1024


_RANKED = {
    "lists": "SELECT l_orderkey AS q, CAST(l_quantity AS INT) % 7 AS grade, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem",
    "rels": "SELECT *, CAST(grade >= 4 AS INT) AS rel FROM lists",
    "aps": "SELECT q, coalesce(avg(CASE WHEN rel = 1 THEN hits / CAST(rank AS DOUBLE) END), 0) AS ap FROM (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rank) AS hits FROM rels) GROUP BY q",
}


def _lists(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_quantity").cast("int") % 7).alias("grade"), "l_extendedprice", "l_linenumber")
    return rk.ranked(rows, "q", "l_extendedprice", "l_linenumber", F.col("grade") >= 4)


@query("SELECT q, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS rr FROM rels GROUP BY q", **_RANKED)
def rank_mrr(spark, sf_dir):
    return rk.reciprocal(_lists(spark, sf_dir), "q").select("q", F.round("rr", 6).alias("rr"))


@query("SELECT q, round(ap, 6) AS ap FROM aps", **_RANKED)
def rank_map(spark, sf_dir):
    return rk.average_precision(_lists(spark, sf_dir), "q").select("q", F.round("ap", 6).alias("ap"))


@query(
    """SELECT q, count(*) AS n, round(CASE WHEN max(rank) >= 1 THEN sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) / 1.0 END, 6)::DOUBLE AS p1, round(CASE WHEN max(rank) >= 2 THEN sum(CASE WHEN rank <= 2 THEN rel ELSE 0 END) / 2.0 END, 6)::DOUBLE AS p2,
  round(CASE WHEN max(rank) >= 3 THEN sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) / 3.0 END, 6)::DOUBLE AS p3, round(avg(rel), 6) AS p_all, round(coalesce(sum(rel) / CAST(max(CASE WHEN rel = 1 THEN rank END) AS DOUBLE), 0), 6) AS r_precision FROM rels GROUP BY q""",
    **_RANKED,
)
def rank_precision(spark, sf_dir):
    out = rk.precision(_lists(spark, sf_dir), "q", (1, 2, 3))
    return out.select("q", "n", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "p3", "p_all", "r_precision")])


def _dcg_sql(rank: str, classic: bool, k: int = 5) -> str:
    d = f"CASE WHEN {rank} = 1 THEN 1.0 ELSE log2({rank}) END" if classic else f"log2({rank} + 1)"
    return f"sum(CASE WHEN {rank} <= {k} THEN grade / ({d}) ELSE 0 END)"


@query(
    f"SELECT q, round(coalesce(a / nullif(b, 0), 0), 6) AS classic, round(coalesce(c / nullif(d, 0), 0), 6) AS other FROM (SELECT q, {_dcg_sql('rank', True)} AS a, {_dcg_sql('ideal', True)} AS b, {_dcg_sql('rank', False)} AS c, {_dcg_sql('ideal', False)} AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, rank) AS ideal FROM lists) GROUP BY q)",
    **_RANKED,
)
def rank_ndcg(spark, sf_dir):
    rows = _lists(spark, sf_dir)
    a = rk.ndcg(rows, "q", 5, classic=True).select("q", F.round("ndcg", 6).alias("classic"))
    return a.join(rk.ndcg(rows, "q", 5, classic=False).select("q", F.round("ndcg", 6).alias("other")), "q")


_CUTS, _MEANS = (1, 2, 3), ("mrr", "map", "r_precision", "p1", "p2", "p3", "p_all", "ndcg1", "ndcg2", "ndcg3", "ndcg_all", "mean_candidates")
_PRECISION = ", ".join(f"CASE WHEN max(rank) >= {k} THEN sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / CAST({k} AS DOUBLE) END AS p{k}" for k in _CUTS)
_GAIN = ", ".join(f"CASE WHEN max(rank) >= {k} OR {k} = 999 THEN coalesce({_dcg_sql('rank', True, k)} / nullif({_dcg_sql('ideal', True, k)}, 0), 0) END AS ndcg{k if k < 999 else '_all'}" for k in (*_CUTS, 999))
_PER_LIST = {
    "per_list": f"""SELECT q, coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr, coalesce(avg(CASE WHEN rel = 1 THEN hits / CAST(rank AS DOUBLE) END), 0) AS map,
  coalesce(sum(rel) / CAST(max(CASE WHEN rel = 1 THEN rank END) AS DOUBLE), 0) AS r_precision, {_PRECISION}, avg(rel) AS p_all, {_GAIN}, count(*) AS mean_candidates
  FROM (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rank) AS hits, row_number() OVER (PARTITION BY q ORDER BY grade DESC, rank) AS ideal FROM rels) GROUP BY q"""
}


@query(f"SELECT count(*) AS n_queries, {', '.join(f'count(p{k}) AS p{k}_n' for k in _CUTS)}, {', '.join(f'round(coalesce(avg({m}), 0)::DOUBLE, 6) AS {m}' for m in _MEANS)} FROM per_list", **_RANKED, **_PER_LIST)
def rank_summary(spark, sf_dir):
    """Relevant are grades of at least 4; the SQL's 999 stands for lists as a whole, which are shorter."""
    out = rk.summary(_lists(spark, sf_dir), "q", _CUTS)
    return out.select("n_queries", *[f"p{k}_n" for k in _CUTS], *[F.round(m, 6).alias(m) for m in _MEANS])


def _docs(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('cap|', doc_id)), doc_id) AS k FROM documents) WHERE k <= 20")
def cap_per_group(spark, sf_dir):
    return sm.cap(_docs(spark, sf_dir), ["lang"], 20, "cap", "doc_id").select("doc_id", "lang")


_SPLIT = {"sides": "SELECT doc_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY md5(concat('split|', doc_id)), doc_id) <= floor(count(*) OVER (PARTITION BY lang, source) * 0.5) THEN 'dev' ELSE 'test' END AS side FROM documents"}


@query("SELECT doc_id, lang, source, side FROM sides", **_SPLIT)
def stratified_split(spark, sf_dir):
    return sm.split(_docs(spark, sf_dir), ["lang", "source"], 0.5, "split", "doc_id").select("doc_id", "lang", "source", "side")


@query(
    "SELECT n.example_id, n.neg_id, side FROM negs n JOIN psides USING (example_id)",
    psides="SELECT p_partkey AS example_id, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY md5(concat('split|', p_partkey)), p_partkey) <= floor(count(*) OVER (PARTITION BY p_type) * 0.5) THEN 'dev' ELSE 'test' END AS side FROM part",
)
def pair_split(spark, sf_dir):
    part = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.col("p_type").alias("topic"))
    side = sm.split(part, ["topic"], 0.5, "split", "example_id").select("example_id", "side")
    return fx.negatives(spark, sf_dir).join(side.hint("merge"), "example_id").select("example_id", "neg_id", "side")


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('hard|', doc_id)), doc_id) AS j FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= greatest(1, floor(n * 0.3))) WHERE j <= 10"""
)
def hard_pool_sample(spark, sf_dir):
    return sm.hard_pool(_docs(spark, sf_dir), ["lang"], "n_chars", 0.3, 10, "hard", "doc_id").select("doc_id", "lang")


@query("SELECT example_id, topic, n_slots FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n_slots DESC, example_id DESC) AS k FROM (SELECT example_id, topic, count(*) AS n_slots FROM preds WHERE cand_idx = 0 GROUP BY example_id, topic)) WHERE k <= 7")
def top_n_by_complexity(spark, sf_dir):
    n = fx.predictions(spark, sf_dir).where("cand_idx = 0").groupBy("example_id", "topic").agg(F.count(F.lit(1)).alias("n_slots"))
    return sm.ranked_in(n, ["topic"], [F.desc("n_slots"), F.desc("example_id")]).where("k <= 7").drop("k")


@query(
    """SELECT d.doc_id, d.lang, d.source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(concat('quota|', doc_id)), doc_id) AS k FROM documents) d
  JOIN (SELECT lang, source, floor(50 / CAST(m AS DOUBLE)) + CAST(j <= 50 % m AS INT) AS want FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS j, count(*) OVER (PARTITION BY lang) AS m FROM (SELECT DISTINCT lang, source FROM documents))) s
  ON d.lang = s.lang AND d.source = s.source WHERE k <= want"""
)
def quota_sample(spark, sf_dir):
    return sm.quota(_docs(spark, sf_dir), "lang", "source", 50, "quota", "doc_id").select("doc_id", "lang", "source")


@query("SELECT doc_id, format('{}_{}_{:03d}', source[1:3], lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)) AS id FROM documents")
def assign_ids(spark, sf_dir):
    rows = numbered(_docs(spark, sf_dir), ["source", "lang"], ["doc_id"])
    return rows.select("doc_id", F.format_string("%s_%s_%03d", F.substring("source", 1, 3), "lang", "k").alias("id"))


@query("SELECT doc_id, lang, label FROM (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY md5(concat('bal|', doc_id)), doc_id) AS k, count(*) FILTER (WHERE label = 5) OVER (PARTITION BY lang) AS a FROM (SELECT doc_id, lang, CAST(doc_id % 7 AS INT) AS label FROM documents)) WHERE k <= least(a, 15)")
def label_balance(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("label", (F.col("doc_id") % 7).cast("int"))
    return sm.balance(rows, "lang", "label", 5, 15, "bal", "doc_id").select("doc_id", "lang", "label")


@query("SELECT example_id, neg_id, pick FROM (SELECT p_partkey AS example_id, 0 AS neg_id, [p_name, p_brand, p_type][CAST(p_partkey % 3 AS INT) + 1] AS pick FROM part)")
def pick_one_reference(spark, sf_dir):
    texts = F.array("p_name", "p_brand", "p_type")
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.lit(0).alias("neg_id"), F.element_at(texts, (F.col("p_partkey") % 3).cast("int") + 1).alias("pick"))


@query("SELECT doc_id, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, md5(concat('sort|', doc_id)), doc_id) AS place FROM (SELECT doc_id, lang, length(text) AS n FROM documents)")
def sort_by_length(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    return numbered(rows, ["lang"], [F.desc("n"), sm.draw("sort", "doc_id"), "doc_id"], "place").select("doc_id", "n", "place")


_PARTS = {"parted": "SELECT conv_id, CASE WHEN conv_id % 10 IN (0, 1) THEN 'test' WHEN conv_id % 10 = 2 THEN 'dev' ELSE 'train' END AS part FROM conversations UNION ALL SELECT conv_id, 'train' FROM conversations WHERE conv_id % 10 = 1 UNION ALL SELECT conv_id, 'dev' FROM conversations WHERE conv_id % 5 = 0"}


@query("SELECT conv_id, CASE WHEN bool_or(part = 'train') THEN 'train' WHEN bool_or(part = 'test') THEN 'test' ELSE 'dev' END AS part FROM parted GROUP BY conv_id", **_PARTS)
def partition_precedence(spark, sf_dir):
    c, digit = fx.read(spark, sf_dir, "conversations").select("conv_id"), F.col("conv_id") % 10
    rows = c.select("conv_id", F.when(digit.isin(0, 1), "test").when(digit == 2, "dev").otherwise("train").alias("part"))
    rows = rows.unionByName(c.where(digit == 1).withColumn("part", F.lit("train"))).unionByName(c.where("conv_id % 5 = 0").withColumn("part", F.lit("dev")))
    return sm.precedence(rows, "conv_id")


@query("SELECT count(*) AS n FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def overlap_check(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents")
    return d.where("doc_id % 2 = 0").select("text").intersect(d.where("doc_id % 2 = 1").select("text")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 1 AND o.text = d.text)")
def exclude_seen_text(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where("doc_id % 2 = 0").join(d.where("doc_id % 2 = 1").select("text"), "text", "left_anti").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def restrict_to_test_topics(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.join(d.where("doc_id % 97 = 0").select("source").distinct(), "source", "left_semi").select("doc_id", "source")


@query("SELECT 'documents' AS origin, CAST(doc_id AS BIGINT) AS id, text, lang FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS BIGINT), text, NULL FROM benchmark")
def union_sources(spark, sf_dir):
    a = fx.read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("id"), "text", "lang")
    b = fx.read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").cast("long").alias("id"), "text")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT example_id, slot, n - coalesce(m, 0) AS missing FROM (SELECT example_id, slot, count(*) AS n FROM facts GROUP BY ALL) LEFT JOIN (SELECT example_id, slot, count(*) AS m FROM cands WHERE cand_idx = 0 GROUP BY ALL) USING (example_id, slot) WHERE n > coalesce(m, 0)")
def slot_multiset_diff(spark, sf_dir):
    a = fx.facts(spark, sf_dir).groupBy("example_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    b = fx.candidates(spark, sf_dir).where("cand_idx = 0").groupBy("example_id", "slot").agg(F.count(F.lit(1)).alias("m"))
    left = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(b.hint("merge"), ["example_id", "slot"], "left").select("example_id", "slot", left.alias("missing")).where("missing > 0")


@query("SELECT topic, slot, value, count(*) AS n FROM facts GROUP BY ALL")
def slot_value_inventory(spark, sf_dir):
    return fx.facts(spark, sf_dir).groupBy("topic", "slot", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, max(n_chars) AS longest, min(n_chars) AS shortest, round(median(n_chars), 4) AS median, round(stddev_pop(n_chars), 4) AS sd FROM documents GROUP BY lang")
def length_profile(spark, sf_dir):
    """From counts by length, so that a language's median does not need all its lengths in one task."""
    counts = _docs(spark, sf_dir).groupBy("lang", F.col("n_chars").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lang").orderBy("x")
    below = counts.withColumns({"to": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy("lang"))})
    middle = lambda k: F.min(F.when(F.col("to") >= k, F.col("x")))
    n, x, c = F.col("n"), F.col("x"), F.col("c")
    mean = F.sum(x * c) / F.sum(c)
    median = (middle(F.floor((n + 1) / 2)) + middle(F.floor(n / 2) + 1)) / 2
    out = below.groupBy("lang").agg(F.sum(c).alias("n"), F.round(mean, 4).alias("mean"), F.max(x).alias("longest"), F.min(x).alias("shortest"), F.round(median, 4).alias("median"), F.sum(x * c).alias("s"), F.sum(x.cast("double") * x * c).alias("q"))
    sd = F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)), F.lit(0.0))), 4)
    return out.select("lang", "n", "mean", "longest", "shortest", "median", sd.alias("sd"))


@query("SELECT lang, least(CAST(floor((n_chars - lo) * 10 / CAST(greatest(hi - lo, 1) AS DOUBLE)) AS BIGINT), 9) AS bin, count(*) AS n FROM documents JOIN (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang) USING (lang) GROUP BY ALL")
def length_histogram(spark, sf_dir):
    """Ten equally wide bins between the shortest and the longest; the last holds its upper edge."""
    d = _docs(spark, sf_dir)
    edges = d.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    both = d.join(F.broadcast(edges), "lang")  # a row for each language
    place = F.floor((F.col("n_chars") - F.col("lo")) * 10 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double"))
    return both.groupBy("lang", F.least(place, F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT a, b, round(c / CAST(x.n + y.n - c AS DOUBLE), 6) AS jaccard FROM (SELECT a.example_id AS a, b.example_id AS b, count(*) AS c FROM tok a JOIN tok b ON a.topic = b.topic AND a.t = b.t AND a.example_id <> b.example_id AND b.example_id % 50 = 0 GROUP BY ALL) p JOIN tn x ON x.example_id = a JOIN tn y ON y.example_id = b",
    tok="SELECT DISTINCT example_id, topic, lower(regexp_replace(trim(concat(slot, '=', value)), '\\s+', ' ', 'g')) AS t FROM facts WHERE true",
    tn="SELECT example_id, count(*) AS n FROM tok GROUP BY example_id",
)
def jaccard_pairs(spark, sf_dir):
    """Each query (b, ids divisible by 50) with all rows of its topic that share a token of any slot; the others have 0.

    Rows with equal token sets are packed, ``PACK`` ids at most; packs meet in a grid of cells, where tokens are counted, and
    are then dealt out as ids. No pair is shuffled: only packs are, once for each cell that they stand in. Two ids that both
    stand in several topics have one row of all their tokens.
    """
    token = F.lower(F.regexp_replace(F.trim(F.concat("slot", F.lit("="), "value")), r"\s+", " "))
    own, kind = Window.partitionBy("example_id"), ["topic", "ts", "n", "many"]
    tok = fx.facts(spark, sf_dir).groupBy("example_id", "topic").agg(F.array_sort(F.collect_set(token)).alias("ts"))
    tok = tok.withColumns({"n": F.sum(F.size("ts")).over(own), "many": F.count(F.lit(1)).over(own) > 1}).where("topic is not null and example_id is not null")
    rows = tok.withColumn("query", F.col("example_id") % 50 == 0)
    packs = numbered(rows, [*kind, "query"], ["example_id"]).groupBy(*kind, "query", F.floor((F.col("k") - 1) / PACK).alias("pack"))
    packs = written(packs.agg(F.collect_list("example_id").alias("ids")))
    met = overlaps(packs, "topic").withColumn("jaccard", F.round(F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c")), 6))
    each = lambda df, *kept: df.select(*kept, "ids_a", F.explode("ids_b").alias("b")).select(*kept, "b", F.explode("ids_a").alias("a")).where("a <> b")
    pairs = each(met.where("not (many_a and many_b)"), "jaccard").select("a", "b", "jaccard")
    if packs.where("many and query").isEmpty():
        return pairs
    several = each(met.where("many_a and many_b"), "c", "n_a", "n_b").groupBy("a", "b", "n_a", "n_b").agg(F.sum("c").alias("c"))
    score = F.round(F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c")), 6)
    return pairs.unionByName(several.select("a", "b", score.alias("jaccard")))
