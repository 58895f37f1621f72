"""Queries of dataset building, sweeps over grids, tokens, matching, batch scoring and learnt routers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotmeter.functions.values import grade_ser, value_equal
from slotmeter.operators import gaps as gp
from slotmeter.operators import aligning as al
from slotmeter.operators import negatives as ng
from slotmeter.operators import parsing as ps
from slotmeter.operators import records as rc
from slotmeter.operators import routers as ro
from slotmeter.operators import sampling as sm
from slotmeter.operators import scorers as sc
from slotmeter.operators import significance as sg
from slotmeter.operators import slots
from slotmeter.operators import units as un
from slotmeter.operators import verify as v
from slotmeter.operators.numbering import numbered
from slotmeter.plans import fixtures as fx
from slotmeter.plans import protocols, routing
from slotmeter.plans.registering import registry
from slotmeter.sources.work import folder, written

QUERIES, ORACLES, query = registry()
PAIR = v.PAIR


#: Confirm thresholds of the fusion grid, in tenths.
CONFIRM = (5, 6, 7, 8)
_SWEEP = {
    "state": f"""SELECT coalesce(x.example_id, g.example_id) AS example_id, coalesce(x.neg_id, g.neg_id) AS neg_id, x.slot IS NOT NULL AS hx, g.slot IS NOT NULL AS hg, coalesce(m.prob, 0.5) AS prob,
    CASE WHEN x.slot IS NOT NULL AND g.slot IS NOT NULL THEN {fx.equal_sql('x', 'g')} ELSE false END AS same
  FROM extr_m x FULL JOIN neg_refs g ON x.example_id = g.example_id AND x.neg_id = g.neg_id AND x.slot = g.slot LEFT JOIN smax m ON m.example_id = g.example_id AND m.neg_id = g.neg_id AND m.slot = g.slot""",
    "grid": "SELECT r, a, r / 10.0::DOUBLE AS tr, a / 10.0::DOUBLE AS ta FROM (SELECT unnest([1, 2, 3, 4, 5]) AS r), (SELECT unnest([3, 4, 5, 6, 7]) AS a)",
    "points": """SELECT r, a, example_id, neg_id, count(*) FILTER (WHERE hx AND hg AND prob >= tr AND NOT same) AS s,
    count(*) FILTER (WHERE hg AND ((hx AND prob < tr) OR (NOT hx AND prob < ta))) AS d, count(*) FILTER (WHERE hx AND NOT hg) AS i FROM state, grid GROUP BY ALL""",
}


@query("SELECT r, a, dev_acc, test_acc, n_confirm, CAST(row_number() OVER (ORDER BY dev_acc DESC, r, a) = 1 AS INT) AS best FROM (SELECT r, a, round(avg(CAST(p.s = g.s AND p.d = g.d AND p.i = g.i AS INT)) FILTER (WHERE side = 'dev'), 6) AS dev_acc, round(avg(CAST(p.s = g.s AND p.d = g.d AND p.i = g.i AS INT)) FILTER (WHERE side = 'test'), 6) AS test_acc, len(list_filter([5, 6, 7, 8], lambda c: c > r)) AS n_confirm FROM points p JOIN msers g ON g.example_id = p.example_id AND g.neg_id = p.neg_id AND g.method = 'gold' JOIN psides z ON z.example_id = p.example_id GROUP BY r, a)", psides=routing.PART_SIDES, **_SWEEP)
def fusion_sweep(spark, sf_dir):
    """Only the reject and add thresholds change a fusion: 25 outcomes stand for all triples.

    n_confirm is the number of confirm thresholds above the reject threshold; the best pair is chosen on dev examples.
    """
    rejects, adds = range(1, 6), range(3, 8)
    records = routing.source_records(spark, sf_dir, routing.sides(spark, sf_dir).select("example_id", "side"), best=True)
    source = records.select(F.col("example_id").alias("source_id"), rc.with_last(F.col("gold"), F.col("facts")).alias("slots"))
    rows = fx.negatives(spark, sf_dir).join(source.hint("merge"), "source_id").select("example_id", rc.probable(F.col("slots"), fx.prob).alias("probable"))
    rows = rows.join(records.where("side is not null").select("example_id", "gold", "side", rc.filled(F.col("extraction")).alias("x")).hint("merge"), "example_id")
    rows = rows.select("side", F.size("x").alias("nx"), rc.counted(F.col("gold"), F.col("probable")).alias("g"), rc.meetings(F.col("x"), F.col("probable")).alias("m"))
    wrong, lost, never, more = rc.fusion_counts(F.col("nx"), F.col("m"), [r / 10 for r in rejects], [a / 10 for a in adds])
    counts = [c.alias(f"s{r}") for r, c in zip(rejects, wrong, strict=True)] + [c.alias(f"d{r}") for r, c in zip(rejects, lost, strict=True)] + [c.alias(f"e{a}") for a, c in zip(adds, never, strict=True)]
    rows = rows.select("side", "g", more.alias("i"), *counts)
    ok = lambda r, a: (F.array(F.col(f"s{r}"), F.col(f"d{r}") + F.col(f"e{a}"), F.col("i")) == F.col("g")).cast("double")
    acc = lambda side, r, a: F.round(F.avg(F.when(F.col("side") == side, ok(r, a))), 6).alias(f"{side}{r}{a}")
    points = [(r, a) for r in rejects for a in adds]
    told = rows.agg(F.count(F.lit(1)).alias("n"), *[acc(side, r, a) for side in ("dev", "test") for r, a in points]).where("n > 0")
    out = told.select(F.inline(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.col(f"dev{r}{a}").alias("dev_acc"), F.col(f"test{r}{a}").alias("test_acc")) for r, a in points])))
    n = F.size(F.filter(F.array(*map(F.lit, CONFIRM)), lambda c: c > F.col("r"))).cast("long")
    best = F.row_number().over(Window.orderBy(F.desc("dev_acc"), "r", "a")) == 1  # 25 rows
    return out.select("r", "a", "dev_acc", "test_acc", n.alias("n_confirm"), best.cast("int").alias("best"))


_GAPS = {
    "gaps": """SELECT *, CASE WHEN mismatch THEN 1 - levenshtein(want, got) / CAST(greatest(length(want), length(got), 1) AS DOUBLE) END AS sim, CASE WHEN mismatch THEN ((example_id * 31 + pos * 17) % 100) / CAST(100 AS DOUBLE) END AS entailed
  FROM (SELECT *, got IS NULL AS missing, got IS NOT NULL AND lower(trim(got)) = lower(trim(want)) AS exact, got IS NOT NULL AND lower(trim(got)) <> lower(trim(want)) AS mismatch
  FROM (SELECT r.example_id, r.topic, r.cand_idx, r.slot, r.pos, unnest(r.vals) AS want, p.vals[1] AS got FROM wanted r LEFT JOIN preds p ON p.example_id = r.example_id AND p.cand_idx = r.cand_idx AND p.slot = r.slot))"""
}


def gaps(spark, sf_dir):
    """Value gaps of all candidates; spelling stands for the similarity of embeddings, a fixed formula for the entailment."""
    r = fx.references(spark, sf_dir).select("example_id", "topic", "slot", "pos", "vals", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cand_idx"))
    spelt = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")
    return gp.value_gaps(r, fx.predictions(spark, sf_dir), ["example_id", "cand_idx"], spelt, ((F.col("example_id") * 31 + F.col("pos") * 17) % 100).cast("double") / 100)


@query("SELECT slot, topic, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE mismatch) AS mismatch, count(*) FILTER (WHERE sim > 0.85) AS alike, count(*) FILTER (WHERE entailed > 0.5) AS confirmed, count(*) FILTER (WHERE mismatch AND sim <= 0.85 AND entailed <= 0.5) AS both_low FROM gaps GROUP BY GROUPING SETS ((), (slot), (topic))", **_GAPS)
def value_gap_analysis(spark, sf_dir):
    return gp.gap_table(gaps(spark, sf_dir), [], ["slot"], ["topic"])


_LABELLED = {"labelled": "SELECT example_id, topic, s, d, i, CASE WHEN 1 - ser >= 0.9 THEN 4 WHEN 1 - ser >= 0.75 THEN 3 WHEN 1 - ser >= 0.5 THEN 2 WHEN 1 - ser >= 0.25 THEN 1 ELSE 0 END AS label FROM mtopics WHERE method = 'gold'"}


def _labelled(spark, sf_dir):
    rows = v.method_counts(fx.negatives(spark, sf_dir), routing.methods(spark, sf_dir, ("gold",)), routing.given(spark, sf_dir))
    return rows.select("example_id", "topic", "s", "d", "i", grade_ser(F.col("ser")).alias("label"))


@query("SELECT topic, label, count(*) AS n, CAST(sum(s) AS BIGINT) AS s, CAST(sum(d) AS BIGINT) AS d, CAST(sum(i) AS BIGINT) AS i FROM labelled GROUP BY GROUPING SETS ((topic, label), (topic), (label), ())", **_LABELLED)
def negative_stats(spark, sf_dir):
    """Negatives and their errors by topic and grade, with the totals of each and of all (null)."""
    return _labelled(spark, sf_dir).cube("topic", "label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "sdi"])


@query("SELECT topic, n_negatives, n_labels, count(*) AS n_examples FROM (SELECT topic, example_id, count(*) AS n_negatives, count(DISTINCT label) AS n_labels FROM labelled GROUP BY topic, example_id) GROUP BY GROUPING SETS ((topic, n_negatives, n_labels), (n_negatives, n_labels))", **_LABELLED)
def negatives_per_example(spark, sf_dir):
    """How many examples have so many negatives of so many grades, by topic and over all (null)."""
    per = _labelled(spark, sf_dir).groupBy("topic", "example_id", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("topic", "example_id").agg(F.sum("n").alias("n_negatives"), F.count(F.lit(1)).alias("n_labels"))
    return per.groupingSets([["topic", "n_negatives", "n_labels"], ["n_negatives", "n_labels"]], "topic", "n_negatives", "n_labels").agg(F.count(F.lit(1)).alias("n_examples"))


_GRADE = "CASE WHEN 1 - ser >= 0.9 THEN 4 WHEN 1 - ser >= 0.75 THEN 3 WHEN 1 - ser >= 0.5 THEN 2 WHEN 1 - ser >= 0.25 THEN 1 ELSE 0 END"
_GRADE_F1 = "CASE WHEN f1 >= 0.9 THEN 6 WHEN f1 >= 0.8 THEN 5 WHEN f1 >= 0.7 THEN 4 WHEN f1 >= 0.6 THEN 3 WHEN f1 >= 0.5 THEN 2 WHEN f1 >= 0.25 THEN 1 ELSE 0 END"
_HASHED = {"hashed": "SELECT p_partkey AS example_id, p_type AS topic, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat('pool|', p_partkey)), p_partkey) - 1 AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM part"}
_TRIED = {
    "tpred": "SELECT t.example_id, t.try, r.slot, r.items, r.multi FROM tries t JOIN refs r ON r.example_id = t.source_id",
    "tref": "SELECT t.example_id, t.try, r.slot, r.items, r.multi FROM tries t JOIN refs r ON r.example_id = t.example_id",
    "tkinds": f"SELECT coalesce(p.example_id, r.example_id) AS example_id, coalesce(p.try, r.try) AS try, {fx._kind_sql('p', 'r')} AS kind FROM tpred p FULL JOIN tref r ON p.example_id = r.example_id AND p.try = r.try AND p.slot = r.slot",
    "counted": "SELECT e.example_id, e.try, e.source_id, count(*) FILTER (WHERE kind = 'M') AS m, count(*) FILTER (WHERE kind = 'S') AS s, count(*) FILTER (WHERE kind = 'D') AS d, count(*) FILTER (WHERE kind = 'I') AS i FROM tries e LEFT JOIN tkinds USING (example_id, try) GROUP BY ALL",
    "written": "SELECT example_id AS source_id, string_agg(concat('(', slot, ': ', array_to_string(vals, '; '), ')'), '; ' ORDER BY pos) AS mr FROM refs GROUP BY example_id",
}
_BY_TOPIC = _HASHED | {"tries": "SELECT a.example_id, t.try, b.example_id AS source_id FROM hashed a, (SELECT unnest(range(1001)) AS try) t JOIN hashed b ON b.topic = a.topic AND b.rn = (a.example_id * 13 + t.try) % a.n WHERE t.try < a.n"} | _TRIED
_BY_ALL = {"hashed": "SELECT p_partkey AS example_id, row_number() OVER (ORDER BY md5(concat('pool|', p_partkey)), p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part"}
_BY_ALL |= {"tries": "SELECT a.example_id, t.try, b.example_id AS source_id FROM hashed a, (SELECT unnest(range(1001)) AS try) t JOIN hashed b ON b.rn = (a.example_id * 13 + t.try) % a.n WHERE t.try < a.n"} | _TRIED
_FIRST = "SELECT example_id, label, try, source_id, s, d, i, mr FROM (SELECT *, row_number() OVER (PARTITION BY example_id, label ORDER BY try) AS k FROM ({}) ) JOIN written USING (source_id) WHERE k = 1"


def _graded(spark, sf_dir, **how):
    """One row for each example and grade it has a negative of, with the negative's record as text."""
    records = written(ng.packed(fx.references(spark, sf_dir), ["example_id", "topic"]))
    one = F.transform("record", lambda x: F.concat(F.lit("("), x["slot"], F.lit(": "), F.array_join(x["vals"], "; "), F.lit(")")))
    return ng.graded_negatives(records, **how).select("example_id", "label", "try", "source_id", "s", "d", "i", F.array_join(one, "; ").alias("mr"))


@query(_FIRST.format(f"SELECT *, {_GRADE} AS label FROM (SELECT *, CAST(s + d + i AS DOUBLE) / greatest(m + s + d, 1) AS ser FROM counted)"), **_BY_TOPIC)
def graded_negative_sample(spark, sf_dir):
    """Each example looks at a run of a hash-ordered pool of its topic; the first record of each grade of 1 - SER stays."""
    return _graded(spark, sf_dir)


@query(
    _FIRST.format(f"""SELECT *, {_GRADE_F1} AS label FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1
  FROM (SELECT *, CAST(m AS DOUBLE) / greatest(m + s + i, 1) AS p, CAST(m AS DOUBLE) / greatest(m + s + d, 1) AS r FROM counted))"""),
    **_BY_ALL,
)
def graded_negative_f1(spark, sf_dir):
    """The same over one pool of all topics, by the seven grades of slot F1."""
    return _graded(spark, sf_dir, rubric="f1", pool=None)


@query("SELECT a.example_id, t.k AS place, b.example_id AS shot_id FROM hashed a, (SELECT unnest([1, 2, 3]) AS k) t JOIN hashed b ON b.topic = a.topic AND b.rn = (a.rn + t.k) % a.n WHERE b.example_id <> a.example_id", **_HASHED)
def fewshot_attach(spark, sf_dir):
    """Three other examples of the same schema: the next ones in hash order, so no topic is joined with itself in full."""
    part = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.col("p_type").alias("topic"))
    pool = numbered(part, ["topic"], [sm.draw("pool", "example_id"), "example_id"], "rn", "n")
    want = pool.select("topic", "example_id", F.col("rn").alias("own"), "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("place"))
    want = want.withColumn("rn", (F.col("own") - 1 + F.col("place")) % F.col("n") + 1)
    both = want.join(pool.select("topic", "rn", F.col("example_id").alias("shot_id")).hint("merge"), ["topic", "rn"]).where("shot_id <> example_id")
    return both.select("example_id", "place", "shot_id")


@query("SELECT p_partkey AS example_id, concat('Text:', chr(10), 'The ', p_name, ' by ', p_brand, chr(10), 'MR:', chr(10), mr, chr(10), 'Score:', chr(10)) AS prompt FROM part JOIN (SELECT example_id, string_agg(concat('(', slot, ': ', array_to_string(vals, '; '), ')'), '; ' ORDER BY pos) AS mr FROM refs GROUP BY example_id) r ON r.example_id = p_partkey")
def build_prompt_column(spark, sf_dir):
    mr = slots.write_record(fx.references(spark, sf_dir), ["example_id"])
    text = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand").alias("text"))
    return text.join(mr.hint("merge"), "example_id").select("example_id", F.concat(F.lit("Text:\n"), "text", F.lit("\nMR:\n"), "mr", F.lit("\nScore:\n")).alias("prompt"))


@query(None)
def paired_permutation(spark, sf_dir):
    """Mean difference of quality and toxic marks, and the share of sign flips with one as far from 0."""
    diffs = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("key"), (F.col("quality") - F.col("toxic")).cast("double").alias("diff"))
    return sg.permutation_test(diffs)


_W, _GAP = r"[\p{L}\p{N}\p{M}_]", r"[\s\v\p{Z}\x{1C}-\x{1F}\x{85}]"


def _tokens_sql(text: str) -> str:
    for clitic in ps.CLITICS:
        text = f"regexp_replace({text}, '({_W})({clitic.replace(chr(39), chr(39) * 2)})\\b', '\\1 \\2', 'g')"
    return f"regexp_extract_all({text}, '{_W}+(?:[-/]{_W}+)*|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\v\\p{{Z}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]')"


_NORMAL = f"regexp_replace(regexp_replace(lower(text), '[-/]', ' ', 'g'), '{_GAP}+', ' ', 'g')"


@query(f"SELECT doc_id, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.array_join(ps.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, {_NORMAL} AS text, array_to_string(list_transform({_tokens_sql(_NORMAL)}, lambda t: CASE WHEN length(t) > 1 THEN trim(t, '.,!?') ELSE t END), ' ') AS tokens FROM documents")
def normalize_utterance(spark, sf_dir):
    low = ps.normal_text(F.col("text"))
    return fx.read(spark, sf_dir, "documents").select("doc_id", low.alias("text"), F.array_join(ps.normal_tokens(low), " ").alias("tokens"))


#: Terms whose places are looked up, a word of each language.
TERMS = ("the", "der", "les", "los")


@query(
    f"""SELECT doc_id, term, len(found) AS n, found[1] - 1 AS first_at, found[-1] - 1 AS last_at, length(array_to_string(tokens[1:found[-1] - 1], ' ')) + 1 - len(list_filter(tokens[1:found[-1] - 1], lambda t: t IN ('.', ','))) AS last_pos
  FROM (SELECT doc_id, term, tokens, list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = term) AS found FROM (SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents), (SELECT unnest({list(TERMS)}) AS term)) WHERE len(found) > 0"""
)
def token_positions(spark, sf_dir):
    """All places of terms in token lists, and the approximate character offset of the last."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", ps.tokenize(F.col("text")).alias("tokens"))
    each = docs.select("doc_id", "tokens", F.explode(F.array(*map(F.lit, TERMS))).alias("term")).withColumn("found", ps.places(F.col("tokens"), F.col("term"))).where(F.size("found") > 0)
    last = F.element_at("found", -1)
    long = lambda c: c.cast("long")
    return each.select("doc_id", "term", long(F.size("found")).alias("n"), long(F.element_at("found", 1)).alias("first_at"), long(last).alias("last_at"), long(ps.token_offset(F.col("tokens"), last)).alias("last_pos"))


_SURFACE = {"surf": "SELECT p_partkey AS example_id, lower(concat('The ', p_name, ' by ', p_brand, ' has size ', p_size, '.')) AS text FROM part"}


def _surface(spark, sf_dir):
    text = F.lower(F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand", F.lit(" has size "), F.col("p_size").cast("string"), F.lit(".")))
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_id"), text.alias("text"))


@query(r"SELECT f.example_id, f.slot, f.vpos, CASE WHEN len(m) > 0 THEN length(string_split_regex(s.text, p)[1]) ELSE -1 END AS pos, len(m) > 1 AS duplicate FROM (SELECT f.*, s.text, concat('\b', regexp_escape(lower(f.value)), '\b') AS p, regexp_extract_all(s.text, concat('\b', regexp_escape(lower(f.value)), '\b')) AS m FROM facts f JOIN surf s USING (example_id)) f, LATERAL (SELECT f.text) s", **_SURFACE)
def match_verbatim(spark, sf_dir):
    both = fx.facts(spark, sf_dir).join(_surface(spark, sf_dir).hint("merge"), "example_id").withColumn("m", al.keywords(F.col("text"), F.array(F.lower("value"))))
    return both.select("example_id", "slot", "vpos", F.col("m.pos").cast("long").alias("pos"), "m.duplicate")


@query("SELECT example_id, neg_id, pos, vpos, ((length(premise) * 7 + length(hypothesis) * 13) % 100) / 100.0::DOUBLE AS prob FROM pairsql", pairsql="SELECT n.example_id, n.neg_id, f.pos, f.vpos, concat('The ', p_name, ' by ', p_brand, ' has size ', p_size, '.') AS premise, " + routing._HYP + " AS hypothesis FROM negs n JOIN facts f ON f.example_id = n.source_id JOIN part ON p_partkey = n.example_id")
def score_entailment_batches(spark, sf_dir):
    """The data path of a batch scorer, with a deterministic test scorer in the model's place."""
    test = lambda a, b: ((a.str.len() * 7 + b.str.len() * 13) % 100) / 100.0
    return sc.score_batches(routing.QUERIES["entailment_pairs"](spark, sf_dir), test, [*PAIR, "pos", "vpos"])


#: Columns that the learnt routers see.


def router_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """(rows, inputs): features, label, the cost of a wrong choice and the side of every pair, written once; the inputs' names."""
    units, topics = protocols.pair_units(spark, sf_dir, routing.sides(spark, sf_dir))
    cost = F.abs(F.col("lora_count") - F.col("nli_count")) + 0.1
    return written(un.with_topics(units.withColumn("cost", cost), topics)), [*un.BASE, *[f"topic_{t}" for t in topics]]


def _chosen(rows: DataFrame, router: ro.Router) -> DataFrame:
    return router.route(rows).select(*PAIR, "side", "label", "choice", F.round("p", 6).alias("p"))


@query(None)
def logistic_router(spark, sf_dir):
    """Choices on test pairs, with the accuracy on dev pairs beside them."""
    rows, inputs = router_rows(spark, sf_dir)
    chosen = _chosen(rows, ro.logistic(rows.where("side = 'dev'"), inputs))
    dev = chosen.where("side = 'dev'").agg(F.round(F.avg((F.col("choice") == F.col("label")).cast("double")), 6).alias("dev_accuracy"))
    return chosen.where("side = 'test'").drop("side", "label").join(F.broadcast(dev))  # one row


_PANELS: dict[tuple[str, str], tuple] = {}


def _panel(spark, sf_dir) -> tuple[DataFrame, list]:
    """(rows, [(name, router, accuracy by side)]) of all configurations and weightings, fitted on dev pairs once for a folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _PANELS:
        rows, inputs = router_rows(spark, sf_dir)
        _PANELS[at] = rows, ro.panel_accuracy(ro.boosted_panel(rows.where("side = 'dev'"), inputs, "cost"), rows)
    return _PANELS[at]


def _winner(panel: list) -> int:
    """The place of the best dev accuracy, the first of equal ones."""
    return max(range(len(panel)), key=lambda k: (panel[k][2]["dev"], -k))


@query(None)
def boosted_router(spark, sf_dir):
    """Test choices of the configuration and weighting with the best dev accuracy."""
    rows, panel = _panel(spark, sf_dir)
    name, router, accuracy = panel[_winner(panel)]
    return _chosen(rows, router).where("side = 'test'").select(*PAIR, "choice", "p", F.lit(name).alias("router"), F.lit(round(accuracy["dev"], 6)).alias("dev_accuracy"))


@query(None)
def boosted_panel(spark, sf_dir):
    """Dev and test accuracy of every configuration, which one wins on dev, and the importance of each input to it."""
    _, panel = _panel(spark, sf_dir)
    best = _winner(panel)
    found = [(k, name, acc["dev"], acc["test"], int(k == best), [{"input": c, "importance": x} for c, x in ro.importances(router)]) for k, (name, router, acc) in enumerate(panel)]
    each = spark.createDataFrame(found, "place int, router string, dev_accuracy double, test_accuracy double, best int, inputs array<struct<input:string,importance:double>>")
    return each.select("place", "router", "dev_accuracy", "test_accuracy", "best", F.inline("inputs"))


@query(None)
def save_load_router(spark, sf_dir):
    """A router's files read back give its choices: rows where both differ, and all."""
    rows, inputs = router_rows(spark, sf_dir)
    router, path = ro.logistic(rows.where("side = 'dev'"), inputs), folder(spark)
    router.save(spark, path)
    again = ro.load(spark, path).route(rows).select(*PAIR, F.col("choice").alias("again"))
    both = router.route(rows).join(again.hint("merge"), PAIR)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("choice") != F.col("again")).alias("n_different"))


@query(None)
def route_saved(spark, sf_dir):
    """A saved router applied to feature rows."""
    (rows, inputs), path = router_rows(spark, sf_dir), folder(spark)
    ro.logistic(rows.where("side = 'dev'"), inputs).save(spark, path)
    return ro.load(spark, path).route(rows.where("side = 'test'")).select(*PAIR, "choice", F.round("p", 6).alias("p"))
