"""Registered queries of the operators: thin layers that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotmeter.llm.bpe import encode_texts
from slotmeter.llm.class_lm import score_texts
from slotmeter.llm.decontaminate import find_contamination
from slotmeter.llm.langid import fit_languages, held_out, identify
from slotmeter.llm.line_dedup import dedup_lines
from slotmeter.llm.minhash import near_duplicates
from slotmeter.llm.multi_index import link_vectors
from slotmeter.llm.periodic import periodic_runs
from slotmeter.llm.personal import KINDS, find_personal
from slotmeter.llm.phrases import collocations
from slotmeter.llm.suffix_dedup import drop_repeats
from slotmeter.llm.toxicity import fit_toxicity, labelled_sample, score_toxicity
from slotmeter.llm.url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op1_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+least(len(w),10)-1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w)-8))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_query
def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


@_query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, fit_languages(docs.where(~out), threshold=False))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@_query
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_read(spark, sf_dir, "embeddings"))


ORACLES["op4_multi_index"] = """
WITH RECURSIVE ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@_query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), n=2)


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM r WHERE k > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    labels = _read(spark, sf_dir, "labels").where(~out)
    found = score_toxicity(docs, fit_toxicity(labelled_sample(docs, labels)))
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@_query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode_texts(_read(spark, sf_dir, "documents"), path, decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """The texts that the query judges: of every tenth document the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.expr("filter(split(text, '[ \\\\t\\\\n\\\\x0b\\\\f\\\\r]+'), w -> w <> '')")
    chosen = docs.where(h % 10 == 0).select("doc_id", g.alias("g"), words.alias("w"))
    at = chosen.where(F.size("w") > 0).select("doc_id", "w", "g", (F.col("g") % F.size("w")).cast("int").alias("a"))
    at = at.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    text = F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p]))"), " ")
    rest = docs.where(h.isNull() | (h % 10 != 0) | F.col("text").isNull() | ~F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]"))
    return rest.select("doc_id", "text").unionAll(at.select("doc_id", text.alias("text")))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_planted_periods(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# crc32 bit by bit; equal 16-word strings p apart, in islands of consecutive starts, are the runs
ORACLES["op11_periodic_runs"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda x, c: list_reduce(list_concat([xor(x, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
x AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM g),
s AS (SELECT doc_id, len(w) AS n, i, hash(array_to_string(w[i + 1:i + 16], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 15)) AS i FROM x WHERE len(w) >= 24)),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
f AS (SELECT doc_id, p, min(i) AS start, count(*) + 15 + p AS length FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS grp FROM e) GROUP BY doc_id, p, grp),
r AS (SELECT doc_id, start, length, min(p) AS period FROM f WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r) WHERE k = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(w) AS v, unnest(range(0, len(w))) AS i FROM x) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(t.start AS BIGINT) AS start, CAST(t.length AS BIGINT) AS length, CAST(t.period AS BIGINT) AS period,
  CAST(1000 * t.length // t.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM x LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@_query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone and base_sha256 are those of the base spans; spans has the method's as well."""
    found = find_personal(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint) as n_{name}") for k, name in enumerate(KINDS)]
    spans = written(F.concat("base", "added"))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"))


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)) GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
parts AS (SELECT lang, a, k, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c),
live AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.lang = c.lang AND parts.phrase = c.phrase AND 100 * parts.a >= 100 * c.a)),
cuts AS (SELECT live.*, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM live, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, l.a AS l, r.a AS r, n.n, 1000 * CAST(cuts.a AS HUGEINT) * n.n // (CAST(l.a AS HUGEINT) * r.a) AS score, j
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS t FROM s) WHERE t = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000
"""
