import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from slotmeter.llm.url_filter import RULES, host_of, judge_urls, lexical, path_of

SF = "/root/testdata/sf0.01"
#: Host, path and rule of the contract in SQL.
SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT unnest(['net/', 'example.net/en/', 'example.com/de/', 'org/fr/']) AS rule),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM h, r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[strpos(rule, '/'):]) GROUP BY page_id)
SELECT page_id, host, path, rule FROM h LEFT JOIN f USING (page_id)
"""


def test_host_path_and_rule_as_in_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rows = judge_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "") for r in rows) == sorted((i, h, p, r or "") for i, h, p, r in con.sql(SQL).fetchall())
    says = dict(RULES)
    assert all(r["verdict"] == says[r["rule"]] and r["block_score"] is None for r in rows if r["rule"])
    assert all((r["verdict"] == "block") == (r["block_score"] >= 0.5) for r in rows if not r["rule"])


def accuracy(pages, ruled, unseen):
    """(right, majority, rows) of ruled pages whose rule is taken away, judged by trees that did not learn from them."""
    rows = judge_urls(pages, unseen=F.coalesce(unseen, F.lit(False))).where("rule is null").collect()
    got = {r["page_id"]: r["verdict"] for r in rows if r["page_id"] in ruled}
    most = max(sum(ruled[i] == v for i in got) for v in ("allow", "block")) / len(got)
    return sum(got[i] == ruled[i] for i in got) / len(got), most, len(got)


def test_held_out_accuracy_and_scores_that_differ(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    every = judge_urls(pages).collect()
    ruled = {r["page_id"]: r["verdict"] for r in every if r["rule"]}
    scores = {r["block_score"] for r in every if not r["rule"]}
    by_url = accuracy(pages, ruled, F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)) == 0)
    by_suffix = {x: accuracy(pages, ruled, F.substring_index("host", ".", -2) == x) for x in ("example.com", "example.net", "example.org")}
    print("different scores", len(scores), "held-out urls", by_url, "held-out suffixes", by_suffix)
    assert len(scores) > 10 and len(ruled) > 100
    assert by_url[2] > 100 and by_url[0] > by_url[1] + 0.05


def test_features_are_their_plain_versions(spark):
    urls = ["http://a-b.c-1.example.com/x//y2/z?p=1&q=&&r#f", "x", "", "https://é.net/ü?=", "ftp://a/" + "ab" * 200, "://?#", "http://h/a?b?c&d#e?f&g"]
    got = lexical(spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})).collect()
    for r in got:
        u, h, p = r["url"], r["host"], r["path"]
        query = re.match(r"(?s)[^?#]*\?([^#]*)", u)
        n = max(len(u), 1)
        want = {
            "length": len(u), "host_length": len(h), "path_length": len(p), "depth": len([x for x in p.split("/") if x]), "labels": len(h.split(".")),
            "digit_ratio": sum(c in "0123456789" for c in u) / n, "entropy": -sum(c / n * math.log2(c / n) for c in Counter(u).values()),
            "n_params": len([x for x in (query[1] if query else "").split("&") if x]), "has_fragment": "#" in u, "n_hyphens": h.count("-"),
        }
        assert all(abs(r[k] - float(v)) < 1e-9 for k, v in want.items()), (u, want, r)
        assert r["suffix"] == ".".join(h.split(".")[-2:]) and r["top"] == h.split(".")[-1]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "no scheme net/"), (4, "HTTP://A.NET?x=1"), (4, "HTTP://A.NET?x=1"), (None, "https://example.net/en/a"), (5, "x://net"), (6, "x://planet/"), (7, "x://sub.example.com/de/"), (8, "x://example.com/DE/"), (9, "x://a.org/fr/" + "p" * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "url as host", "page_id as rule", "url as top")
    got = judge_urls(table).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [by[i]["rule"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, None)] == [None, None, None, None, None, None, "example.com/de/", None, "org/fr/", "example.net/en/"]
    assert (by[4]["host"], by[4]["path"], by[6]["host"], by[1]["host"], by[3]["path"]) == ("a.net", "", "planet", "", "")
    assert judge_urls(table.limit(0)).collect() == []
    assert {r["verdict"] for r in judge_urls(table.where("page_id in (7, 8)")).collect()} == {"block"}
    assert {r["verdict"] for r in judge_urls(table.where("page_id in (1, 8)")).collect()} == {"allow"}
