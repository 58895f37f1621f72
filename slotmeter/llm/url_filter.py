"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions and Spark ML only. The trees learn from urls that a rule decides and judge the
others from length, depth, digit ratio, character entropy, parameter counts and suffix statistics.
Statistics of a row that is trained on come from the other fold of urls, so no row sees its own label.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import ascii_lower

#: The contract's rules: (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "n_params", "has_fragment", "n_hyphens", "suffix_n", "suffix_blocked", "suffix_allowed", "top_blocked", "top_allowed")
#: Suffix tables of up to so many rows are broadcast (about 5 MB); larger ones are joined by key.
BROADCAST_ROWS = 50_000
#: Bound of the labelled sample that the trees are fitted on, and the urls that the common shares weigh in a suffix's.
MAX_TRAIN, PRIOR = 20_000, 5.0


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; '' for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first listed) and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = name.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Add the lexical features of columns url, host and path."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    # -sum p*log2(p) over the distinct characters; each one's count is what its removal takes away
    chars = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s))
    return df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.split(host, r"\.")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": entropy,
            "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "n_hyphens": F.length(F.regexp_replace(host, "[^-]", "")).cast("double"),
            "suffix": F.substring_index(host, ".", -2),
            "top": F.substring_index(host, ".", -1),
        }
    )


def fold_of(url: Column) -> Column:
    """Equal urls are in one of two folds."""
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(2))


def _with_statistics(df: DataFrame, every: DataFrame, key: str, shares: tuple[float, float], train: bool) -> DataFrame:
    """Add the number of urls of ``key`` and the smoothed shares of them that rules block and allow.

    Rows to train on see the other fold only. Only a table of checked size is broadcast.
    """
    kinds = {"n": F.lit(True), "b": F.col("says") == "block", "a": F.col("says") == "allow"}
    table = every.groupBy(key).agg(*[F.count_if(F.coalesce(c, F.lit(False)) & (F.col("fold") == k)).alias(f"{name}{k}") for name, c in kinds.items() for k in (0, 1)])
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")
    seen = {name: F.when(F.col("fold") == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0")) if train else F.col(f"{name}0") + F.col(f"{name}1") for name in kinds}
    n, b, a = (F.coalesce(seen[name], F.lit(0)) for name in "nba")
    joined = df.join(table, key, "left")
    joined = joined.withColumns({f"{key}_n": F.log1p(n), f"{key}_blocked": (b + PRIOR * shares[0]) / (n + PRIOR), f"{key}_allowed": (a + PRIOR * shares[1]) / (n + PRIOR)})
    return joined.drop(*[f"{name}{k}" for name in kinds for k in (0, 1)])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_train: int = MAX_TRAIN, trees: int = 10, depth: int = 3, unseen: Column | None = None) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict and block_score (null where a rule decides).

    The trees are fitted on a hash-chosen sample of about ``max_train`` rule-decided rows; suffix
    statistics come from all rows: how many urls have the suffix or the top-level name, and which shares
    of them rules block and allow. Nothing the trees see restates a rule's path. A null url has empty host and path and is judged by the trees
    like any other. Rows with repeated or null ids are judged alone. If no row is decided by a rule,
    the rest is allowed; if all decided rows agree, the rest follows them. Other columns are not read.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    if unseen is not None:
        base = base.withColumn("unseen", unseen)
        rule, says = (F.when(~F.col("unseen"), c) for c in (rule, says))
    base = base.withColumns({"rule": rule, "says": says, "fold": fold_of(F.col("url"))})
    total, n, blocked = base.agg(F.count(F.lit(1)), F.count("rule"), F.count_if(F.col("says") == "block")).head()
    if n == 0 or blocked in (0, n):
        fixed = "block" if n and blocked == n else "allow"
        out = base.withColumns({"verdict": F.coalesce("says", F.lit(fixed)), "block_score": F.lit(None).cast("double")})
        return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "block_score")
    shares, every = (blocked / total, (n - blocked) / total), lexical(base)

    def features(df: DataFrame, train: bool) -> DataFrame:
        for key in ("suffix", "top"):
            df = _with_statistics(df, every, key, shares, train)
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    share = min(1.0, max_train / n)
    chosen = every.where(F.col("rule").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20))))
    train = features(chosen, True).select("features", (F.col("says") == "block").cast("double").alias("label"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(train)
    scored = model.transform(features(every, False)).withColumn("p", vector_to_array("probability")[1])
    open_ = F.col("rule").isNull()
    verdict = F.when(open_, F.when(F.col("p") >= 0.5, "block").otherwise("allow")).otherwise(F.col("says"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(open_, F.col("p")).alias("block_score"))
