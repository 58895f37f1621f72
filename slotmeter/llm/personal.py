"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed forms find (e-mail, address, card and phone numbers). Around each seed, and around
every other stretch of words with a digit or an at sign, lexical patterns are read off: the letters
and digits of the stretch itself with its checksum, the word before, the two words before, and the words
on both sides. Patterns and instances (the stretches' lower-case forms) are a bipartite graph:

- a pattern's score is the lower bound (Wilson, two standard errors) of the confident share of its instances,
- an unseen instance's confidence is that one of its accepted patterns is right (noisy or); seeds have 1,

and both are repeated until no instance is new. Accepted instances become spans wherever they occur; a
span that base spans or a better one overlap is left out. So a card number that stands too close to a
phone number for the fixed forms is found by its digits, and a member number by what stands before it.

Texts without digit and at sign are settled before Python. The graph is joined and summed by Spark;
keys are salted, as one pattern may have most instances and one instance most occurrences.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, staged

KINDS = ("email", "ip", "card", "phone")
#: Words of a candidate at most, characters read for the words beside it, salts, rounds, least score of a pattern.
WORDS, BESIDE, SALTS, ROUNDS, LEAST = 4, 80, 16, 5, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\t-\r=:]+")
_DIGIT = re.compile(r"[0-9@]")
_EDGE = "\"'()[]{}<>.,;!?#*$%&|`~^"
_SHAPE = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small_parts(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed forms, in order; linear in the text."""
    out, end = [], 0
    for m in re.finditer("@", text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (domain := _DOMAIN.match(text, m.end())):
            end = domain.end()
            out.append((0, start, end))
    out += [(1, *m.span()) for m in _IP.finditer(text) if _small_parts(m.group())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def shape_of(found: str) -> str:
    """Runs of letters as a, each digit as 9, and whether checksum and parts hold where they could."""
    digits = "".join(c for c in found if c in "0123456789")
    told = (" luhn" if luhn(digits) else " no luhn") if 16 <= len(digits) <= 19 else ""
    if _IP.fullmatch(found):
        told += " parts" if _small_parts(found) else " no parts"
    return re.sub("[0-9]", "9", _SHAPE.sub("a", found)) + told


def _beside(text: str, start: int, end: int) -> tuple[list[str], str]:
    left = [w for x in _WORD.findall(text[max(0, start - BESIDE) : start]) if (w := x.strip(_EDGE).lower())][-2:]
    right = next((w for x in _WORD.findall(text[end : end + BESIDE]) if (w := x.strip(_EDGE).lower())), "")
    return left, right


def patterns_of(text: str, start: int, end: int) -> list[str]:
    left, right = _beside(text, start, end)
    out = [f"shape {shape_of(text[start:end])}"]
    if left:
        out.append(f"after {left[-1]}")
        out.append(f"between {left[-1]} | {right}")
    if len(left) == 2:
        out.append(f"after {left[0]} {left[1]}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of up to WORDS words, each with a digit or at sign, that no base span overlaps."""
    spans = sorted((s, e) for _, s, e in base)
    starts, run, last = [s for s, _ in spans], [], None
    ends = []  # the farthest end of the spans so far
    for _, e in spans:
        ends.append(max(e, ends[-1] if ends else 0))
    for m in _WORD.finditer(text):
        word = m.group()
        core = word.strip(_EDGE)
        if not core or not _DIGIT.search(core):
            run = []
            continue
        s = m.start() + word.index(core)
        whole = m.start() + len(word) - len(word.lstrip("\"'[{<"))  # a bracket may open a number
        k = bisect_left(starts, s + len(core))
        if k and ends[k - 1] > s:
            run = []
            continue
        if run and text[last : m.start()].strip(" "):
            run = []
        run, last = [*run[-WORDS + 1 :], whole], m.end()
        for j, first in enumerate(run):
            yield (s if j == len(run) - 1 else first), s + len(core)


_FOUND = "base array<struct<kind:int,start:int,end:int>>, seed int, start int, end int, instance string, patterns array<string>"


def occurrences(docs: DataFrame) -> DataFrame:
    """Columns (id, th, text): one row with base for each text, then one for each seed and candidate in it."""
    id_type = docs.schema["id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, ths = batch.column(0), batch.column(1)
        rows: list[tuple] = []

        def given() -> pa.RecordBatch:
            of, *values = zip(*rows, strict=True)
            types = [base_type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            columns = [ids.take(pa.array(of)), ths.take(pa.array(of)), *(pa.array(v, t) for v, t in zip(values, types, strict=True))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "th", "base", "seed", "start", "end", "instance", "patterns"])

        for k, text in enumerate(batch.column(2).to_pylist()):
            base = base_spans(text)
            rows.append((k, [dict(zip(("kind", "start", "end"), b, strict=True)) for b in base], None, None, None, None, None))
            for kind, s, e in base:
                rows.append((k, None, kind, s, e, text[s:e].lower(), patterns_of(text, s, e)))
            for s, e in candidates(text, base):
                rows.append((k, None, None, s, e, text[s:e].lower(), patterns_of(text, s, e)))
                if len(rows) >= 20_000:
                    yield given()
        if rows:
            yield given()

    return arrow_map(docs, run, f"id {id_type}, th long, {_FOUND}", rows=500)


def _lower_bound(share: Column, n: Column, z: float = 2.0) -> Column:
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def learn(found: DataFrame, least: float = LEAST, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns: pattern, score, n, kind), (instances: instance, confidence, kind) from ``occurrences``; seeds are not listed."""
    masses = [f"m{k}" for k in range(len(KINDS))]
    # an instance that is a seed anywhere is one everywhere
    edges = found.where("instance is not null").select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("seed").alias("seed"))
    seeds = found.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("own"))
    edges = edges.join(seeds.hint("merge"), "instance", "left")
    edges = staged(edges.select("pattern", "instance", "own", *[F.when(F.col("own") == k, 1.0).otherwise(0.0).alias(m) for k, m in enumerate(masses)]))
    salt = F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int")
    known, n_known = None, 0
    for _ in range(rounds):
        now = edges
        if known is not None:
            told = known.select("instance", *[F.when(F.col("kind") == k, F.col("confidence")).otherwise(0.0).alias(f"t{k}") for k in range(len(KINDS))])
            now = edges.join(told.hint("merge"), "instance", "left").select("pattern", "instance", "own", *[F.coalesce(f"t{k}", m).alias(m) for k, m in enumerate(masses)])
        share = sum(F.col(m) for m in masses) / F.col("n")
        scored = now.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in masses]).withColumn("score", _lower_bound(F.least(share, F.lit(1.0)), F.col("n")))
        accepted = staged(scored.where(F.col("score") >= least))
        open_ = edges.where("own is null").select("pattern", "instance", salt.alias("salt"))
        voted = open_.join(_salted(accepted).hint("merge"), ["pattern", "salt"])
        weight = [F.sum(F.col("score") * F.col(m) / F.col("n")).alias(m) for m in masses]
        votes = voted.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("confidence"), *weight)
        best = F.greatest(*masses)
        kind = F.coalesce(*[F.when(F.col(m) == best, k) for k, m in enumerate(masses)])
        known = staged(votes.select("instance", F.round("confidence", 9).alias("confidence"), kind.alias("kind")))
        if (n := known.count()) == n_known:
            break
        n_known = n
    best = F.greatest(*masses)
    kind = F.coalesce(*[F.when(F.col(m) == best, k) for k, m in enumerate(masses)])
    return accepted.select("pattern", "score", "n", kind.alias("kind")), known


def _settled(spans: list[dict]) -> list[dict]:
    """The best spans of which no two overlap: by confidence, then length, then place."""
    starts: list[int] = []
    end_of: dict[int, int] = {}
    kept = []
    for x in sorted(spans, key=lambda x: (-x["confidence"], x["start"] - x["end"], x["start"])):
        at = bisect_left(starts, x["end"])
        if at and end_of[starts[at - 1]] > x["start"]:
            continue
        insort(starts, x["start"])
        end_of[x["start"]] = x["end"]
        kept.append({"kind": x["kind"], "start": x["start"], "end": x["end"]})
    return sorted(kept, key=lambda x: (x["kind"], x["start"]))


_SPANS = "array<struct<kind:int,start:int,end:int>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id, base and added for each row of ``docs``: spans (kind, start, end) in code points, by kind, then start.

    kind is a place in KINDS. base has the fixed forms, left to right without overlap in each kind;
    added has what the learnt patterns find besides, apart from base and from each other. Null and
    empty texts have no spans. Rows with equal id and text get equal results and count as one
    occurrence each; null ids are ids. Ties between kinds go to the first listed. Other columns are not
    read; empty input gives an empty result. Without seeds nothing is learnt.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    found = staged(occurrences(named.where(may).select("id", "th", "text")))
    _, known = learn(found, least)
    salt = F.pmod(F.xxhash64("id", "th", "start"), F.lit(SALTS)).cast("int")
    seen = found.where("instance is not null and seed is null").select("id", "th", "start", "end", "instance", salt.alias("salt"))
    spans = seen.join(_salted(known).hint("merge"), ["instance", "salt"]).groupBy("id", "th").agg(F.collect_set(F.struct("confidence", "kind", "start", "end")).alias("spans"))
    id_type = named.schema["id"].dataType.simpleString()

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = [_settled(x) for x in batch.column(2).to_pylist()]
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, kinds)], names=["rid", "rth", "added"])

    added = arrow_map(spans, settle, f"rid {id_type}, rth long, added {_SPANS}")
    base = found.where("instance is null").select("id", "th", "base")
    both = base.join(added.hint("merge"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    none = F.array().cast(_SPANS)
    return both.select("id", "base", F.coalesce("added", none).alias("added")).unionAll(named.where(~may).select("id", none.alias("base"), none.alias("added")))
