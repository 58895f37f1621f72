"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two strings sums, over all subsequences of ``ORDER`` letters they share, a decay to
the power of the lengths they span, so an insult with letters inserted or left out stays near its
plain form; its ``POWER``-th power, a kernel again, sets near forms apart from accidental ones. A
sentence is a bag of units (the letters and digits of a token; a run of tokens of one letter is one unit), and its kernel with a landmark is that of its best unit, scaled by the landmark's own.
Beside it stands what the text's other distinct units add, up to ``MORE``: where ordinary words
resemble a landmark by chance, several different ones in a text tell more than the best alone.
Landmarks are units, or beginnings of units, that tell toxic training texts from others. The machine
is trained on sentences: of a toxic text its most toxic sentence stands for it, chosen again after
each round, and all sentences of the other texts are negative.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map, staged

#: Letters of a subsequence, decay of each letter it spans, power of the kernel, longest unit (longer ones are read in overlapping cuts).
ORDER, DECAY, POWER, WIDTH = 3, 0.75, 2, 32
#: Landmarks, least share of a landmark's letters a unit must have to be compared, and least kernel that counts.
#: The two bounds spare work: with 0.6 and 0.1 held-out recall on sf0.1 was 0.66 beside 0.68, false alarms equal.
LANDMARKS, SHARE, FLOOR = 56, 0.75, 0.2
#: Bound of what a text's other units add to a landmark's kernel, and the power that leaves only near ones.
MORE, SHARPEN = 4.0, 4
#: Least evidence of a landmark: toxic texts that have it, times the log of its likelihood ratio.
EVIDENCE = 12.0
#: Letters of a beginning that can be a landmark.
BEGINNINGS = (5, 6, 7, 8)
#: Bound of the labelled sample: toxic and other texts.
MAX_TEXTS = 3000
#: Tokens a worker remembers before it starts afresh.
MEMORY = 300_000
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_OTHER = re.compile(r"[\W_]+")
_RUN = re.compile(r"(?:^|\s)(?:\w\s+){2}\w(?:\s|$)")


def plain(token: str) -> str:
    """Its letters and digits."""
    return token if token.isalnum() else _OTHER.sub("", token)


def runs(sentence: str) -> list[str]:
    """Runs of three or more tokens of one letter or digit, each as one unit."""
    found, run = [], []
    for t in [*sentence.split(), "###"]:
        if len(t) == 1 and t.isalnum():
            run.append(t)
            continue
        if len(run) >= 3:
            found.append("".join(run))
        run = []
    return found


def cuts(unit: str) -> list[str]:
    return [unit] if len(unit) <= WIDTH else [unit[k : k + WIDTH] for k in range(0, len(unit) - WIDTH // 2, WIDTH // 2)]


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split((text or "").lower()) if s]


def codes(strings: list[str], width: int) -> np.ndarray:
    """Code points in rows; characters that are not letters or digits, and the padding, are 0 and match nothing."""
    same = [(s if s.isalnum() else "".join([c if c.isalnum() else "\0" for c in s])).ljust(width, "\0") for s in strings]
    return np.frombuffer("".join(same).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(strings), width)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The gap-weighted subsequence kernel of each row of a with the same row of b."""
    n, la = a.shape
    lb = b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # pairs lie side by side
    inner = np.ones((la + 1, lb + 1, n), np.float32)  # common subsequences of q letters, decayed to the prefixes' ends
    total = np.zeros(n, np.float32)
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    for q in range(ORDER):
        last = q == ORDER - 1
        nxt = None if last else np.zeros_like(inner)
        for i in range(1, la + 1):
            match = (a[i - 1] == b) & (a[i - 1] != 0)
            step = inner[i - 1, :-1] * match
            step *= square
            if last:
                total += step.sum(0)
                continue
            along = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                along *= decay
                along += step[j - 1]
                np.multiply(nxt[i - 1, j], decay, out=nxt[i, j])
                nxt[i, j] += along
        inner = nxt
    return total


def _paired(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """kernel(a[ia], b[ib]) in pieces of bounded size, cut to the rows' real widths."""
    out = np.zeros(len(ia), np.float32)
    wa, wb = [(x != 0).cumsum(1).argmax(1) + 1 for x in (a, b)]
    order = np.lexsort((wb[ib], wa[ia]))
    for k in range(0, len(order), 4096):
        rows = order[k : k + 4096]
        x, y = ia[rows], ib[rows]
        out[rows] = kernel(a[x][:, : wa[x].max()], b[y][:, : wb[y].max()])
    return out


def _best(hits) -> list[tuple[int, float]]:
    """The largest value of each landmark."""
    best: dict[int, float] = {}
    for l, v in hits:
        best[l] = max(best.get(l, 0.0), v)
    return list(best.items())


class Landmarks:
    """Landmark strings and the scaled kernel of units with them."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        self.codes = codes(strings, WIDTH)
        at = np.arange(len(strings))
        self.own = _paired(self.codes, self.codes, at, at)
        self.alphabet = np.unique(self.codes[self.codes > 0])
        self.counts = np.stack([(self.codes == c).sum(1) for c in self.alphabet]).astype(np.float32) if len(self.alphabet) else np.zeros((0, len(strings)), np.float32)
        self.needed = np.maximum(ORDER, np.ceil(SHARE * self.counts.sum(0)))
        self.known: dict[str, list] = {}  # by token, and by a token's letters and digits
        self.hot: set[str] = set()  # tokens that resemble a landmark

    def scaled(self, value: np.ndarray, landmark: np.ndarray) -> np.ndarray:
        return np.minimum(value / np.maximum(self.own[landmark], 1e-30), 1) ** POWER

    def compare(self, strings: list[str]) -> list[list]:
        """For each string of at most WIDTH letters, (landmark, scaled kernel) of those it resembles."""
        found: list = [[] for _ in strings]
        for k in range(0, len(strings) if self.strings else 0, 20_000):
            rows = codes(strings[k : k + 20_000], WIDTH)
            place = np.minimum(np.searchsorted(self.alphabet, rows), len(self.alphabet) - 1)
            has = np.zeros((len(rows), len(self.alphabet)), np.float32)
            r, c = np.nonzero(self.alphabet[place] == rows)
            has[r, place[r, c]] = 1
            u, l = np.nonzero(has @ self.counts >= self.needed)
            value = self.scaled(_paired(rows, self.codes, u, l), l) if len(u) else np.zeros(0)
            ok = value > FLOOR
            for x, y, v in zip(u[ok].tolist(), l[ok].tolist(), value[ok].tolist(), strict=True):
                found[k + x].append((y, v))
        return found

    def learn(self, tokens: set[str]) -> None:
        """Compare the tokens that are not remembered yet."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
            self.hot.clear()
        new = [(t, plain(t)) for t in tokens - known.keys()]
        forms = {p: cuts(p) for _, p in new if p not in known}
        flat = sorted({c for p in forms.values() for c in p if len(c) > ORDER})
        hits = {c: h for c, h in zip(flat, self.compare(flat), strict=True) if h}
        for p, parts in forms.items():
            known[p] = list(hits.get(parts[0], ())) if len(parts) == 1 else _best(h for c in parts for h in hits.get(c, ()))
        for t, p in new:
            known[t] = known[p]
            if known[t]:
                self.hot.add(t)

    def features(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """For each text, of its sentences that resemble any landmark: the best kernels there, then what the text's other units add."""
        lower = [(t or "").lower() for t in texts]
        spaced = [bool(_RUN.search(t)) for t in lower]
        tokens = [set(t.split()) for t in lower]
        every: set[str] = set()
        for t, text, own in zip(spaced, lower, tokens, strict=True):
            every |= own
            if t:
                every.update(u for s in sentences(text) for u in runs(s))
        self.learn(every)
        out, m = [], len(self.strings)
        for t, text, own in zip(spaced, lower, tokens, strict=True):
            rows: list[np.ndarray] = []
            hot = own & self.hot
            units = {plain(u): self.known[u] for u in hot}
            if t or hot:
                # a token that ends a sentence has lost its marks there
                hits_of = {x: self.known[u] for u in hot for x in (u, u.rstrip(".!?"), plain(u))}
                for s in sentences(text):
                    here = s.split()
                    hits = [h for u in here if u in hits_of for h in hits_of[u]] if not hits_of.keys().isdisjoint(here) else []
                    if t:
                        found = {u: self.known[u] for u in runs(s)}
                        units |= found
                        hits += [h for some in found.values() for h in some]
                    if hits:
                        row = np.zeros(2 * m, np.float32)
                        for l, v in hits:
                            row[l] = max(row[l], v)
                        rows.append(row)
            if len(units) > 1 and rows:
                at = [l for some in units.values() for l, _ in some]
                near = np.array([v for some in units.values() for _, v in some]) ** SHARPEN
                total, most = np.bincount(at, near, m), np.zeros(m)
                np.maximum.at(most, at, near)
                rest = np.minimum(total - most, MORE)
                for row in rows:
                    row[m:] = rest
            out.append(rows)
        return out


class Svm:
    """Linear machine on Nystroem features: weights on landmark kernels, an offset, and a logistic scale."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = Landmarks(landmarks)
        m = len(landmarks)
        self.beta, self.offset, self.scale = np.zeros(2 * m), -1.0, (4.0, 0.0)
        if m:
            i, j = np.divmod(np.arange(m * m), m)
            own = self.landmarks.own
            gram = (_paired(self.landmarks.codes, self.landmarks.codes, i, j).astype(float) ** POWER / (own[i].astype(float) * own[j]) ** POWER).reshape(m, m)
            weight = 1 / np.sqrt(np.diag(gram))  # kernels with landmarks are scaled by the landmark's own
            gram *= weight[:, None] * weight[None]
            values, vectors = np.linalg.eigh((gram + gram.T) / 2)
            keep = values > 1e-3 * values.max()
            self.map = vectors[:, keep] / np.sqrt(values[keep])
        else:
            self.map = np.zeros((0, 0))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.stack(rows) @ self.beta + self.offset if rows else np.zeros(0)

    def fit(self, bags: list[list[np.ndarray]], label: np.ndarray, rounds: int = 4, penalty: float = 1.0) -> Svm:
        """Multiple-instance training: Newton steps on the squared hinge loss, then new witnesses of toxic texts."""
        m = len(self.landmarks.strings)
        empty = np.zeros(2 * m, np.float32)
        positive = [b or [empty] for b, y in zip(bags, label, strict=True) if y]
        negative = [r for b, y in zip(bags, label, strict=True) if not y for r in (b or [empty])]
        if not positive or not negative or not m:
            self.offset = 1.0 if positive and not negative else -1.0
            return self
        witness = [max(b, key=lambda r: float(r.sum())) for b in positive]
        for _ in range(rounds):
            x = np.stack(witness + negative)
            x = np.hstack([x[:, :m] @ self.map.astype(np.float32), x[:, m:] @ self.map.astype(np.float32), np.ones((len(x), 1), np.float32)])
            y = np.concatenate([np.ones(len(witness)), -np.ones(len(negative))])
            ridge = np.diag(np.append(np.full(x.shape[1] - 1, penalty), 1e-3))
            w, active = np.zeros(x.shape[1]), np.ones(len(y), bool)
            for _ in range(50):
                a = x[active]
                w = np.linalg.solve(ridge + 2 * (a.T @ a).astype(float), 2 * (a.T @ y[active].astype(np.float32)).astype(float))
                now = y * (x @ w) < 1
                if (now == active).all():
                    break
                active = now
            r = self.map.shape[1]
            self.beta, self.offset = np.concatenate([self.map @ w[:r], self.map @ w[r:-1]]), float(w[-1])
            witness = [bag[int(self.margins(bag).argmax())] for bag in positive]
        best = np.array([max(self.margins(b).max(initial=-np.inf), self.offset) for b in bags])
        # logistic scale of the margins (Platt), by Newton steps, with both classes weighing the same
        target = np.where(label, (label.sum() + 1) / (label.sum() + 2), 1 / ((~label).sum() + 2))
        share = np.where(label, (~label).sum() / label.sum(), 1.0)
        a, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * best + c, -30, 30)))
            d, h = share * (p - target), share * np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(h * best * best).sum() + 1e-3, (h * best).sum()], [(h * best).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(d * best).sum() + 1e-3 * a, d.sum()])
            a, c = a - step[0], c - step[1]
            if abs(step).max() < 1e-6:
                break
        self.scale = (float(a), float(c))
        return self

    def score(self, bags: list[list[np.ndarray]]) -> np.ndarray:
        """A text's score is that of its most toxic sentence; one that resembles no landmark has the offset's."""
        best = np.array([max(self.margins(b).max(initial=-np.inf), self.offset) for b in bags])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * best + self.scale[1], -30, 30)))


def _bounded(labelled: DataFrame, max_texts: int) -> DataFrame:
    """About ``max_texts`` hash-chosen texts of each label."""
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not counts:
        return labelled
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, int(min(1.0, max_texts / n) * unit))])
    return labelled.where(F.pmod(F.xxhash64("text"), F.lit(unit)) <= F.element_at(share, F.col("toxic")))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_texts: int = MAX_TEXTS) -> DataFrame:
    """(text, toxic) of about ``max_texts`` hash-chosen labelled ids of each label, written once.

    Ids are chosen before any text moves; the chosen ones, at most four times ``max_texts``, are
    broadcast, so texts are read in place. Null ids and labels are left out.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("boolean").alias("toxic")).where("id is not null and toxic is not null")
    chosen = _bounded(rows.withColumn("text", F.col("id").cast("string")), max_texts).select("id", "toxic").limit(4 * max_texts)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return staged(texts.join(F.broadcast(chosen), "id").select("text", "toxic"))


def _apart(strings: list[str], most: int, near: float = 0.5) -> list[str]:
    """The first strings of which none resembles an earlier one."""
    chosen: list[str] = []
    everyone = codes(strings, WIDTH)
    own = _paired(everyone, everyone, np.arange(len(strings)), np.arange(len(strings)))
    taken: list[int] = []
    for k in range(len(strings)):
        if len(chosen) == most:
            break
        if taken:
            t = np.array(taken)
            if (_paired(everyone, everyone, np.full(len(t), k), t) / np.sqrt(own[k] * own[t])).max() > near:
                continue
        taken.append(k)
        chosen.append(strings[k])
    return chosen


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", landmarks: int = LANDMARKS, max_texts: int = MAX_TEXTS) -> Svm:
    """Train on a bounded sample of rows with text and label 0 or 1; without both labels the answer is constant."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("boolean").alias("toxic")).where("text is not null and toxic is not null")
    rows = _bounded(rows, max_texts)

    def bags(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        unit, label, several = [], [], []
        for t, y in zip(texts, toxic, strict=True):
            whole = {u for x in set((t or "").lower().split()) if ORDER < len(u := plain(x)) <= WIDTH}
            own = dict.fromkeys(whole, 0)
            for u in whole:
                for n in BEGINNINGS:
                    if len(u) >= n:
                        own[u[:n]] = own.get(u[:n], 0) + 1
            unit += own
            label += [y] * len(own)
            several += [n > 1 for n in own.values()]
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(label, pa.bool_()), pa.array(several, pa.bool_())], names=["unit", "toxic", "several"])

    found = arrow_map(rows, bags, "unit string, toxic boolean, several boolean")
    in_toxic, in_other = F.col("toxic"), ~F.col("toxic")
    seen = found.groupBy("unit").agg(*[F.count_if(side & more).alias(name) for name, side, more in (("p1", in_toxic, F.lit(True)), ("n1", in_other, F.lit(True)), ("p2", in_toxic, F.col("several")), ("n2", in_other, F.col("several")))])
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = total.get(True, 0), total.get(False, 0)
    if not pos or not neg:
        model = Svm([])
        model.offset = 1.0 if pos else -1.0
        return model
    # how much a unit, or several different units that begin with it, tells of toxic texts; chance alone tells less
    told = F.lit(0.0)
    for k in "12":
        p, n = F.col(f"p{k}") / pos, F.col(f"n{k}") / neg
        one = F.col(f"p{k}") * F.log((p + 0.5 / pos) / (n + 0.5 / neg))
        told = F.greatest(told, F.when((one >= EVIDENCE) & (p > 4 * n), one).otherwise(0.0))
    ranked = seen.select("unit", told.alias("told")).where("told > 0").orderBy(F.desc("told"), "unit").limit(8 * landmarks).collect()
    chosen = _apart([r["unit"] for r in ranked], landmarks)
    model = Svm(chosen)

    def featured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bags = model.landmarks.features(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b"".join(r.tobytes() for r in b) for b in bags], pa.binary())], names=["toxic", "rows"])

    found = arrow_map(rows, featured, "toxic boolean, rows binary").toArrow()  # the bounded sample's few rows
    bags_of = sorted(zip(found.column("toxic").to_pylist(), found.column("rows").to_pylist(), strict=True))
    return model.fit([list(np.frombuffer(b, np.float32).reshape(-1, 2 * len(chosen))) for _, b in bags_of], np.array([y for y, _ in bags_of], bool))


def score_toxicity(docs: DataFrame, model: Svm, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns named in ``keep`` and score (0 to 1) for each row of ``docs``.

    Null and empty texts get the score of a text that resembles no landmark. Ids may repeat or be null.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = model.score(model.landmarks.features(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(scores)], names=["id", *keep, "score"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in keep])
    return arrow_map(base, run, base.drop("text").withColumn("score", F.lit(0.0)).schema).withColumnRenamed("id", id_col)
