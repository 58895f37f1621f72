"""BPE encoding and decoding as streaming transducers.

Encoding keeps, for each prefix of a piece, the last token of that prefix's encoding. It is the one
token whose pair with the last token before it survives the merges unchanged, since a sequence is a
BPE encoding exactly if all its neighbouring pairs are. A token is emitted once it is stable: once
every prefix that a future token could still follow has it in its chain. A difference travels to the
left only from merge to later merge over a shared operand, so the longest such chain of the merge
list (``lookahead``) is sufficient, and a long piece is encoded in constant memory.

Decoding is a state machine from token to text: whole characters leave as soon as their bytes are
there, and an incomplete or wrong byte sequence becomes U+FFFD.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import arrow_map

#: A tokenizer file is broadcast; larger ones are refused.
MAX_FILE = 64 << 20
#: Words whose tokens a worker remembers before it starts afresh.
MEMORY = 100_000
#: White space of Unicode; str.split() takes four control characters more.
_WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_CONTROL = re.compile("[\\x1c-\\x1f]")
#: Longer pieces are streamed.
SHORT = 64
#: Characters of the texts whose words are looked up together.
GROUP = 4 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """A word-end BPE tokenizer read from the text of its JSON file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.rank = {(m[0], m[1]): k for k, m in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(len(t.removesuffix(self.end)) if t != self.end else len(t) for t in self.ids)
        self.lookahead = sufficient_lookahead(list(self.rank), self.end)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.letters = byte_letters()
        self.table = dict(enumerate(self.letters))
        of = {c: b for b, c in enumerate(self.letters)}

        def spelled(i: int) -> bytes | None:
            name = self.names.get(i)
            if name is None or i in self.special.values():
                return name and name.encode()
            closes = bool(self.end) and name.endswith(self.end)
            return bytes(of[c] for c in (name[: -len(self.end)] if closes else name)) + b" " * closes

        every = range(max(self.names) + 1)
        named = [self.names.get(i) for i in every]
        #: What a token decodes to: its bytes, or (True) its name.
        self.pieces = {False: pa.array([spelled(i) for i in every], pa.binary()), True: pa.array([n and n.encode() for n in named], pa.binary())}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._spines: dict[tuple[str, bool], list] = {}
        self._before: tuple[str, list] = ("", [None])
        self._marks: dict[str, list[int]] = {}
        self._words: dict[str | int, bytes] = {}

    # the merges themselves, for one token or two

    def merged(self, symbols: list[str]) -> list[str]:
        """Apply the merges to a short list of symbols: lowest rank first, leftmost of equal ones."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 60:
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def stands(self, token: str) -> bool:
        """Whether the token's own symbols merge to it."""
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = token in self.ids and self.merged(self._symbols(token)) == [token]
        return found

    def _spine(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """The symbols at one edge of a token while it is merged: (symbol, rank of its birth, rank of its end)."""
        found = self._spines.get((token, right))
        if found is None:
            found, symbols, edge, born = [], self._symbols(token), -1 if right else 0, -1
            while len(symbols) > 1:
                ranks = [self.rank[p] if p in self.rank else 1 << 60 for p in zip(symbols, symbols[1:])]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if k == (len(ranks) - 1 if right else 0):
                    found.append((symbols[edge], born, ranks[k]))
                    born = ranks[k]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            found.append((symbols[0], born, 1 << 60))
            self._spines[token, right] = found
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether b stands and stays apart from a when their symbols are merged together.

        They do stay apart unless a symbol at a's right edge and one at b's left edge are there at the same
        time and their merge comes before either's own next one (of equal ranks the left one first).
        """
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > MEMORY:
                self._pairs.clear()
            rank, found = self.rank, self.stands(b)
            for x, born, ends in self._spine(a, True):
                for y, since, until in self._spine(b, False):
                    r = rank.get((x, y))
                    if r is not None and born < r < ends and since < r <= until:
                        found = False
            self._pairs[a, b] = found
        return found

    def last_token(self, text: str, last: list, until: int, suffix: str = "", inside: bool = False) -> str:
        """The last token of text[:until]'s encoding, given those of all shorter prefixes.

        inside: the text continues an earlier one, whose last token is last[0].
        """
        ids, pairs = self.ids, self._pairs
        for start in range(until - 1, max(-1, until - self.longest - 1), -1):  # one token fits; most are short
            token = text[start:until] + suffix
            if token in ids:
                before = last[start]
                if before is None:
                    if not start and not inside and self.stands(token):
                        return token
                else:
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.follows(before, token):
                        return token
        raise ValueError(f"no token ends here: {text[max(0, until - 40):until]!r}")

    def encode_piece(self, text: str) -> list[int]:
        """The ids of one piece of letters."""
        if len(text) > SHORT:
            stream = Stream(self)
            return stream.feed(text) + stream.close()
        before, last = self._before  # what the piece shares with the one before needs no new work
        n, most = 0, min(len(text), len(last)) - 1
        while n < most and before[n] == text[n]:
            n += 1
        del last[n + 1 :]
        for until in range(n + 1, len(text)):
            last.append(self.last_token(text, last, until))
        self._before = (text, last)
        token = self.last_token(text, last, len(text), self.end)
        at, names = len(text) - (len(token) - len(self.end)), [token]
        while at > 0:
            names.append(last[at])
            at -= len(last[at])
        return [self.ids[t] for t in reversed(names)]

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self._words.clear()
        self._pairs.clear()
        self._marks.clear()
        self._before = ("", [None])

    # texts

    def words(self, text: str) -> list[str | int]:
        """White-space separated normalised words; a special token's id where its string stands."""
        if text.isascii() and "<" not in text and not _CONTROL.search(text):
            return text.lower().split()
        out: list[str | int] = []
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ")  # letter by letter: no final sigma
            if _CONTROL.search(part):
                out += [w for w in _WHITE.split(part.lower()) if w]
            else:
                out += part.lower().split()
        return out

    def encode_word(self, word: str) -> list[int]:
        if word.isalpha():  # letters only are one piece
            pieces = [word if word.isascii() else word.encode().decode("latin-1").translate(self.table)]
        elif word.isascii() and word.isprintable():
            pieces = self.piece.findall(word)
        else:  # code points that are not assigned yet count as neither letters nor digits
            shape = "".join(["\ufffe" if category(c) == "Cn" else c for c in word])
            pieces = ["".join([self.letters[b] for b in word[m.start() : m.end()].encode()]) for m in self.piece.finditer(shape)]
        ids: list[int] = []
        for piece in pieces:
            if len(piece) < 3:
                found = self._marks.get(piece)
                if found is None:
                    found = self._marks[piece] = self.encode_piece(piece)
                ids += found
            else:
                ids += self.encode_piece(piece)
        return ids

    def encode_many(self, texts: list[str | None]) -> Iterator[tuple[bytes, int]]:
        """Each text's ids as little-endian 32-bit integers, and how many; words new to a group are encoded in order."""
        group, size = [], 0
        for t in texts:
            group.append(self.words(t or ""))
            size += len(t or "")
            if size > GROUP:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list]) -> Iterator[tuple[bytes, int]]:
        known = self._words
        if len(known) >= MEMORY:
            known.clear()
        found: set = set()
        for words in group:
            found.update(words)
        new = found - known.keys()
        for word in sorted(new, key=str) if any(isinstance(w, int) for w in new) else sorted(new):
            ids = [word] if isinstance(word, int) else self.encode_word(word)
            known[word] = array("i", ids).tobytes()
        for words in group:
            coded = b"".join(map(known.__getitem__, words))
            yield coded, len(coded) // 4


class Decoder:
    """Incremental byte-to-text state machine: ids in any portions, complete characters out; an incomplete end waits.

    Its output alphabet is either the tokens' bytes, where word ends become spaces (the text), or the
    tokens' names with spaces between, as a tokenizer file without a decoder gives them.
    """

    def __init__(self, bpe: Bpe, names: bool = False) -> None:
        self.pieces = bpe.pieces[names]
        self.between = b" " if names else b""
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def _bytes(self, lists: pa.ListArray) -> pa.Array:
        values = lists.flatten()
        if len(values) and (pc.min(values).as_py() < 0 or pc.max(values).as_py() >= len(self.pieces)):
            raise ValueError("an id is outside the vocabulary")
        return pc.binary_join(pa.ListArray.from_arrays(_offsets(lists), self.pieces.take(values)), self.between)

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = self._bytes(pa.array([ids], pa.list_(pa.int32())))[0].as_py()
        raw, self.started = (self.between if self.started else b"") + raw, True
        return self.state.decode(raw)

    def close(self) -> str:
        """What is left, and the machine starts afresh."""
        self.started = False
        out = self.state.decode(b"", final=True)
        self.state.reset()
        return out

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Each list's text, one after the other through the same machine."""
        step = self.state.decode
        return pa.array([step(x, final=True) for x in self._bytes(lists.fill_null([])).to_pylist()], pa.string())


class Stream:
    """The transducer of one piece: feed() its letters in any portions, then close()."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.letters, self.last = bpe, "", [None]
        self.inside = False  # whether something was emitted; last[0] is then its last token

    def _chain(self, until: int) -> list[int]:
        """The token ends of the prefix's encoding, back to where emission stands."""
        ends = [until]
        while until > 0:
            until -= len(self.last[until])
            ends.append(until)
        return ends[::-1]

    def feed(self, letters: str) -> list[int]:
        """Take letters; give the ids that became stable. The newest letter waits: it may end the piece."""
        out: list[int] = []
        for at in range(0, len(letters), 1024):
            self.letters += letters[at : at + 1024]
            for until in range(len(self.last), len(self.letters)):
                self.last.append(self.bpe.last_token(self.letters, self.last, until, inside=self.inside))
            if len(self.letters) > self.bpe.lookahead + self.bpe.longest:
                out += self._emit()
        return out

    def _emit(self) -> list[int]:
        """Emit what all prefixes share that a future token can follow: the last ``longest`` ones."""
        n = len(self.last) - 1
        shared = set(self._chain(n))
        for k in range(max(1, n - self.bpe.longest), n):
            shared &= set(self._chain(k))
        stable = max(shared)
        ids = [self.bpe.ids[self.last[e]] for e in self._chain(n) if 0 < e <= stable]
        if stable:  # the last stable token stays as the left neighbour of what follows
            self.letters, self.last, self.inside = self.letters[stable:], self.last[stable:], True
        return ids

    def close(self) -> list[int]:
        """The last letter carries the word end; everything left is stable now."""
        if not self.letters:
            return []
        n = len(self.letters)
        token = self.bpe.last_token(self.letters, self.last, n, self.bpe.end, self.inside)
        at, names = n - (len(token) - len(self.bpe.end)), [token]
        while at > 0:
            names.append(self.last[at])
            at -= len(self.last[at])
        return [self.bpe.ids[t] for t in reversed(names)]


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """How many letters behind the reading head an encoding can still change.

    A later letter changes a merge (x, y) at the head; then a merge (c, x) or (c, xy) of higher rank
    may happen or not, and so on to the left. The longest chain of rising ranks is the answer.
    """

    def size(token: str) -> int:
        return len(token[: -len(end)]) if end and token.endswith(end) else len(token)

    left: dict[str, int] = {}  # by right operand: the longest chain among the merges of higher rank
    most = 1
    for x, y in reversed(merges):
        chain = size(x) + max(left.get(x, 0), left.get(x + y, 0))
        most = max(most, chain + size(y))
        left[y] = max(left.get(y, 0), chain)
    return most


_LOADED: dict[str, Bpe] = {}


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).astype(np.int32))


def _shared(spark, path: str):
    """A function that gives the tokenizer in a worker; the file is read once, by the driver."""
    with open(path, encoding="utf-8") as f:
        source = f.read(MAX_FILE + 1)
    if len(source) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    sent, name = spark.sparkContext.broadcast(source), uuid.uuid4().hex

    def load() -> Bpe:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Bpe(sent.value)
        return _LOADED[name]

    return load


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", keep: tuple[str, ...] = (), decoded_col: str | None = None, as_text: bool = False) -> DataFrame:
    """(id, the columns named in keep, ids) for each row: the whole text's token ids; null and empty texts have none.

    Strings of special tokens become their ids. Characters that Unicode assigned after Python's own
    tables were made count as neither letters nor digits. ``decoded_col`` adds what decode_ids gives
    (with ``as_text`` too), in the same pass, so ids need not travel twice. Ids may repeat or be null; other columns are not read.
    """
    load = _shared(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = load()
        coded = list(bpe.encode_many(batch.column(1).to_pylist()))
        offsets = np.concatenate(([0], np.cumsum([n for _, n in coded]))).astype(np.int32)
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(b for b, _ in coded))])
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, *keep, out_col])

    def run_both(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(), names=not as_text)
        for coded in run(batch):
            yield pa.RecordBatch.from_arrays([*coded.columns, decoder.decode(coded.column(coded.num_columns - 1))], names=[*coded.schema.names, decoded_col])

    base = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = base.drop("_text").withColumn(out_col, F.array(F.lit(0)))
    if decoded_col is None:
        return arrow_map(base, run, schema.schema, after=lambda: load().forget())
    return arrow_map(base, run_both, schema.withColumn(decoded_col, F.lit("")).schema, after=lambda: load().forget())


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", as_text: bool = False) -> DataFrame:
    """``coded`` with the decoded string added: token names with spaces between, or with as_text the text itself.

    Null ids decode to an empty string; an id outside the vocabulary is an error.
    """
    load = _shared(coded.sparkSession, path)
    columns = [c for c in coded.columns if c != out_col]
    coded = coded.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = Decoder(load(), names=not as_text).decode(batch.column(at))
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out_col])

    schema = coded.withColumn(out_col, F.lit("")).schema
    return arrow_map(coded, run, schema)
