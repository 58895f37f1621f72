"""Vectorised hashing of words and word shingles over the UTF-8 bytes of many texts at once.

A word's hash is a polynomial in an odd base modulo 2**64 over random byte values, mixed at the
end; word hashes of a chunk are differences of one running sum, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE, np.uint8))
_VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        _POWERS[base] = np.concatenate((np.ones(1, np.uint64), np.full(n + CHUNK // 8, base, np.uint64))).cumprod(dtype=np.uint64)
    return _POWERS[base][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, with a seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    """(text index, piece); a long text is cut at white space, so a piece has about CHUNK bytes unless one word is longer."""
    for k, t in enumerate(texts):
        start, t = 0, t or b""
        while len(t) - start > CHUNK:
            end = start + CHUNK
            while end < len(t) and not _IS_SPACE[t[end]]:
                end += 1
            yield k, t[start:end]
            start = end
        yield k, t[start:] if start else t


def _hash_chunk(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the pieces in order, and how many words each piece has."""
    joined = b"\n".join(pieces) + b"\n"
    raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
    space = np.concatenate(([True], _IS_SPACE[raw]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _powers(_BASE_INVERSE, len(raw))[starts])
    edges = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces])))
    return hashes, np.diff(np.searchsorted(starts, edges))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and the word count of each text."""
    counts = np.zeros(len(texts), np.int64)
    out, owners, pieces, size = [], [], [], 0

    def flush() -> None:
        if pieces:
            hashes, n = _hash_chunk(pieces)
            out.append(hashes)
            np.add.at(counts, owners, n)

    for k, piece in _pieces(texts):
        owners.append(k)
        pieces.append(piece)
        size += len(piece)
        if size >= CHUNK:
            flush()
            owners, pieces, size = [], [], 0
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles.

    A text with fewer words has its whole word sequence as the only one; no words, none.
    """
    words, counts = word_hashes(texts)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):  # position i gets the polynomial of words i..i+n-1
        rolled[: len(words) - k] += words[k:] * np.uint64(pow(_BASE, k + 1, 2**64))
    rolled = mix(rolled, n)
    found, at = [], 0
    for c in counts.tolist():
        if c >= n:
            found.append(np.unique(rolled[at : at + c - n + 1]))
        elif c:
            whole = sum(int(w) * pow(_BASE, k + 1, 2**64) for k, w in enumerate(words[at : at + c])) % 2**64
            found.append(mix(np.array([whole], np.uint64), 1000 + c))
        else:
            found.append(np.zeros(0, np.uint64))
        at += c
    return found
