"""Words of many texts at once as Arrow strings and numpy arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_set(chars: bytes) -> np.ndarray:
    """Which of the 256 bytes are in ``chars``."""
    return np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(chars, np.uint8))


def text_slices(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """[from, to) of consecutive texts with about ``most`` bytes; a longer text stands alone."""
    size = np.cumsum([len(t or b"") for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def words_of(texts: list[bytes | None], apart: np.ndarray, ends: np.ndarray | None = None, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, text number of each, piece number of each) of UTF-8 texts.

    Words are maximal runs without a byte of ``apart`` or ``ends``; bytes of ``ends`` also end a
    piece, as does the end of a text. ``lower`` lower-cases A-Z. Null texts have no words.
    """
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    if lower:
        joined = joined.lower()  # of bytes: A-Z only
    raw = np.frombuffer(joined, np.uint8)
    edges = np.cumsum([len(t or b"") + 1 for t in texts]) - 1 if texts else np.zeros(0, np.int64)
    gap = (apart if ends is None else apart | ends)[raw]
    gap[edges] = True
    change = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, stops = change[0::2], change[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    kept = np.ascontiguousarray(raw[~gap])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    text = np.searchsorted(edges, starts, side="right")
    if ends is None:
        return words, text, text
    ending = ends[raw]
    ending[edges] = True
    return words, text, np.cumsum(ending)[starts]
