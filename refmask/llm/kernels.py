"""Numpy helpers for Arrow batches of texts: words, their hashes, and sums by document.

A text is handled as its UTF-8 bytes. White space is the six ASCII characters of the word rule, so cutting bytes and
cutting characters give the same words. Hashes have 64 bits and are the same on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
PIECE_BYTES = 1 << 21
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)
_state: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values() -> np.ndarray:
    if "bytes" not in _state:
        _state["bytes"] = mix(np.arange(1, 257, dtype=U) * U(_STEP))
    return _state["bytes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2**64."""
    if len(_state.get("powers", ((),))[0]) < n:
        up, down = np.full(n, _STEP, U), np.full(n, _INVERSE, U)
        up[0] = down[0] = 1
        _state["powers"] = np.cumprod(up), np.cumprod(down)
    return _state["powers"]


def separators(which: str) -> np.ndarray:
    """Which bytes stand between words: ``spaces``, or ``marks`` for all ASCII but letters and digits."""
    if which not in _state:
        out = np.zeros(256, bool)
        for b in range(128):
            out[b] = b in (9, 10, 11, 12, 13, 32) if which == "spaces" else not chr(b).isalnum()
        _state[which] = out
    return _state[which]


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def pieces(texts: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts, of so many bytes and rows at most; a longer text is a
    run of its own, a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(int(np.searchsorted(at, at[lo] + most, side="right")) - 1, lo + most_rows))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the stretches without separators."""
    inside = ~separator[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    edge = offsets[1:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[edge] = True
    ends = np.flatnonzero(inside & (~after[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(byte_values()[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def runs(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in sequence within a row, and where each begins."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    total = np.full(len(first), (k * 0xD6E8FEB86659FD93) % (1 << 64), U)
    for j in range(k):
        total = mix(total + hashes[first + j])
    return total, first


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value for each byte, by row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
