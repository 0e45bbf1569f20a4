"""Runs of bytes of a kind in Arrow text columns: where they lie and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import words

U = np.uint64


def byte_set(listed: str, spans: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """A mask of 256 bytes: the listed ASCII characters, and closed spans of byte values."""
    mask = np.zeros(256, bool)
    mask[list(listed.encode())] = True
    for low, high in spans:
        mask[low : high + 1] = True
    return mask


def runs(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes of `solid` inside a text, in order."""
    inside = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, closes = inside.copy(), inside
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], A-Z like a-z; in pieces of bounded size, so that a long text needs little more than itself."""
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + words.PIECE)))
        base = start[at]
        out[at:to] = words.spans(data[base : end[to - 1]], start[at:to] - base, end[at:to] - base, words._FOLDED)
        at = to
    return out


def combined(h: np.ndarray, at: np.ndarray, n: int, also: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the n neighbours that start at each place of `at`."""
    total = np.zeros(len(at), np.uint64) + U(also) if isinstance(also, int) else also.copy()
    for i in range(n):
        total += h[at + i] * words._factor(i)
    return words.mix(total)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] as an Arrow string array."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - first[:-1], size) + np.arange(first[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.string())
