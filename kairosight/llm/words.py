"""Vectorised word, line and shingle hashing over Arrow text columns.

A word is a maximal run of bytes outside space and 0x09-0x0D.  Its 64-bit hash is a
polynomial with random byte values modulo 2^64, taken from one running sum over the
whole buffer, then mixed.  Two different words meet with a chance of about 2^-63.
Work is done in pieces of bounded size that end at white space, so that one very long
text needs no more memory than many short ones beyond eight bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import runtime

U = np.uint64
#: An odd base with base-1 = 2 mod 4, so that swapped bytes keep 63 bits of difference.
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}
runtime.remembers(_powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), U(base))
        have[0] = U(1)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = PIECE):
    """Slices of a batch with about `limit` bytes of text each (one row at least)."""
    _, offsets = column(batch, name)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """Words of some texts, in order: `first[d]:first[d+1]` are those of text d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of pieces: text ends where possible, else white space, else wherever a word ends."""
    cuts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                text_end = int(offsets[k + 1])
                back = np.flatnonzero(SPACE[data[at:end]])
                if len(back) and back[-1] > 0:
                    end = at + int(back[-1])
                else:
                    end = text_end
                    for probe in range(at + PIECE, text_end, PIECE):
                        ahead = np.flatnonzero(SPACE[data[probe : probe + PIECE]])
                        if len(ahead):
                            end = min(text_end, probe + int(ahead[0]))
                            break
        cuts.append(end)
        at = end
    return cuts


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> Words:
    """All words of the texts; fold: A-Z hash like a-z."""
    values = _FOLDED if fold else _VALUES
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    hashes, starts, ends, at = [], [], [], 0
    for end in _cuts(data, offsets):
        part = data[at:end]
        solid = ~SPACE[part]
        begins, closes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[at + 1 : end]
        closes[:-1] &= ~solid[1:] | edge[at + 1 : end]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        hashes.append(spans(part, s, e, values))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offsets))


def spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Hashes of data[s:e] for each pair."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, len(data)), out=total[1:])
    h = total[e]
    h -= total[s]
    h *= _power(_INVERSE, len(data) + 1)[s]
    h += (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h)


def _factor(i: int) -> np.uint64:
    return U((0xA0761D6478BD642F * (2 * i + 1) + 0xE7037ED1A0B428DA * i * i) & ((1 << 64) - 1) | 1)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and the index of the first word of each."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        h += w.hash[i : total - n + 1 + i] * _factor(i)
    last = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(total - n + 1) + n <= last[: total - n + 1])
    return mix(h[at]), at


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as (text, hash), ordered by text; a shorter text is one shingle."""
    h, at = windows(w, n)
    counts = np.diff(w.first)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.full(len(short), U(0x5851F42D4C957F2D)) * counts[short].astype(np.uint64)
        for i in range(n - 1):
            has = counts[short] > i
            whole[has] += w.hash[w.first[short[has]] + i] * _factor(i)
        h, doc = np.concatenate([h, mix(whole)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]
