"""The log-bilinear network of `lbl_model`: tokens, parameters, steps of noise-contrastive estimation, probabilities.

A token is predicted in at most three steps, each an exactly normalised log-bilinear choice (the sum of context vectors times
the vector of what is chosen, plus a bias):

1. one of the most frequent words, or `unknown`; contexts are the previous word and a coarse class of the one before;
2. for unknown words one of 256 classes by a word's last two bytes, so that words never seen have one too;
3. one of the class's most frequent words, or the rest of the class, which its words share by smoothed counts.

Steps 2 and 3 also see the previous word's own vector where it has one.  Probabilities come from batched matrix products: all
pairs of contexts at once in step 1, blocks of tokens in step 2, the tokens of a class in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import words

END = np.uint64(0x1F83D9ABFB41BD6B)
COLUMNS = 16
CLASSES = 256
SUFFIXES, COARSE_OWN, COARSE_SUFFIX = 512, 32, 64
COARSE = COARSE_OWN + COARSE_SUFFIX + 1
BLOCK = 1 << 12
_LOWER = np.arange(256)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Setting:
    """Sizes and steps of the model."""

    vocabulary: int = 2047
    members: int = 255  # learned words of a class
    least: int = 4  # occurrences of a learned word
    noise: int = 32
    own_noise: int = 2  # within a class
    batch: int = 2048
    rate: float = 0.03
    tail_rate: float = 0.08
    start_tokens: int = 1_500_000  # of the bounded sample from which all shards start
    start_passes: int = 4
    shard_tokens: int = 4_000_000
    together: int = 64  # shards whose changes are averaged at once
    seed: int = 7


def suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number of each word by its last two bytes; its class is what is left modulo CLASSES."""
    last = _LOWER[data[end - 1]]
    before = np.where(end - start > 1, _LOWER[data[np.maximum(end - 2, 0)]], 0)
    return (last * 37 + before * 101) % SUFFIXES


@dataclass
class Head:
    """The most frequent training words, sorted by hash: count, output of step 1 (0: unknown) and leaf of step 3 (0: none).

    Leaf base[k] is the rest of class k; its learned words follow.  mass: smoothed counts of the leaves.
    """

    hash: np.ndarray
    count: np.ndarray
    index: np.ndarray
    leaf: np.ndarray
    base: np.ndarray
    mass: np.ndarray
    n: int
    distinct: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == h, at, -1)

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.distinct + 1)


def head_of(h: np.ndarray, count: np.ndarray, own_class: np.ndarray, by_class: np.ndarray, n: int, distinct: int, setting: Setting) -> Head:
    """h: hashes as bigint, count and class of the most frequent words, in any order; by_class: smoothed counts of all words of each class."""
    h = h.view(np.uint64)
    by = np.lexsort((h, -count, h != END))  # the end first, then the most frequent
    h, count, own_class, place = h[by], count[by], own_class[by], np.arange(len(h))
    flat = place < setting.vocabulary
    rest = by_class + 0.5 - np.bincount(own_class[flat], count[flat] + 0.5, CLASSES)
    tail = np.flatnonzero(~flat & (count >= setting.least))
    tail = tail[np.argsort(own_class[tail], kind="stable")]  # most frequent first in each class
    k = own_class[tail]
    nth = np.arange(len(k)) - np.searchsorted(k, k)
    tail, k, nth = (x[nth < setting.members] for x in (tail, k, nth))
    base = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=CLASSES) + 1)])
    leaf = np.zeros(len(h), np.int64)
    leaf[tail] = base[k] + 1 + nth
    mass = np.zeros(base[-1])
    mass[leaf[tail]] = count[tail] + 0.5
    mass[base[:-1]] = np.maximum(rest - np.bincount(k, count[tail] + 0.5, CLASSES), 0.5)
    order = np.argsort(h)
    return Head(h[order], count[order], np.where(flat, place + 1, 0)[order], leaf[order], base, mass, n, distinct)


class Tokens:
    """Tokens of some texts: each text's words, then the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, head: Head, setting: Setting):
        w = words.words(data, offsets, fold=True)
        n_docs = len(offsets) - 1
        self.first = w.first + np.arange(n_docs + 1)
        total = int(self.first[-1])
        is_end = np.zeros(total, bool)
        is_end[self.first[1:] - 1] = True
        self.hash = np.full(total, END)
        self.hash[~is_end] = w.hash
        suffix = np.zeros(total, np.int64)
        suffix[~is_end] = suffixes(data, w.start, w.end)
        self.own_class = suffix % CLASSES
        each, back = np.unique(self.hash, return_inverse=True)
        self.row = head.find(each)[back]
        there = self.row >= 0
        self.out, self.leaf = np.zeros(total, np.int64), head.base[self.own_class]
        self.out[there] = head.index[self.row[there]]
        own = head.leaf[self.row[there]]
        self.leaf[there] = np.where(own > 0, own, self.leaf[there])
        size = setting.vocabulary + 1
        fine = np.where(self.out > 0, self.out, size + suffix)
        coarse = np.where((self.out > 0) & (self.out < COARSE_OWN), self.out, COARSE_OWN + suffix % COARSE_SUFFIX)
        begin = np.zeros(total, bool)
        begin[self.first[:-1]] = True
        self.one = np.empty(total, np.int64)
        self.two = np.empty(total, np.int64)
        self.own = np.zeros(total, np.int64)  # the leaf of the previous word; 0 stands for those without a vector of their own
        if total:
            self.one[1:] = fine[:-1]
            self.one[begin] = size + SUFFIXES
            self.two[2:] = coarse[:-2]
            self.two[begin] = COARSE - 1
            self.two[np.minimum(self.first[:-1] + 1, total - 1)] = COARSE - 1
            self.own[1:] = np.where((self.out[:-1] == 0) & (self.leaf[:-1] != head.base[self.own_class[:-1]]), self.leaf[:-1], 0)
            self.own[begin] = 0


class Model:
    """Tables of parameters by name; rows of each are what one context or choice has, a choice's bias last."""

    def __init__(self, head: Head, setting: Setting):
        rng = np.random.Generator(np.random.PCG64(setting.seed))
        self.head, self.setting = head, setting
        size, leaves = setting.vocabulary + 1, int(head.base[-1])
        known = np.bincount(head.index, head.count + 0.5, size)
        known[0] = max(head.total - known[1:].sum(), 0.5)
        known = np.maximum(known, 0.25)
        self.unigram = known / known.sum()
        self.classes = np.add.reduceat(head.mass, head.base[:-1])
        self.within = head.mass / np.repeat(self.classes, np.diff(head.base))  # of a leaf in its class
        self.classes = self.classes / self.classes.sum()
        draw = lambda rows: rng.normal(0, 0.1, (rows, COLUMNS)).astype(np.float32)
        with_bias = lambda v, p: np.concatenate([v, np.log(p).astype(np.float32)[:, None]], 1)  # noqa: E731  the last column
        self.tables = {
            "one": draw(size + SUFFIXES + 1), "two": draw(COARSE), "out": with_bias(draw(size), self.unigram),
            "tail_one": draw(size + SUFFIXES + 1), "tail_two": draw(COARSE), "tail_own": np.zeros((leaves, COLUMNS), np.float32),
            "class": with_bias(draw(CLASSES), self.classes), "leaf": with_bias(np.zeros((leaves, COLUMNS), np.float32), self.within),
        }

    def normalisers(self) -> np.ndarray:
        """Step 1: log of the sum over outputs of exp(score), for every pair of contexts."""
        t = self.tables
        z = np.empty((len(t["one"]), len(t["two"])))
        out, bias = t["out"][:, :COLUMNS], t["out"][:, COLUMNS]
        top = bias + t["one"] @ out.T
        for j, v in enumerate(t["two"]):
            s = top + out @ v
            m = s.max(1, keepdims=True)
            z[:, j] = m[:, 0] + np.log(np.exp(s - m).sum(1, dtype=np.float64))
        return z

    def log_probability(self, x: Tokens, z: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's choices after its context."""
        t = self.tables
        own = np.empty(len(x.out))
        for at in range(0, len(own), BLOCK):
            i = slice(at, at + BLOCK)
            v = t["out"][x.out[i]]
            own[i] = np.einsum("ij,ij->i", t["one"][x.one[i]] + t["two"][x.two[i]], v[:, :COLUMNS]) + v[:, COLUMNS] - z[x.one[i], x.two[i]]
        tail = np.flatnonzero(x.out == 0)
        tail = tail[np.argsort(x.own_class[tail], kind="stable")]
        k = x.own_class[tail]
        more = np.empty(len(tail))
        q = np.ones((BLOCK, COLUMNS + 1), np.float32)  # its last column meets the biases
        for at in range(0, len(tail), BLOCK):
            i, ks = tail[at : at + BLOCK], k[at : at + BLOCK]
            n = len(i)
            q[:n, :COLUMNS] = t["tail_one"][x.one[i]]
            q[:n, :COLUMNS] += t["tail_two"][x.two[i]]
            q[:n, :COLUMNS] += t["tail_own"][x.own[i]]
            more[at : at + n] = _log_share(q[:n], t["class"], ks)
            cuts = [0, *(np.flatnonzero(np.diff(ks)) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:], strict=False):
                low, high = self.head.base[ks[a]], self.head.base[ks[a] + 1]
                if high - low > 1:
                    more[at + a : at + b] += _log_share(q[a:b], t["leaf"][low:high], x.leaf[i[a:b]] - low)
        own[tail] += more
        return own


def _log_share(q: np.ndarray, v: np.ndarray, right: np.ndarray) -> np.ndarray:
    """log softmax of the right one of v's rows for each row of q."""
    s = q @ v.T
    own = s[np.arange(len(q)), right].astype(np.float64)
    m = 0.0
    if np.sqrt((q * q).sum(1).max() * (v * v).sum(1).max()) > 60:  # exp of float32 ends at 88
        m = s.max(1).astype(np.float64)
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    return own - m - np.log((s @ np.ones(s.shape[1], s.dtype)).astype(np.float64))


def _sigma(x: np.ndarray) -> np.ndarray:
    """The logistic of x, which is overwritten."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Steps of noise-contrastive estimation with Adagrad, a step size for the vector and one for the bias of each row; only rows that a batch meets move."""

    def __init__(self, model: Model, seed: int):
        self.m, self.t, self.tokens = model, {k: v.copy() for k, v in model.tables.items()}, 0
        self.rng = np.random.Generator(np.random.PCG64([model.setting.seed, seed]))
        self.cumulative = [np.cumsum(model.unigram), np.cumsum(model.classes)]
        self.shift = [np.log(model.setting.noise * p).astype(np.float32) for p in (model.unigram, model.classes)]
        self.leaves = np.concatenate([[0], np.cumsum(model.within)])
        self.leaf_shift = np.log(model.setting.own_noise * model.within).astype(np.float32)
        self.met = {k: np.zeros(len(v), np.float32) for k, v in self.t.items()}
        self.squares = {k: np.full((len(v), 2), 1e-2, np.float32) for k, v in self.t.items()}

    def _add(self, name: str, row: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Add the gradients g of these rows, of which some repeat."""
        table, squares = self.t[name], self.squares[name]
        flag = np.zeros(len(table), bool)
        flag[row] = True
        rows = np.flatnonzero(flag)
        small = np.empty(len(table), np.int32)
        small[rows] = np.arange(len(rows), dtype=np.int32)
        at = small[row]
        n = np.bincount(at, minlength=len(rows))
        total = np.empty((len(rows), g.shape[1]), np.float32)
        for j in range(g.shape[1]):
            total[:, j] = np.bincount(at, g[:, j], len(rows))
        total /= np.sqrt(n)[:, None].astype(np.float32)
        for part, columns in enumerate((slice(0, COLUMNS), slice(COLUMNS, None))[: 1 + (g.shape[1] > COLUMNS)]):
            own = total[:, columns]
            squares[rows, part] += np.einsum("ij,ij->i", own, own) / own.shape[1]
            own *= rate / np.sqrt(squares[rows, part])[:, None]
        table[rows] += total
        self.met[name][rows] += n

    def _shared(self, q: np.ndarray, right: np.ndarray, kind: int, name: str, rate: float) -> np.ndarray:
        """A step for choices of one set with noise that the batch shares; the gradient of q, whose last column is one."""
        t = self.t[name]
        noise = np.minimum(np.searchsorted(self.cumulative[kind], self.rng.random(self.m.setting.noise)), len(t) - 1)
        v, u, shift = t[right], t[noise], self.shift[kind]
        g = _sigma(shift[right] - np.einsum("ij,ij->i", q, v))[:, None]
        wrong = _sigma(q @ u.T - shift[noise])
        np.negative(wrong, out=wrong)
        self._add(name, np.concatenate([right, noise]), np.concatenate([g * q, wrong.T @ q]), rate)
        v *= g
        v += wrong @ u
        return v

    def _within(self, q: np.ndarray, right: np.ndarray, k: np.ndarray, rate: float) -> np.ndarray:
        """A step for choices inside classes k, with noise of each token's own class; the gradient of q."""
        base, m = self.m.head.base, self.m.setting.own_noise
        low, high = self.leaves[base[k]], self.leaves[base[k + 1]]
        noise = np.searchsorted(self.leaves, low[:, None] + (high - low)[:, None] * self.rng.random((len(k), m)), "right") - 1
        noise = np.clip(noise, base[k][:, None], base[k + 1][:, None] - 1)
        rows = np.concatenate([right[:, None], noise], 1)
        v = self.t["leaf"][rows]
        s = self.leaf_shift[rows] - np.einsum("ij,ikj->ik", q, v)
        s[:, 1:] *= -1
        g = _sigma(s)
        g[:, 1:] *= -1
        self._add("leaf", rows.ravel(), (g[:, :, None] * q[:, None, :]).reshape(-1, COLUMNS + 1), rate)
        return np.einsum("ik,ikj->ij", g, v)

    def read(self, x: Tokens) -> None:
        """One pass over the tokens, in an order that mixes texts."""
        s, t = self.m.setting, self.t
        q = np.ones((s.batch, COLUMNS + 1), np.float32)
        order = self.rng.permutation(len(x.out))
        for at in range(0, len(order), s.batch):
            i = order[at : at + s.batch]
            one, two, own = x.one[i], x.two[i], q[: len(i)]
            np.add(t["one"][one], t["two"][two], out=own[:, :COLUMNS])
            g = self._shared(own, x.out[i], 0, "out", s.rate)[:, :COLUMNS]
            self._add("one", one, g, s.rate)
            self._add("two", two, g, s.rate)
        order = order[x.out[order] == 0]
        for at in range(0, len(order), s.batch):
            i = order[at : at + s.batch]
            one, two, before, own = x.one[i], x.two[i], x.own[i], q[: len(i)]
            np.add(t["tail_one"][one], t["tail_two"][two], out=own[:, :COLUMNS])
            has = np.flatnonzero(before)
            own[has, :COLUMNS] += t["tail_own"][before[has]]
            k = x.own_class[i]
            g = (self._shared(own, k, 1, "class", s.tail_rate) + self._within(own, x.leaf[i], k, s.tail_rate))[:, :COLUMNS]
            self._add("tail_one", one, g, s.tail_rate)
            self._add("tail_two", two, g, s.tail_rate)
            self._add("tail_own", before[has], g[has], s.tail_rate)
        self.tokens += len(x.out)

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """(block, bytes) of the rows met: blocks of all tables are numbered one after the other."""
        block = 0
        for name, start in self.m.tables.items():
            form = _form(start.shape[1])
            for at in range(0, len(start), BLOCK):
                rows = at + np.flatnonzero(self.met[name][at : at + BLOCK])
                if len(rows):
                    out = np.empty(len(rows), form)
                    out["at"], out["n"], out["x"] = rows - at, self.met[name][rows], self.t[name][rows] - start[rows]
                    yield block, out.tobytes()
                block += 1


def _form(columns: int) -> np.dtype:
    return np.dtype([("at", "<u2"), ("n", "<f4"), ("x", "<f2", (columns,))])


def blocks(model: Model) -> list[tuple[str, int]]:
    """Table and first row of each block."""
    return [(name, at) for name, t in model.tables.items() for at in range(0, len(t), BLOCK)]


def mean_change(parts: list[bytes], columns: int) -> bytes:
    """The mean of the changes of a block's rows, weighted by how often they were met."""
    total, n = np.zeros((BLOCK, columns)), np.zeros(BLOCK)
    for part in parts:
        x = np.frombuffer(part, _form(columns))
        total[x["at"]] += x["x"].astype(np.float64) * x["n"][:, None]
        n[x["at"]] += x["n"]
    at = np.flatnonzero(n)
    out = np.empty(len(at), _form(columns))
    out["at"], out["n"], out["x"] = at, n[at], total[at] / n[at][:, None]
    return out.tobytes()


def load(model: Model, found: list[tuple[int, bytes]]) -> None:
    """Add the mean changes of blocks."""
    where = blocks(model)
    for block, part in found:
        name, at = where[block]
        table = model.tables[name]
        x = np.frombuffer(part, _form(table.shape[1]))
        table[at + x["at"].astype(np.int64)] += x["x"].astype(np.float32)
