"""N-gram Jaccard join by PartEnum signatures.

A text is its set of distinct n-word shingles.  Two texts link when
100 * |A n B| >= percent * |A u B|, that is when they differ in at most
k = (100 - percent) * (|A| + |B|) / (100 + percent) shingles.

Sizes fall into bands wide enough that linked sets lie in one band or in neighbours; the smaller
of two such sets also signs for the band above.  For a band, the domain of shingles is cut into
n1 partitions by hash, each into three parts.  With n1 = k // 2 + 1 + m, at least m + 1 partitions
of a linked pair differ in at most one shingle, so at least one pair of the three parts of each is
equal: the subsets of two of three parts are enumerated, and each is a signature.  A signature of
no shingles says little; it is used only by sets with more than m partitions that have one, which
loses no pair, because m + 1 good partitions cannot all be explained by m of them.

Candidates that share a signature are never expanded into all pairs.  Members of a group are first
compared with one hub of the group (the one in most groups).  Only where a group still falls into
several components, members of different components are compared, in blocks of bounded size; groups with
the same members are one.  Such a block returns no pairs, only which members hang together by what their
sketches leave; each cluster of those is then compared once, on whole sets, again in blocks, which return
the links that join components.  So rows grow with members, not with pairs.
Parity sketches give a lower bound of the difference, which drops candidates without loss: first one of
512 bits, then a sharp one of at least four bits a shingle.  What remains is verified on whole sets.  Sketches
and sets of the members stream past those of the hub.

Equality of shingles is equality of 64-bit hashes.  Defined cases: a null, empty or blank text has no
shingles and links with nothing; rows with equal sets are one class; rows with a null id get the
component of their class, or null if no row of it has an id; rows that repeat an id with other text
link both texts' classes as any others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import components, runtime, words
from .words import U

SKETCH = [f"w{i}" for i in range(8)]
#: From this size on a sketch of 512 bits no longer tells unrelated sets apart, and passages that many texts share would pair them.
LARGE = 600
#: Shingles left out of the domain of large sets: the most frequent ones among those in some large sets of a sample of texts.  They never decide.
COMMON, COMMON_HITS, SAMPLE = 1 << 17, 5, 20_000
#: Members of a block that is compared at once.
BLOCK = 1024
#: Bytes of a sharp sketch that blocks compare: all of it up to 16,384 shingles; larger ones are folded.
BLOCK_SHARP = 8192
#: Shingles of a block of whole sets, about.
BLOCK_SETS = 1 << 20
#: Bits of the filter that spares most texts of the second reading; it never decides.
FILTER_BITS = 1 << 23
#: Bits of a signature.  Signatures that are equal by chance only add candidates; each byte fewer is one less to shuffle for every signature.
SIGNATURE = U((1 << 48) - 1)
#: Classes that one task remembers so as not to sign them again; it never decides.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Rule:
    """What links two texts."""

    shingle: int = 3
    percent: int = 90

    def most(self, both):
        """The largest difference of a linked pair whose sizes add up to `both`."""
        return (100 - self.percent) * both // (100 + self.percent)


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    partitions: int
    slack: int


@lru_cache(maxsize=8)
def bands(rule: Rule, up_to: int) -> tuple[Band, ...]:
    out, low = [], 1
    while low <= up_to:
        high = max(low, int(low * (100 / rule.percent) ** 1.5))
        k = rule.most(2 * high)
        least = k // 2 + 1
        slack = 0
        if least >= 8:  # room for the partitions that are likely to have a subset without shingles
            size = max(1, low * rule.percent // 100)
            expected = least * 3 * np.exp(-2 / 3 * size / least)
            slack = int(np.ceil(expected + 3 * np.sqrt(expected)))
        out.append(Band(low, high, (least + slack) if k else 0, slack))
        low = high + 1
    return tuple(out)


def signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, rule: Rule, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) rows of sets given as sorted (text, hash) rows; size: of the whole sets.

    common: sorted hashes that bands of large sets leave out of their domain.  Any part of the domain may be left out:
    what remains of two sets differs no more than the sets do.
    """
    n_docs = len(size)
    rare = np.ones(len(h), bool)
    if common is not None and len(common):
        at = np.searchsorted(common, h)
        at[at == len(common)] = 0
        rare = common[at] != h
    table = bands(rule, max(1, 1 << int(size.max(initial=1)).bit_length() + 1))
    highs = np.array([b.high for b in table])
    parts, slacks = np.array([b.partitions for b in table]), np.array([b.slack for b in table])
    own = np.searchsorted(highs, size)
    lows = np.array([b.low for b in table])
    spread = words.mix(h ^ U(0x2545F4914F6CDD1D))
    high32, third = spread >> U(32), ((spread & U(0xFFFFFFFF)) * U(3)) >> U(32)
    docs, sigs = [], []
    for up in (0, 1):
        band = own + up
        n1 = np.where(size > 0, parts[band], 0)
        if up:
            n1 = np.where(100 * size >= rule.percent * lows[band], n1, 0)
        if not n1.any():
            continue
        first = np.concatenate([[0], np.cumsum(n1)])
        use = (n1[doc] > 0) & (rare | (lows[band[doc]] < LARGE))
        d, v = doc[use], h[use]
        block = first[d] + ((high32[use] * n1[d].astype(np.uint64)) >> U(32)).astype(np.int64)
        cell = block * 3 + third[use].astype(np.int64)
        total = int(first[-1])
        sums = np.zeros(3 * total, np.uint64)
        np.add.at(sums, cell, words.mix(v + U(0x632BE59BD9B4E019)))
        counts = np.bincount(cell, minlength=3 * total).reshape(total, 3)
        sums = sums.reshape(total, 3)
        owner = np.repeat(np.arange(n_docs), n1)
        place = ((np.arange(total) - first[owner]).astype(np.uint64) << U(16)) + (band[owner].astype(np.uint64) << U(2))
        light = counts.sum(1, keepdims=True) - counts == 0
        light_blocks = np.bincount(owner, light.any(1), minlength=n_docs)
        sign_all = light_blocks > slacks[band]
        for left_out in range(3):
            rest = sums.sum(1, dtype=np.uint64) - sums[:, left_out]
            keep = ~light[:, left_out] | sign_all[owner]
            docs.append(owner[keep])
            sigs.append(words.mix(rest[keep] + words.mix(place[keep] + U(left_out + 1))))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    docs, sigs = np.concatenate(docs), np.concatenate(sigs)
    order = np.argsort(docs, kind="stable")
    return docs[order], sigs[order] & SIGNATURE


def class_keys(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, doc, words.mix(h ^ U(0x9FB21C651E98DF25)))
    return words.mix(total + size.astype(np.uint64))


def sketches(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Parity of the shingles in each of 512 cells, as eight words a text."""
    cell = (words.mix(h ^ U(0x8CB92BA72F3D8DD7)) & U(511)).astype(np.int64)
    parity = (np.bincount(doc * 512 + cell, minlength=n_docs * 512) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n_docs, 512), axis=1, bitorder="little").view(np.uint64)


def sharp_sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity of the shingles in a power of two of cells, four a shingle at least; a larger sketch folds into a smaller one."""
    spread = words.mix(h ^ U(0x7FB5D329728EA185))
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i, n in enumerate(size.tolist()):
        cells = max(512, 1 << (4 * n - 1).bit_length())
        at = (spread[first[i] : first[i + 1]] & U(cells - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def prepare(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (shingles), key (class) and sketches of each row; one pass over the text."""

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text", words.PIECE):
            doc, h = words.shingles(words.words(*words.column(part, "text"), fold=True), rule.shingle)
            size = np.bincount(doc, minlength=part.num_rows)
            sketch = sketches(doc, h, part.num_rows)
            arrays = [part.column(0), pa.array(size), pa.array(class_keys(doc, h, size).view(np.int64)), *(pa.array(sketch[:, i].view(np.int64)) for i in range(8)), pa.array(sharp_sketches(doc, h, size), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "key", *SKETCH, "sharp"])

    schema = "doc_id bigint, n bigint, key bigint, " + ", ".join(f"{w} bigint" for w in SKETCH) + ", sharp binary"
    return runtime.map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)


def common_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted hashes of shingles that many large sets share, from a sample of texts of fixed size; equal texts of a task count once."""
    n = docs.count()
    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = [], set()
        for batch in batches:
            for chunk in words.chunks(batch, "text", words.PIECE):
                doc, h = words.shingles(words.words(*words.column(chunk, "text"), fold=True), rule.shingle)
                size = np.bincount(doc, minlength=chunk.num_rows)
                new = size >= LARGE
                for i, k in enumerate(class_keys(doc, h, size).tolist()):
                    if k in met:
                        new[i] = False
                    met.add(k)
                held.append(h[new[doc]])
        if held:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "n"])

    counted = runtime.map_tasks(part, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_HITS)
    top = counted.orderBy(F.desc("n"), "h").limit(COMMON).select("h").collect()
    return np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))


def signed(docs: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """(signature, key) rows; a task signs a class it has met before only once, as far as it remembers."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in words.chunks(batch, "text", words.PIECE):
                doc, h = words.shingles(words.words(*words.column(part, "text"), fold=True), rule.shingle)
                size = np.bincount(doc, minlength=part.num_rows)
                key = class_keys(doc, h, size)
                new = np.zeros(part.num_rows, bool)
                for i, k in enumerate(key.tolist()):
                    if k not in met:
                        new[i] = True
                        if len(met) < REMEMBERED:
                            met.add(k)
                use = new[doc]
                owner, sig = signatures(doc[use], h[use], np.where(new, size, 0), rule, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(key[owner].view(np.int64))], names=["signature", "key"])

    return runtime.map_tasks(docs.select("text"), run, "signature bigint, key bigint")


def shared(signed: DataFrame) -> DataFrame:
    """(signature, key) rows of signatures that two classes share; sorted runs stream past, no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((0, 2), np.int64)
        carried_shared = False

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["signature", "key"])

        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
            rows = np.concatenate([carry, rows])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            rows = rows[new]
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            part = np.zeros(len(rows), bool)
            part[1:] |= same
            part[:-1] |= same
            part[0] |= carried_shared
            yield out(rows[:-1][part[:-1]])
            carry, carried_shared = rows[-1:], bool(part[-1])
        if carried_shared:
            yield out(carry)

    return runtime.map_tasks(signed.repartition("signature").sortWithinPartitions("signature", "key"), run, "signature bigint, key bigint")


def _near(rule: Rule, n_a: Column, n_b: Column, a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Lower bound of the difference of two sets, and whether they may link."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)).cast("bigint") for x, y in zip(a, b, strict=True)), F.lit(0).cast("bigint"))
    sizes = (100 * F.least(n_a, n_b)) >= (rule.percent * F.greatest(n_a, n_b))
    return differ, sizes & (differ * (100 + rule.percent) <= (100 - rule.percent) * (n_a + n_b))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if last is not None and any(c[0] != x for c, x in zip(cols, last, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
        last = [c[-1] for c in cols]
    if held:
        yield pa.Table.from_batches(held)


def _folded(m: np.ndarray, width: int) -> np.ndarray:
    """Sharp sketches, a row each, folded to a width in words."""
    while m.shape[1] > width:
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return m


def _levels(bodies: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(width, sketches folded to it) from 8 words to the widest; rows of narrower sketches stay empty."""
    own = np.array([len(b) // 8 for b in bodies])
    out, width = [], int(own.max(initial=0))
    wider = np.zeros((len(own), 2 * width), np.uint64)
    while width >= 8:
        level = _folded(wider, width)
        at = np.flatnonzero(own == width)
        if len(at):
            level[at] = np.frombuffer(b"".join(bodies[i] for i in at.tolist()), np.uint64).reshape(len(at), width)
        out.append((width, level))
        wider, width = level, width // 2
    return out[::-1]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels once the pairs (i, j) hang together: the least place of each cluster."""
    while True:
        a, b = label[i], label[j]
        new = a != b
        if not new.any():
            return label
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _blocks(parts: DataFrame, group: str, most: dict[str, int], *same: str) -> DataFrame:
    """group, largest, cl, cs of groups of several components: the largest component, and how many blocks it and the others have.

    parts: a row for each group and component with g members; most: of columns that add up over members, how much a block may hold.
    Groups that agree in the columns `same`, each a bit_xor over members, have the same members; one of them stays.
    """
    weights = [w for w in most if w != "g"]
    total = parts.groupBy(group).agg(
        F.max(F.struct("g", "component", *weights)).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("g").alias("g"), *(F.sum(w).alias(w) for w in weights), *(F.bit_xor(x).alias(x) for x in same)
    )
    blocks = lambda of: F.greatest(F.lit(1), *(F.ceil(of(w) / k).cast("int") for w, k in most.items()))
    cl, cs = blocks(lambda w: F.col(f"top.{w}")), blocks(lambda w: F.col(w) - F.col(f"top.{w}"))
    found = total.where("parts > 1").select(group, "g", *same, F.col("top.component").alias("largest"), cl.alias("cl"), cs.alias("cs"))
    if same:
        found = found.groupBy(*same, "g", "largest", "cl", "cs").agg(F.min(group).alias(group))
    return found.select(group, "largest", "cl", "cs")


def _dealt(members: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Members (with largest, cl and cs) dealt to pairs (i, j) of blocks of their group, sorted by them and rep.

    Blocks of a group's largest component come first and meet the others' blocks only, so a large group of near copies
    with a few strangers costs as many comparisons as it has members, for each block of strangers.
    """
    inside, spread = F.col("component") == F.col("largest"), F.xxhash64("rep")
    own = F.when(inside, F.pmod(spread, F.col("cl"))).otherwise(F.col("cl") + F.pmod(spread, F.col("cs"))).cast("int")
    meets = F.sequence(F.when(inside, F.col("cl")).otherwise(F.lit(0)), F.col("cl") + F.col("cs") - 1)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(meets))
    dealt = dealt.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "own", "component", "n", *columns)
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "rep")


def _left(t: pa.Table, bodies: list[bytes], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of members of a pair of blocks that lie in different components and whose sharp sketches allow a link."""
    n, rep, comp, own = (np.asarray(t.column(c)) for c in ("n", "rep", "component", "own"))
    low, high = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    width, levels = np.array([len(b) // 8 for b in bodies]), _levels(bodies)
    first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
    step = max(1, (1 << 18) // max(1, len(second)))
    for at in range(0, len(first), step):
        x, y = first[at : at + step, None], second[None, :]
        may = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= rule.percent * np.maximum(n[x], n[y]))
        if low == high:
            may &= rep[x] < rep[y]
        i, j = np.nonzero(may)
        i, j = first[at + i], second[j]
        for wide, sketch in levels:
            near = np.minimum(width[i], width[j]) < wide  # told by narrower ones already
            told = np.flatnonzero(~near)
            for part in np.array_split(told, 1 + len(told) * wide // (1 << 20)):
                p, q = i[part], j[part]
                near[part] = np.bitwise_count(sketch[p] ^ sketch[q]).sum(1, dtype=np.int64) <= rule.most(n[p] + n[q])
            i, j = i[near], j[near]
        yield i, j


def _edges(found: set[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def _across(groups: DataFrame, nodes: DataFrame, sharp: DataFrame, rule: Rule) -> DataFrame:
    """Edges (u, v) that tie together the reps of all pairs that share a signature, lie in different components and may link.

    groups: signature, key; nodes: key, rep, component and n; sharp: key, body.  Groups within one component go before sketches are joined.
    A pair of blocks returns an edge for each member that is tied to one before it, not its pairs, of which near copies that
    just fail to link have as many as the square of their number.
    """
    members = groups.join(nodes.select("key", "component"), "key")
    parts = members.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    sizes = _blocks(parts, "signature", {"g": BLOCK}, "x", "y")

    def bounded(batch: pa.RecordBatch):
        bodies = (np.frombuffer(b, np.uint64, offset=8)[None, :] for b in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_folded(b, BLOCK_SHARP // 8).tobytes() for b in bodies], pa.binary())], names=["key", "sharp"])

    body = runtime.map_batches(sharp.select("key", "body"), bounded, "key bigint, sharp binary")
    cut = groups.join(sizes, "signature").join(nodes, "key").join(body, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for t in _runs(batches, 3):
            label = np.arange(t.num_rows)
            for i, j in _left(t, t.column("sharp").to_pylist(), rule):
                label = _joined(label, i, j)
            rep = np.asarray(t.column("rep"))
            tied = np.flatnonzero(label != np.arange(len(label)))
            found.update(zip(rep[label[tied]].tolist(), rep[tied].tolist(), strict=True))
            if len(found) > 500_000:
                yield _edges(found)
        if found:
            yield _edges(found)

    return runtime.map_tasks(_dealt(cut, "signature", ["sharp"]), run, "u bigint, v bigint").distinct()


def _between(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(u, v): links that join the components of each cluster as all links between its members do.

    clusters: node, component (here: the cluster); nodes: key, rep, component and n.  Whole sets meet in blocks, each pair of them once.
    """
    members = nodes.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    parts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("shingles"))
    content = _sets(docs, members.select("rep").distinct(), rule)
    cut = members.join(_blocks(parts, "cluster", {"g": BLOCK, "shingles": BLOCK_SETS}), "cluster").join(content, ["rep", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for t in _runs(batches, 3):
            sets = [np.frombuffer(b, np.uint64) for b in t.column("body").to_pylist()]
            size = np.array([len(x) for x in sets])
            bodies = []
            for x in sets:
                sharp = np.frombuffer(sharp_sketches(np.zeros(len(x), np.int64), x, np.array([len(x)]))[0], np.uint64)
                bodies.append(_folded(sharp[None, :], BLOCK_SHARP // 8).tobytes())
            rep = np.asarray(t.column("rep"))
            label = np.unique(np.asarray(t.column("component")), return_inverse=True)[1]  # of components
            top = np.arange(label.max(initial=0) + 1)
            for i, j in _left(t, bodies, rule):
                for x, start, stop in zip(*_spans(i), strict=True):
                    y = j[start:stop]
                    y = y[top[label[y]] != top[label[x]]]
                    if not len(y):
                        continue
                    flat = np.concatenate([sets[k] for k in y.tolist()])
                    at = np.searchsorted(sets[x], flat)
                    at[at == len(sets[x])] = 0
                    both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[y])[:-1]]))
                    for k in y[100 * both >= rule.percent * (size[x] + size[y] - both)].tolist():
                        if top[label[x]] != top[label[k]]:
                            top = _joined(top, label[[x]], label[[k]])
                            found.add((int(rep[x]), int(rep[k])))
            if len(found) > 500_000:
                yield _edges(found)
        if found:
            yield _edges(found)

    return runtime.map_tasks(_dealt(cut, "cluster", ["body"]), run, "u bigint, v bigint").distinct()


def _spans(at: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each value of a sorted array, and where its run starts and stops."""
    value, start = np.unique(at, return_index=True)
    return value.tolist(), start.tolist(), np.append(start, len(at))[1:].tolist()


def _past_hubs(pairs: DataFrame, bodies: DataFrame, fits, first: str, second: str) -> DataFrame:
    """(first, second, key_a, key_b) of the pairs (a, b) for which fits(body of a, body of b); b's bodies stream past a's.

    A hub's pairs are dealt to 64 groups, each with a copy of its body.
    """
    keyed = pairs.select("a", "b", "key_a", "key_b", F.pmod(F.xxhash64("b"), F.lit(64)).alias("salt"))
    members = keyed.join(bodies.select(F.col("rep").alias("b"), F.col("key").alias("key_b"), "body"), ["b", "key_b"]).select("a", "key_a", "salt", F.lit(1).alias("kind"), "b", "key_b", "body")
    hubs = keyed.select("a", "key_a", "salt").distinct().join(bodies.select(F.col("rep").alias("a"), F.col("key").alias("key_a"), "body"), ["a", "key_a"]).select("a", "key_a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), F.col("key_a").alias("key_b"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            keep = []
            for i, (a, kind, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 6)), strict=True)):
                if kind == 0:
                    hub, own = a, body
                elif hub != a:
                    raise ValueError("a hub's body is missing")
                elif fits(own, body):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in (0, 4, 1, 5)], names=[first, second, "key_a", "key_b"])

    schema = f"{first} bigint, {second} bigint, key_a bigint, key_b bigint"
    return runtime.map_tasks(members.union(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind"), run, schema)


def _sharpened(pairs: DataFrame, sharp: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that the sharp sketches leave; sharp: rep, key, body (the size, then the sketch)."""

    def fits(x: bytes, y: bytes) -> bool:
        sizes = int.from_bytes(x[:8], "big") + int.from_bytes(y[:8], "big")
        a, b = np.frombuffer(x, np.uint64, offset=8), np.frombuffer(y, np.uint64, offset=8)
        if len(a) > len(b):
            a, b = b, a
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        return int(np.bitwise_count(a ^ b).sum()) <= rule.most(sizes)

    return _past_hubs(pairs, sharp, fits, "a", "b")


def _sets(docs: DataFrame, needed: DataFrame, rule: Rule) -> DataFrame:
    """(rep, key, body) of the texts of the ids in needed (rep, distinct): their whole sets as sorted hashes."""
    spark = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    from_one = place("rep") + 1  # bitmap functions count from 1
    marks = needed.groupBy(F.bitmap_bucket_number(from_one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(from_one)).alias("bits")).collect()
    filled = np.zeros(FILTER_BITS, bool)  # a fixed number of bits, whatever the corpus
    for r in marks:
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        at = (r.bucket - 1) * 32768
        filled[at : at + 32768] = bits
    sent = spark.sparkContext.broadcast(np.packbits(filled, bitorder="little"))

    def sets(batch: pa.RecordBatch):
        bits = sent.value
        at = np.asarray(batch.column(2))
        batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
        for part in words.chunks(batch, "text", words.PIECE) if batch.num_rows else ():
            doc, h = words.shingles(words.words(*words.column(part, "text"), fold=True), rule.shingle)
            size = np.bincount(doc, minlength=part.num_rows)
            first = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(class_keys(doc, h, size).view(np.int64)), pa.array([h[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())], names=["rep", "key", "body"])

    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", place(F.col("doc_id").cast("bigint")).alias("place"))
    content = runtime.map_batches(read, sets, "rep bigint, key bigint, body binary")
    return content.join(needed, "rep", "left_semi").dropDuplicates(["rep", "key"])


def _verify(pairs: DataFrame, docs: DataFrame, sharp: DataFrame, rule: Rule) -> DataFrame:
    """(u, v) of the pairs (a, b) of ids whose texts link, from whole sets."""
    likely = runtime.durable(_sharpened(pairs, sharp, rule), "likely")
    content = _sets(docs, likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), rule)

    def fits(x: bytes, y: bytes) -> bool:
        own, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        at = np.searchsorted(own, other)
        at[at == len(own)] = 0
        both = int((own[at] == other).sum())
        return 100 * both >= rule.percent * (len(own) + len(other) - both)

    links = runtime.durable(_past_hubs(likely, content, fits, "u", "v").select("u", "v"), "links")
    runtime.drop(likely)
    return links


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, class_key, component_id of each row of docs."""
    prepared = runtime.durable(prepare(docs, rule), "prepared")
    classes = prepared.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    groups = runtime.durable(shared(signed(docs, rule, common_shingles(docs, rule))), "shared")
    popular = groups.groupBy("key").agg(F.count(F.lit(1)).alias("popularity"))
    one = prepared.where("doc_id is not null").select("key", "doc_id", "n", *SKETCH, "sharp")
    reps = classes.where("rep is not null").withColumnRenamed("rep", "doc_id")
    nodes = popular.join(reps, "key").join(one, ["key", "doc_id"]).dropDuplicates(["key"]).withColumnRenamed("doc_id", "rep")
    nodes = runtime.durable(nodes.select("key", "rep", "popularity", "n", *SKETCH, "sharp"), "nodes")
    sharp = nodes.select("rep", "key", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "sharp").alias("body"))
    slim = groups.join(nodes.select("key", "rep", "popularity"), "key")
    hub = slim.groupBy("signature").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("order"), "key")).alias("hub"))
    # a member meets the same hub in many groups: pairs are made distinct before sketches are joined
    to_hub = slim.join(hub, "signature").select((-F.col("hub.order")).alias("a"), F.col("hub.key").alias("key_a"), "rep", "key").where("rep <> a").distinct()
    sketched = nodes.select("key", "n", *SKETCH)
    own = sketched.select(F.col("key").alias("key_a"), F.struct("n", *SKETCH).alias("hub"))
    differ, may = _near(rule, F.col("n"), F.col("hub.n"), [F.col(w) for w in SKETCH], [F.col(f"hub.{w}") for w in SKETCH])
    likely = to_hub.join(own, "key_a").join(sketched, "key").withColumn("differ", differ).where(may)
    best = likely.groupBy("rep", "key").agg(F.min(F.struct("differ", "a", "key_a")).alias("best"))
    pairs = runtime.durable(best.select(F.col("best.a").alias("a"), F.col("rep").alias("b"), F.col("best.key_a").alias("key_a"), F.col("key").alias("key_b")), "to-hubs")
    links = _verify(pairs, docs, sharp, rule)

    found = components.components(links)
    labelled = nodes.select("key", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = runtime.durable(labelled, "labelled")
    near = runtime.durable(_across(groups, labelled, sharp, rule), "across")
    runtime.drop(groups, pairs)
    if not near.isEmpty():
        clusters = components.components(near)
        others = runtime.durable(_between(clusters, labelled, docs, rule), "between")
        if not others.isEmpty():
            before, found = found, components.components(links.union(others))
            runtime.drop(before)
        runtime.drop(clusters, others)
    runtime.drop(links, near, labelled, nodes)

    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = prepared.select("doc_id", "n", "key").join(labels, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of docs that stay when one document of each group does: the one with the smallest id, and rows without an id.

    Where rows repeat that id, the least of them by all columns stays.
    """
    found = runtime.durable(join(docs, rule).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    without = docs.where(docs["doc_id"].isNull())
    kept = docs.join(found, docs["doc_id"] == found["doc_id"], "left_semi")
    again = found.where("n > 1")
    if again.isEmpty():
        return without.union(kept)
    once = kept.join(again, docs["doc_id"] == again["doc_id"], "left_anti")
    many = kept.join(again, docs["doc_id"] == again["doc_id"], "left_semi")
    own = "nth" + "_" * max(map(len, docs.columns))  # no column of docs
    nth = F.row_number().over(Window.partitionBy(many["doc_id"]).orderBy(*(many[c] for c in docs.columns)))
    return without.union(once).union(many.withColumn(own, nth).where(F.col(own) == 1).select(*docs.columns))


def query(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The digest of the contract."""
    return join(docs, rule).select("doc_id", "n_shingles", "component_id")
