"""Phrase collocations of each language.

Every run of 1 to max_words words inside a piece of text is a DataFrame row (lang, words, phrase); rows are counted by
language and phrase, with partial sums before the shuffle.  Phrases that occur often enough are candidates.  Each way of
cutting one in two is joined to the counts of its first part and of its rest and scored in exact decimals; the lowest score
counts.  Candidates that a phrase of one word more accounts for go by an anti-join, and windows rank what is left.

A phrase can only be frequent if the phrases in it are.  So words are counted first; then, as rows of 64-bit hashes alone,
pairs of frequent words and longer phrases of frequent pairs.  Two phrases with one hash only add up, so a hash that is rare
tells that its phrases are.  The phrases of frequent hashes are rows of text, counted exactly.  Which hashes are frequent is
told to the tasks by a Bloom filter (bits in proportion to them, up to a bound), which never keeps a frequent phrase out: the
result is that of counting all rows of text, without the many that occur once.  When the filter is full it saves nothing and
changes nothing.

One longer phrase accounts for all shorter ones in it only through phrases between them that are at least as frequent as
itself, so looking at one more word suffices for any share.

A language may hold most of the rows: ranks are taken in buckets of phrases first, and only the best of each bucket meet.

Defined cases: a null or empty text has no words; a null language is `und`; repeated rows count each time; equal scores and
counts go by the bytes of the phrase; an empty table gives no rows; other columns are ignored; a very long text is one
task's work, a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime, tokens, words
from .tokens import U

#: Bits of the filter for each phrase, and the most bits there are (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27
_PROBES = 4
#: Buckets of phrases in which a language is ranked before its best phrases meet.
BUCKETS = 256
_BREAK = tokens.byte_set(".,;:!?", ((0x0A, 0x0D),))
_SOLID = ~(_BREAK | tokens.byte_set(" \t"))
_UPPER = tokens.byte_set("", ((65, 90),))


@dataclass(frozen=True)
class Rule:
    """What is a candidate, when a longer phrase accounts for it, and how many phrases of a language are reported."""

    max_words: int = 5
    least: int = 100
    share_percent: int = 100
    top: int = 2000


class Pieces:
    """The words of some texts: their lower-cased bytes with one space behind each, and which neighbours share a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, end = tokens.runs(data, offsets, _SOLID)
        self.text = np.searchsorted(offsets, start, "right") - 1
        piece = np.searchsorted(np.flatnonzero(_BREAK[data]), start)
        self.hash = tokens.hashes(data, start, end)
        self.follows = (self.text[1:] == self.text[:-1]) & (piece[1:] == piece[:-1])
        size = end - start
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        source = np.repeat(start - self.at[:-1], size + 1) + np.arange(self.at[-1])
        self.body = data[np.minimum(source, len(data) - 1)] if len(data) else data.copy()
        self.body[_UPPER[self.body]] += 32
        self.body[self.at[1:] - 1] = 32

    def starts(self, n: int) -> np.ndarray:
        """Words at which n words of one piece start."""
        total = len(self.hash) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(total, bool)
        for i in range(n - 1):
            ok &= self.follows[i : i + total]
        return np.flatnonzero(ok)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        return tokens.slices(self.body, self.at[at], self.at[at + n] - 1)


def _language(column: pa.Array) -> np.ndarray:
    """A hash of each language."""
    coded = column.dictionary_encode()
    data, offsets = words.column(pa.record_batch([coded.dictionary], names=["x"]), "x")
    own = words.mix(words.spans(data, offsets[:-1], offsets[1:]))
    return own[np.asarray(coded.indices)]


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = words.mix(h ^ U(0x94D049BB133111EB)) | U(1)
    for i in range(_PROBES):
        yield (h + U(i) * step) & U(bits - 1)


def _passes(have: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _probes(h, 64 * len(have)):
        out &= (have[at >> U(6)] >> (at & U(63))) & U(1) == 1
    return out


def filter_of(found: DataFrame) -> Broadcast:
    """A Bloom filter of the hashes in found(h), for the tasks; the driver gets its words only, 16 MB at most."""
    spark = found.sparkSession
    bits = max(1 << 10, min(MOST_BITS, 1 << (BITS_EACH * found.count()).bit_length()))

    def run(batch: pa.RecordBatch):
        place = np.concatenate(list(_probes(np.asarray(batch.column(0)).view(np.uint64), bits)))
        yield pa.RecordBatch.from_arrays([pa.array((place >> U(6)).astype(np.int64)), pa.array((U(1) << (place & U(63))).view(np.int64))], names=["slot", "bits"])

    slots = runtime.map_batches(found.select("h"), run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    have = np.zeros(bits >> 6, np.uint64)
    have[np.asarray(slots["slot"])] = np.asarray(slots["bits"]).view(np.uint64)
    return spark.sparkContext.broadcast(have)


def _over_texts(docs: DataFrame, make, schema: str) -> DataFrame:
    """What `make` yields for the pieces of some texts, the hashes of their languages, and those languages."""

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text"):
            p = Pieces(*words.column(part, "text"))
            if len(p.hash):
                yield from make(p, _language(part.column(0))[p.text], part.column(0))

    return runtime.map_batches(docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text"), run, schema)


def rows(docs: DataFrame, known: dict[int, Broadcast | None]) -> DataFrame:
    """(lang, words, phrase): a row for each run of words inside a piece, of the sizes in `known`, if its hash passes that filter."""

    def make(p: Pieces, own: np.ndarray, langs: pa.Array):
        for n, passing in known.items():
            at = p.starts(n)
            if passing is not None:
                at = at[_passes(passing.value, tokens.combined(p.hash, at, n, own[at]))]
            if len(at):
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(p.text[at])), pa.array(np.full(len(at), n, np.int32)), p.phrases(at, n)], names=["lang", "words", "phrase"])

    return _over_texts(docs, make, "lang string, words int, phrase string")


def hashed_rows(docs: DataFrame, sizes: range, inside: int, known: Broadcast) -> DataFrame:
    """(h): the hash of each run of so many words inside a piece all of whose runs of `inside` words pass the filter."""

    def make(p: Pieces, own: np.ndarray, langs: pa.Array):
        at = p.starts(inside)
        good = np.zeros(len(p.hash) + 1, bool)
        good[at[_passes(known.value, tokens.combined(p.hash, at, inside, own[at]))]] = True
        for n in sizes:
            at = p.starts(n)
            for i in range(n - inside + 1):
                at = at[good[at + i]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.combined(p.hash, at, n, own[at]).view(np.int64))], names=["h"])

    return _over_texts(docs, make, "h bigint")


def _word_hashes(found: DataFrame) -> DataFrame:
    """(h) of found(lang, phrase) of one word each."""

    def run(batch: pa.RecordBatch):
        p = Pieces(*words.column(batch, "phrase"))
        yield pa.RecordBatch.from_arrays([pa.array(tokens.combined(p.hash, np.arange(len(p.hash)), 1, _language(batch.column(0))[p.text]).view(np.int64))], names=["h"])

    return runtime.map_batches(found.select("lang", "phrase"), run, "h bigint")


def counted(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of the phrases that occur often enough, and (lang, n) with all word occurrences."""
    count = lambda df: df.groupBy("lang", "words", "phrase").agg(F.count(F.lit(1)).alias("f"))
    enough = lambda df: df.where(F.col("f") >= rule.least)
    singles = runtime.durable(count(rows(docs, {1: None})), "words")
    totals = runtime.durable(singles.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    every = runtime.durable(enough(singles), "frequent-words")
    runtime.drop(singles)
    passing, known = filter_of(_word_hashes(every)), {}
    for inside, sizes in ((1, range(2, 3)), (2, range(3, rule.max_words + 1))):
        if sizes and sizes[0] <= rule.max_words:
            often = runtime.durable(enough(hashed_rows(docs, sizes, inside, passing).groupBy("h").agg(F.count(F.lit(1)).alias("f"))), "frequent-hashes")
            passing = filter_of(often)
            known |= dict.fromkeys(sizes, passing)
            runtime.drop(often)
    if known:
        every = every.unionByName(runtime.durable(enough(count(rows(docs, known))), "frequent-phrases"))
    return every, totals


def scored(every: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of every phrase of two words or more, by its lowest cut."""
    parts = F.split("phrase", " ")
    cut = lambda a, b: F.array_join(F.slice(parts, a, b), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), cut(1, k).alias("first"), cut(k + 1, F.col("words") - k).alias("rest")))
    long = every.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "words", "phrase", "a", "c.*")
    part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    joined = long.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals), "lang")  # a row a language
    # exact: 1000 * a * n has 38 digits for counts below 10^17, and `div` of decimals does not round
    exact = lambda c: c.cast("decimal(19,0)")
    joined = joined.withColumn("over", (exact(1000 * F.col("a")) * exact(F.col("n"))).cast("decimal(38,0)")).withColumn("under", (exact(F.col("l")) * exact(F.col("r"))).cast("decimal(38,0)"))
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("low")
    return joined.groupBy("lang", "words", "phrase", "a", "n").agg(lowest).select("lang", "words", "phrase", "a", "low.l", "low.r", "n", "low.score")


def unaccounted(candidates: DataFrame, rule: Rule) -> DataFrame:
    """Candidates without a longer one around them that occurs in at least so large a share of their places."""
    parts = F.split("phrase", " ")
    shorter = F.array_distinct(F.array(F.array_join(F.slice(parts, 1, F.col("words") - 1), " "), F.array_join(F.slice(parts, 2, F.col("words") - 1), " ")))
    around = candidates.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer"))
    most = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    accounted = most.join(candidates.select("lang", "phrase", "a"), ["lang", "phrase"]).where(100 * F.col("longer") >= rule.share_percent * F.col("a"))
    return candidates.join(accounted.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def ranked(found: DataFrame, rule: Rule) -> DataFrame:
    """The first phrases of each language with their rank; buckets of a language are cut to as many first."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    first = found.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    best = first.where(F.col("place") <= rule.top).drop("bucket", "place")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= rule.top)


def mine(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """lang, rank, words, phrase, a, l, r, n and score of the best phrases of each language."""
    every, totals = counted(docs, rule)
    return ranked(unaccounted(runtime.durable(scored(every, totals), "scored"), rule), rule)


def query(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The columns of the contract."""
    return mine(docs, rule).select("lang", "rank", "phrase", *(F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")))


def oracle(rule: Rule = Rule()) -> str:
    """The same in SQL, counting every run of words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
k AS (SELECT lang, w, unnest(range(1, {rule.max_words + 1})) AS k FROM w), i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k WHERE k <= len(w)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {rule.least}),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.k, a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN n ON n.lang = x.lang
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
j AS (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c), t AS (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM j), u AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM t GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < {rule.share_percent} * a QUALIFY rank <= {rule.top}"""
