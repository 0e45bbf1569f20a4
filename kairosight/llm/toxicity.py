"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts.  For a word behind another one, each takes a discount from its own counts of that
pair and gives it to the counts of the pair in both classes together; what those give up goes to the word's continuation
counts in the class (in how many contexts it was seen there), discounted again in favour of the continuation counts of both
classes.  So rare expressions are scored by shared counts, and words too rare for counts of their own are one expression.
A toxic text is mostly ordinary: its likelihood mixes a small share of the toxic model into the ordinary one, which keeps
chance differences of ordinary words, or of a text's language, from adding up.  A text's score compares the two
log-likelihoods over its distinct pairs of words, normalised by their number and by the root of it (noise of the sum grows
with the root), through a logistic curve.

Counts are learned from a bounded sample of labelled rows (`toxic_rows`, and `ordinary_each` ordinary rows for each), the
curve from others (`curve_rows` of each class), so that a model has a bounded size and can be sent to every task;
`words_kept` and `pairs_kept` bound what of it is sent.  All texts are scored whole, in one pass without a shuffle.

Words are runs of letters, digits and bytes beyond ASCII, A-Z like a-z, equal by 64-bit hashes.  Labels, language, source and
id are no inputs of a score.

Defined cases: a null or empty text and one without words have no evidence and get the curve's value at zero; rows with a null
id are held out and scored; labels that are null or neither 0 nor 1, or without an id, teach nothing; an id with several
labels is toxic if one says so; repeated rows are scored alike; without counted rows of both classes every score is half the
share of toxic ones, or 0; other columns are ignored; an empty table gives no rows; a very long text needs memory for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime, tokens, words
from .tokens import U

_WORD = tokens.byte_set("", ((48, 57), (65, 90), (97, 122), (128, 255)))
#: What stands before the first word of a text.
_START = U(1)
_HASHES = 1 << 30


@dataclass(frozen=True)
class Rule:
    """Sizes of the sample, counts from which words and pairs are kept, the discount, the toxic share of a toxic text, bounds of the model."""

    toxic_rows: int = 8_192
    ordinary_each: int = 3
    curve_rows: int = 4_096
    least_word: int = 5
    least_pair: int = 16
    discount: float = 0.5
    toxic_share: float = 0.005
    words_kept: int = 1 << 19
    pairs_kept: int = 1 << 20
    seed: int = 13


def remainder(doc_id: Column) -> Column:
    """Of the checksum of an id as text; 0 for none."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 5, F.lit(0))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and hash of the word before, of every word."""
    start, end = tokens.runs(data, offsets, _WORD)
    text = np.searchsorted(offsets, start, "right") - 1
    h = tokens.hashes(data, start, end)
    before = np.concatenate([[_START], h[:-1]]) if len(h) else h
    before[np.flatnonzero(np.diff(text, prepend=-1))] = _START
    return text, h, before


def _pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return words.mix(before * words._factor(0) + h * words._factor(1))


@dataclass
class Table:
    """Rows of numbers by sorted keys: of toxic texts, of ordinary ones, and for pairs and contexts of both together."""

    keys: np.ndarray
    values: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, keys: np.ndarray, *values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], tuple(v[order] for v in values))

    def get(self, keys: np.ndarray, missing: tuple[float, ...]) -> tuple[np.ndarray, ...]:
        if not len(self.keys):
            return tuple(np.full(len(keys), m) for m in missing)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        return tuple(np.where(hit, v[at], m) for v, m in zip(self.values, missing, strict=True))


@dataclass
class Model:
    """What the tasks need: shares of words and of pairs, and what contexts leave to the level below."""

    words: Table
    rare: tuple[float, float]
    pairs: Table
    contexts: Table
    toxic_share: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of words, and log-likelihood as toxic less that as ordinary, of each text."""
        text, h, before = _tokens(data, offsets)
        pair, n = _pair(before, h), len(offsets) - 1
        _, once = np.unique(words.mix(pair + text.astype(np.uint64) * words._factor(2)), return_index=True)
        text, h, before, pair = text[once], h[once], before[once], pair[once]
        toxic, ordinary = self.words.get(h, self.rare)
        pair_toxic, pair_ordinary, pair_both = self.pairs.get(pair, (0.0, 0.0, 0.0))
        left_toxic, left_ordinary, left_both = self.contexts.get(before, (1.0, 1.0, 1.0))
        ratio = (pair_toxic + left_toxic * (pair_both + left_both * toxic)) / (pair_ordinary + left_ordinary * (pair_both + left_both * ordinary))
        return np.bincount(text, minlength=n), np.bincount(text, np.log1p(self.toxic_share * (ratio - 1)), minlength=n)

    def score(self, size: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        one, root, base = self.curve
        some = np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(one * evidence / some + root * evidence / np.sqrt(some) + base, -50, 50)))


def _sample(labels: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, toxic, curve (whether for the curve), weight: about as many rows of each kind as the rule says, all if fewer."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    part = remainder(F.col("doc_id"))
    taught = known.where(part != 0).withColumn("curve", part == 4)
    sizes = {(r.toxic, r.curve): r["n"] for r in taught.groupBy("toxic", "curve").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    chosen, weight = F.lit(False), F.lit(0.0)
    for (toxic, curve), n in sizes.items():
        wanted = rule.curve_rows if curve else rule.toxic_rows if toxic else rule.ordinary_each * min(rule.toxic_rows, sizes.get((1, False), 0))
        share = min(1.0, wanted / n)
        kind = (F.col("toxic") == toxic) & (F.col("curve") == curve)
        chosen = chosen | (kind & (F.pmod(F.xxhash64("doc_id", F.lit(rule.seed)), F.lit(_HASHES)) < int(share * _HASHES)))
        weight = F.when(kind, 1 / share if share else 0.0).otherwise(weight)
    return taught.where(chosen).withColumn("weight", weight)


def _pairs(taught: DataFrame) -> DataFrame:
    """(before, word, toxic, ordinary): how often each pair of words occurs in each class; summed for each batch first."""

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text"):
            text, h, before = _tokens(*words.column(part, "text"))
            if not len(h):
                continue
            toxic = np.asarray(part.column(0))[text]
            key = _pair(before, h)
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            a = np.add.reduceat(toxic[order].astype(np.int64), first)
            b = np.add.reduceat(1 - toxic[order].astype(np.int64), first)
            at = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(h[at].view(np.int64)), pa.array(a), pa.array(b)], names=["before", "word", "toxic", "ordinary"])

    found = runtime.map_batches(taught.select("toxic", "text"), run, "before bigint, word bigint, toxic bigint, ordinary bigint")
    return found.groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _threshold(rows: DataFrame, least: int, most: int) -> int:
    """The count from which on at most `most` rows are left; `least` at least.  Counts of 4096 and more are one row of the histogram."""
    sizes = rows.groupBy(F.least(F.col("toxic") + F.col("ordinary"), F.lit(4096)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    left, at = 0, 4097
    for c, n in sorted(((r.c, r["n"]) for r in sizes), reverse=True):
        if left + n > most or c < least:
            break
        left, at = left + n, c
    return max(least, at) if left else least


def fit(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> Model | float:
    """The model of labelled rows, or the share of toxic ones where there are not both classes to learn from."""
    chosen = runtime.durable(_sample(labels, rule), "toxicity-sample")
    taught = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # as many rows as the rule says
    pairs = runtime.durable(_pairs(taught.where("not curve")), "toxicity-pairs")
    single = runtime.durable(pairs.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary")), "toxicity-words")  # contexts of each word
    totals = single.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not totals[0] or not totals[1]:
        share = chosen.agg(F.sum(F.col("weight") * F.col("toxic")) / F.sum("weight")).first()[0]
        return float(share or 0.0)
    often = F.col("toxic") + F.col("ordinary") >= _threshold(single, rule.least_word, rule.words_kept)
    kept = single.where(often).toArrow()  # words_kept rows at most
    part = [np.asarray(kept[c]) / n for c, n in zip(("toxic", "ordinary"), totals, strict=True)]
    own = [np.maximum(p - rule.discount / n, 0) for p, n in zip(part, totals, strict=True)]
    shared = (part[0] + part[1]) / max((part[0] + part[1]).sum(), 1e-300)
    shares = [o + (p.sum() - o.sum()) * shared for o, p in zip(own, part, strict=True)]
    rare = tuple(max(1 - p.sum(), 1e-9) for p in part)

    often = F.col("toxic") + F.col("ordinary") >= _threshold(pairs, rule.least_pair, rule.pairs_kept)
    kinds = {"toxic": F.col("toxic"), "ordinary": F.col("ordinary"), "both": F.col("toxic") + F.col("ordinary")}
    less = {k: F.greatest(c - F.lit(rule.discount), F.lit(0.0)) for k, c in kinds.items()}
    sums = [x for k, c in kinds.items() for x in (F.sum(c).alias(f"n_{k}"), F.sum(F.when(often, less[k]).otherwise(0.0)).alias(f"m_{k}"))]
    around = runtime.durable(pairs.groupBy("before").agg(*sums, F.bool_or(often).alias("some")).where("some").drop("some"), "toxicity-contexts")
    of = lambda c, k: F.when(F.col(f"n_{k}") > 0, c / F.col(f"n_{k}")).otherwise(0.0)
    left = around.select("before", *((1 - of(F.col(f"m_{k}"), k)).alias(k) for k in kinds)).toArrow()  # pairs_kept rows at most
    discounted = pairs.where(often).join(around, "before").select("before", "word", *(of(less[k], k).alias(f"p_{k}") for k in kinds)).toArrow()  # the same
    hashes = lambda t, c: np.asarray(t[c]).view(np.uint64)
    model = Model(
        Table.of(hashes(kept, "word"), *shares),
        tuple(r / max(rare) for r in rare),
        Table.of(_pair(hashes(discounted, "before"), hashes(discounted, "word")), *(np.asarray(discounted[f"p_{k}"]) for k in kinds)),
        Table.of(hashes(left, "before"), *(np.asarray(left[k]) for k in kinds)),
        rule.toxic_share,
    )
    found = _evidence(taught.where("curve"), model, ("toxic", "weight")).select("toxic", "weight", "n_words", "evidence").toArrow()  # curve_rows of each class at most
    model.curve = curve(*(np.asarray(found[c]).astype(float) for c in ("toxic", "weight", "n_words", "evidence")))
    runtime.drop(chosen, pairs, single, around)
    return model


def curve(toxic: np.ndarray, weight: np.ndarray, size: np.ndarray, evidence: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the evidence a word and by the root of the words, each scaled, with a small penalty; evidence never counts against its sign."""
    if not len(toxic) or toxic.min() == toxic.max():
        return 100.0, 50.0, -5.0
    some = np.maximum(size, 1)
    raw = np.column_stack([evidence / some, evidence / np.sqrt(some)])
    scale = np.maximum(raw.std(0), 1e-9)
    x = np.column_stack([raw / scale, np.ones(len(raw))])
    weight = weight / weight.mean()
    penalty = np.diag([1.0, 1.0, 1e-6])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        slope = x.T @ (weight * (toxic - p)) - penalty @ b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale[0]), float(b[1] / scale[1]), float(b[2])


def _evidence(docs: DataFrame, model: Model, carry: tuple[str, ...]) -> DataFrame:
    """carry columns, n_words, evidence and score of each row of docs; one narrow pass."""
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in words.chunks(batch, "text") if batch.num_rows else ():
                size, evidence = own.evidence(*words.column(part, "text"))
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size.astype(np.int64)), pa.array(evidence), pa.array(own.score(size, evidence))], names=[*carry, "n_words", "evidence", "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_words bigint, evidence double, score double"])
    return runtime.map_tasks(docs.select(*carry, "text"), run, schema)


def scores(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, n_words, evidence (log-likelihood ratio) and score of each row of docs."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if isinstance(model, float):
        return own.select("doc_id", F.lit(None).cast("bigint").alias("n_words"), F.lit(0.0).alias("evidence"), F.lit(model / 2).alias("score"))
    return _evidence(own, model, ("doc_id",))


def query(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The columns of the contract, and the words and the evidence of each text."""
    found = scores(docs, fit(docs, labels, rule))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "evidence")
