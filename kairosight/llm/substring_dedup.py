"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after a line break, and after . ! or ? before white space.  A span
starts at every sentence and takes the following ones until it has two sentences and 20 words, or
40 words (so that a passage in one long sentence counts as well).  With Rule.both, a sentence that alone has 40
words starts two spans: itself, and the run of two sentences from there.  Each span is hashed from its
words; spans are joined globally by hash, and every sentence that lies in a span other than the
first one with its hash goes.  First is the smallest doc_id, in a document the earliest place.

A document contributes each hash once; repeats inside it are known without a join.  The join is a
grouped minimum (combined before the shuffle, so a passage in a third of all documents is one row a
task) and an equi-join whose skewed partitions Spark may split.

Defined cases: a null text stays null; an empty one stays as it is; rows without an id lose only
their own repeats and take no part in the join; rows that repeat an id are one document, so they are
not removed for each other's sake; other columns keep their values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, words
from .words import U


@dataclass(frozen=True)
class Rule:
    """A span is complete with this many sentences and words, or with so many words; both: with either, where they differ."""

    sentences: int = 2
    words: int = 20
    enough_words: int = 40
    both: bool = False


#: What the registered query and the pipeline use.
WHOLE = Rule(both=True)

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


@dataclass
class Spans:
    """Sentences of some texts and the spans that start at them; sentence i is bytes start[i]:end[i]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of text d: first[d]:first[d+1]
    at: np.ndarray  # sentences at which a span starts
    stop: np.ndarray  # the sentence after its last
    hash: np.ndarray
    doc: np.ndarray
    again: np.ndarray  # whether its text has an equal span before
    run: np.ndarray  # 1 for the longer of two spans that start together


def spans(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> Spans:
    w = words.words(data, offsets, fold=False)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:][data == 10] = True
    cut[1:-1][_STOP[data[:-1]] & words.SPACE[data[1:]]] = True
    cut[offsets] = True
    cut[len(data)] = False
    start = np.flatnonzero(cut)
    start = start[np.isin(start, offsets[:-1][np.diff(offsets) > 0]) | ~np.isin(start, offsets)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.append(start[1:], len(data))
    end = np.minimum(end, offsets[doc + 1])
    first = np.searchsorted(doc, np.arange(len(offsets)))
    word = np.searchsorted(w.start, np.append(start, len(data)))  # first word of each sentence
    full = np.flatnonzero(word[1:] > word[:-1])  # sentences with words; others belong to no count
    n_words = word[full + 1] - word[full]
    total = np.concatenate([[0], np.cumsum(n_words)])
    k = len(full)
    by_count = np.maximum(np.arange(k) + rule.sentences, np.searchsorted(total, total[:k] + rule.words))
    stop = np.minimum(by_count, np.searchsorted(total, total[:k] + rule.enough_words))
    last = np.searchsorted(doc[full], doc[full], "right")  # sentences of the text end here
    origin, ends, hashes = [], [], []
    for to in (stop, np.where(by_count > stop, by_count, k + 1)) if rule.both else (stop,):
        ok = np.flatnonzero(to <= last)
        origin.append(ok)
        ends.append(to[ok])
        hashes.append(_run_hashes(w.hash, word[full[ok]], word[full[np.maximum(to[ok], 1) - 1] + 1]))
    run = np.repeat(np.arange(len(origin)), [len(x) for x in origin])
    origin, stop, h = map(np.concatenate, (origin, ends, hashes))
    order = np.lexsort((run, origin))
    origin, stop, h, run = origin[order], stop[order], h[order], run[order]
    d = doc[full[origin]]
    key = words.mix(h + d.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(origin), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    return Spans(start, end, first, full[origin], full[np.maximum(stop, 1) - 1] + 1 if len(origin) else origin, h, d, again, run)


_ROLL = 0xC6A4A7935BD1E995 & ~3 | 3


def _run_hashes(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the word runs h[s:e]: a polynomial over word hashes, in pieces so that powers stay bounded."""
    if not len(s):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(s), np.uint64)
    at = 0
    while at < len(s):
        base = int(s[at])
        to = max(at + 1, int(np.searchsorted(e, base + words.PIECE)))
        part = h[base : int(e[to - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * words._power(_ROLL, len(part)), out=total[1:])
        a, b = s[at:to] - base, e[at:to] - base
        out[at:to] = (total[b] - total[a]) * words._power(pow(_ROLL, -1, 1 << 64), len(part) + 1)[a]
        at = to
    return words.mix(out + (e - s).astype(np.uint64))


def _spans_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, hash, place) of the first span with each hash in each document."""

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text"):
            s = spans(*words.column(part, "text"), rule)
            new = ~s.again
            at = 2 * (s.at[new] - s.first[s.doc[new]]) + s.run[new]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(s.doc[new])), pa.array(s.hash[new].view(np.int64)), pa.array(at.astype(np.int32))], names=["doc_id", "hash", "place"])

    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return runtime.map_batches(read, run, "doc_id bigint, hash bigint, place int")


def repeated(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, places): for each document with repeats of others, twice the sentences at which such spans start, plus the run."""
    found = runtime.durable(_spans_table(docs, rule), "spans")
    firsts = found.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc").select("hash", "first_doc")
    later = found.join(firsts, "hash").where("doc_id > first_doc")
    return later.groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def _rewrite(docs: DataFrame, carry: list[str], rule: Rule, extra: tuple[str, str]) -> DataFrame:
    """carry columns with the new text, n_sentences and n_removed; `places` is the last column of docs."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{x} bigint" for x in extra)])

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text"):
            column = part.schema.get_field_index("text")
            data, offsets = words.column(part, "text")
            s = spans(data, offsets, rule)
            lists = part.column(part.num_columns - 1)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
            sizes = np.where(np.asarray(lists.is_valid()), sizes, 0)
            owner = np.repeat(np.arange(part.num_rows), sizes)
            named = 2 * s.first[owner] + flat
            index = np.searchsorted(2 * s.at + s.run, named)
            gone = np.union1d(index, np.flatnonzero(s.again))
            change = np.zeros(len(s.start) + 1, np.int64)
            np.add.at(change, s.at[gone], 1)
            np.add.at(change, s.stop[gone], -1)
            cover = np.cumsum(change)[:-1] > 0
            per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[s.first])
            removed = per_doc(cover)
            texts = part.column(column)
            if removed.any():
                body = data.tobytes()
                new = texts.to_pylist()
                for d in np.flatnonzero(removed).tolist():
                    own = range(s.first[d], s.first[d + 1])
                    new[d] = b"".join(body[s.start[i] : s.end[i]] for i in own if not cover[i]).decode()
                texts = pa.array(new, texts.type)
            kept = [texts if i == column else part.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(s.first)), pa.array(removed)], names=[*carry, *extra])

    return runtime.map_batches(docs, run, schema)


def dedup(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Every row of docs with what is left of its text, n_sentences and n_removed (with _ behind them where docs has such columns)."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    marks = repeated(docs, rule)
    joined = docs.join(marks, docs["doc_id"] == marks["doc_id"], "left").select(*(docs[c] for c in docs.columns), marks["places"].alias(_free(docs, "places")))
    return _rewrite(joined, docs.columns, rule, (_free(docs, "n_sentences"), removed_column(docs)))


def _free(docs: DataFrame, name: str) -> str:
    """The name, or with as many _ behind it as make it no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def removed_column(docs: DataFrame) -> str:
    """The column of dedup(docs) with the number of sentences that went."""
    return _free(docs, "n_removed")


def query(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_chars and text (what is left) of each row of docs."""
    return dedup(docs.select("doc_id", "text"), rule).select("doc_id", "n_sentences", "n_removed", F.length("text").cast("bigint").alias("n_chars"), "text")
