"""A log-bilinear language model in numpy, trained by noise-contrastive estimation over all training documents.

The network is in `lbl_net`.  Counts of all training words are exact and grow with the corpus; the most frequent ones (up to
HEAD, a fixed number) are sent to the tasks, the others are joined.  Of the words sent, each seen `least` times has vectors of
its own as a choice and as a context (up to 255 in each of 256 classes by their last letters); all other words, and those never
seen, are chosen by class and share what their class has left by smoothed counts.

Training does not depend on how the input is cut.  A bounded sample of texts, chosen by hash, gives the start in one task.  Where
the corpus is larger, all its texts are dealt to shards by hash, as many as its tokens ask for; every shard starts there, reads its
texts in the order of their hashes, and the changes are averaged row by row, weighted by how often a shard met the row, a few
dozen shards at a time.

Defined cases: a null or empty text is the end token alone; a null id counts as the empty string where the
fold is drawn; repeated rows are scored alike; very long texts are read in pieces of bounded size; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lbl_net, runtime, words
from .lbl_net import CLASSES, END, Head, Model, Setting, Tokens, head_of

#: So many words' counts at most are sent to all tasks.
HEAD = 1 << 17
#: Steps of the hash by which the start sample is drawn.
DRAW = 1 << 20


def _folds(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold == 1).alias("held_out"))


def counts(train: DataFrame) -> DataFrame:
    """(hash, n, class) of every training token, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends, size = [], 0, 0

        def merged():
            h, c, k = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, at = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(at, c).astype(np.int64), k[first]

        for batch in batches:
            for part in words.chunks(batch, "text"):
                data, offsets = words.column(part, "text")
                w = words.words(data, offsets, fold=True)
                u, first, c = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((u, c, lbl_net.suffixes(data, w.start[first], w.end[first]) % CLASSES))
                ends += part.num_rows
                size += len(u)
                if size > 2_000_000:
                    held = [merged()]
                    size = 0
        if ends:
            held.append((np.array([END]), np.array([ends]), np.array([0])))
            u, c, k = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(k.astype(np.int32))], names=["hash", "n", "class"])

    found = runtime.map_tasks(train.select("text"), run, "hash bigint, n bigint, class int")
    return found.groupBy("hash").agg(F.sum("n").alias("n"), F.min("class").alias("class"))


def _head(table: DataFrame, setting: Setting) -> Head:
    n, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    by_class = np.zeros(CLASSES)
    for r in table.groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        by_class[r["class"]] = r.mass
    # the most frequent words by sixteenths of a power of two: as many whole steps as HEAD holds
    level = F.floor(F.log2("n") * 16)
    least, room = None, HEAD
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        room -= r.words
        if room < 0:
            break
        least = r.level
    top = table.where(F.lit(False) if least is None else level >= least).toArrow()
    at = {c: top.column(c).to_numpy() for c in top.column_names}
    return head_of(at["hash"].astype(np.int64), at["n"].astype(np.int64), at["class"].astype(np.int64), by_class, n, distinct, setting)


def _trained(texts: DataFrame, model: Model, passes: int) -> DataFrame:
    """(block, nth, part): the changes of each shard of texts(shard, key, text), which are together and in order."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, last = None, [], None

        def out():
            for _ in range(passes - 1):  # only the bounded start sample is held for more passes
                for part in held:
                    trainer.read(part)
            found = list(trainer.changes())
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([last] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["block", "nth", "part"])

        for batch in batches:
            shard = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != last:
                    if trainer:
                        yield out()
                    last, held = int(shard[a]), []
                    trainer = lbl_net.Trainer(sent.value, last)
                for part in words.chunks(batch.slice(a, b - a), "text"):
                    own = Tokens(*words.column(part, "text"), sent.value.head, sent.value.setting)
                    trainer.read(own)
                    if passes > 1:
                        held.append(own)
        if trainer:
            yield out()

    return runtime.map_tasks(texts, run, "block bigint, nth bigint, part binary")


def _add_mean(model: Model, changes: DataFrame, shards: int) -> None:
    """Add the mean of all shards' changes to the model; `together` shards of a block meet in a task at once, then their means."""
    columns = [model.tables[name].shape[1] for name, _ in lbl_net.blocks(model)]

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        block = rows.column("block")[0].as_py()
        part = lbl_net.mean_change(rows.column("part").to_pylist(), columns[block])
        return pa.table({"block": pa.array([block], pa.int64()), "nth": rows.column("group").slice(0, 1), "part": pa.array([part], pa.binary())})

    while shards > 1:
        grouped = changes.withColumn("group", F.floor(F.col("nth") / model.setting.together)).groupBy("block", "group")
        changes, shards = grouped.applyInArrow(mean, "block bigint, nth bigint, part binary"), -(-shards // model.setting.together)
    found = changes.select("block", "part").toArrow()  # the size of the model at most
    lbl_net.load(model, sorted(zip(found.column("block").to_pylist(), found.column("part").to_pylist(), strict=True)))


def fit(docs: DataFrame, setting: Setting = Setting()) -> tuple[DataFrame, Model]:
    """Counts of all training words (a table) and the trained model, from docs(doc_id, text, held_out)."""
    train = docs.where("not held_out").select(F.xxhash64("doc_id", "text").alias("key"), "text")
    table = runtime.durable(counts(train), "counts")
    model = Model(_head(table, setting), setting)
    n = model.head.n
    if not n:
        return table, model
    drawn = train.where(F.pmod("key", F.lit(DRAW)) < F.lit(int(np.ceil(DRAW * min(1.0, setting.start_tokens / n)))))
    start = drawn.select(F.lit(0).cast("bigint").alias("shard"), "key", "text").repartition(1).sortWithinPartitions("key")
    _add_mean(model, runtime.durable(_trained(start, model, setting.start_passes), "start"), 1)
    if n > setting.start_tokens:
        shards = -(-n // setting.shard_tokens)
        dealt = train.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        texts = dealt.select("shard", "key", "text").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key")
        _add_mean(model, runtime.durable(_trained(texts, model, 1), "trained"), shards)
    return table, model


def score(docs: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text, held_out)."""
    spark, head = docs.sparkSession, model.head
    sent = spark.sparkContext.broadcast((model, model.normalisers()))
    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, base double, score double, tail array<bigint>, tail_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, z = sent.value
        head, setting = model.head, model.setting
        row = TaskContext.get().partitionId() << 40
        base_of, rest_of = np.log10(head.count + 0.5), np.log10(head.mass)
        is_rest = np.zeros(len(head.mass), bool)
        is_rest[head.base[:-1]] = True
        for batch in batches:
            for part in words.chunks(batch, "text", words.PIECE):
                n_docs = part.num_rows
                t = Tokens(*words.column(part, "text"), head, setting)
                doc = np.repeat(np.arange(n_docs), np.diff(t.first))
                there = t.row >= 0
                base = np.where(there, base_of[t.row] if len(base_of) else 0.0, 0.0)
                own = model.log_probability(t, z) / np.log(10)
                shares = (t.out == 0) & is_rest[t.leaf]  # its count is joined where the head lacks it
                own[shares] += base[shares] - rest_of[t.leaf[shares]]
                per_doc = lambda x: np.bincount(doc, x, n_docs)
                n_tokens = np.diff(t.first)
                key = np.flatnonzero(~there)
                order = key[np.lexsort((t.hash[key], doc[key]))]
                d, h = doc[order], t.hash[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(h))).astype(np.int32)
                offsets = pa.array(np.searchsorted(d[at], np.arange(n_docs + 1)).astype(np.int32))
                arrays = [
                    pa.array(row + np.arange(n_docs)), part.column(0), part.column(2), pa.array(n_tokens), pa.array(per_doc(there).astype(np.int64)),
                    pa.array(per_doc(base) - n_tokens * np.log10(head.total)), pa.array(per_doc(own)),
                    pa.ListArray.from_arrays(offsets, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times)),
                ]
                row += n_docs
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "n_tokens", "head_known", "base", "score", "tail", "tail_n"])

    first = runtime.durable(runtime.map_tasks(docs.select("doc_id", "text", "held_out"), run, schema), "scored")
    tail = first.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("hash"), F.col("t.tail_n").alias("times"))
    joined = tail.join(table, "hash", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return first.drop("tail", "tail_n").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(head.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def query(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The digest of the contract."""
    folded = _folds(docs)
    return score(folded, *fit(folded, setting))
