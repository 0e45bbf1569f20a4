"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Best-fit decreasing looks at lengths only, and equal lengths are interchangeable.  So the
executors tokenise and count pieces by length; the driver packs the histogram (one entry for
each length up to the capacity, whatever the corpus) with a segment tree over remaining
capacities, placing runs of equal pieces into runs of equally full bins; and the executors map
each piece by its rank among pieces of its length to a sequence and an offset.

Defined cases: a null or empty text is the end token alone; repeated rows, null ids and clashing
column names are packed row by row; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime, words

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
#: Ids and words that a worker remembers (some 120 MB); beyond either the memo starts anew, results stay the same.
MEMO_IDS, MEMO_WORDS = 12_000_000, 3_000_000
#: Words given to the library as one text, with spaces between.
TOGETHER = 256


class Memo:
    """Word hash -> place and number of its ids: a large sorted table and a small recent one that is merged now and then."""

    def __init__(self):
        self.tables = [np.zeros((3, 0), np.int64), np.zeros((3, 0), np.int64)]

    def __len__(self) -> int:
        return sum(t.shape[1] for t in self.tables)

    def find(self, h: np.ndarray) -> np.ndarray:
        """(place, number) of each hash; a place of -1 where it is not known."""
        out = np.full((2, len(h)), -1)
        for t in self.tables:
            own = t[0].view(np.uint64)
            at = np.searchsorted(own, h)
            met = at < len(own)
            met[met] = own[at[met]] == h[met]
            out[:, met] = t[1:, at[met]]
        return out

    def add(self, h: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
        """New hashes, sorted."""
        large, small = self.tables
        small = self._merged(small, np.stack([h.view(np.int64), place, n]))
        if 4 * small.shape[1] > large.shape[1]:
            large, small = self._merged(large, small), np.zeros((3, 0), np.int64)
        self.tables = [large, small]

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.insert(a, np.searchsorted(a[0].view(np.uint64), b[0].view(np.uint64)), b, axis=1)


class Tokens:
    """Token ids of texts through a memo of white-space words, looked up by hash for a whole batch at once.

    The tokenizer drops white space and no token crosses it, so a text's ids are its words' ids in order; only
    words not met before go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._clear()

    def _clear(self) -> None:
        self.memo, self.ids, self.used = Memo(), np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words one after the other, and the number of ids of each."""
        body = data.tobytes()
        text = [body[s:e].decode("utf-8") for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        groups = [text[at : at + TOGETHER] for at in range(0, len(text), TOGETHER)]
        ids, n = [], []
        for own, e in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            where = np.fromiter((x[0] for x in e.offsets), np.int64, len(e.ids))  # in characters
            ids.append(np.array(e.ids, np.uint32))
            n.append(np.bincount(np.searchsorted(ends, where, "right"), minlength=len(own)))
        return np.concatenate(ids), np.concatenate(n)

    def _learn(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember these words, whose hashes are sorted and new."""
        found, n = self._encoded(data, start, end)
        if self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used // 2, 2 * len(found)), np.uint32)])
        self.ids[self.used : self.used + len(found)] = found
        self.memo.add(h, self.used + np.cumsum(n) - n, n)
        self.used += len(found)

    def encode(self, batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with its end token, and where each text's ids begin."""
        data, offsets = words.column(batch, name)
        w = words.words(data, offsets, fold=False)
        if self.used > MEMO_IDS or len(self.memo) > MEMO_WORDS:
            self._clear()
        u, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
        place, n = self.memo.find(u)
        if (place < 0).any():
            new = place < 0
            self._learn(data, u[new], w.start[first[new]], w.end[first[new]])
            place, n = self.memo.find(u)
        place, n = place[word], n[word]
        ends = np.cumsum(n)
        begin = np.concatenate([[0], ends])[w.first] + np.arange(len(offsets))
        out = np.full(int(begin[-1]), END, np.uint32)
        inside = np.ones(len(out), bool)
        inside[begin[1:] - 1] = False
        out[inside] = self.ids[np.repeat(place - (ends - n), n) + np.arange(int(n.sum()))]
        return out, begin


_tokens: dict[str, Tokens] = {}
runtime.remembers(_tokens.clear)


def tokens(path: str | None = None) -> Tokens:
    """This process's tokenizer for a vocabulary file; by default the public one of this machine."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and rank: rank counts pieces of a length in a task from 0."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        coder = tokens(path)
        for batch in batches:
            for part in words.chunks(batch, "text", 2 * words.PIECE):
                ids_, begin = coder.encode(part, "text")
                count = -(-np.diff(begin) // capacity)
                row = np.repeat(np.arange(part.num_rows), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(np.diff(begin)[row] - start, capacity)
                at = begin[row] + start
                body = memoryview(ids_.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(body[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_of = length[order]
                nth = np.arange(len(row)) - np.searchsorted(run_of, run_of)
                rank = np.empty(len(row), np.int64)
                rank[order] = seen[run_of] + nth
                seen += np.bincount(length, minlength=capacity + 1)
                arrays = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if ids:
                    ends = np.append(at, begin[-1]).astype(np.int32)
                    arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids_.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return runtime.map_tasks(docs.select("doc_id", "text"), run, schema + (", ids array<int>" if ids else ""))


class Capacities:
    """Segment tree over remaining capacities: which have open bins, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += change
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity >= length with an open bin."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing of a histogram of lengths.

    Rows (length, rank, bin, each, offset), sorted: pieces of a length from that rank on fill bins from that
    number on, `each` to a bin, from that offset.  A bin that took a piece and still fits another of the same
    length is the tightest one, so each bin of a run takes as many as fit before the next does.
    """
    tree, runs = Capacities(capacity), {}  # runs: remaining capacity -> [first bin, bins]
    rows, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            runs.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                first, n = runs[room].pop()
                tree.add(room, -1)
            full = min(n, left // each)
            rows += [(length, rank, first, each, capacity - room)] if full else []
            put(room - each * length, first, full)
            left, rank = left - full * each, rank + full * each
            if full < n and left:  # fewer are left than the next bin takes
                rows.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, n - full)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), table.T.copy(), strict=True)) | {"bins": np.array([bins])}


def place(p: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces of these lengths and ranks."""
    wide = np.int64(1) << 48
    row = np.searchsorted(p["length"] * wide + p["rank"], length * wide + rank, "right") - 1
    nth = rank - p["rank"][row]
    return p["bin"][row] + nth // p["each"][row], p["offset"][row] + nth % p["each"][row] * length


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of each piece.

    The driver sees at most `capacity` counts; the plan it sends has a few rows for each length.
    """
    spark = docs.sparkSession
    found = runtime.durable(pieces(docs, capacity, path, ids), "pieces")
    by_task = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = spark.sparkContext.broadcast(plan(histogram, capacity))
    out = [f for f in found.schema.fields if f.name not in ("task", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)

    def run(batch: pa.RecordBatch):
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        sequence, offset = place(sent.value, np.asarray(at["length"]), np.asarray(at["rank"]))
        yield pa.RecordBatch.from_arrays([*(at[f.name] for f in out), pa.array(sequence), pa.array(offset)], names=[*(f.name for f in out), "sequence_id", "offset"])

    ranked = found.join(shift, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "task")
    return runtime.map_batches(ranked, run, schema + ", sequence_id bigint, offset bigint")


def query(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return pack(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
