"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text.  The ledger keeps the measurements and one failure
bit a rule; policies are versioned masks over those bits, so a policy change or an ablation
is bitwise arithmetic over the ledger and never touches text again.

Defined cases: a null or empty text has no words and fails `few_words`; a null in another
column is carried along; repeated rows get equal verdicts each; an empty table gives an empty
ledger; input columns that are not named below are ignored, so clashing names cannot occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, words

#: Name of each rule; its place is its bit.
RULES = ("few_words", "repeated_words", "symbols", "shouting", "duplicate_lines", "word_length", "table_bars")
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Limits:
    """Thresholds; the first two are the fixed base rules."""

    min_words: int = 20
    repeat_percent: int = 30
    symbols_per_word: float = 0.5
    upper_share: float = 0.5
    duplicate_line_share: float = 0.5
    mean_word_chars: tuple[float, float] = (1.5, 20.0)
    bar_share: float = 0.25


#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT[r] for r in ("few_words", "repeated_words", "symbols", "shouting", "word_length")),
    "v2": sum(BIT.values()),
}
CURRENT = "v2"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bars")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _later(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (doc, hash) in text order: which have an equal one before, which have any equal one."""
    key = words.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    again = np.flatnonzero(any_)  # few; in text order, so a stable sort leaves the first of each value in front
    by_key = again[np.argsort(key[again], kind="stable")]
    later[by_key[1:][key[by_key[1:]] == key[by_key[:-1]]]] = True
    return later, any_


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    n = len(offsets) - 1
    w = words.words(data, offsets, fold=False)
    out = {"n_words": np.diff(w.first)}
    inside = ~words.SPACE[data]
    out["word_chars"] = _per_text(inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)
    out["n_upper"], out["n_letters"], out["n_bars"] = (_per_text(x, offsets) for x in (_UPPER[data], _LETTER[data], data == 124))
    # lines that hold a word
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[doc + 1])
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[full], end[full], doc[full]
    h = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # pieces of bounded size, whole lines
        to = max(at + 1, int(np.searchsorted(end, start[at] + 4 * words.PIECE)))
        base = start[at]
        h[at:to] = words.spans(data[base : end[to - 1]], start[at:to] - base, end[at:to] - base)
        at = to
    later, _ = _later(doc, h)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=n)
    # words in 8-word windows that occur twice
    h, first = words.windows(w, 8)
    total = len(w.hash)
    _, twice = _later(w.doc[first] if len(first) else first, h)
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, first[twice], 1)
    np.add.at(change, first[twice] + 8, -1)
    covered = np.cumsum(change)[:total] > 0
    out["n_repeat_words"] = _per_text(covered, w.first)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def evaluate(m: dict[str, np.ndarray], limits: Limits) -> np.ndarray:
    """Failure bits of each text."""
    n = m["n_words"]
    some = np.maximum(n, 1)
    mean = m["word_chars"] / some
    low, high = limits.mean_word_chars
    failed = {
        "few_words": n < limits.min_words,
        "repeated_words": 100 * m["n_repeat_words"] > limits.repeat_percent * n,
        "symbols": m["n_symbols"] > limits.symbols_per_word * n,
        "shouting": m["n_upper"] > limits.upper_share * m["n_letters"],
        "duplicate_lines": m["n_dup_lines"] > limits.duplicate_line_share * m["n_lines"],
        "word_length": (mean < low) | (mean > high),
        "table_bars": m["n_bars"] > limits.bar_share * n,
    }
    return sum(failed[r].astype(np.int64) << i for i, r in enumerate(RULES))


def ledger(docs: DataFrame, limits: Limits = Limits(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, the measurements and fail_bits (bigint), one row a text; one narrow pass over the text."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{m} bigint" for m in MEASURES), "fail_bits bigint"])

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text"):
            m = measure(*words.column(part, "text"))
            kept = [part.column(part.schema.get_field_index(c)) for c in carry]
            arrays = [*kept, *(pa.array(m[k]) for k in MEASURES), pa.array(evaluate(m, limits))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *MEASURES, "fail_bits"])

    extra = [] if "text" in carry else ["text"]
    return runtime.map_batches(docs.select(*carry, *extra), run, schema)


def passes(bits, policy: str = CURRENT):
    """Whether a ledger row is kept under a policy."""
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == F.lit(0)


def ledger_with_rows(docs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of the measurements and fail_bits, stored as a table; and that column's name."""
    columns, name = docs.columns, "ledger"
    while name in {c.lower() for c in columns}:
        name += "_"
    fields = [*MEASURES, "fail_bits"]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), f"{name} struct<{', '.join(f'{x}: bigint' for x in fields)}>"])

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text"):
            m = measure(*words.column(part, "text"))
            own = pa.StructArray.from_arrays([*(pa.array(m[k]) for k in MEASURES), pa.array(evaluate(m, limits))], names=fields)
            yield pa.RecordBatch.from_arrays([*part.columns, own], names=[*columns, name])

    return runtime.durable(runtime.map_batches(docs, run, schema), "ledger"), name


def keep(docs: DataFrame, policy: str = CURRENT, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the policy keeps by the stored ledger, with their columns and nothing else."""
    found, name = ledger_with_rows(docs, limits)
    return found.where(passes(F.col(f"{name}.fail_bits"), policy)).select(*docs.columns)


def ablations(found: DataFrame) -> DataFrame:
    """For each policy and rule: rows it keeps, rows the rule alone rejects, rows kept without the rule.

    One pass: bit patterns are counted first (at most 2^rules rows), the rest is bitwise arithmetic on them.
    """
    patterns = found.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(m).alias("mask")) for p, m in POLICIES.items()))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).alias("bit")) for r, b in BIT.items()))
    grid = patterns.select("fail_bits", "n", F.explode(masks).alias("p")).select("fail_bits", "n", "p.*", F.explode(rules).alias("r")).select("*", "r.*")
    left = F.col("fail_bits").bitwiseAND(F.col("mask"))
    without = left.bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        grid.groupBy("policy", "rule")
        .agg(
            count(left == 0).alias("kept"),
            count(left == F.col("bit")).alias("rejected_by_this_alone"),
            count(without == 0).alias("kept_without"),
        )
    )


def query(docs: DataFrame) -> DataFrame:
    """The digest of the contract: measurements, base_failed and kept, then the ledger's bits."""
    bits = F.col("fail_bits")
    return ledger(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *MEASURES[:5],
        (~passes(bits, "base")).alias("base_failed"),
        passes(bits).alias("kept"),
        "fail_bits",
    )
