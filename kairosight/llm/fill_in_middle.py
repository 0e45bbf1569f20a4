"""Fill-in-middle transformation of texts by an Arrow-batched pandas UDF.

A text is cut into units by a pattern (by default lines with their break).  finditer gives the unit ends, which are kept
in one compact array of offsets; the prefix and the middle end at two of them, chosen by the digest of a seed and the
document's id, so two lookups slice the text.  The parts are put behind marks in one of two orders; a text that holds a
mark, an empty one, and the share that is not transformed stay plain.

The operator is row by row: no shuffle, and a lost executor costs its own rows only.  Batches are bounded in bytes, so
one very long text needs memory for itself and its output.

Defined cases: a null text counts as empty and is plain; a null id takes the seed with nothing behind it; rows that repeat
an id are cut at the same places as far as their texts agree in units; an empty table gives no rows; other columns of the
input are carried along, also those that are called like a result (the results are fields of one new column).
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Rule:
    """How texts are cut and how many of them, in percent, are transformed, and of those in the order that starts with the suffix."""

    unit: str = r"[^\n]*\n|[^\n]+"
    seed: str = "7"
    percent: int = 100
    suffix_first_percent: int = 50


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    return array("q", (m.end() for m in unit.finditer(text)))


def seeds(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four groups of eight hexadecimal digits of the digest of a document's seed."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    return h1, h2, h3, h4


def transform(text: str, doc_id: int | None, rule: Rule, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the output of one text."""
    ends = unit_ends(text, unit)
    h1, h2, h3, h4 = seeds(rule.seed, doc_id)
    if not text or h3 % 100 >= rule.percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rule.suffix_first_percent:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that gave an output; no part of it holds a mark, so the first of each is the mark itself."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    cut = output.index(second, len(PREFIX))
    last = output.index(MIDDLE, cut + len(second))
    first, other, middle = output[len(PREFIX) : cut], output[cut + len(second) : last], output[last + len(MIDDLE) :]
    return other + middle + first if form == "spm" else first + middle + other


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def filled(text: Column, doc_id: Column, rule: Rule = Rule()) -> Column:
    """A struct of FIELDS for each text."""

    @F.pandas_udf(FIELDS)
    def batch(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        unit = regex.compile(rule.unit)
        rows = []
        for t, i in zip(texts, ids, strict=True):
            n, form, prefix, middle, output = transform(t or "", int(i) if i else None, rule, unit)
            rows.append((n, form, prefix, middle, output, _sha256(output), _sha256(restore(output, form))))
        found = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
        return found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return batch(text, doc_id.cast("bigint").cast("string"))  # ids as text: a nullable number would become a float


def transformed(docs: DataFrame, rule: Rule = Rule(), name: str = "fim") -> DataFrame:
    """Every row of docs with one more column, a struct of FIELDS: the output text, its form, lengths and digests."""
    runtime.prepare_batches(docs.sparkSession)
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, filled(F.col("text"), F.col("doc_id"), rule))


def query(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    out = transformed(docs.select("doc_id", "text"))
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(f"fim.{f}").alias(f) for f in fields))


#: The same in SQL.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM k),
p AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
