"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next stage's docs.  All but the last return the columns of documents.  The quality stage stores its ledger (failure
bits and measurements of every row) and applies the current policy to it.

Defined cases: an empty table gives no sequences; a row without text is rejected by the quality rules; rows without an id
stay apart in the near-copy stage; rows that repeat the id of the document that stays count as that document, of which
one row stays; columns that documents has besides its own are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, packing, quality_rules, runtime, substring_dedup

#: Near copies: five-word shingles, Jaccard similarity of 0.8 or more.
NEAR = jaccard_join.Rule(shingle=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps by the ledger, which is stored beside the rows."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard_join.representatives(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences in repeated spans; documents of which nothing is left go."""
    found = substring_dedup.dedup(docs, substring_dedup.WHOLE)
    changed = F.col(substring_dedup.removed_column(docs)) > 0
    left = found.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return packing.query(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("substring_dedup", repeated_passages), ("best_fit_packing", pack)]
#: The stages are not expressible in SQL (tokenizers, iterated components); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
