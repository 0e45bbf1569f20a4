"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_trie, collocations, fill_in_middle, hash_forest, html_extraction, jaccard_join, lbl_model, license_scan, packing, pipeline, quality_rules, substring_dedup, token_counts, toxicity
from .runtime import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.query(table(spark, sf_dir, "pages"))


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.query(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_model.query(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op7b_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, and what each rule decides alone, from the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(table(spark, sf_dir, "documents"))


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.query(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(table(spark, sf_dir, "documents"), substring_dedup.WHOLE)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.query(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.query(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_hash_prefix_forest": op2_hash_prefix_forest,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op7b_rule_ablations": op7b_rule_ablations,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_trie": op9_bpe_trie,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_toxicity": op13_toxicity,
    "pipeline": pipeline.run,
}
ORACLE: dict[str, str] = {
    "op5_license_scan": license_scan.oracle(),
    "op11_phrase_collocations": collocations.oracle(),
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
