"""Decisions about caches, listings and names, permutation p-values, and pooled vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .ranges import free


def cache_matches(records: DataFrame, by: list[str], variant: Column, version: Column, file: Column, stem: Column, count: Column, digest: Column, needs_version: Column) -> DataFrame:
    """by, matches: whether a cache of records belongs to what is expected.

    records has schema_variant, schema_version, source_news_file, source_news_stem, source_doc_count and source_digest.
    Variant, count and digest must have exactly one value, the expected one; file and stem too where they are given at
    all; the version only where it is needed.  Blank values count as absent.  Only the least and the greatest value of
    a column are kept, so partial aggregates stay small.  A by without records has no row.
    """
    base = F.regexp_extract(text.or_empty(F.col("source_news_file")), "([^/]*)$", 1)
    given = {"variant": F.col("schema_variant"), "version": F.col("schema_version"), "file": base, "stem": F.col("source_news_stem"), "count": F.col("source_doc_count").cast("string"), "digest": F.col("source_digest")}
    some = {k: F.nullif(F.trim(text.or_empty(c)), F.lit("")) for k, c in given.items()}
    ends = records.groupBy(*by).agg(*(f(c).alias(f"{k}_{f.__name__}") for k, c in some.items() for f in (F.min, F.max)))

    def only(k: str, want: Column) -> Column:
        return F.coalesce((F.col(f"{k}_min") == want) & (F.col(f"{k}_max") == want), F.lit(False))

    def only_or_none(k: str, want: Column) -> Column:
        return F.col(f"{k}_min").isNull() | only(k, want)

    fits = only("variant", variant) & (~needs_version | only("version", version)) & only_or_none("file", file) & only_or_none("stem", stem)
    return ends.select(*by, (fits & only("count", count.cast("string")) & only("digest", digest)).alias("matches"))


def is_usable(bank: DataFrame, by: list[str]) -> DataFrame:
    """by, usable: whether a bank has times and mass above zero at any of them."""
    return bank.groupBy(*by).agg((F.count("t") > 0).alias("times"), F.coalesce(F.bool_or(F.col("mass") > 0), F.lit(False)).alias("some")).select(*by, (F.col("times") & F.col("some")).alias("usable"))


def permutation_p(observed: DataFrame, null: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, score, n_null, p_value: (scores of permutations that reach the observed one + 1) / (permutations + 1).

    A key without permutations has p-value 1; a null or NaN score has none.
    """
    reached = null.select(*keys, F.col(score).alias("null_score")).join(observed.select(*keys, score), keys)
    counts = reached.groupBy(*keys).agg(F.count("null_score").alias("n_null"), F.count_if(F.col("null_score") >= F.col(score)).alias("reach"))
    some = F.col(score).isNotNull() & ~F.isnan(score)
    n, r = F.coalesce("n_null", F.lit(0)), F.coalesce("reach", F.lit(0))
    return observed.join(counts, keys, "left").select(*keys, score, n.alias("n_null"), F.when(some, (r + 1) / (n + 1)).alias("p_value"))


def pages_read(items: DataFrame, listing: str, page: str, year: Column, target: int) -> DataFrame:
    """listing, page of the pages that a reader of dated listings takes, newest first.

    It stops after a page that goes below the target year once that year was met, and after one that has older years
    only.  Pages without years decide nothing.
    """
    ends = items.groupBy(listing, page).agg(F.min(year).alias("oldest"), F.max(year).alias("newest"), F.coalesce(F.bool_or(year == target), F.lit(False)).alias("met"))
    so_far = Window.partitionBy(listing).orderBy(page)
    met = F.max(F.col("met")).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    stops = F.coalesce((met & (F.col("oldest") < target)) | (F.col("newest") < target), F.lit(False))
    marked = ends.withColumn("stops", stops)
    earlier = F.coalesce(F.max("stops").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return marked.withColumn("earlier", earlier).where("not earlier").select(listing, page)


def names_any(path: Column, tokens: list[str]) -> Column:
    """Whether the last part of a path holds one of the tokens, in any case."""
    base = F.lower(F.trim(F.regexp_extract(text.or_empty(path), "([^/]*)$", 1)))
    return F.greatest(*(F.contains(base, F.lit(t.lower())) for t in tokens), F.lit(False))


def pooled(tokens: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """key, place (from 0), value: the mean of the unmasked token vectors; without any, no row."""
    places = tokens.where(mask).select(key, F.posexplode(vector).alias("place", "x"))
    return places.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("value"))


def resolution(wanted: DataFrame, manifests: DataFrame, by: list[str], rebuild: Column) -> DataFrame:
    """by, outcome, path: where the bank of each row of wanted comes from, in one pass over the manifests.

    manifests has by, kind ('bank' or 'refined'; others do not count), place (0 is the preferred one, null the last), path,
    matches (whether its metadata are the expected ones; null is unknown, which a bank may be and a refined corpus may not)
    and filled (whether it has mass; null is unknown).  Unless it is to be rebuilt, the first matching bank is taken:
    'preferred' or 'older', or 'empty' if it has no mass.  Then 'reuse' of the first matching corpus, 'sync' from corpora that
    do not match, 'build' where a rebuild is asked for, else 'missing'.  path is that of the bank or corpus taken.
    """
    bank, corpus, seeds, again = (free(n, wanted) for n in ("bank", "corpus", "seeds", "again"))
    kind, matches = F.col("kind"), F.col("matches")
    first = lambda when: F.min(F.when(when, F.struct(F.coalesce("place", F.lit((1 << 31) - 1)).alias("place"), "path", "filled")))
    refined = F.coalesce(kind == "refined", F.lit(False))
    best = manifests.groupBy(*by).agg(
        first((kind == "bank") & F.coalesce(matches, F.lit(True))).alias(bank),
        first(refined & F.coalesce(matches, F.lit(False))).alias(corpus),
        F.bool_or(refined).alias(seeds),
    )
    x = wanted.select(*by, F.coalesce(rebuild, F.lit(False)).alias(again)).join(best, by, "left")
    has_bank = ~F.col(again) & F.col(bank).isNotNull()
    of_bank = F.when(~F.coalesce(F.col(f"{bank}.filled"), F.lit(True)), "empty").when(F.col(f"{bank}.place") == 0, "preferred").otherwise("older")
    outcome = F.when(has_bank, of_bank).when(F.col(corpus).isNotNull(), "reuse").when(F.col(seeds), "sync").when(F.col(again), "build").otherwise("missing")
    return x.select(*by, outcome.alias("outcome"), F.when(has_bank, F.col(f"{bank}.path")).otherwise(F.col(f"{corpus}.path")).alias("path"))


def opened(resolved: DataFrame, makers: dict[str, Callable[[str | None], DataFrame]]) -> DataFrame:
    """The table of a resolution of one row: only the maker of its outcome is called, with the path; an error if there is none."""
    row = resolved.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a resolution of one row is needed")
    if row[0].outcome not in makers:
        raise ValueError(f"the bank cannot be had: {row[0].outcome}")
    return makers[row[0].outcome](row[0].path)
