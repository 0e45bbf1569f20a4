"""Articles and their records: identity, duplicates, signatures, caches and manifests."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times
from .ranges import free


def identity(date: Column, title: Column, url: Column) -> dict[str, Column]:
    return {"__title": text.title_identity(title), "__time": times.article_time_text(date), "__url": text.url_identity(url)}


def deduplicated(news: DataFrame, order: str, date: str = "date", title: str = "title", url: str = "url", content: str = "content") -> DataFrame:
    """One row an identity (title, second, address): the longest content, then the better address, then the first.

    As long as no identity with a title and a time repeats, nothing is removed; if one does, all identities collapse.
    """
    keyed = news.withColumns(identity(F.col(date), F.col(title), F.col(url)))
    valid = (F.col("__title") != "") & (F.col("__time") != "")
    any_ = keyed.where(valid).groupBy("__title", "__time", "__url").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("__any"))
    best = Window.partitionBy("__title", "__time", "__url").orderBy(F.desc(F.length(text.or_empty(F.col(content)))), F.desc(text.canonical_score(F.col(url))), order)
    ranked = keyed.withColumn("__r", F.row_number().over(best)).crossJoin(F.broadcast(any_))  # one row
    return ranked.where((F.col("__r") == 1) | ~F.col("__any")).select(*news.columns)


def duplicate_statistics(news: DataFrame, date: str = "date", title: str = "title", url: str = "url") -> DataFrame:
    """One row: groups of valid identities that repeat, and rows beyond the first in them."""
    groups = news.select(*(c.alias(k) for k, c in identity(F.col(date), F.col(title), F.col(url)).items())).where("__title <> '' and __time <> ''").groupBy("__title", "__time", "__url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def first_wins(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def item_key(link: Column, title: Column, date: Column) -> Column:
    return F.coalesce(F.nullif(text.or_empty(link), F.lit("")), F.concat_ws("|", text.or_empty(title), text.or_empty(date)))


def merged_themes(items: DataFrame, url: str, theme: str, order: str, fields: list[str]) -> DataFrame:
    """One row an address with the first of each field and the distinct themes in order of appearance."""
    firsts = items.groupBy(url, theme).agg(F.min(order).alias("__o")).groupBy(url).agg(F.array_sort(F.collect_list(F.struct("__o", theme))).alias("__t"))
    lead = first_wins(items, F.col(url), [order]).select(url, *fields)
    return lead.join(firsts.select(url, F.transform("__t", lambda x: x[theme]).alias("themes")), url)


def signature(docs: DataFrame, key: str, order: str, blocks: int = 1024) -> DataFrame:
    """One row: number of keys and the SHA-1 of the keys joined by line breaks in order.

    A digest of an ordered whole is sequential, so the keys, and only they, meet in one aggregate buffer.
    """
    listed = docs.agg(F.count(F.lit(1)).alias("doc_count"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text.or_empty(F.col(key))).alias("k")))).alias("keys"))
    return listed.select("doc_count", F.sha1(F.array_join(F.transform("keys", lambda x: x.k), "\n")).alias("digest"))


def reusable(cached: DataFrame, variant: str, version: str, source_file: str, source_stem: str, needs_version: bool = False) -> DataFrame:
    """The first fitting row of each doc_key over caches in order (columns cache_order and row_order); empty fields fit."""
    base = F.regexp_extract(text.or_empty(F.col("source_news_file")), "([^/]*)$", 1)
    fits = lambda c, want: (text.or_empty(c) == "") | (text.or_empty(c) == want)
    ok = (text.or_empty(F.col("doc_key")) != "") & fits(F.col("schema_variant"), variant) & fits(F.col("schema_version"), version) & fits(base, source_file) & fits(F.col("source_news_stem"), source_stem)
    if needs_version:
        ok &= text.or_empty(F.col("schema_version")) != ""
    return first_wins(cached.where(ok), F.col("doc_key"), ["cache_order", "row_order"])


def with_cache(docs: DataFrame, cache: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs joined to their cached records, and the docs without one."""
    return docs.join(cache.select("doc_key", *fields), "doc_key", "inner"), docs.join(cache, "doc_key", "left_anti")


def corpus_summary(records: DataFrame, date: Column) -> DataFrame:
    """One row: records, actionable ones, those with a date that parses, and their share in percent."""
    n, acts = F.count(F.lit(1)), F.count_if("is_actionable")
    parsed = F.count_if(F.col("is_actionable") & times.bank_time(date).isNotNull())
    return records.agg(n.alias("total"), acts.alias("actionable"), parsed.alias("parseable"), F.when(n > 0, 100.0 * acts / n).otherwise(0.0).alias("actionable_pct"))


def distinct_values(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the sorted distinct values of each column; meant for columns of a few values."""
    return records.agg(*(F.array_sort(F.collect_set(F.trim(text.or_empty(F.col(c))))).alias(c) for c in columns))


def manifests_match(banks: DataFrame, manifests: DataFrame, on: list[str], expected: dict[str, str | float]) -> DataFrame:
    """banks with matches: null without a manifest, else whether every expected key has an equal value (numbers to 1e-8).

    manifests has the columns on, key and value (text); a key that is there twice must be equal both times, a missing one is not.
    """
    key, value, n, found = (F.col("key"), F.col("value"), free("n", banks), free("found", banks))
    near = lambda v: F.abs(value.try_cast("double") - v) <= 1e-8
    same = {k: near(float(v)) if isinstance(v, (int, float)) else value == v for k, v in expected.items()}
    equal = [F.coalesce(F.bool_and(F.when(key == k, F.coalesce(s, F.lit(False)))), F.lit(False)) for k, s in same.items()]
    told = manifests.groupBy(*on).agg(F.count(F.lit(1)).alias(n), reduce(and_, equal, F.lit(True)).alias(found))
    return banks.join(told, on, "left").withColumn("matches", F.when(F.col(n) > 0, F.col(found))).drop(n, found)


def swept(df: DataFrame, **axes: list) -> DataFrame:
    """Each row of df with all combinations of named parameter values, a bounded sweep."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df
