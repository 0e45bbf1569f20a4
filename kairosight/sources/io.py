"""Readers and writers: series, article arrays, records, banks and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..operators import etl, news

ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "date", "content", "url", "summary")])
RECORD = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("doc_key", "published_at", "title", "schema_version", "schema_variant")), T.StructField("is_actionable", T.BooleanType()), T.StructField("topic_tags", T.ArrayType(T.StringType())),
    T.StructField("regime_vec", T.StructType([T.StructField(c, T.DoubleType()) for c in ("tightness", "demand_outlook", "renewable_surplus", "volatility_tone", "policy_in_effect")])),
    T.StructField("horizon_days", T.IntegerType()), T.StructField("confidence", T.DoubleType()), *(T.StructField(c, T.StringType()) for c in ("summary", "source_news_file", "source_news_stem", "source_news_digest")),
])
BANK_FIELDS = ("t", "mass", "docs")


def series(spark: SparkSession, path: str, at: str, value: str, key: str = "") -> DataFrame:
    """Text columns of a series file, Parquet or CSV by its name; parsing is a separate step."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    missing = [c for c in (at, value, *([key] if key else [])) if c not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} are not in {path}")
    return df.select(*([F.col(key).cast("string").alias("series_id")] if key else []), F.col(at).alias("ts"), F.col(value).alias("value"))


def articles(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """Articles of a JSON array: published_at parsed, rows without it dropped, duplicates removed, in time order."""
    if not path.rstrip("/").endswith(".json"):
        raise ValueError(f"articles come as .json, not {path}")
    raw = spark.read.schema(ARTICLE).option("multiLine", True).json(path).withColumn("__o", F.monotonically_increasing_id())
    dated = raw.withColumn("published_at", times.article_time(F.col(date))).where("published_at is not null")
    return news.deduplicated(dated, "__o", date=date).orderBy("published_at", "__o").drop("__o")


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not blank."""
    return df.where(F.trim(text.or_empty(F.col(column))) != "")


def records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; empty lines are skipped, malformed ones fail or, if not strict, are skipped."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bank(spark: SparkSession, path: str, fields: tuple[str, ...] = BANK_FIELDS) -> DataFrame:
    """A bank's table; an error names the fields it lacks."""
    df = spark.read.parquet(path)
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"the bank in {path} lacks {missing}")
    return df


def filtered_csv(spark: SparkSession, path: str, column: str, token: str) -> DataFrame:
    """CSV rows whose token list holds a token; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df.where(text.token_list_has(F.col(column), token))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).option("header", True).csv(path)


def write_bank(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def flat_arrays(df: DataFrame) -> DataFrame:
    """Array and struct columns as JSON text, for CSV."""
    return df.select(*(F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes))


def write_debug(df: DataFrame, path: str) -> None:
    flat_arrays(df).write.mode("overwrite").option("header", True).csv(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """A ledger with new rows in place of those with the same key; written beside the old one, then read back."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    both = new if old is None else etl.upsert(old, new, key)
    both.write.mode("overwrite").parquet(f"{path.rstrip('/')}.next")
    spark.read.parquet(f"{path.rstrip('/')}.next").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
