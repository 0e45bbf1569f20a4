"""Feeds, JSON payloads with links, and structured data inside pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, times

_ITEM = r"(?is)<item[\s>].*?</item>"


def _tag(name: str):
    body = F.regexp_extract("__item", rf"(?is)<{name}(?:\s[^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{name}>", 1)
    return F.trim(body)


def items(feeds: DataFrame, xml: str, carry: list[str]) -> DataFrame:
    """title, link, published_at (UTC) and body of each dated item of RSS documents; content:encoded wins over description."""
    one = feeds.select(*carry, F.explode(F.regexp_extract_all(xml, F.lit(_ITEM), 0)).alias("__item"))
    body = F.coalesce(F.nullif(_tag("content:encoded"), F.lit("")), _tag("description"))
    found = one.select(*carry, text.unescaped(_tag("title")).alias("title"), _tag("link").alias("link"), times.rfc822(_tag("pubDate")).alias("published_at"), text.without_tags(body).alias("body"))
    return found.where("published_at is not null")


def _walk(value, name: str) -> Iterator[str]:
    """All strings under a key, at any depth, in order."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get(name), str):
                yield v[name]
            stack.extend(reversed([x for k, x in v.items() if k != name or not isinstance(x, str)]))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def nested(df: DataFrame, payload: str, name: str, carry: list[str]) -> DataFrame:
    """carry columns and `value`: every string under a key of JSON payloads, at any depth; bad JSON has none."""
    schema = df.select(*carry, F.lit(None).cast("string").alias("value")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, s in enumerate(batch.column(len(carry)).to_pylist()):
                try:
                    values = list(_walk(json.loads(s), name)) if s else []
                except ValueError:
                    values = []
                row += [i] * len(values)
                found += values
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(carry))), pa.array(found, pa.string())], names=[*carry, "value"])

    return df.select(*carry, payload).mapInArrow(run, schema)


def structured(pages: DataFrame, html: str, carry: list[str], least_body: int = 80) -> DataFrame:
    """headline, published and body of the objects of a page's JSON-LD scripts, nested ones too; short bodies are null."""
    schema = pages.select(*carry, *(F.lit(None).cast("string").alias(c) for c in ("headline", "published", "body"))).schema

    def flat(v) -> Iterator[dict]:
        stack = [v]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                yield x
                stack.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                stack.extend(reversed(x))

    script = re.compile(r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.DOTALL | re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cols = [], ([], [], [])
            for i, s in enumerate(batch.column(len(carry)).to_pylist()):
                for block in script.findall(s or ""):
                    try:
                        objects = [o for o in flat(json.loads(block)) if "headline" in o or "articleBody" in o]
                    except ValueError:
                        continue
                    for o in objects:
                        body = o.get("articleBody")
                        row.append(i)
                        for col, v in zip(cols, (o.get("headline"), o.get("datePublished"), body if isinstance(body, str) and len(body) >= least_body else None), strict=True):
                            col.append(v if isinstance(v, str) else None)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(carry))), *(pa.array(c, pa.string()) for c in cols)], names=[*carry, "headline", "published", "body"])

    return pages.select(*carry, html).mapInArrow(run, schema)
