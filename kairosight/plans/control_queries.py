"""Queries over caches, guards, permutation p-values, names, listings, pooled vectors and lenient dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times
from ..operators import control, models
from . import fixtures as X
from .registry import query, table

#: Cases of a cache: what its records carry (variant, version, file, stem, digest), and whether they fit.
_CASES = {
    "equal": ("'load'", "'v2'", "'in/news.json'", "'news'", "'d1'", "n", True),
    "no_file": ("'load'", "''", "NULL", "''", "'d1'", "n", True),
    "two_variants": ("CASE WHEN doc_id % 2 = 0 THEN 'load' ELSE 'gas' END", "'v2'", "'news.json'", "'news'", "'d1'", "n", False),
    "other_file": ("'load'", "'v2'", "'old.json'", "'news'", "'d1'", "n", False),
    "two_stems": ("'load'", "'v2'", "'news.json'", "CASE WHEN doc_id % 2 = 0 THEN 'news' ELSE 'old' END", "'d1'", "n", False),
    "no_digest": ("'load'", "'v2'", "'news.json'", "'news'", "NULL", "n", False),
    "other_count": ("'load'", "'v2'", "'news.json'", "'news'", "'d1'", "n + 1", False),
    "old_version": ("'load'", "'v1'", "'news.json'", "'news'", "'d1'", "n", False),
}


@query("ct2_cache_match", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v[-1]})" for k, v in _CASES.items()) + ") t(case_name, matches)")
def ct2(spark, d):
    """Each case is a cache of all documents; the version is needed in the case of an old one."""
    docs = table(spark, d, "documents").select("doc_id")
    counted = docs.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # one row
    names = ("schema_variant", "schema_version", "source_news_file", "source_news_stem", "source_digest", "source_doc_count")
    case = F.explode(F.array(*(F.struct(F.lit(k).alias("case_name"), *(F.expr(e).cast("string").alias(c) for c, e in zip(names, v, strict=False))) for k, v in _CASES.items()))).alias("c")
    records = counted.select("n", case).select("n", "c.*")
    want = {"variant": "load", "version": "v2", "file": "news.json", "stem": "news", "digest": "d1"}
    found = control.cache_matches(records, ["case_name", "n"], count=F.col("n"), needs_version=F.col("case_name") == "old_version", **{k: F.lit(v) for k, v in want.items()})
    return found.select("case_name", "matches")


@query("ct4_empty_bank", "SELECT * FROM (VALUES ('given', TRUE), ('blank', FALSE), ('no_times', FALSE)) t(bank, usable)")
def ct4(spark, d):
    mass = X.mass(spark, d).select("t", "mass")
    case = F.explode(F.array(F.struct(F.lit("given").alias("bank"), "t", "mass"), F.struct(F.lit("blank").alias("bank"), F.col("t"), F.lit(0.0).alias("mass")), F.struct(F.lit("no_times").alias("bank"), F.lit(None).cast("timestamp_ntz").alias("t"), F.col("mass"))))
    return control.is_usable(mass.select(case.alias("c")).select("c.*"), ["bank"])


@query("ma18_permutation_p", """WITH o AS (SELECT event_type, round(avg(value), 9) AS score FROM events GROUP BY 1), z AS (SELECT event_type, user_id, round(avg(value), 9) AS s FROM events GROUP BY 1, 2),
p AS (SELECT o.event_type, (count(*) FILTER (s >= score) + 1) / (count(*) + 1) AS p_value FROM o JOIN z ON z.event_type = o.event_type GROUP BY 1), t AS (SELECT avg((p_value < 0.05)::INT) AS share FROM p)
SELECT event_type, round(p_value, 6) AS p_value, CASE WHEN share > 0.2 THEN 'strong' WHEN share > 0.05 THEN 'weak' ELSE 'none' END AS verdict FROM p, t""")
def ma18(spark, d):
    """The means of users stand for the scores of permutations, those of event types for the observed ones."""
    e = table(spark, d, "events")
    mean = F.round(F.avg("value"), 9).alias("score")
    p = control.permutation_p(e.groupBy("event_type").agg(mean), e.groupBy("event_type", "user_id").agg(mean), ["event_type"], "score")
    tier = p.agg(models.verdict(F.avg((F.col("p_value") < 0.05).cast("int"))).alias("verdict"))
    return p.crossJoin(F.broadcast(tier)).select("event_type", F.round("p_value", 6).alias("p_value"), "verdict")  # one row


@query("ma21_pooled_vectors", """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings WHERE vec_id % 8 < 6)
SELECT vec_id // 8 AS text_id, place, round(avg(v::DOUBLE), 6) AS value FROM x GROUP BY 1, 2""")
def ma21(spark, d):
    """Eight vectors are the tokens of a text, the last two of them padding."""
    tokens = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("text_id"), "vec_id", "embedding")
    return control.pooled(tokens, "text_id", "embedding", F.col("vec_id") % 8 < 6).select("text_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


@query("ops17_pages_read", """WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) // 3 AS page FROM orders),
p AS (SELECT o_custkey, page, min(y) AS lo, max(y) AS hi, bool_or(y = 1996) AS met FROM r GROUP BY 1, 2),
f AS (SELECT o_custkey, min(page) FILTER (met) AS first_met FROM p GROUP BY 1),
s AS (SELECT o_custkey, min(page) FILTER (hi < 1996 OR (lo < 1996 AND page >= first_met)) AS stop FROM p JOIN f USING (o_custkey) GROUP BY 1)
SELECT o_custkey, page FROM p JOIN s USING (o_custkey) WHERE page <= coalesce(stop, page)""")
def ops17(spark, d):
    """A customer's orders, newest first and three a page, are a listing that is read for one year."""
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    items = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.floor((newest - 1) / 3).cast("bigint").alias("page"))
    return control.pages_read(items, "o_custkey", "page", F.year("o_orderdate"), 1996)


@query("tx10_corpus_hint", "SELECT doc_id, contains(lower(lang || doc_id), 'e1') OR contains(lower(lang || doc_id), 'n2') AS hinted FROM documents")
def tx10(spark, d):
    path = F.concat(F.lit("e1/n2/"), F.upper("lang"), F.col("doc_id").cast("string"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", control.names_any(path, ["E1", "n2"]).alias("hinted"))


@query("tx26_found_columns", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'click Time' WHEN event_type = 'error' THEN 'ERROR' WHEN user_id = 8 THEN 'User.8' WHEN event_id % 2 = 0 THEN 'event id' END AS found FROM events""")
def tx26(spark, d):
    """Each event has a header of its own; names are compared without case and punctuation, the first wanted one that is there decides, of names alike the last."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    ids = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("Event_ID"), F.lit("event id"))).otherwise(F.array(F.lit("id")))
    names = F.concat(ids, F.array(F.concat(kind, F.lit(" Time")), F.concat(F.lit("User."), user), F.upper(kind)))
    return table(spark, d, "events").select("event_id", text.find_name(names, ["click_time", "Error", "user 8", "EventId"]).alias("found"))


_SWAPPED = "CASE WHEN day(ts) <= 12 THEN make_date(year(ts), day(ts), month(ts)) ELSE ts::DATE END"
_MINUTE = "strftime(ts, '%Y-%m-%dT%H:%M:00')"


@query("dt4_lenient_time", f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN {_MINUTE} WHEN 6 THEN strftime({_SWAPPED}, '%Y-%m-%dT00:00:00')
WHEN 7 THEN NULL ELSE strftime(ts, '%Y-%m-%dT00:00:00') END AS t FROM events""")
def dt4(spark, d):
    """Dates that the article formats do not have: written out, with weekday, ordinal, dots, no separators, or month first."""
    ts = F.col("ts")
    forms = ("EEEE, d MMMM yyyy HH:mm:ss 'GMT'", "d'th of' MMMM yyyy", "d MMM yyyy HH:mm", "yyyyMMdd", "d.M.yyyy", "EEE MMM d yyyy", "M/d/yyyy")
    said = F.coalesce(*(F.when(F.col("event_id") % 8 == i, F.date_format(ts, f)) for i, f in enumerate(forms)), F.lit("soon"))
    return table(spark, d, "events").select("event_id", F.date_format(times.lenient_time(said), "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
