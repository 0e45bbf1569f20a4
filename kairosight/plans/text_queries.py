"""Queries over article text, identities, caches and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import bank, etl, news, splits
from . import fixtures as X
from .bank_queries import R, T
from .registry import query, table

# articles: documents with made-up titles, dates and addresses; some repeat
_ART = """art AS (SELECT doc_id AS pos, '  Title  ' || (doc_id % 300) || chr(9) || 'Ab' AS title, strftime(TIMESTAMP '2024-01-01' + to_hours((doc_id % 300)::INT), '%d-%m-%Y %I:%M:%S %p') AS date,
'https://Site.example.com/a/' || (doc_id % 150) || CASE WHEN doc_id % 4 = 0 THEN '-0/' ELSE '/' END || CASE WHEN doc_id % 3 = 0 THEN '?q=1#top' ELSE '' END AS url, text AS content, lang, source FROM documents)"""


def articles(spark, d):
    i = F.col("doc_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (i % 300).cast("int"))
    url = F.concat(F.lit("https://Site.example.com/a/"), (i % 150).cast("string"), F.when(i % 4 == 0, "-0/").otherwise("/"), F.when(i % 3 == 0, "?q=1#top").otherwise(""))
    return table(spark, d, "documents").select(i.alias("pos"), F.concat(F.lit("  Title  "), (i % 300).cast("string"), F.lit("\tAb")).alias("title"), F.date_format(at, "dd-MM-yyyy hh:mm:ss a").alias("date"), url.alias("url"), F.col("text").alias("content"), "lang", "source")


_IDENT = f"""{_ART}, idn AS (SELECT *, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS kt, date AS kd, regexp_replace(url, '\\s+', '', 'g') AS ku, length(content) AS len, CASE WHEN regexp_matches(trim(url), '(?:-|%3A)0/?$') THEN 0 ELSE 1 END AS sc FROM art)"""


@query("ops12_news_dedupe", f"WITH {_IDENT} SELECT pos, title, url FROM idn QUALIFY row_number() OVER (PARTITION BY kt, kd, ku ORDER BY len DESC, sc DESC, pos) = 1")
def ops12(spark, d):
    return news.deduplicated(articles(spark, d), "pos").select("pos", "title", "url")


@query("ag21_duplicate_stats", f"WITH {_IDENT}, g AS (SELECT count(*) AS n FROM idn GROUP BY kt, kd, ku HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS removed FROM g")
def ag21(spark, d):
    return news.duplicate_statistics(articles(spark, d))


@query("ops13_canonical_score", f"WITH {_IDENT} SELECT pos, sc AS score FROM idn")
def ops13(spark, d):
    return articles(spark, d).select("pos", text.canonical_score(F.col("url")).cast("bigint").alias("score"))


@query("ops14_item_dedupe", f"WITH {_ART} SELECT pos FROM (SELECT *, CASE WHEN pos % 5 = 0 THEN '' ELSE url END AS link FROM art) QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(link, ''), title || '|' || date) ORDER BY pos) = 1")
def ops14(spark, d):
    link = F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("url"))
    return news.first_wins(articles(spark, d), news.item_key(link, F.col("title"), F.col("date")), ["pos"]).select("pos")


@query("ops11_first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))")
def ops11(spark, d):
    return news.first_wins(table(spark, d, "documents"), text.title_identity(F.col("text")), ["doc_id"]).select("doc_id")


@query("ops15_sorted_all", f"WITH {_ART} SELECT pos, row_number() OVER (ORDER BY date DESC, title DESC, pos) AS place FROM art")
def ops15_all(spark, d):
    """The place of every article by date and title."""
    return splits.placed(articles(spark, d).select("pos", "date", "title"), "date", "title", "pos").select("pos", F.col("place").cast("bigint").alias("place"))


@query("ops16_longest_candidate", f"WITH {_ART} SELECT pos, CASE WHEN length(title) >= length(url) THEN title WHEN length(lang) > length(url) THEN lang ELSE url END AS best FROM art")
def ops16(spark, d):
    longest = F.aggregate(F.array("title", "url", "lang"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return articles(spark, d).select("pos", longest.alias("best"))


@query("ops7_first_items", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def ops7(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(25).select("doc_id")


@query("tx1_title_identity", f"WITH {_IDENT} SELECT pos, kt AS title, ku AS url FROM idn")
def tx1(spark, d):
    return articles(spark, d).select("pos", text.title_identity(F.col("title")).alias("title"), text.url_identity(F.col("url")).alias("url"))


@query("tx3_compact_summary", "SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 60), ' ') AS summary FROM documents")
def tx3(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_words(F.col("text"), 60).alias("summary"))


_KEY = "CASE WHEN pos % 7 = 0 THEN 'id' || pos ELSE substr(sha1(title || '|' || date || '|' || url), 1, 16) END"


def keyed(spark, d):
    a = articles(spark, d).withColumn("id", F.when(F.col("pos") % 7 == 0, F.concat(F.lit("id"), F.col("pos").cast("string"))))
    return a.withColumn("doc_key", text.doc_identity(F.col("id"), F.col("title"), F.col("date"), F.col("url")))


@query("tx4_doc_identity", f"WITH {_ART} SELECT pos, {_KEY} AS doc_key FROM art")
def tx4(spark, d):
    return keyed(spark, d).select("pos", "doc_key")


@query("ag22_corpus_signature", f"WITH {_ART} SELECT count(*) AS doc_count, sha1(string_agg({_KEY}, chr(10) ORDER BY pos)) AS digest FROM art")
def ag22(spark, d):
    return news.signature(keyed(spark, d), "doc_key", "pos")


_REPLY = """rp AS (SELECT event_id, (props->>'k')::INT AS k, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Answer: ' || props || ' done' WHEN 2 THEN props ELSE 'no object here' END AS reply FROM events)"""


def replies(spark, d):
    e = table(spark, d, "events").withColumn("k", X.k_of())
    m = F.col("event_id") % 4
    return e.select("event_id", "k", F.when(m == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(m == 2, F.col("props")).otherwise("no object here").alias("reply"))


@query("tx5_json_object", f"WITH {_REPLY} SELECT event_id, CASE WHEN event_id % 4 < 3 THEN k END AS k FROM rp")
def tx5(spark, d):
    return replies(spark, d).select("event_id", F.get_json_object(text.json_object(F.col("reply")), "$.k").cast("bigint").alias("k"))


_TAGS = """tg AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Heatwave; cold-snap|heatwave, unknown' WHEN 1 THEN 'routine/outage' WHEN 2 THEN '' ELSE 'policy active,other,holiday,outage,fuel_shock,heatwave' END AS s FROM events)"""


def tag_text():
    m = F.col("event_id") % 4
    return F.when(m == 0, "Heatwave; cold-snap|heatwave, unknown").when(m == 1, "routine/outage").when(m == 2, "").otherwise("policy active,other,holiday,outage,fuel_shock,heatwave")


@query("tx6_topics", f"""WITH {_TAGS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'heatwave|cold_snap' WHEN 1 THEN 'routine|outage' WHEN 2 THEN '' ELSE 'policy_active|other|holiday|outage|fuel_shock' END AS tags FROM tg""")
def tx6(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(text.topic_list(tag_text()), "|").alias("tags"))


_CL = lambda x, lo, hi: f"greatest(least(CASE WHEN isfinite(try_cast({x} AS DOUBLE)) THEN try_cast({x} AS DOUBLE) ELSE 0 END, {hi}), {lo})"


@query("tx7_refine_validate", f"""WITH r AS (SELECT event_id, (props->>'k')::INT AS k, event_id % 4 AS m FROM events), s AS (SELECT *, CASE k % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'true ' WHEN 2 THEN 'no' ELSE 'actionable' END AS act, CASE WHEN k % 6 = 0 THEN 'nan' ELSE (k / 10.0)::DOUBLE::VARCHAR END AS c FROM r),
t AS (SELECT *, lower(trim(act)) IN ('1', 'true', 'yes', 'y', 'actionable') AND m <> 1 AS ok FROM s)
SELECT event_id, ok AS is_actionable, CASE WHEN m = 0 THEN 'heatwave|cold_snap' WHEN m = 1 THEN 'routine|outage' WHEN m = 3 THEN 'policy_active|other|holiday|outage|fuel_shock' WHEN ok THEN 'other' ELSE 'routine' END AS tags,
CASE WHEN ok THEN round_even({_CL("c", 0, 14)}, 0)::INT ELSE 0 END AS horizon_days, round(CASE WHEN ok THEN {_CL("c", 0, 1)} ELSE 0 END, 6) AS confidence, round(CASE WHEN ok THEN {_CL("c", -1, 1)} ELSE 0 END, 6) AS tightness,
CASE WHEN ok THEN round_even({_CL("c", 0, 1)}, 0) ELSE 0 END AS policy_in_effect FROM t""")
def tx7(spark, d):
    k = F.col("k")
    e = table(spark, d, "events").withColumn("k", X.k_of())
    act = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "true ").when(k % 4 == 2, "no").otherwise("actionable")
    c = F.when(k % 6 == 0, "nan").otherwise((k / 10.0).cast("string"))
    v = text.validated(tag_text(), act, c, c, {x: c for x in bank.COMPONENTS}, F.col("props"))
    return e.select("event_id", v["is_actionable"].alias("is_actionable"), F.array_join(v["topic_tags"], "|").alias("tags"), v["horizon_days"].cast("bigint").alias("horizon_days"), R(v["confidence"]).alias("confidence"), R(v["tightness"]).alias("tightness"), v["policy_in_effect"].alias("policy_in_effect"))


@query("tx8_default_record", f"WITH {_ART} SELECT pos, array_to_string(list_slice(string_split(trim(regexp_replace(title || ' ' || substr(content, 1, 240), '\\s+', ' ', 'g')), ' '), 1, 60), ' ') AS summary FROM art")
def tx8(spark, d):
    return articles(spark, d).select("pos", text.default_summary(F.col("title"), F.col("content")).alias("summary"))


@query("flt8_truthiness", "SELECT event_id, event_id % 6 NOT IN (0, 1, 2, 3) AS truthy, event_id % 6 IN (4) AS affirmed FROM events")
def flt8(spark, d):
    c = F.element_at(F.array(*map(F.lit, ("", "0", "False", " none ", "YES", "maybe"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.truthy(c).alias("truthy"), text.affirmed(c).alias("affirmed"))


@query("flt10_clamp", f"WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'x' WHEN 2 THEN 'inf' ELSE value::VARCHAR END AS s FROM events) SELECT event_id, round(greatest(least(CASE WHEN isfinite(try_cast(s AS DOUBLE)) THEN try_cast(s AS DOUBLE) ELSE 3 END, 40), 2), 6) AS v FROM t")
def flt10(spark, d):
    m = F.col("event_id") % 5
    c = F.when(m == 0, "nan").when(m == 1, "x").when(m == 2, "inf").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", R(text.clamp(c, 2, 40, 3)).alias("v"))


@query("flt9_token_filter", "SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split(lang || ', ' || source || ',NULL', ','), lambda x: upper(trim(x))), 'SRC3')")
def flt9(spark, d):
    return table(spark, d, "documents").where(text.token_list_has(F.concat("lang", F.lit(", "), "source", F.lit(",NULL")), "src3")).select("doc_id")


@query("src3_blank_text", "SELECT doc_id FROM documents WHERE trim(CASE WHEN doc_id % 10 = 0 THEN '  ' WHEN doc_id % 10 = 1 THEN NULL ELSE text END) <> ''")
def src3(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, "  ").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("text"))
    return table(spark, d, "documents").where(F.trim(text.or_empty(t)) != "").select("doc_id")


_CACHE = f"""{_ART}, dk AS (SELECT pos, {_KEY} AS doc_key FROM art), ca AS (SELECT doc_key, pos % 3 AS cache_order, pos AS row_order, CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN 'price' ELSE 'load' END AS variant, CASE WHEN pos % 5 = 0 THEN 'v1' ELSE 'v2' END AS version FROM dk WHERE pos % 2 = 0),
hit AS (SELECT * FROM ca WHERE variant IN ('', 'load') AND version = 'v2' QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY cache_order, row_order) = 1)"""


def cache_of(spark, d):
    p = F.col("pos")
    c = keyed(spark, d).where(p % 2 == 0).select("doc_key", (p % 3).alias("cache_order"), p.alias("row_order"), F.when(p % 4 == 0, "").when(p % 4 == 1, "price").otherwise("load").alias("schema_variant"), F.when(p % 5 == 0, "v1").otherwise("v2").alias("schema_version"), F.lit("/data/news.json").alias("source_news_file"), F.lit("news").alias("source_news_stem"))
    return news.reusable(c, "load", "v2", "news.json", "news")


@query("jn11_cache_reuse", f"WITH {_CACHE} SELECT doc_key, row_order FROM hit")
def jn11(spark, d):
    return cache_of(spark, d).select("doc_key", "row_order")


@query("st4_missing_docs", f"WITH {_CACHE} SELECT DISTINCT doc_key FROM dk WHERE doc_key NOT IN (SELECT doc_key FROM hit)")
def st4(spark, d):
    return news.with_cache(keyed(spark, d).select("doc_key").distinct(), cache_of(spark, d), ["row_order"])[1]


@query("ag19_corpus_summary", f"""WITH {_ART}, q AS (SELECT pos % 3 = 0 AS a, CASE WHEN pos % 4 = 0 THEN 'bad' ELSE date END AS date FROM art) SELECT count(*) AS total, count(*) FILTER (a) AS actionable, count(*) FILTER (a AND date <> 'bad') AS parseable, round(100.0 * count(*) FILTER (a) / count(*), 6) AS actionable_pct FROM q""")
def ag19(spark, d):
    p = F.col("pos")
    r = articles(spark, d).select((p % 3 == 0).alias("is_actionable"), F.when(p % 4 == 0, "bad").otherwise(F.col("date")).alias("date"))
    x = news.corpus_summary(r, F.col("date"))
    return x.withColumn("actionable_pct", R("actionable_pct"))


@query("ag20_corpus_values", "SELECT (SELECT string_agg(DISTINCT lang, '|' ORDER BY lang) FROM documents) AS lang, (SELECT string_agg(DISTINCT source, '|' ORDER BY source) FROM documents) AS source")
def ag20(spark, d):
    x = news.distinct_values(table(spark, d, "documents"), ["lang", "source"])
    return x.select(*(F.array_join(c, "|").alias(c) for c in x.columns))


@query("ct1_manifest_match", """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
ELSE o_orderpriority <> '1-URGENT' AND o_custkey % 3 = 1 AND o_orderstatus = 'F' END AS matches FROM orders""")
def ct1(spark, d):
    """Orders are banks: their manifests tell the decay and the variant, some lack the variant, some banks have none."""
    o, urgent = table(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT"
    decay = F.concat((F.col("o_custkey") % 3 + 4).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(".000000000001"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.filter(F.array(entry("tau", decay), entry("variant", F.when(~urgent, F.col("o_orderstatus"))), entry("made", F.col("o_orderdate").cast("string"))), lambda e: e["value"].isNotNull())
    manifests = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.inline(entries))
    return news.manifests_match(o.select("o_orderkey"), manifests, ["o_orderkey"], {"tau": 5.0, "variant": "F"})


@query("ct7_parameter_grid", "SELECT c_custkey, b AS backbone, l AS lr, h AS horizon FROM customer, (SELECT unnest(['dlinear', 'mlp']) AS b), (SELECT unnest([0.001::DOUBLE, 0.0001::DOUBLE]) AS l), (SELECT unnest([48, 96, 192]) AS h)")
def ct7(spark, d):
    """Customers are datasets, each with all settings."""
    return news.swept(table(spark, d, "customer").select("c_custkey"), backbone=["dlinear", "mlp"], lr=[0.001, 0.0001], horizon=[48, 96, 192])


@query("jn12_merged_themes", f"""WITH {_ART}, t AS (SELECT url, lang, min(pos) AS o FROM art GROUP BY 1, 2), m AS (SELECT url, string_agg(lang, '|' ORDER BY o) AS themes FROM t GROUP BY 1) SELECT m.url, themes, a.pos FROM m JOIN (SELECT url, min(pos) AS pos FROM art GROUP BY 1) a USING (url)""")
def jn12(spark, d):
    return news.merged_themes(articles(spark, d), "url", "lang", "pos", ["pos"]).select("url", F.array_join("themes", "|").alias("themes"), "pos")


@query("jn13_feed_merge", f"WITH {_ART} SELECT url, source, pos FROM art QUALIFY row_number() OVER (PARTITION BY url ORDER BY source, pos) = 1")
def jn13(spark, d):
    return news.first_wins(articles(spark, d), F.col("url"), ["source", "pos"]).select("url", "source", "pos")


# pages and addresses
@query("tx13_url_canonical", "SELECT page_id, CASE WHEN regexp_matches(u, '^[a-z]+://[^/]*/?$') THEN regexp_replace(u, '/*$', '/') ELSE regexp_replace(u, '/+$', '') END AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)")
def tx13(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query("tx14_domain", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE lower(regexp_extract(url, '://([^/:?#]+)', 1)) END AS domain FROM pages")
def tx14(spark, d):
    k = F.col("page_id") % 4
    bare = F.regexp_replace("url", "^[a-z]+:", "")
    u = F.when(k == 0, F.upper("url")).when(k == 1, bare).when(k == 2, F.concat(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit(":8080/x"))).otherwise("mailto:a@b.c")
    return table(spark, d, "pages").select("page_id", text.domain(u).alias("domain"))


@query("ag26_domain_counts", "SELECT count(*) AS links, count(d) AS valid, count(DISTINCT d) AS domains FROM (SELECT CASE WHEN page_id % 5 = 0 THEN NULL ELSE lower(regexp_extract(url, '://([^/:?#]+)', 1)) END AS d FROM pages)")
def ag26(spark, d):
    return etl.domain_counts(table(spark, d, "pages").select(F.when(F.col("page_id") % 5 == 0, "ftp://x.y/z").otherwise(F.col("url")).alias("link")), "link")


@query("tx15_query_builder", "SELECT page_id, CASE WHEN h LIKE 'www.%' THEN substr(h, 5) ELSE h END AS site, CASE WHEN page_id % 3 = 0 THEN '\"two words\"' WHEN page_id % 3 = 1 THEN 'one' ELSE 'theme:X y' END AS word, '(domain:a.b OR domain:c.d)' AS both FROM (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS h FROM pages)")
def tx15(spark, d):
    k = F.col("page_id") % 3
    w = F.when(k == 0, "two words").when(k == 1, "one").otherwise("theme:X y")
    return table(spark, d, "pages").select("page_id", text.domain_filter(F.col("url")).alias("site"), text.keyword_filter(w).alias("word"), text.any_of(F.array(F.lit("a.b"), F.lit(""), F.lit("c.d")), "domain:").alias("both"))


@query("tx16_article_urls", "SELECT page_id, regexp_matches(url, '^https?://[^/]*example\\.com[/?#]') AND regexp_matches(url, '^https?://[^/]*/(en|fr)/') AS ok FROM pages")
def tx16(spark, d):
    return table(spark, d, "pages").select("page_id", text.is_article(F.col("url"), ("example.com",), "^/(en|fr)/").alias("ok"))


_UN = lambda x: f"replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&quot;', '\"'), '&amp;', '&')"
_SQ = lambda x: f"trim(regexp_replace({_UN(f'''regexp_replace({x}, '<[^>]+>', ' ', 'g')''')}, '\\s+', ' ', 'g'))"


@query("tx17_html_fields", f"SELECT page_id, {_SQ('''regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)''')} AS title FROM pages")
def tx17(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("tx18_page_date", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-03-0' || (page_id % 9 + 1) WHEN 1 THEN '2024-04-01T10:00:00Z' WHEN 2 THEN 'March 5, 2024' ELSE '' END AS date FROM pages")
def tx18(spark, d):
    k = F.col("page_id") % 4
    head = F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="2024-03-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('">'))).when(k == 1, F.lit('<time datetime="2024-04-01T10:00:00Z">')).when(k == 2, F.lit("<p>March 5, 2024</p>")).otherwise("")
    return table(spark, d, "pages").select("page_id", text.page_date(F.concat(head, F.col("html"))).alias("date"))


@query("tx19_page_blocks", f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>(.*?)(?:</article>|$)', 1), '(?is)<(?:p|li|h2|h3|blockquote)(?:\\s[^>]*)?>(.*?)</(?:p|li|h2|h3|blockquote)>', 1)) AS b FROM pages)
SELECT DISTINCT page_id, {_SQ("b")} AS block FROM b WHERE {_SQ("b")} <> ''""")
def tx19(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(text.page_blocks(F.col("html"))).alias("block"))


@query("tx20_page_links", """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"''#]+)', 1)) AS u FROM pages) SELECT DISTINCT page_id, CASE WHEN u LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || u ELSE u END AS link FROM l""")
def tx20(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(text.page_links(F.col("html"), F.col("url"))).alias("link"))


@query("tx12_tags_stripped", f"SELECT page_id, md5({_SQ('html')}) AS h FROM pages")
def tx12(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(text.without_tags(F.col("html")), r"\s+", " "))).alias("h"))


@query("tx11_clean_text", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace('  ' || text || chr(13) || '  x ', chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents")
def tx11(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_lines(F.concat(F.lit("  "), "text", F.lit("\r  x "))).alias("t"))


@query("tx21_before_stops", "SELECT doc_id, trim(substr(text, 1, least(coalesce(nullif(position('the' IN lower(text)), 0), 1000000), coalesce(nullif(position('und' IN lower(text)), 0), 1000000), length(text) + 1) - 1)) AS t FROM documents")
def tx21(spark, d):
    return table(spark, d, "documents").select("doc_id", text.before_stops(F.col("text"), ("The", "und")).alias("t"))


@query("tx24_content_prefix", f"WITH {_ART}, s AS (SELECT pos, CASE WHEN pos % 4 = 0 THEN NULL ELSE content END AS c, CASE WHEN pos % 3 = 0 THEN substr(content, 1, 20) ELSE 'Summary' END AS s FROM art) SELECT pos, CASE WHEN c IS NULL THEN s WHEN starts_with(c, s) THEN c ELSE s || chr(10) || c END AS t FROM s")
def tx24(spark, d):
    p = F.col("pos")
    s = F.when(p % 3 == 0, F.substring("content", 1, 20)).otherwise("Summary")
    return articles(spark, d).select("pos", text.content_or_summary(s, F.when(p % 4 != 0, F.col("content"))).alias("t"))


@query("tx25_extract_summary")
def tx25(spark, d):
    return table(spark, d, "documents").select("doc_id", text.extract_summary(F.col("text")).alias("summary"))


@query("tx27_line_content", "SELECT page_id, 'First line ' || page_id || chr(10) || 'Second' AS t FROM pages")
def tx27(spark, d):
    i = F.col("page_id").cast("string")
    t = F.concat(F.lit("My Title\n12 March 2024\n3 min read\n\n First line "), i, F.lit("\r\nSecond\nShare this\nafter "), i)
    return table(spark, d, "pages").select("page_id", text.line_content(t, F.lit("my title")).alias("t"))


@query("tx28_task_names", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'run_' || event_id || '_x' ELSE 'plain' END AS base, CASE WHEN event_id % 2 = 0 THEN '1e-4' ELSE '' END AS rate, 'a-b_c' AS part FROM events")
def tx28(spark, d):
    i = F.col("event_id").cast("string")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("run_"), i, F.lit("__lr1e-4__ga2__schcos_x"))).otherwise("plain")
    b = text.task_base(name)
    return table(spark, d, "events").select("event_id", b.base.alias("base"), b.rate.alias("rate"), text.task_part(F.lit(" a/b  c_"), "na").alias("part"))


@query("tx29_cache_names", "SELECT page_id, regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g') AS name FROM pages")
def tx29(spark, d):
    return table(spark, d, "pages").select("page_id", text.cache_name(F.col("url")).alias("name"))


@query("tx31_count_text", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 100)::BIGINT::VARCHAR WHEN event_id % 3 = 1 THEN '' ELSE '2.5' END AS t FROM events")
def tx31(spark, d):
    k = F.col("event_id") % 3
    v = F.when(k == 0, (F.col("event_id") % 100).cast("double")).when(k == 2, 2.5)
    return table(spark, d, "events").select("event_id", text.count_text(v).alias("t"))


#: Sections of this query's argument keys.
_SECTIONS = {"News": "^news_", "Residual model": "^delta_", "Data": "_file$"}


@query("flt13_masked_secrets", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'abcd***wxyz' WHEN 1 THEN '***' WHEN 2 THEN 'visible-value' ELSE '' END AS v, CASE event_id % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'Other' WHEN 2 THEN 'Residual model' ELSE 'Other' END AS section FROM events")
def flt13(spark, d):
    """FLT13 and FLT14."""
    at = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 4 + 1).cast("int"))
    key = at("news_api_key_API_KEY", "hf_token", "delta_token_budget", "password")
    return table(spark, d, "events").select("event_id", text.mask_secret(key, at("abcd-secret-wxyz", "short", "visible-value", "")).alias("v"), text.section(key, _SECTIONS).alias("section"))


@query("tx23_feed_items", "SELECT event_id, 'Item ' || event_id AS title, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'short' END AS body FROM events WHERE event_id % 5 <> 0")
def tx23(spark, d):
    from ..sources import feeds

    e = table(spark, d, "events")
    item = F.concat(F.lit("<item><title>Item "), F.col("event_id").cast("string"), F.lit("</title><link>http://x/"), F.col("event_id").cast("string"), F.lit("</link>"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("<pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))).otherwise(""), F.lit("<description>short</description>"), F.when(F.col("event_id") % 2 == 0, "<content:encoded><![CDATA[<p>full</p>]]></content:encoded>").otherwise(""), F.lit("</item>"))
    feed = F.concat(F.lit('<rss xmlns:content="c"><channel>'), item, F.lit("</channel></rss>"))
    return feeds.items(e.select("event_id", feed.alias("xml")), "xml", ["event_id"]).select("event_id", "title", T("published_at").alias("at"), F.col("body").alias("body"))
