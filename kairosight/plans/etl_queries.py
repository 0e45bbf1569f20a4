"""Queries over rollups, upserts, readers and writers, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bank, etl, information, models, windows
from ..sources import feeds, io, stored
from ..streaming import bank_stream
from . import fixtures as X
from .bank_queries import GRID, R, T, _labels
from .registry import query, table
from .time_queries import with_split


def wide(spark, d):
    """event types by day with counts of each hour as text."""
    e = table(spark, d, "events").select(F.col("event_type").alias("station_key"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("h"), F.round("value", 2).alias("value"))
    p = e.groupBy("station_key", "date").pivot("h", list(range(24))).agg(F.round(F.sum("value"), 2))
    named = p.select("station_key", F.concat("date", F.lit("T00:00:00")).alias("date"), F.substring("date", 1, 4).alias("year"), *(F.col(str(h)).cast("string").alias(f"hour_{h:02d}") for h in range(24)))
    return named.withColumn("record_id", F.concat_ws("-", "station_key", "date"))


_WIDE = """w AS (SELECT event_type AS station_key, date_trunc('day', ts) AS day, hour(ts) AS h, round(sum(round(value, 2)), 2) AS v FROM events GROUP BY ALL),
x AS (SELECT s.station_key, s.day + to_hours(h.h::INT) AS time, w.v FROM (SELECT DISTINCT station_key, day FROM w) s CROSS JOIN (SELECT unnest(range(24)) AS h) h LEFT JOIN w ON w.station_key = s.station_key AND w.day = s.day AND w.h = h.h)"""


@query("ag24_hourly_unpivot", f"WITH {_WIDE} SELECT station_key, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, round(v, 2) AS traffic_count FROM x WHERE station_key = 'click'")
def ag24(spark, d):
    x = etl.hourly(etl.matching(wide(spark, d), 2024, station_key="click"))
    return etl.aggregated(x, "none", []).select("station_key", T("time").alias("time"), R("traffic_count", 2).alias("traffic_count"))


for _mode, _sql in (("sum", "sum(v)"), ("mean", "avg(v)"), ("first", "arg_min(v, station_key) FILTER (v IS NOT NULL)")):

    def _ag24(spark, d, mode=_mode):
        x = etl.aggregated(etl.hourly(etl.matching(wide(spark, d), 2024)), mode, ["station_key", "record_id"])
        return x.select(T("time").alias("time"), R("traffic_count", 4).alias("traffic_count"))

    query(f"ag24_hourly_{_mode}", f"WITH {_WIDE} SELECT strftime(time, '%Y-%m-%d %H:%M:%S') AS time, round({_sql}, 4) AS traffic_count FROM x GROUP BY time")(_ag24)


@query("flt6_year_filter", "SELECT count(DISTINCT (event_type, ts::DATE)) AS n FROM events WHERE year(ts) = 2024 AND event_type = 'view'")
def flt6(spark, d):
    return etl.matching(wide(spark, d), 2024, station_key="view").agg(F.count(F.lit(1)).alias("n"))


@query("ag25_point_rollup", """SELECT l_shipdate::DATE::VARCHAR AS period_from, l_returnflag AS unit, round(sum(l_quantity), 6) AS total_value, count(*) AS record_count, count(DISTINCT l_suppkey || '-' || l_linestatus) AS point_count,
string_agg(DISTINCT l_suppkey || '-' || l_linestatus, '|' ORDER BY l_suppkey || '-' || l_linestatus) AS point_directions FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1, 2""")
def ag25(spark, d):
    li = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("period_from"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").cast("string").alias("value"), F.col("l_suppkey").alias("operator"), F.lit("-").alias("point"), F.col("l_linestatus").alias("direction"), F.year("l_shipdate").alias("year"))
    return etl.rollup(li, F.col("value"), ["period_from", "unit"], ["operator", "point", "direction"], F.col("year"), 1996)


@query("flt7_exit_points", """SELECT s_nationkey || 'p' || s_suppkey % 40 || 'exit' AS point, max(s_suppkey) AS s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 GROUP BY 1""")
def flt7(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.lit("FNC").alias("pointType"), F.when(k % 2 == 0, "Exit").otherwise("exit").alias("directionKey"), F.lit("nl").alias("tSOCountry"), F.when(k % 3 == 0, "0").otherwise("1").alias("hasData"), F.when(k % 5 == 0, "true").otherwise("none").alias("isInvalid"), F.col("s_nationkey").cast("string").alias("operatorKey"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("pointKey"))
    return etl.exit_points(s, "FNC", "NL", "s_suppkey").select(F.lower("pointDirection").alias("point"), "s_suppkey")


@query("snk6_upsert", """SELECT o_orderkey, o_totalprice, NULL AS added FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 'new' FROM orders WHERE o_orderkey % 3 = 0""")
def snk6(spark, d):
    o = table(spark, d, "orders")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("added"))
    return etl.upsert(o.select("o_orderkey", "o_totalprice"), new, "o_orderkey")


@query("snk7_merge_all_pages", """WITH a AS (SELECT page_id AS pos, 'http://s/' || page_id AS url, 'old' AS v FROM pages WHERE page_id % 3 <> 2), b AS (SELECT page_id AS pos, 'http://s/' || page_id || '/?x' AS url, 'new' || page_id AS v FROM pages WHERE page_id % 3 <> 0),
n AS (SELECT max(pos) + 1 AS n FROM a)
SELECT a.pos, coalesce(b.v, a.v) AS v FROM a LEFT JOIN b ON b.url = a.url || '/?x' UNION ALL SELECT b.pos + n, b.v FROM b, n WHERE b.url NOT IN (SELECT url || '/?x' FROM a)""")
def snk7_all(spark, d):
    """Every page is old, incoming or both: a third each stays, is appended and is replaced in its place."""
    p = table(spark, d, "pages")
    u = F.concat(F.lit("http://s/"), F.col("page_id").cast("string"))
    a = p.where("page_id % 3 <> 2").select(F.col("page_id").alias("pos"), u.alias("url"), F.lit("old").alias("v"))
    b = p.where("page_id % 3 <> 0").select(F.col("page_id").alias("pos"), F.concat(u, F.lit("/?x")).alias("url"), F.concat(F.lit("new"), F.col("page_id").cast("string")).alias("v"))
    return etl.merged_by_url(a, b, "url", "pos").select("pos", "v")


@query("st1_union_all", "SELECT 'a' AS part, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderkey % 2 <> 0")
def st1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    both = o.where("o_orderkey % 2 = 0").withColumn("part", F.lit("a")).unionByName(o.where("o_orderkey % 2 <> 0").withColumn("part", F.lit("b")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("st2_union_evolving", "SELECT o_orderkey, o_orderstatus, NULL AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 <> 0")
def st2(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").unionByName(o.where("o_orderkey % 2 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("p")), allowMissingColumns=True)


@query("st3_distinct_times", "SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def st3(spark, d):
    return table(spark, d, "events").select(T(F.date_trunc("HOUR", "ts")).alias("t")).distinct()


@query("st5_distinct_paths", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a/b|c' ELSE 'x' END AS paths FROM events")
def st5(spark, d):
    p = F.when(F.col("event_id") % 2 == 0, F.array(*map(F.lit, ("a//b/", "./a/b", "c", "a/b")))).otherwise(F.array(F.lit("x"), F.lit("x/")))
    clean = F.transform(p, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "/+", "/"), r"^\./", ""), "/$", ""))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_distinct(clean), "|").alias("paths"))


_DAY = f"WITH {X.MASS}, b AS (SELECT t::DATE AS day, max(mass) AS mass FROM mass GROUP BY 1), v AS (SELECT ts::DATE AS day, avg(value) AS y FROM events GROUP BY 1)"


def _daily_bank(spark, d):
    return X.mass(spark, d).groupBy(F.to_date("t").alias("day")).agg(F.max("mass").alias("mass"))


def _daily_target(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("y"))


@query("jn9_lag_align", f"{_DAY} SELECT l.lag, v.day::VARCHAR AS day, round(mass, 6) AS mass, round(y, 6) AS y FROM b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) l JOIN v ON v.day = b.day + l.lag::INT")
def jn9(spark, d):
    x = etl.lag_aligned(_daily_bank(spark, d), _daily_target(spark, d), (0, 1, 2, 3))
    return x.select(F.col("lag").cast("bigint").alias("lag"), F.col("day").cast("string").alias("day"), R("mass").alias("mass"), R("y").alias("y"))


@query("flt11_membership", f"{_DAY} SELECT day::VARCHAR AS day, round(y, 6) AS y FROM v WHERE day IN (SELECT day FROM b WHERE mass > 20)")
def flt11(spark, d):
    return _daily_target(spark, d).join(_daily_bank(spark, d).where("mass > 20"), "day", "left_semi").select(F.col("day").cast("string").alias("day"), R("y").alias("y"))


@query("jn10_label_bank_join", f"""{_DAY}, s AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS s, sum(value * value) AS s2 FROM events GROUP BY 1),
p AS (SELECT day, sqrt(greatest(s2 / n - (s / n) ** 2, 0)) AS now, sum(n) OVER w AS pn, sum(s) OVER w AS ps, sum(s2) OVER w AS ps2 FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT p.day::VARCHAR AS day, round(ln(greatest(now, 1e-6) / greatest(sqrt(greatest(ps2 / pn - (ps / pn) ** 2, 0)), 1e-6)), 6) AS vol_ratio, round(coalesce(mass, 0), 6) AS mass FROM p LEFT JOIN b USING (day) WHERE pn IS NOT NULL""")
def jn10(spark, d):
    x = _labels(spark, d).join(_daily_bank(spark, d), "day", "left")
    return x.select(F.col("day").cast("string").alias("day"), R("vol_ratio").alias("vol_ratio"), R(F.coalesce("mass", F.lit(0.0))).alias("mass"))


@query("wn13_shape_deviation", f"""WITH {X.SERIES}, c AS (SELECT series_id, ts::DATE AS day, list((value - m) / greatest(s, 1e-6) ORDER BY ts) AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM series WINDOW w AS (PARTITION BY series_id, ts::DATE)) GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM c), u AS (SELECT series_id, day, i, len(z) AS n, unnest(z) AS z, generate_subscripts(z, 1) AS p FROM i),
m AS (SELECT a.series_id, a.day, a.p, a.z, avg(b.z) AS past FROM u a LEFT JOIN u b ON b.series_id = a.series_id AND b.i BETWEEN a.i - 30 AND a.i - 1 AND b.n = a.n AND b.p = a.p GROUP BY ALL)
SELECT series_id, day::VARCHAR AS day, round(coalesce(avg((z - past) ** 2), 0), 6) AS shape_dev FROM m GROUP BY 1, 2""")
def wn13(spark, d):
    """Every series; days are numbered for each of them, one row a day."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("series_id", "day")
    s = X.series(spark, d).withColumn("day", F.to_date("ts"))
    z = s.select("series_id", "day", "ts", ((F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-6))).alias("z"))
    placed = z.withColumn("p", F.row_number().over(w.orderBy("ts"))).withColumn("n", F.count(F.lit(1)).over(w))
    days = placed.select("series_id", "day").distinct().withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("day")))
    u = placed.join(days, ["series_id", "day"])
    later = F.explode(F.sequence(F.col("i") + 1, F.col("i") + 30)).alias("i")
    past = u.select("series_id", later, "n", "p", F.col("z").alias("before")).groupBy("series_id", "i", "n", "p").agg(F.avg("before").alias("past"))
    gap = F.col("z") - F.col("past")
    found = u.join(past, ["series_id", "i", "n", "p"], "left").groupBy("series_id", "day").agg(R(F.coalesce(F.avg(gap * gap), F.lit(0.0))).alias("shape_dev"))
    return found.select("series_id", F.col("day").cast("string").alias("day"), "shape_dev")


@query("ag27_prompt_stats", "SELECT count(*) AS prompts, max(k) AS most, min(k) FILTER (k > 0) AS least, round(avg(k), 6) AS mean FROM (SELECT (props->>'k')::BIGINT AS k FROM events)")
def ag27(spark, d):
    x = etl.prompt_statistics(table(spark, d, "events").withColumn("k", X.k_of().cast("bigint")), "event_id", F.col("k"))
    return x.select("prompts", "most", "least", R("mean").alias("mean"))


@query("ag28_masked_mean", "SELECT event_type, round(sum(value * (user_id % 2)) / greatest(sum(user_id % 2), 1e-6), 6) AS m FROM events GROUP BY 1")
def ag28(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(R(etl.masked_mean(F.col("value"), F.col("user_id") % 2)).alias("m"))


@query("ma19_normalised_scores", """WITH s AS (SELECT event_type, day(ts) AS day, avg(value) AS s FROM events GROUP BY 1, 2), m AS (SELECT *, greatest(s - median(s) OVER (PARTITION BY event_type), 0) AS a FROM s)
SELECT event_type, day, round(CASE WHEN max(a) OVER (PARTITION BY event_type) > 1e-12 THEN a / max(a) OVER (PARTITION BY event_type) ELSE 1 END, 6) AS norm FROM m""")
def ma19(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").cast("bigint").alias("day")).agg(F.avg("value").alias("s"))
    return etl.normalised_scores(s, "s", ["event_type"]).select("event_type", "day", R("norm").alias("norm"))


@query("ma22_padded", f"""WITH {X.SERIES}, a AS (SELECT series_id, ts::DATE AS day, list(value ORDER BY ts) AS a FROM series GROUP BY 1, 2), p AS (SELECT *, unnest(range(24)) AS pos FROM a)
SELECT series_id, day::VARCHAR AS day, pos, round(coalesce(a[pos + 1], 0), 6) AS v, (pos < len(a))::INT::DOUBLE AS mask FROM p""")
def ma22(spark, d):
    a = X.series(spark, d).groupBy("series_id", F.to_date("ts").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("a"))
    z = F.arrays_zip(windows.fit_right(F.col("a"), 24).alias("v"), windows.mask_right(F.col("a"), 24).alias("m"))
    return a.select("series_id", F.col("day").cast("string").alias("day"), F.posexplode(z).alias("pos", "x")).select("series_id", "day", F.col("pos").cast("bigint").alias("pos"), R("x.v").alias("v"), F.col("x.m").alias("mask"))


# readers and writers: what is written and read again
@query("src1_series_csv", f"WITH {X.SERIES} SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, round(value, 6) AS v FROM series")
def src1(spark, d):
    """SRC1 and SNK1: splits written as CSV and read as text."""
    from ..functions import times

    path = stored.place(spark, "series")
    io.write_splits(with_split(spark, d).select("series_id", T("ts").alias("date"), "value", "split"), path)
    return io.series(spark, path, "date", "value", "series_id").select("series_id", T(times.series_time(F.col("ts"), True)).alias("t"), R(F.col("value").cast("double")).alias("v"))


@query("src2_article_array", "SELECT count(*) AS n, count(DISTINCT title) AS titles FROM (SELECT DISTINCT doc_id % 300 AS title FROM documents)")
def src2(spark, d):
    from .text_queries import articles

    path = stored.place(spark, "articles") + ".json"
    rows = articles(spark, d).select(F.floor(F.col("pos") / 500).alias("file"), F.struct("title", "date", "content", F.lit("u").alias("url")).alias("a"))
    rows.groupBy("file").agg(F.to_json(F.collect_list("a")).alias("value")).select("value").write.text(path)  # arrays of up to 500 articles
    x = io.articles(spark, path)
    return io.with_text(x, "title").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("title").alias("titles"))


@query("src4_record_lines", f"WITH {X.NEWS} SELECT count(*) AS n, round(sum(confidence), 6) AS confidence, sum(horizon_days)::BIGINT AS days FROM news")
def src4(spark, d):
    """SRC4 and SNK3."""
    path = stored.place(spark, "records")
    io.write_records(X.news(spark, d).select(F.col("doc_id").cast("string").alias("doc_key"), "confidence", "horizon_days"), path)
    return io.records(spark, path).agg(F.count(F.lit(1)).alias("n"), R(F.sum("confidence")).alias("confidence"), F.sum("horizon_days").alias("days"))


@query("src5_malformed_lines", "SELECT count(*) AS n FROM events WHERE event_id % 4 <> 0")
def src5(spark, d):
    path = stored.place(spark, "lines")
    line = F.when(F.col("event_id") % 4 == 0, "{bad").otherwise(F.concat(F.lit('{"doc_key": "'), F.col("event_id").cast("string"), F.lit('", "confidence": 0.5}')))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return io.records(spark, path, strict=False).where("doc_key is not null").agg(F.count("doc_key").alias("n"))


@query("src6_nested_links", "SELECT event_id, unnest(['http://a/' || event_id, 'http://b/' || event_id]) AS value FROM events WHERE event_id % 3 <> 0")
def src6(spark, d):
    i = F.col("event_id").cast("string")
    payload = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"x": [{"link": "http://a/'), i, F.lit('"}, {"y": {"link": "http://b/'), i, F.lit('", "n": 1}}]}')))
    return feeds.nested(table(spark, d, "events").select("event_id", payload.alias("p")), "p", "link", ["event_id"])


@query("tx22_structured_data", "SELECT event_id, 'Head ' || event_id AS headline, CASE WHEN event_id % 2 = 0 THEN repeat('b', 90) END AS body FROM events WHERE event_id % 3 <> 0")
def tx22(spark, d):
    i = F.col("event_id")
    obj = F.concat(F.lit('{"@graph": [{"@type": "NewsArticle", "headline": "Head '), i.cast("string"), F.lit('", "articleBody": "'), F.when(i % 2 == 0, "b" * 90).otherwise("short"), F.lit('"}]}'))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.when(i % 3 == 0, "{oops").otherwise(obj), F.lit("</script></html>"))
    return feeds.structured(table(spark, d, "events").select("event_id", page.alias("html")), "html", ["event_id"]).select("event_id", "headline", "body")


@query("src7_bank_table", f"WITH {X.MASS} SELECT count(*) AS n, round(sum(mass), 6) AS mass, sum(docs)::BIGINT AS docs FROM mass")
def src7(spark, d):
    """SRC7 and SNK2."""
    path = stored.place(spark, "bank")
    io.write_bank(X.mass(spark, d), path)
    return io.bank(spark, path).agg(F.count(F.lit(1)).alias("n"), R(F.sum("mass")).alias("mass"), F.sum("docs").alias("docs"))


@query("src9_filtered_csv", "SELECT count(*) AS n FROM documents WHERE source = 'src5' OR lang = 'src5'")
def src9(spark, d):
    path = stored.place(spark, "tokens")
    table(spark, d, "documents").select("doc_id", F.concat_ws(",", "lang", "source").alias("currencies")).write.option("header", True).csv(path)
    return io.filtered_csv(spark, path, "currencies", "SRC5").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_append", f"WITH {X.STEPS} SELECT 2 * count(*) AS n, round(2 * sum(y), 4) AS y FROM steps")
def snk4(spark, d):
    path = stored.place(spark, "answers")
    rows = X.steps(spark, d).select(F.col("base").alias("pred"), F.col("y").alias("true"))
    io.append(rows, path)
    io.append(rows, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), R(F.sum("true"), 4).alias("y"))


@query("snk5_debug_rows", f"WITH {X.NUMBERED} SELECT series_id, i AS start, {X.HORIZON} AS n FROM numbered WHERE i % {X.STRIDE} = 0 AND i <= n - {X.HISTORY + X.HORIZON}")
def snk5(spark, d):
    """SNK5 and TX30: array cells are JSON text."""
    path = stored.place(spark, "debug")
    io.write_debug(X.samples(spark, d).select("series_id", "start", "target"), path)
    back = spark.read.csv(path, header=True, schema="series_id string, start long, target string", escape="\\")
    return back.select("series_id", "start", F.size(F.from_json("target", "array<double>")).cast("bigint").alias("n"))


@query("snk6_ledger_file", "SELECT o_orderkey % 10 AS task, CASE WHEN o_orderkey % 10 < 5 THEN 2 ELSE 1 END AS v FROM orders GROUP BY 1, 2")
def snk6_ledger(spark, d):
    path = stored.place(spark, "ledger")
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("task")).distinct()
    io.upsert(spark, path, o.withColumn("v", F.lit(1).cast("bigint")), "task")
    return io.upsert(spark, path, o.where("task < 5").withColumn("v", F.lit(2).cast("bigint")), "task")


# streams and models
@query("stream_bank_mass", f"WITH {X.FORCE} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round(sum(w), 6) AS mass, count(*) AS docs FROM force GROUP BY t")
def stream_bank(spark, d):
    """The streaming form over a bounded table."""
    x = bank_stream.mass(X.news(spark, d), GRID, X.TAU)
    return x.select(T("t").alias("t"), R("mass").alias("mass"), "docs")


@query("ma8_linear_forecast")
def ma8(spark, d):
    """Decomposition and last-value forecasters by ridge regression, fitted on windows that end before 21 January; errors on those whose targets come later, against the last value."""
    x = X.samples(spark, d)
    cut, last = F.lit("2024-01-21").cast("timestamp_ntz"), F.element_at("history", -1)
    fitted, s = x.where(F.element_at("target_times", -1) < cut), x.where(F.element_at("target_times", 1) >= cut)
    a = models.fit_decomposition(fitted, X.HISTORY, X.HORIZON, 7)
    b = models.fit_last_value(fitted, X.HISTORY, X.HORIZON)
    p = s.select("target", models.linear_scores(models.decomposed(F.col("history"), 7), a).alias("a"), F.transform(models.linear_scores(F.transform("history", lambda x: x - last), b), lambda x: x + last).alias("b"), F.array_repeat(last, X.HORIZON).alias("base"))
    mae = lambda c: F.avg(F.aggregate(F.zip_with(c, "target", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda u, v: u + v) / X.HORIZON)
    return p.agg(*(R(mae(c), 4).alias(f"mae_{c}") for c in ("a", "b", "base")))


@query("ma16_principal_components")
def ma16(spark, d):
    e = table(spark, d, "embeddings")
    c = models.principal_components(e, "embedding", 64, 3)
    v = F.col("embedding").cast("array<double>")
    dot = lambda w: F.aggregate(F.zip_with(v, F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", *(R(dot(w), 5).alias(f"pc{i + 1}") for i, w in enumerate(c)))


_MI = f"""{_DAY}, lg AS (SELECT l.lag, v.day, mass AS x, y FROM b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) l JOIN v ON v.day = b.day + l.lag::INT),
pr AS (SELECT * FROM lg QUALIFY count(*) OVER (PARTITION BY lag) >= 20), nu AS (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY day) - 1 AS place FROM pr),
sh AS (SELECT lag, trial, x, place, row_number() OVER (PARTITION BY lag, trial ORDER BY ('0x' || md5('7:' || trial || ':' || place)[1:13])::UBIGINT, place) - 1 AS target FROM nu, (SELECT unnest(range(1, 201)) AS trial)),
ev AS (SELECT lag, 0 AS trial, place, x, y FROM nu UNION ALL SELECT sh.lag, trial, sh.place, sh.x, nu.y FROM sh JOIN nu ON nu.lag = sh.lag AND nu.place = sh.target),
z AS (SELECT lag, trial, place, round(x / stddev_pop(x) OVER w * 1073741824)::BIGINT AS x, round(y / stddev_pop(y) OVER w * 1073741824)::BIGINT AS y, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY lag, trial)),
pp AS (SELECT a.lag, a.trial, a.place, a.n, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, a.place = b.place AS own FROM z a JOIN z b ON a.lag = b.lag AND a.trial = b.trial),
kk AS (SELECT lag, trial, place, greatest(dx, dy) AS d FROM pp WHERE NOT own QUALIFY row_number() OVER (PARTITION BY lag, trial, place ORDER BY greatest(dx, dy)) = 3),
cn AS (SELECT lag, trial, place, n, count(*) FILTER (dx < d OR dx = 0 AND d = 0) AS nx, count(*) FILTER (dy < d OR dy = 0 AND d = 0) AS ny FROM pp JOIN kk USING (lag, trial, place) GROUP BY ALL),
dg AS (SELECT m, coalesce(sum(1.0 / (m - 1)) FILTER (m > 1) OVER (ORDER BY m), 0) - 0.5772156649015329 AS v FROM (SELECT unnest(range(1, 5000)) AS m)),
mi AS (SELECT lag, trial, greatest(0, any_value(dn.v) + (SELECT v FROM dg WHERE m = 3) - avg(dx.v + dy.v)) AS mi FROM cn JOIN dg dn ON dn.m = n JOIN dg dx ON dx.m = nx JOIN dg dy ON dy.m = ny GROUP BY ALL),
pv AS (SELECT r.lag, r.mi, (count(*) FILTER (s.mi >= r.mi - 1e-12) + 1) / 201 AS p FROM mi r JOIN mi s ON s.lag = r.lag AND s.trial > 0 WHERE r.trial = 0 GROUP BY ALL)
SELECT lag, round(mi, 6) AS mi, round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'strong' ELSE 'none' END AS verdict FROM pv"""


@query("ma17_mutual_information", _MI)
def ma17(spark, d):
    """MA17 and MA18: lags of the bank against daily means, with 200 permutations."""
    pairs = etl.lag_aligned(_daily_bank(spark, d), _daily_target(spark, d), (0, 1, 2, 3))
    x = information.tested(pairs, ["lag"], "mass", "y", "day", 200)
    return x.select(F.col("lag").cast("bigint").alias("lag"), R("mi").alias("mi"), R("p_value").alias("p_value"), models.verdict((F.col("p_value") < 0.05).cast("double")).alias("verdict"))
