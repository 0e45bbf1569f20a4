"""Queries over time parsing, splits and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import splits
from . import fixtures as X
from .bank_queries import R, T
from .registry import query, table

_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%m/%d/%Y %H:%M"]
_JAVA = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "MM/dd/yyyy HH:mm"]
_TEXT = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(_FORMATS)) + " ELSE 'bad ' || event_id END"


def texts(spark, d, formats=_JAVA):
    c = F.lit(None).cast("string")
    for i, f in reversed(list(enumerate(formats))):
        c = F.when(F.col("event_id") % (len(formats) + 1) == i, F.date_format("ts", f)).otherwise(c)
    return table(spark, d, "events").select("event_id", "ts", F.coalesce(c, F.concat(F.lit("bad "), F.col("event_id").cast("string"))).alias("s"))


def _duck(*formats):
    return "coalesce(" + ", ".join(f"try_strptime(s, '{f}')" for f in formats) + ")"


_ISO3, _DF3, _MF3 = _FORMATS[:3], _FORMATS[3:6], ["%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y"]
S = "'%Y-%m-%d %H:%M:%S'"


@query("dt1_multiformat_time", f"WITH t AS (SELECT event_id, {_TEXT} AS s FROM events) SELECT event_id, strftime({_duck(*_ISO3, *_DF3)}, {S}) AS day_first, strftime({_duck(*_ISO3, *_MF3)}, {S}) AS month_first FROM t")
def dt1(spark, d):
    return texts(spark, d).select("event_id", T(times.series_time(F.col("s"), True)).alias("day_first"), T(times.series_time(F.col("s"), False)).alias("month_first"))


_SPLIT = "CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'val' ELSE 'test' END"


@query("dt2_day_first_flip", f"""WITH t AS (SELECT {_SPLIT} AS split, strftime(ts, '%m/%d/%Y %H:%M') AS s FROM events), p AS (SELECT split, try_strptime(s, '%d/%m/%Y %H:%M') AS a, try_strptime(s, '%m/%d/%Y %H:%M') AS b FROM t),
m AS (SELECT max(a) FILTER (split = 'train') >= min(a) FILTER (split = 'val') AS i1, max(a) FILTER (split = 'val') >= min(a) FILTER (split = 'test') AS i2, max(b) FILTER (split = 'train') >= min(b) FILTER (split = 'val') AS j1, max(b) FILTER (split = 'val') >= min(b) FILTER (split = 'test') AS j2,
count(*) FILTER (a IS NULL) AS nulls, count(*) FILTER (b IS NULL) AS other_nulls FROM p),
n AS (SELECT coalesce(i1::INT, 0) + coalesce(i2::INT, 0) AS issues, coalesce(j1::INT, 0) + coalesce(j2::INT, 0) AS other_issues, nulls, other_nulls FROM m)
SELECT issues, other_issues, nulls, other_nulls, NOT ((issues > 0 AND other_issues = 0 AND other_nulls <= nulls) OR (issues = 0 AND other_issues = 0 AND other_nulls < nulls)) AS day_first FROM n""")
def dt2(spark, d):
    s = F.when(F.dayofmonth("ts") <= 20, "train").when(F.dayofmonth("ts") <= 25, "val").otherwise("test")
    t = table(spark, d, "events").select(s.alias("split"), F.date_format("ts", "MM/dd/yyyy HH:mm").alias("s"))
    x = splits.flip_day_first(t, "s", "split", ("train", "val", "test"), True)
    return x.select(F.col("issues").cast("bigint").alias("issues"), F.col("other_issues").cast("bigint").alias("other_issues"), "nulls", "other_nulls", "day_first")


_AF = ["%d-%m-%Y %I:%M:%S %p", "%Y-%m-%dT%H:%M:%S+10:00", "%b %d, %Y %I:%M %p", "%B %d, %Y", "%d/%m/%Y %H:%M", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%SZ"]
_AJ = ["dd-MM-yyyy hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss'+10:00'", "MMM dd, yyyy hh:mm a", "MMMM dd, yyyy", "dd/MM/yyyy HH:mm", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
_ATEXT = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(_AF)) + " ELSE 'bad ' || event_id END"
_APARSE = ["%d-%m-%Y %I:%M:%S %p", "%Y-%m-%dT%H:%M:%S+10:00", "%Y-%m-%dT%H:%M:%SZ", "%b %d, %Y %I:%M %p", "%B %d, %Y", "%d/%m/%Y %H:%M", "%Y/%m/%d"]


@query("dt3_article_time", f"WITH t AS (SELECT event_id, {_ATEXT} AS s FROM events) SELECT event_id, coalesce(strftime({_duck(*_APARSE)}, '%Y-%m-%dT%H:%M:%S'), '') AS t FROM t")
def dt3(spark, d):
    """DT3 to DT5: the offset is dropped without conversion; unparsed dates become the empty string."""
    return texts(spark, d, _AJ).select("event_id", times.article_time_text(F.concat(F.lit("  "), F.regexp_replace("s", " ", "  "))).alias("t"))


@query("dt6_bank_time", f"WITH t AS (SELECT event_id, {_ATEXT} AS s FROM events) SELECT event_id, strftime(CASE WHEN s LIKE '%+10:00' THEN try_strptime(s, '%Y-%m-%dT%H:%M:%S+10:00') - INTERVAL 10 HOUR ELSE {_duck('%d-%m-%Y %I:%M:%S %p', '%Y-%m-%dT%H:%M:%SZ', '%d/%m/%Y %H:%M')} END, {S}) AS t FROM t")
def dt6(spark, d):
    return texts(spark, d, _AJ).select("event_id", T(times.bank_time(F.col("s"))).alias("t"))


@query("dt7_has_time", f"WITH t AS (SELECT event_id, {_ATEXT} AS s FROM events) SELECT event_id, regexp_matches(s, '[0-9]{{1,2}}:[0-9]{{2}}') OR regexp_matches(s, '(?i)\\b(AM|PM)\\b') AS has_time FROM t")
def dt7(spark, d):
    return texts(spark, d, _AJ).select("event_id", times.has_time_of_day(F.col("s")).alias("has_time"))


@query("dt9_frequency", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN event_id % 100 WHEN event_id % 4 = 2 THEN 0 ELSE 30 END AS minutes FROM events")
def dt9(spark, d):
    k = F.col("event_id") % 4
    v = F.when(k == 0, "abc").when(k == 1, F.concat((F.col("event_id") % 100).cast("string"), F.lit(".9"))).when(k == 2, "-5").otherwise(" 30 ")
    return table(spark, d, "events").select("event_id", times.frequency_minutes(v).cast("bigint").alias("minutes"))


@query("dt10_infer_freq", """WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events), g AS (SELECT (epoch(t) - epoch(lag(t) OVER (ORDER BY t))) / 60 AS m FROM t), h AS (SELECT median(m) AS m FROM g WHERE m > 0),
d AS (SELECT DISTINCT o_orderdate AS t FROM orders), e AS (SELECT (epoch(t) - epoch(lag(t) OVER (ORDER BY t))) / 60 AS m FROM d), f AS (SELECT median(m) AS m FROM e WHERE m > 0)
SELECT 'events' AS src, CASE WHEN m < 1440 THEN round_even(m, 0)::BIGINT ELSE 0 END AS minutes FROM h UNION ALL SELECT 'orders', CASE WHEN m < 1440 THEN round_even(m, 0)::BIGINT ELSE 0 END FROM f""")
def dt10(spark, d):
    a = splits.inferred_minutes(X.series(spark, d), "ts").select(F.lit("events").alias("src"), F.col("minutes").cast("bigint").alias("minutes"))
    return a.union(splits.inferred_minutes(table(spark, d, "orders"), "o_orderdate").select(F.lit("orders"), F.col("minutes").cast("bigint")))


@query("dt13_axis_label", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fine, strftime(ts, '%Y-%m-%d') AS daily FROM events")
def dt13(spark, d):
    return table(spark, d, "events").select("event_id", times.axis_label(F.col("ts"), 30).alias("fine"), times.axis_label(F.col("ts"), 1440).alias("daily"))


@query("dt15_patch_calendar", f"""WITH {X.NUMBERED}, w AS (SELECT series_id, i AS start FROM numbered WHERE i % {X.STRIDE} = 0 AND i <= n - {X.HISTORY + X.HORIZON})
SELECT w.series_id, w.start, p AS patch, isodow(ts) - 1 AS dow, hour(ts) * 2 + (minute(ts) >= 30)::INT AS hod FROM w, (SELECT unnest(range(0, 5)) AS p), numbered v WHERE v.series_id = w.series_id AND v.i = w.start + least({X.HISTORY}, p * 4 + 8) - 1""")
def dt15(spark, d):
    from ..operators.residual import calendar_keys

    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), "history_times", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("patch"))
    k = calendar_keys(F.element_at("history_times", F.least(F.size("history_times"), F.col("patch") * 4 + 8)))
    return s.select("series_id", "start", F.col("patch").cast("bigint").alias("patch"), k["dow"].cast("bigint").alias("dow"), k["hod"].cast("bigint").alias("hod"))


@query("dt16_fixed_column", f"WITH t AS (SELECT event_id, {_TEXT} AS s FROM events) SELECT event_id, coalesce(strftime({_duck('%d/%m/%Y %H:%M', '%d/%m/%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%m/%d/%Y %H:%M')}, {S}), '') AS t FROM t")
def dt16(spark, d):
    return texts(spark, d).select("event_id", times.fixed_column(F.col("s")).alias("t"))


@query("dt17_rfc822", "SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') AS t, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS g FROM events")
def dt17(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +1000")).alias("a"), F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("b"))
    return e.select("event_id", T(times.rfc822(F.col("a"))).alias("t"), T(times.rfc822(F.col("b"))).alias("g"))


@query("dt18_site_dates", "SELECT event_id, ts::DATE::VARCHAR AS day, year(ts) AS year FROM events")
def dt18(spark, d):
    """DT18 and DT19: a date inside other text, in four forms."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.date_format("ts", "'By A. Writer, 'd MMMM yyyy' - news'")).when(k == 1, F.date_format("ts", "'Published 'MMMM d, yyyy")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "'on 'dd/MM/yyyy"))
    return e.select("event_id", times.site_date(s).cast("string").alias("day"), times.year_in(s).cast("bigint").alias("year"))


@query("dt20_window_slices", """WITH s AS (SELECT user_id, date_trunc('day', min(ts))::TIMESTAMP AS a, date_trunc('second', max(ts)) AS b FROM events GROUP BY 1),
x AS (SELECT user_id, b, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS lo FROM s)
SELECT user_id, strftime(lo, '%Y-%m-%d %H:%M:%S') AS lo, strftime(least(lo + INTERVAL 7 DAY, b), '%Y-%m-%d %H:%M:%S') AS hi FROM x WHERE lo < b""")
def dt20(spark, d):
    """Each user's time, from the day of the first event to the second of the last, cut into weeks."""
    spans = table(spark, d, "events").groupBy("user_id").agg(F.date_trunc("DAY", F.min("ts")).alias("a"), F.date_trunc("SECOND", F.max("ts")).alias("b"))
    return splits.slices(spans, "a", "b", 7).select("user_id", T("lo").alias("lo"), T("hi").alias("hi"))


@query("dt20_months", """WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders)
SELECT o_custkey, year, month(m) AS month, m::DATE::VARCHAR AS first, last_day(m)::VARCHAR AS last FROM (SELECT *, make_date(year, unnest(range(1, 13)), 1) AS m FROM y)""")
def dt20_months(spark, d):
    """The months of every year in which a customer ordered."""
    years = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    m = splits.months(years, "year")
    return m.select("o_custkey", *(F.col(c).cast("bigint").alias(c) for c in ("year", "month")), F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


_ORDERED = "o AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)"


@query("ops1_ratio_split", f"WITH {_ORDERED} SELECT event_id, CASE WHEN i < floor(n * 767 / 1096.0) THEN 'train' WHEN i < floor(n * 767 / 1096.0) + floor(n * 110 / 1096.0) THEN 'val' ELSE 'test' END AS split FROM o")
def ops1(spark, d):
    return splits.by_ratio(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 767, 110, 219).select("event_id", "split")


@query("ops2_shuffled_split", """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM o""")
def ops2(spark, d):
    s = splits.shuffled(table(spark, d, "events").select("event_id"), F.col("event_id"), 42)
    return splits.by_ratio(s, ["shuffle_key", "event_id"], 0.7, 0.1, 0.2).select("event_id", "split")


@query("ops3_chronological_resplit", f"""WITH {_ORDERED}, s AS (SELECT event_id, ts, CASE event_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM events), c AS (SELECT count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b FROM s)
SELECT event_id, CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'val' ELSE 'test' END AS split FROM o, c""")
def ops3(spark, d):
    k = F.col("event_id") % 5
    e = table(spark, d, "events").select("event_id", "ts", F.when(k == 3, "val").when(k == 4, "test").otherwise("train").alias("split"))
    return splits.by_time_keeping_sizes(e, "split", "ts", "event_id").select("event_id", "split")


@query("ops4_probe", "SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY md5('42:' || event_id)) <= greatest(100, floor(count(*) OVER () * 0.05))")
def ops4(spark, d):
    """OPS4 and OPS5: a fraction, with a least number of rows."""
    return splits.probe(table(spark, d, "events").select("event_id"), F.col("event_id"), 0.05, 100, 42)


_SP = f"sp AS (SELECT *, {_SPLIT} AS split FROM series)"


def with_split(spark, d):
    day = F.dayofmonth("ts")
    return X.series(spark, d).withColumn("split", F.when(day <= 20, "train").when(day <= 25, "val").otherwise("test"))


@query("jn8_split_prefix", f"""WITH {X.SERIES}, {_SP}, c AS (SELECT series_id, ts, value, TRUE AS is_target FROM sp WHERE split = 'val'), f AS (SELECT series_id, min(ts) AS first FROM c GROUP BY 1),
p AS (SELECT sp.series_id, ts, value, FALSE FROM sp JOIN f USING (series_id) WHERE split = 'train' AND ts < first QUALIFY row_number() OVER (PARTITION BY sp.series_id ORDER BY ts DESC) <= 24)
SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, round(value, 6) AS value, is_target FROM (SELECT * FROM c UNION ALL SELECT * FROM p)""")
def jn8(spark, d):
    s = with_split(spark, d)
    x = splits.with_history(s.where("split = 'train'").drop("split"), s.where("split = 'val'").drop("split"), "series_id", "ts", 24)
    return x.select("series_id", T("ts").alias("t"), R("value").alias("value"), "is_target")


@query("flt12_split_overlap", """WITH s AS (SELECT ts, CASE WHEN day(ts) <= 21 AND event_id % 2 = 0 THEN 'train' WHEN day(ts) <= 25 THEN 'val' ELSE 'test' END AS split FROM events), b AS (SELECT split, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1)
SELECT a.split AS earlier, b.split AS later FROM b a JOIN b ON (a.split, b.split) IN (('train', 'val'), ('val', 'test')) WHERE a.hi >= b.lo""")
def flt12(spark, d):
    day = F.dayofmonth("ts")
    s = table(spark, d, "events").withColumn("split", F.when((day <= 21) & (F.col("event_id") % 2 == 0), "train").when(day <= 25, "val").otherwise("test"))
    return splits.overlaps(s, "ts", "split", ("train", "val", "test")).select("earlier", "later")


@query("flt4_nulls_before_windows", f"""WITH s AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2), k AS (SELECT * FROM s WHERE hour(ts) % 5 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM k)
SELECT series_id, i AS start, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM n WHERE i % 12 = 0 AND i <= n - 30""")
def flt4(spark, d):
    from ..operators import windows

    s = X.series(spark, d).withColumn("value", F.when(F.hour("ts") % 5 != 0, F.col("value")))
    return windows.sliding(s, 24, 6, 12).select("series_id", F.col("start").cast("bigint").alias("start"), T(F.col("history_times")[0]).alias("t"))


@query("ops18_cadence_all_users", """WITH RECURSIVE o AS (SELECT user_id, date_trunc('second', ts) AS t FROM events GROUP BY ALL), k AS (SELECT user_id, min(t) AS t FROM o GROUP BY 1
UNION ALL SELECT k.user_id, min(o.t) FROM k JOIN o ON o.user_id = k.user_id AND o.t >= k.t + INTERVAL 2 DAY GROUP BY k.user_id) SELECT user_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS t FROM k""")
def ops18_all(spark, d):
    """Every user's events thinned."""
    e = table(spark, d, "events").select("user_id", F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("at"))
    return splits.thinned(e, "at", 2, ["user_id"]).distinct().select("user_id", T("at").alias("t"))
