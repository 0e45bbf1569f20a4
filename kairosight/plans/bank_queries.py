"""Queries over the feature bank, windows and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank, scale, windows
from ..operators.quantiles import keyed_quantiles, quantiles
from . import fixtures as X
from .registry import query, table

GRID = bank.Grid(X.START, X.END, 60)
R = lambda c, n=6: F.round(c, n)
T = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
ALPHA, THETA = 0.5, 30.0


@query("ag1_zscore_scale", "SELECT round(avg(value), 6) AS center_global, round(greatest(stddev_pop(value), 1e-6), 6) AS scale_global FROM events")
def ag1(spark: SparkSession, d: str) -> DataFrame:
    return scale.statistics(table(spark, d, "events"), "value").select(R("center_global").alias("center_global"), R("scale_global").alias("scale_global"))


@query("ag2_robust_scale", """WITH q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.5) m, quantile_cont(value, 0.75) b FROM events)
SELECT round(m, 6) AS center_global, round((b - a) / 1.3489795003921634, 6) AS scale_global FROM q""")
def ag2(spark, d):
    return scale.statistics(table(spark, d, "events"), "value", "robust_quantile").select(R("center_global").alias("center_global"), R("scale_global").alias("scale_global"))


@query("ag2_robust_fallback", "SELECT 'std' AS by_rule, round(stddev_pop(CASE WHEN event_id % 10 < 8 THEN 1.0 ELSE value END), 6) AS scale_global FROM events")
def ag2_fallback(spark, d):
    """Quantiles and MAD vanish when most values are equal: the deviation takes over."""
    flat = table(spark, d, "events").select(F.when(F.col("event_id") % 10 < 8, 1.0).otherwise(F.col("value")).alias("v"))
    return scale.robust(flat, "v").select(F.lit("std").alias("by_rule"), R("scale_global").alias("scale_global"))


@query("flt2_spike_drop", "SELECT count(*) AS n, round(avg(value), 6) AS center_global, round(stddev_pop(value), 6) AS scale_global FROM events WHERE abs(value) <= 50")
def flt2(spark, d):
    clean = scale.without_spikes(scale.finite(table(spark, d, "events"), "value"), "value", 50.0)
    return scale.zscore(clean, "value").crossJoin(clean.agg(F.count(F.lit(1)).alias("n"))).select("n", R("center_global").alias("center_global"), R("scale_global").alias("scale_global"))


@query("flt3_spike_clip", "SELECT event_id, round(greatest(least(value, 50), -50), 6) AS v FROM events")
def flt3(spark, d):
    return table(spark, d, "events").select("event_id", R(scale.clamped(F.col("value"), 50.0)).alias("v"))


@query("flt1_finite_numbers", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'x' || value WHEN 2 THEN 'inf' ELSE value::VARCHAR END AS s FROM events)
SELECT event_id, round(try_cast(s AS DOUBLE), 6) AS v FROM t WHERE isfinite(try_cast(s AS DOUBLE))""")
def flt1(spark, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "nan").when(k == 1, F.concat(F.lit("x"), F.col("value").cast("string"))).when(k == 2, "inf").otherwise(F.col("value").cast("string"))
    return scale.finite(table(spark, d, "events").select("event_id", text.alias("v")), "v").select("event_id", R("v").alias("v"))


@query("ma7_winsorised", """WITH b AS (SELECT quantile_cont(value, 0.005) lo, quantile_cont(value, 0.995) hi FROM events)
SELECT event_id, round(greatest(least(value, hi), lo), 6) AS v FROM events, b""")
def ma7(spark, d):
    e = table(spark, d, "events")
    b = scale.winsor_bounds(e, "value")
    return e.crossJoin(F.broadcast(b)).select("event_id", R(F.greatest(F.least("value", "upper"), "lower")).alias("v"))  # one row of bounds


@query("ma1_normalised_history", f"""WITH {X.NUMBERED}, st AS (SELECT avg(value) c, greatest(stddev_pop(value), 1e-6) s FROM series),
w AS (SELECT series_id, i AS start FROM numbered WHERE i % {X.STRIDE} = 0 AND i <= n - {X.HISTORY + X.HORIZON})
SELECT w.series_id, w.start, h.i - w.start AS pos, round((h.value - c) / s, 6) AS z, round(h.value, 6) AS back FROM w JOIN numbered h ON h.series_id = w.series_id AND h.i BETWEEN w.start AND w.start + {X.HISTORY - 1}, st""")
def ma1(spark, d):
    st = scale.zscore(X.series(spark, d), "value")
    s = X.samples(spark, d).crossJoin(F.broadcast(st))  # one row of statistics
    z = s.withColumn("z", scale.normalise(F.col("history"), F.col("center_global"), F.col("scale_global"))).withColumn("back", scale.denormalise(F.col("z"), F.col("center_global"), F.col("scale_global")))
    return z.select("series_id", "start", F.posexplode(F.arrays_zip("z", "back")).alias("pos", "x")).select("series_id", F.col("start").cast("bigint").alias("start"), F.col("pos").cast("bigint").alias("pos"), R("x.z").alias("z"), R("x.back").alias("back"))


_TO_HALF = "to_timestamp({f}(floor(epoch({a}(ts))) / 1800) * 1800) AT TIME ZONE 'UTC'"


@query("dt12_regular_grid", f"""WITH b AS (SELECT user_id, {_TO_HALF.format(f="floor", a="min")} AS lo, {_TO_HALF.format(f="ceil", a="max")} AS hi FROM events GROUP BY 1)
SELECT user_id, strftime(unnest(generate_series(lo, hi, INTERVAL 30 MINUTE)), '%Y-%m-%d %H:%M:%S') AS t FROM b""")
def dt12(spark, d):
    """The grid of half hours of each user, from the first event to the last."""
    return bank.grids(table(spark, d, "events"), ["user_id"], "ts", 30).select("user_id", T("t").alias("t"))


@query("dt11_align_bounds", """SELECT event_id, strftime(to_timestamp(floor(epoch(ts) / 1800) * 1800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS lo,
strftime(to_timestamp(ceil(floor(epoch(ts)) / 1800) * 1800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS hi FROM events""")
def dt11(spark, d):
    return table(spark, d, "events").select("event_id", T(bank.floor_to(F.col("ts"), 30)).alias("lo"), T(bank.ceil_to(F.col("ts"), 30)).alias("hi"))


@query("dt8_availability", """SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M:%S') AS hourly,
strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS daily FROM events""")
def dt8(spark, d):
    has = F.col("event_id") % 2 == 0
    day = bank.Grid(X.START, X.END, 0)
    return table(spark, d, "events").select("event_id", T(bank.available(F.col("ts"), has, GRID)).alias("hourly"), T(bank.available(F.col("ts"), has, day)).alias("daily"))


@query("flt5_usable_records", f"WITH {X.NEWS} SELECT doc_id, horizon_days::BIGINT AS horizon_days, confidence::DOUBLE AS confidence FROM news WHERE horizon_days > 0 AND confidence > 0")
def flt5(spark, d):
    return bank.usable(X.news(spark, d)).select("doc_id", F.col("horizon_days").cast("bigint").alias("horizon_days"), "confidence")


@query("jn1_interval_join", f"WITH {X.FORCE} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, doc_id, round(w, 6) AS w FROM force")
def jn1(spark, d):
    return bank.in_force(X.news(spark, d), GRID, X.TAU).select(T("t").alias("t"), "doc_id", R("w").alias("w"))


@query("ag4_bank_mass", f"WITH {X.MASS} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round(mass, 6) AS mass, docs FROM mass")
def ag4(spark, d):
    return X.mass(spark, d).select(T("t").alias("t"), R("mass").alias("mass"), "docs")


@query("ag4_bank_daily", f"""WITH {X.NEWS}, g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS t),
n AS (SELECT *, date_trunc('day', published_at) AS p FROM news WHERE horizon_days > 0 AND confidence > 0)
SELECT strftime(t, '%Y-%m-%d') AS t, round(coalesce(sum(confidence * exp(-(epoch(t) - epoch(p)) / 86400.0 / {X.TAU})), 0), 6) AS mass, count(p) AS docs
FROM g LEFT JOIN n ON p <= t AND t <= p + to_days(horizon_days) GROUP BY 1""")
def ag4_daily(spark, d):
    day = bank.Grid(X.START, X.END, 0)
    daily = X.news(spark, d).withColumn("published_at", bank.available(F.col("published_at"), F.lit(True), day))
    return bank.mass(daily, day, X.TAU).select(F.date_format("t", "yyyy-MM-dd").alias("t"), R("mass").alias("mass"), "docs")


_MEAN = lambda c, v=None: f"round(coalesce(sum(w * {v or c}) / greatest(sum(w), 1e-6), 0), 6) AS {c}"


@query("ag4_bank_regime_vec", f"WITH {X.FORCE} SELECT strftime(g.t, '%Y-%m-%d %H:%M:%S') AS t, {', '.join(map(_MEAN, bank.COMPONENTS))} FROM grid g LEFT JOIN force f ON f.t = g.t GROUP BY g.t")
def ag4_vec(spark, d):
    found = bank.weighted_means(X.news(spark, d), GRID, X.TAU, {c: F.col(c) for c in bank.COMPONENTS})
    return found.select(T("t").alias("t"), *(R(c).alias(c) for c in bank.COMPONENTS))


@query("ag5_topic_mass", f"WITH {X.FORCE} SELECT strftime(g.t, '%Y-%m-%d %H:%M:%S') AS t, " + ", ".join(_MEAN(t, f"list_contains(topics, '{t}')::INT::DOUBLE") for t in bank.TOPICS) + " FROM grid g LEFT JOIN force f ON f.t = g.t GROUP BY g.t")
def ag5(spark, d):
    found = bank.weighted_means(X.news(spark, d), GRID, X.TAU, bank.topic_flags(F.col("topics")))
    return found.select(T("t").alias("t"), *(R(c).alias(c) for c in bank.TOPICS))


_EMB = "emb AS (SELECT vec_id, embedding FROM embeddings)"


@query("ag4_bank_text_emb", f"""WITH {X.NEWS}, {_EMB}, g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS t),
n AS (SELECT *, date_trunc('day', published_at) AS p FROM news JOIN emb ON vec_id = doc_id % (SELECT count(*) FROM embeddings) WHERE horizon_days > 0 AND confidence > 0),
f AS (SELECT t, confidence * exp(-(epoch(t) - epoch(p)) / 86400.0 / {X.TAU}) AS w, embedding FROM g JOIN n ON p <= t AND t <= p + to_days(horizon_days)),
u AS (SELECT t, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM f)
SELECT strftime(t, '%Y-%m-%d') AS t, pos, round(sum(w * x) / greatest(sum(w), 1e-6), 6) AS mean FROM u GROUP BY t, pos""")
def ag4_emb(spark, d):
    day = bank.Grid(X.START, X.END, 0)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    dated = X.news(spark, d).withColumn("published_at", bank.available(F.col("published_at"), F.lit(True), day))
    vectors = e.agg(F.count(F.lit(1)).alias("vectors"))  # one row
    n = dated.crossJoin(F.broadcast(vectors)).withColumn("vec_id", F.col("doc_id") % F.col("vectors")).join(e, "vec_id")
    return bank.array_means(n, day, X.TAU, "embedding").select(F.date_format("t", "yyyy-MM-dd").alias("t"), F.col("pos").cast("bigint").alias("pos"), R("mean").alias("mean"))


_EMA = f"""WITH RECURSIVE {X.MASS}, o AS (SELECT t, mass, row_number() OVER (ORDER BY t) AS i FROM mass),
e AS (SELECT i, t, mass, mass::DOUBLE AS ema FROM o WHERE i = 1 UNION ALL SELECT o.i, o.t, o.mass, {ALPHA} * o.mass + (1 - {ALPHA}) * e.ema FROM e JOIN o ON o.i = e.i + 1)"""


def smooth(spark, d):
    m = X.mass(spark, d)
    return m.join(bank.ema(m.withColumn("one", F.lit(1)), ALPHA, ["one"], "t", "mass", "ema").select("t", "ema"), "t")


@query("wn4_bank_ema", f"{_EMA} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round(mass, 6) AS mass, round(ema, 6) AS ema FROM e")
def wn4(spark, d):
    return smooth(spark, d).select(T("t").alias("t"), R("mass").alias("mass"), R("ema").alias("ema"))


@query("jn3_asof_lookup", f"""WITH {X.MASS}, q AS (SELECT event_id, ts + to_days((event_id % 3)::INT * 10 - 10) AS at FROM events)
SELECT event_id, round(coalesce(mass, 0), 6) AS mass, coalesce(docs, 0) AS docs FROM q ASOF LEFT JOIN mass ON q.at >= mass.t""")
def jn3(spark, d):
    q = table(spark, d, "events").select("event_id", (F.col("ts") + F.make_dt_interval((F.col("event_id") % 3 * 10 - 10).cast("int"))).alias("at"))
    return bank.lookup(q, X.mass(spark, d), GRID, "at", ["mass", "docs"]).select("event_id", R("mass").alias("mass"), "docs")


@query("jn3_asof_irregular", """WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT event_id, round(p.value, 6) AS last_value FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.ts >= p.ts""")
def jn3_irregular(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return bank.asof(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["last_value"]).select("event_id", R("last_value").alias("last_value"))


@query("jn2_daily_lookup", f"""WITH {X.MASS}, m AS (SELECT t::DATE AS day, mass FROM mass WHERE hour(t) = 0)
SELECT o_orderkey, round(coalesce(m.mass, 0), 6) AS mass FROM (SELECT o_orderkey, DATE '2024-01-01' + (o_orderkey % 40)::INT AS day FROM orders) LEFT JOIN m USING (day)""")
def jn2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 40).cast("int")).cast("timestamp_ntz").alias("at"))
    m = X.mass(spark, d).where("hour(t) = 0")
    return bank.lookup(o, m, bank.Grid(X.START, X.END, 0), "at", ["mass"]).select("o_orderkey", R("mass").alias("mass"))


_SAMPLE_MASS = f"WITH {X.STEPS}, {X.MASS}, sm AS (SELECT s.*, m.mass FROM steps s LEFT JOIN mass m ON m.t = date_trunc('hour', s.ts))"


@query("jn4_sample_regime", f"WITH {X.STEPS}, {X.MASS} SELECT s.series_id, s.start, round(coalesce(m.mass, 0), 6) AS mass FROM steps s LEFT JOIN mass m ON m.t = s.ts WHERE s.step = 1")
def jn4(spark, d):
    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), F.col("target_times")[0].alias("at"))
    return bank.lookup(s, X.mass(spark, d), GRID, "at", ["mass"]).select("series_id", "start", R("mass").alias("mass"))


@query("jn5_blanked_bank", f"WITH {X.MASS} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round(CASE WHEN hour(t) < 6 THEN 0 ELSE mass END, 6) AS mass, CASE WHEN hour(t) < 6 THEN 0 ELSE docs END AS docs FROM mass")
def jn5(spark, d):
    return bank.blanked(X.mass(spark, d), ["mass", "docs"], F.hour("t") < 6).select(T("t").alias("t"), R("mass").alias("mass"), "docs")


_PERMUTED = f"""WITH {X.MASS}, a AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM mass), b AS (SELECT mass, docs, row_number() OVER (ORDER BY md5(strftime(t, '%Y-%m-%d %H:%M:%S')), t) AS i FROM mass)"""


@query("jn6_permuted_bank", f"{_PERMUTED} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round(mass, 6) AS mass, docs FROM a JOIN b USING (i)")
def jn6(spark, d):
    return bank.permuted(X.mass(spark, d), ["mass", "docs"], F.md5(T("t"))).select(T("t").alias("t"), R("mass").alias("mass"), "docs")


@query("ag18_bank_coverage", f"""WITH {X.MASS} SELECT count(*) AS times, count(*) FILTER (docs > 0) AS covered, count(*) FILTER (mass > {THETA}) AS active, round(100.0 * count(*) FILTER (docs > 0) / count(*), 6) AS covered_pct,
round(100.0 * count(*) FILTER (mass > {THETA}) / count(*), 6) AS active_pct, round(avg(mass), 6) AS mean_mass, round(median(mass), 6) AS median_mass, round(min(mass), 6) AS min_mass, round(max(mass), 6) AS max_mass FROM mass""")
def ag18(spark, d):
    c = bank.coverage(bank.require_mass(X.mass(spark, d)), THETA)
    return c.select("times", "covered", "active", *(R(x).alias(x) for x in c.columns[3:]))


@query("ma20_blended_banks", f"""WITH {X.MASS} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round((1.0 * mass + 2.0 * docs + 3.0 * hour(t)) / greatest(mass + docs + hour(t), 1e-6), 6) AS v FROM mass""")
def ma20(spark, d):
    b = X.mass(spark, d).select("t", F.lit(1.0).alias("v_short"), F.lit(2.0).alias("v_mid"), F.lit(3.0).alias("v_long"), F.col("mass").alias("m_short"), F.col("docs").alias("m_mid"), F.hour("t").alias("m_long"))
    return b.select(T("t").alias("t"), R(bank.blended(b, ["short", "mid", "long"], "v", "m")).alias("v"))


@query("wn1_sliding_windows", f"""WITH {X.NUMBERED}, w AS (SELECT series_id, i AS start FROM numbered WHERE i % {X.STRIDE} = 0 AND i <= n - {X.HISTORY + X.HORIZON})
SELECT w.series_id, w.start, v.i - w.start AS pos, strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS t, round(v.value, 6) AS v FROM w JOIN numbered v ON v.series_id = w.series_id AND v.i BETWEEN w.start AND w.start + {X.HISTORY + X.HORIZON - 1}""")
def wn1(spark, d):
    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), F.posexplode(F.arrays_zip(F.concat("history", "target").alias("v"), F.concat("history_times", "target_times").alias("t"))).alias("pos", "x"))
    return s.select("series_id", "start", F.col("pos").cast("bigint").alias("pos"), T("x.t").alias("t"), R("x.v").alias("v"))


_HIST = f"""WITH {X.NUMBERED}, w AS (SELECT series_id, i AS start FROM numbered WHERE i % {X.STRIDE} = 0 AND i <= n - {X.HISTORY + X.HORIZON}),
h AS (SELECT w.series_id, w.start, v.i - w.start AS pos, v.value AS x FROM w JOIN numbered v ON v.series_id = w.series_id AND v.i BETWEEN w.start AND w.start + {X.HISTORY - 1})"""


def _per_step(spark, d, fn):
    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), F.posexplode(fn(F.col("history"))).alias("pos", "v"))
    return s.select("series_id", "start", F.col("pos").cast("bigint").alias("pos"), R("v").alias("v"))


@query("wn6_residual_history", f"{_HIST} SELECT series_id, start, pos, round(x - sum(x) OVER (PARTITION BY series_id, start ORDER BY pos ROWS {X.HISTORY - 1} PRECEDING) / {X.HISTORY}.0, 6) AS v FROM h")
def wn6(spark, d):
    return _per_step(spark, d, lambda h: windows.residual_history(h, 25))


@query("wn5_trend", f"""{_HIST} SELECT a.series_id, a.start, a.pos, round(avg(b.x), 6) AS v FROM h a CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) JOIN h b ON b.series_id = a.series_id AND b.start = a.start AND b.pos = greatest(0, least({X.HISTORY - 1}, a.pos + o)) GROUP BY ALL""")
def wn5(spark, d):
    return _per_step(spark, d, lambda h: windows.trend(h, 7))


@query("wn5_seasonal", f"""{_HIST} SELECT a.series_id, a.start, a.pos, round(a.x - avg(b.x), 6) AS v FROM h a CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) JOIN h b ON b.series_id = a.series_id AND b.start = a.start AND b.pos = greatest(0, least({X.HISTORY - 1}, a.pos + o)) GROUP BY a.series_id, a.start, a.pos, a.x""")
def wn5_seasonal(spark, d):
    return _per_step(spark, d, lambda h: F.zip_with(h, windows.trend(h, 7), lambda x, t: x - t))


@query("wn7_patches", f"{_HIST} SELECT series_id, start, p AS patch, pos - p * 4 AS pos, round(x, 6) AS v FROM h, (SELECT unnest(range(0, {(X.HISTORY - 8) // 4 + 1})) AS p) WHERE pos BETWEEN p * 4 AND p * 4 + 7")
def wn7(spark, d):
    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), F.posexplode(windows.patches(F.col("history"), 8, 4)).alias("patch", "x"))
    return s.select("series_id", "start", F.col("patch").cast("bigint").alias("patch"), F.posexplode("x").alias("pos", "v")).select("series_id", "start", "patch", F.col("pos").cast("bigint").alias("pos"), R("v").alias("v"))


@query("wn8_padded_patches", f"""{_HIST}, m AS (SELECT series_id, start, max_by(x, pos) AS last FROM h GROUP BY ALL),
q AS (SELECT series_id, start, p AS patch, o AS pos, p * 5 + o AS at FROM m, (SELECT unnest(range(0, 5)) AS p), (SELECT unnest(range(0, 8)) AS o))
SELECT q.series_id, q.start, patch, q.pos, round(coalesce(x, last), 6) AS v FROM q JOIN m USING (series_id, start) LEFT JOIN h ON h.series_id = q.series_id AND h.start = q.start AND h.pos = q.at""")
def wn8(spark, d):
    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), F.posexplode(windows.patches(F.col("history"), 8, 5, F.element_at("history", -1))).alias("patch", "x"))
    return s.select("series_id", "start", F.col("patch").cast("bigint").alias("patch"), F.posexplode("x").alias("pos", "v")).select("series_id", "start", "patch", F.col("pos").cast("bigint").alias("pos"), R("v").alias("v"))


@query("wn10_last_value_removed", f"{_HIST} SELECT series_id, start, pos, round(x - max_by(x, pos) OVER (PARTITION BY series_id, start), 6) AS v FROM h")
def wn10(spark, d):
    return _per_step(spark, d, lambda h: F.transform(h, lambda x: x - F.element_at(h, -1)))


@query("wn14_recent_slope", f"{_HIST} SELECT series_id, start, round(max(x) FILTER (pos = {X.HISTORY - 1}) - max(x) FILTER (pos = {X.HISTORY - 9}), 6) AS slope FROM h GROUP BY ALL")
def wn14(spark, d):
    return X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), R(F.element_at("history", -1) - F.element_at("history", -9)).alias("slope"))


@query("wn3_fit_lengths", f"""{_HIST}, s AS (SELECT series_id, start, list(x ORDER BY pos) AS a FROM h GROUP BY ALL), p AS (SELECT *, unnest(range(0, 30)) AS pos FROM s)
SELECT series_id, start, pos, round(CASE WHEN pos < 6 THEN 0 ELSE a[pos - 5] END, 6) AS l, round(CASE WHEN pos < 24 THEN a[pos + 1] ELSE 0 END, 6) AS r, (pos < 24)::INT::DOUBLE AS m FROM p""")
def wn3(spark, d):
    h = F.col("history")
    s = X.samples(spark, d).select("series_id", F.col("start").cast("bigint").alias("start"), F.posexplode(F.arrays_zip(windows.fit_left(h, 30).alias("l"), windows.fit_right(h, 30).alias("r"), windows.mask_right(h, 30).alias("m"))).alias("pos", "x"))
    return s.select("series_id", "start", F.col("pos").cast("bigint").alias("pos"), R("x.l").alias("l"), R("x.r").alias("r"), "x.m")


_DAILY = "daily AS (SELECT ts::DATE AS day, avg(value) AS value FROM events GROUP BY 1)"


@query("wn11_seasonal_naive", f"""WITH {_DAILY} SELECT day::VARCHAR AS day, round(CASE WHEN count(value) OVER w >= 2 THEN value - avg(value) OVER w END, 6) AS resid FROM daily
WINDOW w AS (PARTITION BY isodow(day) ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def wn11(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return windows.seasonal_naive(daily).select(F.col("day").cast("string").alias("day"), R("resid").alias("resid"))


_LABEL = """WITH s AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS s, sum(value * value) AS s2 FROM events GROUP BY 1),
p AS (SELECT day, sqrt(greatest(s2 / n - (s / n) ** 2, 0)) AS now, sum(n) OVER w AS pn, sum(s) OVER w AS ps, sum(s2) OVER w AS ps2 FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
q AS (SELECT day, now, sqrt(greatest(ps2 / pn - (ps / pn) ** 2, 0)) AS past, ps / pn AS past_mean FROM p WHERE pn IS NOT NULL)"""


def _labels(spark, d):
    sums = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    return windows.volatility_labels(sums)


@query("wn12_daily_labels", f"""{_LABEL} SELECT q.day::VARCHAR AS day, round(ln(greatest(now, 1e-6) / greatest(past, 1e-6)), 6) AS vol_ratio, bool_or(abs(e.value - past_mean) > 3 * past) AS spike_flag
FROM q JOIN events e ON e.ts::DATE = q.day GROUP BY q.day, now, past""")
def wn12(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "value")
    flags = e.join(_labels(spark, d), "day").groupBy("day").agg(F.first("vol_ratio").alias("vol_ratio"), F.bool_or(F.abs(F.col("value") - F.col("past_mean")) > 3 * F.col("past")).alias("spike_flag"))
    return flags.select(F.col("day").cast("string").alias("day"), R("vol_ratio").alias("vol_ratio"), "spike_flag")


@query("ag23_daily_profile", """WITH q AS (SELECT ts::DATE AS day, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1)
SELECT q.day::VARCHAR AS day, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS std,
count(*) FILTER (value > m + 3 * greatest(iqr, 1e-6)) AS spikes FROM events e JOIN q ON q.day = e.ts::DATE GROUP BY 1""")
def ag23(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "value")
    q = keyed_quantiles(e, ["day"], "value", [0.25, 0.5, 0.75, 0.95])
    limit = F.col("q")[1] + 3 * F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-6))
    p = e.join(q, "day").groupBy("day").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.any_value("q")[3].alias("p95"), F.stddev_samp("value").alias("std"), F.count_if(F.col("value") > limit).alias("spikes"))
    return p.select(F.col("day").cast("string").alias("day"), *(R(c).alias(c) for c in ("mean", "max", "p95", "std")), "spikes")


@query("ag29_volatility_bin", f"""WITH {X.SERIES}, v AS (SELECT series_id, ts, CASE WHEN count(value) OVER w >= 12 THEN stddev_samp(value) OVER w END AS vol FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 11 PRECEDING)),
q AS (SELECT quantile_cont(vol, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM v)
SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, CASE WHEN vol IS NULL THEN 0 ELSE least(len(list_filter(q, lambda x: x < vol)), 9) END AS bin FROM v, q""")
def ag29(spark, d):
    s = X.series(spark, d)
    v = windows.rolling(s, "series_id", "ts", 11, "value", F.stddev_samp, 12, "vol")
    q = quantiles(v, "vol", [i / 10 for i in range(1, 10)])
    bin_ = F.when(F.col("vol").isNull(), 0).otherwise(F.least(F.size(F.filter("q", lambda x: x < F.col("vol"))), F.lit(9)))
    return v.crossJoin(F.broadcast(q)).select("series_id", T("ts").alias("t"), bin_.cast("bigint").alias("bin"))  # one row of thresholds


@query("wn15_time_gaps", f"WITH {X.SERIES} SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts))) / 60 AS minutes FROM series")
def wn15(spark, d):
    gaps = windows.over_parts(X.series(spark, d), "series_id", "ts", 1, lambda w: {"before": F.lag("ts").over(w)})
    return gaps.select("series_id", T("ts").alias("t"), ((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))) / 60.0).alias("minutes"))
