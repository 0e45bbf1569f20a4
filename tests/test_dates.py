"""Dates are tried only against formats of their shape, with the same result as against all of them."""

import re

from pyspark.sql import functions as F

from kairosight.functions import times

LISTS = (times.ARTICLE, times.LENIENT, times.BANK, times.SITE, times.COLUMN_FIXES, times.SERIES_ISO + times.SERIES_DAY_FIRST + times.SERIES_MONTH_FIRST)
ODD = ["", " ", "soon", "-5/1/2024", "+5/1/2024", "0005-2-2024", "5-2-24", "31-2-2024", "13/13/2024", "2/13/2024", "20240131", "+20240131", "2024013", "12345678901", "ſep 3, 2024", "mAY 5, 2024", "MAY 5 2024 7:05", "Sept 3 2024",
       "2024-1-2 25:00", "2024-1-2 13:00:00 pm", "2024-1-2 1:00:00 P.M.", "2024-1-2 1:00:00 Pm", "2024-1-2\n", "2024/1/2 3:4", "1.2.2024", "2024.1.2", "2024.13.1", "٢024-1-2", "5 May 2024 1:2:3", "May 5,2024", "2024-1-2 ", "0-0-0"]


def test_same_as_all_formats(spark):
    stamps = spark.sql("select explode(array(timestamp_ntz'2024-05-06 07:08:09', timestamp_ntz'2024-11-30 23:59:00', timestamp_ntz'2024-02-29 00:00:00', timestamp_ntz'0987-01-02 12:00:00')) as t")
    written = stamps.select(F.explode(F.array(*(F.date_format("t", f) for f in sorted(set(sum(LISTS, ())))))).alias("s"))
    texts = written.union(spark.createDataFrame([(s,) for s in [*ODD, None]], "s string"))
    plain = lambda own: F.coalesce(*(F.try_to_timestamp("s", F.lit(f)).cast("timestamp_ntz") for f in own))
    rows = texts.select("s", *(F.struct(times._first(F.col("s"), own).alias("new"), plain(own).alias("old")) for own in LISTS)).collect()
    assert len(rows) > 200 and sum(p.old is not None for r in rows for p in r[1:]) > 200
    assert [(r.s, p) for r in rows for p in r[1:] if p.new != p.old] == []


def test_few_formats_a_shape():
    for own in LISTS:
        shapes = [times._shape(f) for f in own]
        assert max(map(shapes.count, shapes)) <= 3
        assert not any(re.search(s.replace(r"\p{L}", "[A-Za-z]"), "soon") for s in shapes)
