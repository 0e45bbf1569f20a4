"""Parsing and formatting of dates in many formats; what cannot be parsed is null.  Formats are tried in order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of series times, and of article dates, in the order they are tried.
SERIES_ISO = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
SERIES_DAY_FIRST = ("d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy")
SERIES_MONTH_FIRST = ("M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy")
ARTICLE = (
    "yyyy-M-d h:mm:ss a",
    "yyyy-M-d h:mm a",
    "yyyy/M/d h:mm:ss a",
    "yyyy/M/d h:mm a",
    "d-M-yyyy h:mm:ss a",
    "d-M-yyyy h:mm a",
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy h:mm a",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d H:mm",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "d-M-yyyy H:mm:ss",
    "d-M-yyyy H:mm",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "yyyy-M-d",
    "yyyy/M/d",
    "d-M-yyyy",
    "d/M/yyyy",
    "MMM d, yyyy h:mm:ss a",
    "MMM d, yyyy h:mm a",
    "MMMM d, yyyy h:mm:ss a",
    "MMMM d, yyyy h:mm a",
    "MMM d, yyyy H:mm:ss",
    "MMM d, yyyy H:mm",
    "MMMM d, yyyy H:mm:ss",
    "MMMM d, yyyy H:mm",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)
BANK = ("d-M-yyyy h:mm:ss a", "d-M-yyyy H:mm:ss", "yyyy-M-d H:mm:ss", "yyyy-M-d")
#: Further day-first forms, tried where no article format fits.
LENIENT = (
    "d MMMM yyyy H:mm:ss",
    "d MMMM yyyy H:mm",
    "d MMMM yyyy",
    "d MMM yyyy H:mm:ss",
    "d MMM yyyy H:mm",
    "d MMM yyyy",
    "MMMM d yyyy H:mm:ss",
    "MMMM d yyyy H:mm",
    "MMMM d yyyy",
    "MMM d yyyy H:mm:ss",
    "MMM d yyyy H:mm",
    "MMM d yyyy",
    "d.M.yyyy H:mm:ss",
    "d.M.yyyy H:mm",
    "d.M.yyyy",
    "yyyy.M.d",
    "yyyyMMdd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M-d-yyyy",
)
SITE = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "dd/MM/yyyy", "d.M.yyyy")
COLUMN_FIXES = ("d/M/yyyy H:mm", "d/M/yyyy", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy-d-M H:mm")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shape(form: str) -> str:
    """What every text of a format looks like: numbers, words, and what stands between them.  Two shapes that differ have no text in common."""
    kind = lambda t: t if not t[0].isalpha() else "W" if t[0] in "aE" or t.startswith("MMM") else "N"
    marks = re.sub("N+", "N", "".join(kind(t[0]) for t in re.finditer(r"([A-Za-z])\1*|[^A-Za-z]", form)))
    return "^" + "".join({"N": r"[+-]?\d+", "W": r"\p{L}+"}.get(m) or re.escape(m) for m in marks) + "$"


def _first(text: Column, formats) -> Column:
    """The reading of the first format that fits.  Only formats of the text's shape are tried: a failed try costs far more than a look at the shape."""
    of_shape: dict[str, list[str]] = {}
    for f in formats:
        of_shape.setdefault(_shape(f), []).append(f)

    def read(t: Column) -> Column:
        found = F  # F.when begins the chain
        for shape, own in of_shape.items():
            found = found.when(t.rlike(shape), F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in own)))
        return found

    return _once(text, read)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " "))


def series_time(text: Column, day_first: bool) -> Column:
    """ISO forms, then day-first or month-first ones, then any ISO 8601."""
    t = F.trim(text.cast("string"))
    return F.coalesce(_first(t, SERIES_ISO + (SERIES_DAY_FIRST if day_first else SERIES_MONTH_FIRST)), _iso(t))


def _iso(t: Column) -> Column:
    like_iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(like_iso, t.try_cast("timestamp_ntz"))


def _article(t: Column) -> Column:
    return F.coalesce(_iso(F.regexp_replace(t, r"\s*(Z|[+-]\d{2}:?\d{2})$", "")), _first(t, ARTICLE))


def article_time(text: Column) -> Column:
    """ISO 8601 first, whose offset is dropped without conversion, then the article formats."""
    return _once(_squeezed(text), _article)


def _plain(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ", "")
    t = F.regexp_replace(t, r"(?i)(?<=\d)(st|nd|rd|th)\b( of\b)?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i) ?(GMT|UTC|UT|Z)$", ""), r",", ""))


def lenient_time(text: Column) -> Column:
    """The article's time, else a day-first reading without weekday, ordinals, commas and zone names; month first where the day fits no month."""
    return _once(_squeezed(text), lambda t: F.coalesce(_article(t), _first(_plain(t), LENIENT)))


def article_time_text(text: Column) -> Column:
    """The article's time to the second as ISO text, or the empty string."""
    return F.coalesce(F.date_format(article_time(text), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def bank_time(text: Column) -> Column:
    """The bank's formats, then ISO 8601 converted to UTC, then day-first and month-first forms."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    offset = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$"), F.to_utc_timestamp(t.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
    return F.coalesce(_first(t, BANK), offset, _iso(t), _first(t, SERIES_DAY_FIRST + SERIES_MONTH_FIRST))


def has_time_of_day(text: Column) -> Column:
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return t.rlike(r"\d{1,2}:\d{2}") | t.rlike(r"(?i)\b(?:AM|PM)\b")


def rfc822(text: Column) -> Column:
    """A feed's date, as UTC."""
    t = F.regexp_replace(_squeezed(text), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\b(GMT|UTC|UT|Z)$", "+0000")
    return F.to_utc_timestamp(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss xx")), F.current_timezone()).cast("timestamp_ntz")


def site_date(text: Column) -> Column:
    """The first date of the sites' forms found in a text, as a date."""
    t = _squeezed(text)
    found = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2}|\d{1,2} [A-Za-z]+ \d{4}|[A-Z][a-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})", 1)
    return _first(found, SITE).cast("date")


def year_in(text: Column) -> Column:
    y = F.regexp_extract(text, r"\b(20\d{2})\b", 1)
    return F.when(y != "", y.cast("int"))


def fixed_column(text: Column) -> Column:
    """Day-first and then other formats as text; the empty string where none fits."""
    return F.coalesce(F.date_format(_first(F.trim(text), COLUMN_FIXES), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def frequency_minutes(value: Column) -> Column:
    """Whole minutes; what is not a positive number is 0, which means daily."""
    x = F.trim(value.cast("string")).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 1e9), 0).otherwise(F.greatest(x.cast("int"), F.lit(0)))


def axis_label(ts: Column, minutes: int) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss" if 0 < minutes < 1440 else "yyyy-MM-dd")
