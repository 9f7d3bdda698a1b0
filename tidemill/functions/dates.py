"""Dates of feeds and HTTP, as Column expressions. Results are TIMESTAMP_NTZ in UTC; times without a zone are in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import clean

#: Formats of display dates (fixed values of the read model).
DISPLAY = {"full": "dd/MM/yyyy HH:mm:ss", "time": "HH:mm", "day_month": "dd/MM", "day_month_year": "dd/MM/yyyy"}


def in_utc(zoned: Column) -> Column:
    """A TIMESTAMP as TIMESTAMP_NTZ in UTC, whatever the session's zone."""
    return F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz")


def parse_date(c: Column) -> Column:
    """RFC 2822, then ISO 8601; what is neither is NULL. The shape of a value decides which one format is tried."""
    return F.transform(F.array(F.regexp_replace(clean(c), r"^[A-Za-z]{3,9},\s*", "")), _parsed)[0]


def _parsed(s: Column) -> Column:
    timed = r"^\d+ \S+ \S+ \d\d:\d\d"
    rfc = F.when(F.lit(False), F.lit(None).cast("timestamp_ntz"))
    for shape, time in ((timed + r":\d\d", "d MMM yyyy HH:mm:ss"), (timed, "d MMM yyyy HH:mm")):
        rfc = rfc.when(s.rlike(f"{shape}$"), F.try_to_timestamp(s, F.lit(time)).cast("timestamp_ntz"))
        rfc = rfc.when(s.rlike(shape + r" [+-]\d{4}$"), in_utc(F.try_to_timestamp(s, F.lit(f"{time} Z"))))
        rfc = rfc.when(s.rlike(f"{shape} "), in_utc(F.try_to_timestamp(s, F.lit(f"{time} z"))))
    iso = s.rlike(r"^\d{4}-\d\d-\d\d")
    return rfc.when(iso & s.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$"), in_utc(F.try_to_timestamp(s))).when(iso, F.try_to_timestamp(s).cast("timestamp_ntz"))


def first_date(*columns: Column) -> Column:
    return F.coalesce(*(parse_date(c) for c in columns))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def display_date(ts: Column, kind: str) -> Column:
    """A time in one of the DISPLAY formats, or split (a struct of date and time); missing is n/a."""
    if kind == "split":
        return F.struct(display_date(ts, "day_month_year").alias("date"), display_date(ts, "time").alias("time"))
    return F.coalesce(F.date_format(ts, DISPLAY[kind]), F.lit("n/a"))
