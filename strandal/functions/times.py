"""Dates and times to and from text, as column expressions in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = {"Y": "year", "M": "month", "D": "day", "h": "hour", "m": "minute", "s": "second"}


def format_time(pattern: str, t: Column) -> Column:
    """Runs of ``Y M D h m s c`` become fields (``c``: milliseconds), padded with zeros; long fields keep their last digits."""
    out = []
    for run in re.finditer(r"([YMDhmsc])\1*|[^YMDhmsc]+", pattern):
        c, n = run[0][0], len(run[0])
        if c not in "YMDhmsc":
            out.append(F.lit(run[0]))
            continue
        value = F.pmod(F.unix_millis(t.cast("timestamp")), F.lit(1000)) if c == "c" else F.floor(F.date_part(F.lit(_PART[c]), t))
        digits = F.lpad(value.cast("string"), 4, "0")
        out.append(F.right(digits, F.lit(n)) if n <= 4 else F.lpad(digits, n, "0"))
    return F.concat(*out)


def parse_millis(s: Column) -> Column:
    """Unix milliseconds of ``Y.M.D h:m:s[.ms][zone]`` with separators ``- / .`` or space.

    -1 before 1970 or when it can't be read, -2 for a zone that is none, -3 for one beyond 12 hours or 59 minutes.
    """
    day = "^\\s*(\\d{4})[-/. ](\\d{1,2})[-/. ](\\d{1,2})(?:[T ](\\d{1,2}):(\\d{1,2}):(\\d{1,2})(?:[.:](\\d{1,3}))?)?\\s*(.*?)\\s*$"
    zone = "^([+-])(\\d{1,2}):(\\d{2})$"
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def of(m):
        n = lambda i: F.coalesce(F.get(m, i).try_cast("int"), F.lit(0))
        stamp = F.try_make_timestamp(n(0), n(1), n(2), n(3), n(4), n(5).cast("decimal(8,6)"))
        rest = F.get(m, 7)
        part = lambda i: F.coalesce(F.regexp_extract(rest, zone, i).try_cast("int"), F.lit(0))
        minutes = (part(2) * 60 + part(3)) * F.when(rest.startswith("-"), -1).otherwise(1)
        millis = F.unix_millis(stamp) + F.rpad(F.get(m, 6), 3, "0").cast("int") - minutes * 60_000
        bad = (rest == "") | (rest == "Z")
        return (
            F.when((F.get(m, 0) == "") | stamp.isNull(), -1).when(~bad & ~rest.rlike(zone), -2).when((part(2) > 12) | (part(3) > 59), -3)
            .when(millis >= 0, millis).otherwise(-1)
        )

    groups = F.array(*[F.regexp_extract(s, day, i) for i in range(1, 9)])
    return F.when(s.isNull(), F.lit(-1).cast("long")).otherwise(let(groups, of).cast("long"))


def millis_text(ms: Column) -> Column:
    """``Y-M-D h:m:s`` in UTC."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    seconds = F.floor(F.pmod(ms, F.lit(86_400_000)) / 1000)
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(days.cast("string"), F.lit(" "), two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(F.pmod(seconds, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(seconds, F.lit(60))))


def fixed_text(t: Column, day_first: bool = False) -> Column:
    """``YYYY.MM.DD hh:mm:ss``, or with the day first."""
    return format_time("DD.MM.YYYY hh:mm:ss" if day_first else "YYYY.MM.DD hh:mm:ss", t)


def span_seconds(h: Column, m: Column, s: Column, ms: Column) -> Column:
    """Seconds as a double."""
    return h * 3600 + m * 60 + s + ms / 1000.0


def fields(t: Column) -> Column:
    """Year to milliseconds and the weekday (Monday 1) of an instant."""
    part = lambda p: F.floor(F.date_part(F.lit(p), t)).cast("int")
    names = ("year", "month", "day", "hour", "minute", "second")
    return F.struct(*[part(n.upper()).alias(n) for n in names], F.pmod(F.unix_millis(t), F.lit(1000)).cast("int").alias("millis"), weekday(t).alias("weekday"))


def instant(f: Column) -> Column:
    """The instant of such fields; null where there is none."""
    return F.try_make_timestamp(f["year"], f["month"], f["day"], f["hour"], f["minute"], (f["second"] + f["millis"] / 1000).cast("decimal(8,6)"))


def now() -> Column:
    return F.current_timestamp()


def weekday(t: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(t) + 1


def seconds_since_year_one(t: Column) -> Column:
    """Seconds since 0001-01-01 as a double."""
    return F.unix_millis(t.cast("timestamp")) / 1000.0 + 62_135_596_800.0


def from_filetime(ticks: Column) -> Column:
    """A timestamp from 100-nanosecond ticks since 1601."""
    return F.timestamp_micros(F.floor(ticks / 10) - F.lit(11_644_473_600_000_000))
