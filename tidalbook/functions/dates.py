"""Date and time functions; "now" is always a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(as_of: Column, months: int = 0) -> Column:
    return F.add_months(F.trunc(as_of.cast("date"), "month"), months).cast("timestamp_ntz")


def in_month(ts: Column, as_of: Column, months: int = 0) -> Column:
    """Half-open month window, ``months`` away from that of ``as_of``."""
    return (ts >= month_start(as_of, months)) & (ts < month_start(as_of, months + 1))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(ts: Column) -> Column:
    """As ``iso``, with nothing cut off."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a time without zone, read as UTC, in any session zone."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")).cast("timestamp"))


def micros(ts: Column) -> Column:
    """Epoch microseconds, as ``millis``."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")).cast("timestamp"))


def within_window(a: Column, b: Column, ms: int = 300_000) -> Column:
    return F.coalesce(F.abs(millis(a) - millis(b)) <= ms, F.lit(False))


def rolling_days(as_of: Column, days: int = 30) -> tuple[Column, Column]:
    return F.date_format(F.date_sub(as_of.cast("date"), days), "yyyy-MM-dd"), F.date_format(as_of.cast("date"), "yyyy-MM-dd")


#: A statement's time: day, hour, minute, second, fraction, hours from UTC and the zone's name; all but the day may be missing.
MOMENT = r"^\s*(?<year>\d{4})(?<month>\d{2})(?<day>\d{2})(?:(?<hour>\d{2})(?:(?<minute>\d{2})(?<second>\d{2})?)?)?\d?(?:\.[^\[]*)?\s*(?:\[(?<zone>[+-]?\d{1,2})(?::[^\]]*)?\])?"


def parse_ofx_date(raw: Column, now: Column) -> Column:
    """``YYYYMMDD[HH[MM[SS]]][.fff][[±h:TZ]]`` as ISO text; ``now`` for what does not begin with a day."""
    names = re.findall(r"\?<(\w+)>", MOMENT)
    part = {n: F.nullif(F.regexp_extract(raw, MOMENT, i + 1), F.lit("")) for i, n in enumerate(names)}
    day = F.concat_ws("-", part["year"], part["month"], part["day"])
    clock = F.concat_ws(":", *(F.coalesce(part[n], F.lit("00")) for n in ("hour", "minute", "second")))
    zone = F.coalesce(F.format_string("%+03d:00", part["zone"].cast("int")), F.lit("Z"))
    return F.when(part["day"].isNull(), now).otherwise(F.concat(day, F.lit("T"), clock, F.when(part["zone"].isNull(), F.lit("Z")).otherwise(zone)))
