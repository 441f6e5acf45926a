"""Time helpers (Column -> Column). Every result is a naive local ``TIMESTAMP_NTZ``.

All of them are built-in expressions, so they stay inside whole-stage codegen; the session time
zone is pinned to UTC (``session``), so an instant and its wall-clock time there are the same.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "Europe/Berlin"
_EPOCH = _dt.datetime(1970, 1, 1)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minute_of_day(ts) -> Column:
    ts = _c(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def minute_diff(a, b) -> Column:
    """Minute boundaries crossed from ``a`` to ``b`` (not elapsed whole minutes):
    00:00:59 -> 00:01:01 is 1. NULL if either side is NULL."""
    a, b = _c(a), _c(b)
    return (F.datediff(F.to_date(b), F.to_date(a)) * 1440
            + minute_of_day(b) - minute_of_day(a)).cast("int")


def round_minutes(seconds) -> Column:
    """Seconds to minutes, rounded half to even (30 s -> 0, 90 s -> 2)."""
    return F.bround(_c(seconds) / 60.0, 0).cast("int")


def second_of_day(ts) -> Column:
    ts = _c(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(a, b) -> Column:
    """Whole elapsed seconds from ``a`` to ``b`` (NTZ)."""
    a, b = _c(a), _c(b)
    return (F.datediff(F.to_date(b), F.to_date(a)).cast("long") * 86400
            + second_of_day(b) - second_of_day(a))


def tod_distance(a_min, b_min) -> Column:
    """Distance of two minute-of-day values on the 24 h circle."""
    d = F.abs(_c(a_min) - _c(b_min))
    return F.least(d, F.lit(1440) - d)


def parse_local_time(text) -> Column:
    """Day-first local text, with or without seconds; the first format that parses wins."""
    t = _c(text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("d.M.yyyy H:mm:ss")),
                      F.try_to_timestamp(t, F.lit("d.M.yyyy H:mm"))).cast("timestamp_ntz")


def parse_compact_time(text) -> Column:
    """``yyMMddHHmm``; anything else is NULL."""
    t = _c(text)
    ok = t.rlike(r"^\d{10}$")
    return F.when(ok, F.try_to_timestamp(t, F.lit("yyMMddHHmm")).cast("timestamp_ntz"))


def parse_board_time(day, t) -> Column:
    """Board time ``HHMMSS`` or ``DDHHMMSS`` (leading day offset) on the base day ``yyyyMMdd``."""
    day, t = _c(day), _c(t)
    has_off = F.length(t) == 8
    off = F.when(has_off, F.substring(t, 1, 2).cast("int")).otherwise(F.lit(0))
    hms = F.when(has_off, F.substring(t, 3, 6)).otherwise(t)
    base = F.date_add(F.to_date(day, "yyyyMMdd"), off)
    text = F.concat_ws(" ", F.date_format(base, "yyyy-MM-dd"),
                       F.concat_ws(":", F.substring(hms, 1, 2), F.substring(hms, 3, 2), F.substring(hms, 5, 2)))
    return F.when((t.isNotNull()) & (t != ""), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def epoch_to_utc_ntz(epoch_seconds) -> Column:
    return F.lit(_EPOCH) + F.make_dt_interval(secs=_c(epoch_seconds).cast("decimal(18,6)"))


def epoch_to_local(epoch_seconds, tz: str = LOCAL_TZ) -> Column:
    """Epoch seconds -> naive local wall-clock time in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), epoch_to_utc_ntz(epoch_seconds))


def epoch_ms_to_local(epoch_ms, tz: str = LOCAL_TZ) -> Column:
    """Epoch ms (whole) -> naive local wall-clock time in ``tz``. Sessions run in UTC."""
    return F.from_utc_timestamp(F.timestamp_millis(_c(epoch_ms)), tz).cast("timestamp_ntz")


def iso_to_local(text, tz: str = LOCAL_TZ) -> Column:
    """ISO text; with an offset it is converted to local time in ``tz``, without it is
    already local."""
    t = _c(text)
    has_off = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    naive = F.try_to_timestamp(F.regexp_replace(t, "T", " ")).cast("timestamp_ntz")
    stripped = F.regexp_replace(F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    hh = F.regexp_extract(t, r"([+-]\d{2}):?(\d{2})$", 1)
    mm = F.regexp_extract(t, r"([+-]\d{2}):?(\d{2})$", 2)
    off_min = F.when(hh == "", F.lit(0)).otherwise(
        hh.try_cast("int") * 60
        + F.when(F.substring(hh, 1, 1) == "-", -1).otherwise(1) * mm.try_cast("int"))
    wall = F.try_to_timestamp(stripped).cast("timestamp_ntz")
    utc = wall - F.make_dt_interval(mins=F.coalesce(off_min, F.lit(0)))
    return F.when(has_off, F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)).otherwise(naive)


def planned_from_delay(actual_epoch, delay_s, tz: str = LOCAL_TZ) -> Column:
    """Planned = actual - delay (epoch arithmetic before the local conversion, so a DST
    night is handled right); NULL unless both are known."""
    a, d = _c(actual_epoch), _c(delay_s)
    return F.when(a.isNotNull() & d.isNotNull(), epoch_to_local(a - d, tz))


def month_bounds(day) -> Column:
    """Struct(first_day, last_day, prev_first_day, prev_last_day) of the month of ``day``."""
    d = F.to_date(_c(day))
    first = F.trunc(d, "month")
    prev_first = F.add_months(first, -1)
    return F.struct(first.alias("first_day"), F.last_day(d).alias("last_day"),
                    prev_first.alias("prev_first_day"), F.date_sub(first, 1).alias("prev_last_day"))


def five_minute_bucket(ts) -> Column:
    """Departure floored to 5 minutes."""
    ts = _c(ts)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.minute(ts) - F.minute(ts) % 5, F.lit(0))


def hour_buckets(ts, boundary_min: int = 5) -> Column:
    """Array of (yyMMdd, hour) buckets a stop may be filed under, nearest first: its own
    hour, plus the neighbouring hour when within ``boundary_min`` of the boundary."""
    ts = _c(ts)
    own = F.struct(F.date_format(ts, "yyMMdd").alias("bucket_day"), F.hour(ts).alias("bucket_hour"))
    nxt_ts = ts + F.make_dt_interval(hours=F.lit(1))
    prv_ts = ts - F.make_dt_interval(hours=F.lit(1))
    nxt = F.struct(F.date_format(nxt_ts, "yyMMdd").alias("bucket_day"), F.hour(nxt_ts).alias("bucket_hour"))
    prv = F.struct(F.date_format(prv_ts, "yyMMdd").alias("bucket_day"), F.hour(prv_ts).alias("bucket_hour"))
    return (F.when(F.minute(ts) >= 60 - boundary_min, F.array(own, nxt))
            .when(F.minute(ts) < boundary_min, F.array(own, prv))
            .otherwise(F.array(own)))
