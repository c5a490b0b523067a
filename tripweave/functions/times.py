"""Time helpers on zone-free local timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripweave import fixed_values as fv
from tripweave.functions.numbers import col

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(ts) -> Column:
    """Seconds since 1970 of a zone-free timestamp, as written on the clock."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), col(ts)) / 1e6


def whole_seconds(ts) -> Column:
    """Seconds since 1970 without the fraction: what ends and starts are compared by."""
    return F.floor(epoch_seconds(ts)).cast("double")


def seconds_between(a, b) -> Column:
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / 1e6


def add_seconds(ts, seconds) -> Column:
    micros = F.round(col(seconds) * 1e6).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, col(ts))


def end_time(start, minutes) -> Column:
    return add_seconds(start, col(minutes) * 60.0)


def local_to_utc(ts, zone: str = fv.LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col(ts))


def dst_seconds(ts, zone: str = fv.LOCAL_ZONE, standard: int = 3600) -> Column:
    """Daylight-saving part of the zone offset at a local time, in seconds."""
    return F.timestamp_diff("SECOND", local_to_utc(ts, zone), col(ts)) - F.lit(standard)


def day_month(ts) -> Column:
    """``12 mag``; a dash when the date is missing."""
    names = F.array(*[F.lit(m) for m in fv.MONTHS])
    text = F.concat_ws(" ", F.dayofmonth(col(ts)).cast("string"),
                       F.get(names, F.month(col(ts)) - 1))
    return F.when(col(ts).isNull(), F.lit(fv.MISSING)).otherwise(text)
