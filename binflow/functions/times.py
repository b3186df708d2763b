"""UTC time grid helpers over timestamp_ntz columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast(NTZ)


def plus_minutes(ts: Column, minutes: Column | int) -> Column:
    amount = minutes if isinstance(minutes, Column) else F.lit(int(minutes))
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), amount.cast("int"), F.lit(0).cast("decimal(18,6)"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def floor_to_interval(ts: Column, minutes: int) -> Column:
    """Start of the interval holding `ts`; the grid restarts every UTC midnight."""
    of_day = minute_of_day(ts)
    return plus_minutes(day_start(ts), of_day - of_day % minutes)


def ceil_to_next_interval(ts: Column, minutes: int) -> Column:
    """First grid point strictly after `ts`."""
    of_day = minute_of_day(ts)
    return plus_minutes(day_start(ts), of_day - of_day % minutes + minutes)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(3_600_000_000.0)


def parse_time(text: Column) -> Column:
    """ISO text, with or without offset, as UTC wall time; null when unreadable."""
    return F.try_to_timestamp(text).cast(NTZ)
