"""Timestamp helpers on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
MINUTES_PER_DAY = 1_440


def to_timestamp(value: Column, from_text: bool = False) -> Column:
    """Zone-free timestamp; text that is no timestamp becomes NULL."""
    return value.try_cast("timestamp_ntz") if from_text else value.cast("timestamp_ntz")


def epoch_micros(value: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    stamp = value.cast("timestamp_ntz")
    days = F.datediff(stamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = days * F.lit(MINUTES_PER_DAY) + F.hour(stamp) * F.lit(60) + F.minute(stamp)
    seconds = F.extract(F.lit("SECOND"), stamp)
    return minutes * F.lit(60_000_000) + (seconds * F.lit(1_000_000)).cast("long")


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970 as a double, fractions kept."""
    return epoch_micros(value) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded towards minus infinity."""
    micros = epoch_micros(later) - epoch_micros(earlier)
    return F.floor(micros / F.lit(SECONDS_PER_DAY * 1e6)).cast("int")


def instant(as_of: str) -> Column:
    """A fixed reference date for features that count days up to "now"."""
    return F.lit(as_of).cast("timestamp_ntz")
