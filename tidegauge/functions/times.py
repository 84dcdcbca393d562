"""Time columns: the grid of window ends, and ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aligned(ts: Column, slide: int) -> Column:
    """The first multiple of ``slide`` seconds at or after the time, its part of a second dropped first."""
    return F.timestamp_seconds(F.ceil(F.unix_seconds(ts) / slide) * slide)


def seconds_after(ts: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.timestamp_micros(F.unix_micros(ts) + n.cast("long") * 1_000_000)


_ISO = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?(Z|[+-]\d\d(:?\d\d)?)?)?$"


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a time; null if it is none or has no date. Zone offsets and Z are honoured, the
    session's zone by default."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def iso_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("SECOND", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_night(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) >= 22)
