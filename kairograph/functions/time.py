"""Instants and local time.  Instants are UTC timestamps; a zone is always named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(instant: Column, zone) -> Column:
    return F.from_utc_timestamp(instant, zone)


def local_date(instant: Column, zone) -> Column:
    return F.to_date(local(instant, zone))


def local_time(instant: Column, zone) -> Column:
    return F.date_format(local(instant, zone), "HH:mm")


def weekday(instant: Column, zone) -> Column:
    return F.date_format(local(instant, zone), "EEE")


def day_start(date: Column, zone) -> Column:
    """The instant at which a local date begins."""
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def local_midnight(instant: Column, zone) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", local(instant, zone)), zone)


def local_instant(date: Column, clock: Column, zone) -> Column:
    """The instant of a local date and a clock time HH:MM."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(date.cast("string"), F.lit(" "), clock, F.lit(":00"))), zone)


def plus_seconds(instant: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + (seconds.cast("double") * 1_000_000).cast("long"))


def expires_at(anchor: Column, ttl_days: Column) -> Column:
    """The anchor plus days of 24 hours each; null without a time to live."""
    return plus_seconds(anchor, ttl_days * 86_400)


def iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_iso(instant: Column, zone) -> Column:
    """The local time with its offset from UTC and without milliseconds."""
    there = local(instant, zone)
    minutes = ((F.unix_micros(there) - F.unix_micros(instant)) / 60_000_000).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def day_reading(date: Column) -> Column:
    return F.date_format(date, "EEE yyyy-MM-dd")


def reading(instant: Column, zone) -> Column:
    return F.date_format(local(instant, zone), "EEE yyyy-MM-dd HH:mm")


def same_day(a: Column, b: Column, zone) -> Column:
    """Whether both instants lie on one local date; false where one is null."""
    return F.coalesce(local_date(a, zone) == local_date(b, zone), F.lit(False))
