"""Predicates over nodes, edges, plans and tasks as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairograph.config import ALL_DAY_HOURS, OPEN_TASK_AHEAD_DAYS, OPEN_TASK_PAST_DAYS
from kairograph.functions.time import local_date, plus_seconds


def live(now: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def expired(now: Column) -> Column:
    return F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)


def current() -> Column:
    return F.col("valid_to").isNull()


def named(name: str, with_aliases: bool = True) -> Column:
    found = F.lower("title") == name.lower()
    return found | F.coalesce(F.exists("aliases", lambda a: F.lower(a) == name.lower()), F.lit(False)) if with_aliases else found


def occurs_within(start: Column | None, end: Column | None) -> Column:
    """Closed overlap of the node's time with [start, end]; undated nodes are out."""
    found = F.col("occurred_at").isNotNull()
    if end is not None:
        found &= F.col("occurred_at") <= end
    if start is not None:
        found &= F.coalesce("end_at", "occurred_at") >= start
    return found


def relevant_on(date: Column) -> Column:
    return ~F.col("done") & F.col("opens_on").isNotNull() & (F.col("opens_on") <= date)


def relevant_recently(date: Column, zone: str) -> Column:
    return relevant_on(date) & (F.col("closes_at").isNull() | (local_date(F.col("closes_at"), zone) >= F.date_sub(date, OPEN_TASK_PAST_DAYS)))


def someday() -> Column:
    return ~F.col("done") & F.col("opens_on").isNull()


def open_task(now: Column) -> Column:
    day = 86_400
    closes = F.col("closes_at")
    return ~F.col("done") & (closes.isNull() | closes.between(plus_seconds(now, F.lit(-OPEN_TASK_PAST_DAYS * day)), plus_seconds(now, F.lit(OPEN_TASK_AHEAD_DAYS * day))))


def touches(start: Column, end: Column) -> Column:
    """Whether a plan lies in [start, end): points by their start, spans by overlap, all-day plans to 23 hours after."""
    begin, stop = F.col("occurred_at"), F.col("end_at")
    last = F.when(F.col("all_day"), plus_seconds(F.coalesce(stop, begin), F.lit(ALL_DAY_HOURS * 3600))).otherwise(stop)
    return F.when(last.isNull(), (begin >= start) & (begin < end)).otherwise((begin < end) & (last > start))


def multi_day(zone: str) -> Column:
    end = plus_seconds(F.col("end_at"), F.lit(-0.001))
    return F.coalesce(local_date(F.col("occurred_at"), zone) != local_date(end, zone), F.lit(False))
