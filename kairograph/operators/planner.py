"""Planner reads: plans that touch an interval and tasks of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import ALL_DAY_HOURS, InvalidRequest
from kairograph.functions import predicates as P
from kairograph.functions.time import day_reading, day_start, local_date, plus_seconds, reading, same_day
from kairograph.operators.reads import hub_of, live_nodes, live_tasks
from kairograph.sources.graph import Graph


def title_order() -> Column:
    """Titles as a reader orders them, not by code points."""
    return F.collate("title", "UNICODE")


def plans(graph: Graph, start: str, end: str, now: Column) -> DataFrame:
    """Live plans in [start, end) by start and title, with hub, place, room and notes (id, title, body)."""
    if start >= end:
        raise InvalidRequest("from must lie before to")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    early = plus_seconds(lo, F.lit(-ALL_DAY_HOURS * 3600))
    found = live_nodes(graph, now).where((F.col("kind") == "plan") & (F.col("occurred_at") < hi)).join(graph.plans, F.col("id") == F.col("node_id"))
    found = found.where((F.coalesce("end_at", "occurred_at") >= early) & P.touches(lo, hi))
    items = found.select("id", "title", "body", "rsvp", F.col("occurred_at").alias("start_at"), "end_at", "all_day", "time_zone", "attended", F.col("agent_id").alias("owner"))
    wanted = items.select(F.col("id").alias("src_id"))
    links = graph.edges.where(P.current() & F.col("type").isin("AT_LOCATION", "HAS_NOTE")).join(wanted, "src_id", "left_semi")
    target = live_nodes(graph, now).where("kind in ('place', 'memory')").select(F.col("id").alias("dst_id"), F.col("kind").alias("target_kind"), F.col("title").alias("target_title"), F.col("body").alias("target_body"))
    linked = links.join(target, "dst_id").join(graph.places.select(F.col("node_id").alias("dst_id"), "address"), "dst_id", "left")
    place = F.when((F.col("type") == "AT_LOCATION") & (F.col("target_kind") == "place"), F.struct("created_at", "id", "dst_id", "target_title", "address", F.col("properties")["room"].alias("room")))
    note = F.when(F.col("type") == "HAS_NOTE", F.struct("created_at", "id", F.struct(F.col("dst_id").alias("id"), F.col("target_title").alias("title"), F.col("target_body").alias("body")).alias("n")))
    beside = linked.groupBy("src_id").agg(F.min(place).alias("p"), F.array_sort(F.collect_list(note)).alias("notes"))
    beside = beside.select(
        F.col("src_id").alias("id"), F.col("p.dst_id").alias("place_id"), F.col("p.target_title").alias("place_title"), F.col("p.address").alias("address"), F.col("p.room").alias("room"),
        F.when(F.size("notes") > 0, F.col("notes.n")).alias("notes"),
    )
    hub = hub_of(graph, now, ("HAS_PLAN",), items).select(F.col("item_id").alias("id"), "hub_id", "hub_title")
    return items.join(hub, "id", "left").join(beside, "id", "left").orderBy("start_at", title_order(), "id")


def view(items: DataFrame, name: str, zone: str) -> DataFrame:
    """The rows that a view of a calendar shows: planner (timed), month (all-day, over days, or loose) or tile (all)."""
    shown = {"planner": ~F.col("all_day") & F.col("end_at").isNotNull(), "month": F.col("all_day") | P.multi_day(zone) | F.col("hub_id").isNull(), "tile": F.lit(True)}
    return items.where(shown[name])


def timeline(graph: Graph, start: str, end: str, now: Column, zone: str, name: str) -> DataFrame:
    items = plans(graph, start, end, now).withColumn("occurred_at", F.col("start_at"))
    return view(items, name, zone).drop("occurred_at").orderBy("start_at", title_order(), "id")


def day_tasks(graph: Graph, date: str, now: Column, zone: str) -> DataFrame:
    """Tasks that a day shows: relevant on it, or done and held or finished that day."""
    day = F.lit(date).cast("date")
    begin, stop = day_start(day, zone), day_start(F.date_add(day, 1), zone)
    finished = graph.history.where((F.col("field") == "done") & (F.col("new_value") == "true") & (F.col("changed_at") >= begin) & (F.col("changed_at") < stop)).select(F.col("node_id").alias("id")).distinct().withColumn("finished", F.lit(True))
    tasks = live_tasks(graph, now).join(finished, "id", "left")
    held = (F.col("opens_on") <= day) & (F.col("closes_at").isNull() | (F.col("closes_at") >= begin))
    return _described(graph, tasks.where(P.relevant_on(day) | (F.col("done") & (F.coalesce(held, F.lit(False)) | F.coalesce("finished", F.lit(False))))), now)


def someday_tasks(graph: Graph, now: Column) -> DataFrame:
    return _described(graph, live_tasks(graph, now, P.someday()), now)


def _described(graph: Graph, tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks by close (those without one last) and title, with their hub; owner is who keeps the task."""
    hub = hub_of(graph, now, ("HAS_ITEM",), tasks).select(F.col("item_id").alias("id"), "hub_id", "hub_title")
    late = ~F.col("done") & F.coalesce(F.col("closes_at") < now, F.lit(False))
    found = tasks.join(hub, "id", "left").select("id", "title", "body", "opens_on", "closes_at", "done", F.col("task_verified_at").alias("verified_at"), "created_at", "updated_at", late.alias("past_due"), "hub_id", "hub_title", F.col("agent_id").alias("owner"))
    return found.orderBy(F.asc_nulls_last("closes_at"), title_order(), "id")


def readings(tasks: DataFrame, zone: str, date: str | Column) -> DataFrame:
    """Local readings of tasks and the bucket of a day: due_on_day, upcoming, past_due or null."""
    closes, day = local_date(F.col("closes_at"), zone), (F.lit(date) if isinstance(date, str) else date).cast("date")
    bucket = F.when(closes == day, "due_on_day").when(closes > day, "upcoming").when((closes < day) & ~F.col("done"), "past_due")
    return tasks.withColumns({"closes_local": reading(F.col("closes_at"), zone), "opens_local": day_reading(F.col("opens_on")), "bucket": bucket})


def plan_readings(plans: DataFrame, zone: str, start: str = "occurred_at") -> DataFrame:
    """Start and end in a plan's own zone, else in the given one; all-day plans as dates alone."""
    tz = F.coalesce("time_zone", F.lit(zone))
    read = lambda c: F.when(F.col("all_day"), day_reading(local_date(F.col(c), tz))).otherwise(reading(F.col(c), tz))
    return plans.withColumns({"starts_local": read(start), "ends_local": read("end_at")})


def course_freshness(hubs: DataFrame, now: Column, zone: str) -> DataFrame:
    """(title, verified_at, verified_today, owner) of hubs (hub_id, hub_title, hub_verified_at, hub_agent), one of each
    title: the one of the greatest id."""
    one = hubs.groupBy(F.col("hub_title").alias("title")).agg(F.max(F.struct("hub_id", "hub_verified_at", "hub_agent")).alias("h"))
    return one.select("title", F.col("h.hub_verified_at").alias("verified_at"), same_day(F.col("h.hub_verified_at"), now, zone).alias("verified_today"), F.col("h.hub_agent").alias("owner"))
