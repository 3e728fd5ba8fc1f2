"""Recurring plans: their dates from a rule, their plans written out, and the written-out plans taken back.

series: id, hub_id, title, agent_id, first (date), start_time and end_time (HH:MM), time_zone, and the rule:
freq (DAILY, WEEKLY or MONTHLY), every (each so many, 1 by default), days (array of weekdays, Monday 1, for WEEKLY; the
first date's own by default), times (how many, skipped ones included) or until (the last possible date), skipped (array of
dates).  A column that is not there counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import InvalidRequest
from kairograph.functions.time import local_instant
from kairograph.operators.mutations import close_plans, value_of
from kairograph.sources.graph import Graph, cut

RULE = {"every": "int", "days": "array<int>", "times": "int", "until": "date", "skipped": "array<date>"}
SERIES = {"hub_id": "string", "title": "string", "agent_id": "string", "start_time": "string", "end_time": "string", "time_zone": "string"} | RULE
#: Months without the first date's day are no dates; of eight months or years in a row one at least has it.
SPARE = 8


def dates(series: DataFrame, horizon: Column | None = None) -> Column:
    """The array of a series' dates in order, skipped ones taken out.

    A rule without times and until goes on to the horizon (a date); without one it has no dates.  Only functions on arrays:
    a row makes its dates where it is."""
    every = F.greatest(F.coalesce("every", F.lit(1)), F.lit(1))
    freq = F.upper("freq")
    days = F.coalesce("days", F.array(F.weekday("first") + 1))
    end = F.coalesce("until", horizon) if horizon is not None else F.col("until")
    span = F.when(freq == "DAILY", F.date_add("first", (F.col("times") - 1) * every)).when(freq == "WEEKLY", F.date_add("first", F.col("times") * every * 7)).otherwise(F.add_months("first", F.col("times") * every * SPARE))
    last = F.when(F.col("times").isNull(), end).when(F.col("until").isNull(), span).otherwise(F.least(span, "until"))
    monday, stop = F.date_sub("first", F.weekday("first")), F.greatest(last, "first")
    daily = F.sequence("first", stop, F.make_dt_interval(F.when(freq == "DAILY", every).otherwise(F.lit(1))))
    weekly = F.filter(daily, lambda d: (F.floor(F.datediff(d, monday) / 7) % every == 0) & F.array_contains(days, F.weekday(d) + 1))
    monthly = F.filter(F.sequence("first", stop, F.make_ym_interval(F.lit(0), every)), lambda d: F.dayofmonth(d) == F.dayofmonth("first"))
    found = F.when(last >= F.col("first"), F.when(freq == "DAILY", daily).when(freq == "WEEKLY", weekly).when(freq == "MONTHLY", monthly))
    found = F.when(F.col("times").isNull(), found).otherwise(F.slice(found, F.lit(1), F.greatest("times", F.lit(0))))
    return F.array_except(F.coalesce(found, F.array().cast("array<date>")), F.coalesce("skipped", F.array().cast("array<date>")))


def occurrences(series: DataFrame, zone: str, horizon: Column | None = None) -> DataFrame:
    """(id, day, number, occurred_at, end_at): what a series' rule says when it is read; days are local dates, numbers from 1."""
    full = series.withColumns({c: value_of(series, c, k) for c, k in SERIES.items()})
    each = full.select("id", "start_time", "end_time", F.coalesce("time_zone", F.lit(zone)).alias("tz"), F.posexplode(dates(full, horizon)).alias("at", "day"))
    return each.select("id", "day", (F.col("at") + 1).alias("number"), local_instant(F.col("day"), F.col("start_time"), F.col("tz")).alias("occurred_at"), local_instant(F.col("day"), F.col("end_time"), F.col("tz")).alias("end_at"))


def _plan_id() -> Column:
    return F.sha2(F.concat_ws("|", F.lit("series"), "id", F.col("day").cast("string")), 256)


def id_key(node_id: Column) -> Column:
    """The bytes that stand for an id of 64 characters: 32 for a hash in lower case, else its own; never null, so that no
    filter of a join makes it again."""
    return F.coalesce(F.unhex(F.when(node_id == F.lower(node_id), node_id)), node_id.cast("binary"), F.lit(b""))


def id_of(key: Column) -> Column:
    """The id for which id_key() gave these bytes."""
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(key.cast("string"))


def members(series: DataFrame, zone: str, horizon: Column | None = None) -> DataFrame:
    """(series_id, node_id): the plans that write_out() makes of a series."""
    return occurrences(series, zone, horizon).select(F.col("id").alias("series_id"), _plan_id().alias("node_id"))


def write_out(graph: Graph, series: DataFrame, at: Column, zone: str, horizon: Column | None = None) -> Graph:
    """A plan for each date of each series, under its hub if it has one.  A plan that is there is not made again, so a second
    run, or a longer horizon, adds only what is missing.

    Only ids as long as a written plan's are looked up, by their bytes, and only where the graph has any; what is missing
    then is stored as series and day, of which rows of the graph are made where they are read."""
    if "freq" not in series.columns or "first" not in series.columns:
        raise InvalidRequest("a series needs freq and first")
    full = series.withColumns({c: value_of(series, c, k) for c, k in SERIES.items()})
    days = full.select("id", "hub_id", "title", "agent_id", "time_zone", "start_time", "end_time", F.explode_outer(dates(full, horizon)).alias("day")).where("day is not null")
    there = graph.nodes.where(F.length("id") == 64).select(id_key(F.col("id")).alias("key"))
    if not there.isEmpty():
        missing = cut(days.select("id", "day", id_key(_plan_id()).alias("key")).join(there, "key", "left_anti").select("id", "day").distinct())
        days = missing.join(full.select("id", "hub_id", "title", "agent_id", "time_zone", "start_time", "end_time"), "id")
    tz = F.coalesce("time_zone", F.lit(zone))
    each = days.withColumns({"node_id": _plan_id(), "occurred_at": local_instant(F.col("day"), F.col("start_time"), tz), "end_at": local_instant(F.col("day"), F.col("end_time"), tz)})
    none = lambda kind: F.lit(None).cast(kind)
    nodes = each.select(
        F.col("node_id").alias("id"), F.lit("plan").alias("kind"), "title", none("string").alias("body"), none("array<float>").alias("embedding"), "occurred_at", none("timestamp").alias("expires_at"), none("timestamp").alias("verified_at"),
        F.lit(0).alias("access_count"), none("timestamp").alias("last_accessed_at"), F.lit("agent").alias("source"), "agent_id", at.alias("created_at"), at.alias("updated_at"),
    )
    plans = each.select("node_id", "end_at", F.lit(False).alias("all_day"), "time_zone", none("string").alias("rsvp"), none("boolean").alias("attended"))
    edges = each.where("hub_id is not null").select(
        F.sha2(F.concat_ws("|", F.lit("HAS_PLAN"), "hub_id", "node_id"), 256).alias("id"), F.col("hub_id").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("HAS_PLAN").alias("type"),
        F.create_map().cast("map<string,string>").alias("properties"), F.lit(1.0).alias("confidence"), at.alias("created_at"), at.alias("valid_from"), none("timestamp").alias("valid_to"),
    )
    return graph.with_(nodes=graph.nodes.unionByName(nodes), plans=graph.plans.unionByName(plans), edges=graph.edges.unionByName(edges))


def take_back(graph: Graph, written: DataFrame, at: Column) -> Graph:
    """The plans that were written out of series (written: series_id, node_id) go: a history row keeps each title, their edges
    end, nodes and details are removed.  From then on occurrences() says them as they are read.  Plans of no series
    (series_id null) stay, and a second run changes nothing."""
    return close_plans(graph, written.where("series_id is not null").select(F.col("node_id").alias("id")), at, "manual")
