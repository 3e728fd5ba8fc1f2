"""Changes of the graph: operations in, new tables out.

Each function takes the graph and a table of operations and returns the graph after it; apply() runs a batch in the fixed
order.  Operation tables carry what their step needs; a column that a step may do without may be absent.  Where a value,
null and nothing must be told apart, `has_x` says whether x is given; without that column x is given where it is not null.

creates: temp_id, kind, title, body, embedding, occurred_at, ttl_days, agent_id and detail columns of any kind.
patches: id and any of title, body, occurred_at, ttl_days and the detail columns.  edges: EDGE columns.
spawns: temp_id, hub_id, title, agent_id, dates, start_time, end_time, time_zone, rsvp, body, place_id, room.
session_edits: seq, hub_id, from_date, to_date, and any of body, rsvp, attended, start_time, end_time, room, close.
closed_edges: id and perhaps valid_from as it was read.  closed_nodes, verified (tasks that are restated): id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import OPERATIONS, SYMMETRIC_TYPES, Conflict, InvalidRequest, NotFound
from kairograph.functions import predicates as P
from kairograph.functions.text import embedding_text, history_text
from kairograph.functions.time import day_start, expires_at, iso, local_date, local_instant, local_midnight, plus_seconds
from kairograph.sources.graph import Graph, cut

#: Detail columns that operations may set, by table and type.
DETAILS = {
    "persons": {"birthday": "date", "aliases": "array<string>"},
    "plans": {"end_at": "timestamp", "all_day": "boolean", "time_zone": "string", "rsvp": "string", "attended": "boolean"},
    "tasks": {"opens_on": "date", "closes_at": "timestamp", "done": "boolean"},
    "places": {"address": "string", "latitude": "double", "longitude": "double"},
}
KIND_OF = {"persons": "person", "plans": "plan", "tasks": "task", "places": "place"}
FIELDS = {"title": "string", "body": "string", "occurred_at": "timestamp", "ttl_days": "int"} | {c: k for table in DETAILS.values() for c, k in table.items()}
#: Types of wanted edges that held ones are read by; with more of them all held edges are read.
MOST_TYPES = 1000
EDITS = {"body": "string", "rsvp": "string", "attended": "boolean", "start_time": "string", "end_time": "string", "room": "string"}


def value_of(ops: DataFrame, name: str, kind: str) -> Column:
    """The column as that type, null where the table lacks it."""
    return (F.col(name) if name in ops.columns else F.lit(None)).cast(kind)


def tri_state(ops: DataFrame, fields: dict[str, str], *keep: str | Column) -> DataFrame:
    """The kept columns and, of each field, has_x and x of its type."""
    out = [F.col(k) if isinstance(k, str) else k for k in keep]
    for name, kind in fields.items():
        value = value_of(ops, name, kind)
        given = F.coalesce(f"has_{name}", F.lit(False)) if f"has_{name}" in ops.columns else value.isNotNull()
        out += [given.alias(f"has_{name}"), value.alias(name)]
    return ops.select(*out)


def history_key(field: str, at: Column) -> Column:
    """The id of a history row of a node (id)."""
    return F.sha2(F.concat_ws("|", "id", F.lit(field), at.cast("string")), 256)


def history_rows(changed: DataFrame, field: str, old: Column, new: Column, at: Column, source: str, agent: Column | None = None) -> DataFrame:
    text = lambda c: c.cast("string")
    return changed.select(
        history_key(field, at).alias("id"), F.col("id").alias("node_id"), F.lit(field).alias("field"), text(old).alias("old_value"), text(new).alias("new_value"),
        F.lit(None).cast("array<float>").alias("embedding"), at.alias("changed_at"), F.lit(source).alias("source"), (F.lit(None) if agent is None else agent).cast("string").alias("agent_id"),
    )


def create_nodes(graph: Graph, creates: DataFrame, at: Column) -> Graph:
    """Nodes with their details, and a history row for tasks that are created done."""
    made = creates.withColumn("id", new_id(at))
    nodes = made.select(
        "id", "kind", "title", value_of(made, "body", "string").alias("body"), value_of(made, "embedding", "array<float>").alias("embedding"), "occurred_at",
        expires_at(F.coalesce("occurred_at", at), value_of(made, "ttl_days", "int")).alias("expires_at"), F.lit(None).cast("timestamp").alias("verified_at"),
        F.lit(0).alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed_at"), F.lit("agent").alias("source"), "agent_id", at.alias("created_at"), at.alias("updated_at"),
    )
    own = lambda table: made.where(F.col("kind") == KIND_OF[table])
    detail = lambda table: {c: value_of(made, c, k) for c, k in DETAILS[table].items()}
    rows = {t: detail(t) for t in DETAILS}
    rows["persons"]["aliases"] = F.coalesce(rows["persons"]["aliases"], F.array().cast("array<string>"))
    rows["plans"]["all_day"] = F.coalesce(rows["plans"]["all_day"], F.lit(False))
    rows["tasks"]["done"] = F.coalesce(rows["tasks"]["done"], F.lit(False))
    rows["tasks"]["task_verified_at"] = at
    tables = {t: getattr(graph, t).unionByName(own(t).select(F.col("id").alias("node_id"), *[v.alias(c) for c, v in rows[t].items()])) for t in DETAILS}
    done = own("tasks").where(rows["tasks"]["done"])
    return graph.with_(nodes=graph.nodes.unionByName(nodes), history=graph.history.unionByName(history_rows(done, "done", F.lit("false"), F.lit("true"), at, "ingest")), **tables)


def new_id(at: Column, *parts: str) -> Column:
    """The id of what an operation makes, the same however often it runs."""
    return F.sha2(F.concat_ws("|", *(parts or ("temp_id",)), at.cast("string")), 256)


def anchor_all_day(plans: DataFrame, zone: str) -> DataFrame:
    """Starts and ends of created all-day plans moved to local midnight."""
    if "all_day" not in plans.columns:
        return plans
    for c in ("occurred_at", "end_at"):
        if c in plans.columns:
            plans = plans.withColumn(c, F.when((F.col("kind") == "plan") & F.col("all_day"), local_midnight(F.col(c), zone)).otherwise(F.col(c)))
    return plans


def anchor_patches(graph: Graph, patches: DataFrame, zone: str) -> DataFrame:
    """Tri-state patches with the times of all-day plans at local midnight.  One that turns all_day on moves the stored
    times too; one that leaves it on moves what it sets."""
    held = graph.plans.select(F.col("node_id").alias("id"), F.col("end_at").alias("was_end_at"), F.col("all_day").alias("was")).join(graph.nodes.select("id", F.col("occurred_at").alias("was_occurred_at")), "id")
    rows = patches.join(held.join(patches.select("id"), "id", "left_semi"), "id", "left")
    on = F.coalesce(F.when(F.col("has_all_day"), F.col("all_day")).otherwise(F.col("was")), F.lit(False)) & F.col("was").isNotNull()
    turned = on & ~F.col("was")
    changes = {}
    for c in ("occurred_at", "end_at"):
        moved = turned & ~F.col(f"has_{c}") & F.col(f"was_{c}").isNotNull()
        changes[c] = F.when(moved, local_midnight(F.col(f"was_{c}"), zone)).when(on, local_midnight(F.col(c), zone)).otherwise(F.col(c))
        changes[f"has_{c}"] = F.col(f"has_{c}") | moved
    return rows.withColumns(changes).select(*patches.columns)


def update_nodes(graph: Graph, patches: DataFrame, at: Column, zone: str | None = None) -> Graph:
    """Patches of nodes and their details.  A history row for each of title, body, start and done that changes; a task
    that is patched at all is verified.  zone: all-day plans keep to its midnights."""
    patches = tri_state(patches, FIELDS, "id")
    if zone:
        patches = anchor_patches(graph, patches, zone)
    named = ("title", "body", "occurred_at")
    joined = graph.nodes.join(patches.select("id", "has_ttl_days", "ttl_days", *[f"has_{c}" for c in named], *[F.col(c).alias(f"new_{c}") for c in named]), "id", "left")
    given = lambda c: F.coalesce(f"has_{c}", F.lit(False))
    moved = {c: F.when(given(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in named}
    differs = {c: ~F.col(c).eqNullSafe(v) for c, v in moved.items()}
    history = graph.history
    for c, v in moved.items():
        text = iso if c == "occurred_at" else (lambda x: x)
        history = history.unionByName(history_rows(joined.where(differs[c]), c, text(F.col(c)), text(v), at, "ingest"))
    any_change = differs["title"] | differs["body"] | differs["occurred_at"] | given("ttl_days")
    nodes = joined.select(
        "id", "kind", moved["title"].alias("title"), moved["body"].alias("body"), F.when(differs["title"] | differs["body"], F.lit(None)).otherwise(F.col("embedding")).alias("embedding"), moved["occurred_at"].alias("occurred_at"),
        F.when(given("ttl_days"), expires_at(at, F.col("ttl_days"))).otherwise(F.col("expires_at")).alias("expires_at"), "verified_at", "access_count", "last_accessed_at", "source", "agent_id", "created_at",
        F.when(any_change, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    tables = {}
    for name in ("persons", "plans", "places", "tasks"):
        fields = [c for c in DETAILS[name] if c != "done"]
        table = getattr(graph, name)
        mark = patches.select(F.col("id").alias("node_id"), *[f"has_{c}" for c in fields], *[F.col(c).alias(f"new_{c}") for c in fields])
        found = table.join(mark, "node_id", "left").withColumns({c: F.when(given(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields})
        tables[name] = found.select(*table.columns)
    marks = patches.select("id", "has_done", F.col("done").alias("new_done"))
    return mark_done(graph.with_(nodes=nodes, history=history, **tables), marks, at, "ingest")


def require_kind(graph: Graph, ids: DataFrame, kind: str, now: Column | None = None) -> None:
    """Raises unless each id is a node of that kind: not found, or an invalid request.  now: expired nodes are not found."""
    held = ids.select("id").distinct().join(graph.nodes.select("id", "kind", "expires_at"), "id", "left").where(F.col("kind").isNull() | (F.col("kind") != kind) | (F.lit(False) if now is None else ~P.live(now)))
    bad = held.orderBy(F.col("kind").isNotNull(), "id").first()
    if bad is not None:
        raise NotFound(bad.id) if bad.kind is None or bad.kind == kind else InvalidRequest(f"node {bad.id} is not a {kind}")


def mark_done(graph: Graph, marks: DataFrame, at: Column, source: str = "manual") -> Graph:
    """marks: id, has_done, new_done.  The flag is set and verified; history only where it changes."""
    tasks = graph.tasks.join(marks.withColumnRenamed("id", "node_id"), "node_id", "left")
    named, given = F.col("has_done").isNotNull(), F.coalesce("has_done", F.lit(False))
    changed = tasks.where(given & (F.col("new_done") != F.col("done"))).withColumnRenamed("node_id", "id")
    history = graph.history.unionByName(history_rows(changed, "done", F.col("done"), F.col("new_done"), at, source))
    rows = tasks.select("node_id", "opens_on", "closes_at", F.when(given, F.col("new_done")).otherwise(F.col("done")).alias("done"), F.when(named, at).otherwise(F.col("task_verified_at")).alias("task_verified_at"))
    return graph.with_(tasks=rows, history=history)


def mark_tasks(graph: Graph, marks: DataFrame, at: Column) -> Graph:
    """Marks by hand: (id, done).  Raises for ids that are no tasks."""
    require_kind(graph, marks, "task")
    return mark_done(graph, marks.select("id", F.lit(True).alias("has_done"), F.col("done").alias("new_done")), at)


def mark_attended(graph: Graph, marks: DataFrame, now: Column) -> Graph:
    """Marks by hand: (id, attended), null to take a mark back.  Raises for ids that are no live plans."""
    require_kind(graph, marks, "plan", now)
    rows = graph.plans.drop("attended").join(marks.select(F.col("id").alias("node_id"), F.lit(True).alias("m"), F.col("attended").alias("new")), "node_id", "left")
    rows = rows.join(graph.plans.select("node_id", "attended"), "node_id").withColumn("attended", F.when(F.col("m"), F.col("new")).otherwise(F.col("attended")))
    return graph.with_(plans=rows.select(*graph.plans.columns))


def verify_by_hand(graph: Graph, ids: DataFrame, at: Column) -> Graph:
    """verify_tasks(), which raises for ids that are no tasks."""
    require_kind(graph, ids, "task")
    return verify_tasks(graph, ids, at)


def verify_tasks(graph: Graph, ids: DataFrame, at: Column) -> Graph:
    """The tasks and their hubs are stamped as verified."""
    mark = ids.select(F.col("id").alias("node_id")).distinct().withColumn("m", F.lit(True))
    tasks = graph.tasks.join(mark, "node_id", "left").withColumn("task_verified_at", F.when(F.col("m"), at).otherwise(F.col("task_verified_at"))).drop("m")
    return stamp_hubs(graph.with_(tasks=tasks), ids, at)


def stamp_hubs(graph: Graph, tasks: DataFrame, at: Column) -> Graph:
    """The hubs of the tasks are verified."""
    mark = tasks.select(F.col("id").alias("dst_id")).distinct()
    hubs = graph.edges.where(P.current() & (F.col("type") == "HAS_ITEM")).join(mark, "dst_id", "left_semi").select(F.col("src_id").alias("id")).distinct().withColumn("m", F.lit(True))
    return graph.with_(nodes=graph.nodes.join(hubs, "id", "left").withColumn("verified_at", F.when(F.col("m"), at).otherwise(F.col("verified_at"))).select(*graph.nodes.columns))


def close_edges(graph: Graph, ids: DataFrame, at: Column, hit: bool = False) -> Graph:
    """hit: a column of that name says which edges were named."""
    closed = ids.select("id").distinct().withColumn("m", F.lit(True))
    named = F.coalesce("m", F.lit(False))
    edges = graph.edges.join(closed, "id", "left").withColumn("valid_to", F.when(F.col("m") & P.current(), at).otherwise(F.col("valid_to")))
    return graph.with_(edges=edges.select(*graph.edges.columns, *([named.alias("hit")] if hit else [])))


def neighbours(graph: Graph, ids: DataFrame) -> DataFrame:
    """Nodes that a current edge joins with the ids."""
    near, out = graph.edges.where(P.current()), None
    for end, other in (("src_id", "dst_id"), ("dst_id", "src_id")):
        found = near.join(ids.select(F.col("id").alias(end)), end, "left_semi").select(F.col(other).alias("id"))
        out = found if out is None else out.union(found)
    return out.distinct()


def close_nodes(graph: Graph, ids: DataFrame, at: Column, source: str = "ingest") -> Graph:
    """Edges of the nodes end, a history row keeps each title, nodes and details go."""
    gone = ids.select("id").distinct()
    return _without(graph, gone, graph.nodes.join(gone, "id", "left_semi"), at, source)


def close_plans(graph: Graph, ids: DataFrame, at: Column, source: str = "ingest") -> Graph:
    """close_nodes() of those ids that are plans still; others do nothing, so a second run finds none and looks for no edges."""
    held = cut(graph.nodes.where("kind = 'plan'").select("id", "title").join(ids.select("id").distinct(), "id", "left_semi"))
    return _without(graph, held.select("id").distinct(), held, at, source)


def _without(graph: Graph, gone: DataFrame, held: DataFrame, at: Column, source: str) -> Graph:
    """The graph after gone (id, each once) is closed; held: their nodes (id, title)."""
    ends = {end: gone.select(F.col("id").alias(end), F.lit(True).alias(f"m_{end}")) for end in ("src_id", "dst_id")}
    edges = graph.edges.join(ends["src_id"], "src_id", "left").join(ends["dst_id"], "dst_id", "left")
    edges = edges.withColumn("valid_to", F.when(P.current() & (F.col("m_src_id") | F.col("m_dst_id") | F.lit(False)), at).otherwise(F.col("valid_to"))).select(*graph.edges.columns)
    history = graph.history.unionByName(history_rows(held, "deleted", F.col("title"), F.lit(None), at, source))
    details = {n: getattr(graph, n).join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti") for n in ("persons", "plans", "tasks", "places")}
    return graph.with_(nodes=graph.nodes.join(gone, "id", "left_anti"), edges=edges, history=history, **details)


def _ends(edges: DataFrame) -> DataFrame:
    """Canonical ends: for symmetric types the lesser id first."""
    mirrored = F.col("type").isin(*SYMMETRIC_TYPES)
    return edges.withColumn("x", F.when(mirrored, F.least("src_id", "dst_id")).otherwise(F.col("src_id"))).withColumn("y", F.when(mirrored, F.greatest("src_id", "dst_id")).otherwise(F.col("dst_id")))


def new_edges(graph: Graph, wanted: DataFrame) -> DataFrame:
    """The wanted edges that are not held: same type and ends, and each given property equal, means held."""
    types = [r.type for r in wanted.select("type").distinct().limit(MOST_TYPES + 1).collect()]  # held edges of other types are not even read
    near = graph.edges.where(P.current()) if len(types) > MOST_TYPES else graph.edges.where(P.current() & F.col("type").isin(types))
    held = _ends(near).select("type", "x", "y", F.col("properties").alias("held"))
    same = F.forall(F.map_entries("properties"), lambda e: F.coalesce(F.try_element_at("held", e["key"]) == e["value"], F.lit(False)))
    found = _ends(wanted).join(held, ["type", "x", "y"]).where(same).select("id").distinct()
    return wanted.where("src_id <> dst_id").join(found, "id", "left_anti")


def create_edges(graph: Graph, wanted: DataFrame) -> Graph:
    return graph.with_(edges=graph.edges.unionByName(new_edges(graph, wanted).select(*graph.edges.columns)))


def spawn_plans(graph: Graph, spawns: DataFrame, at: Column, zone: str) -> Graph:
    """One plan for each date of each spawn, linked to its hub and its place."""
    optional = {"time_zone": "string", "rsvp": "string", "body": "string", "end_time": "string", "place_id": "string", "room": "string"}
    spawns = spawns.withColumns({c: value_of(spawns, c, k) for c, k in optional.items()})
    tz = F.coalesce("time_zone", F.lit(zone))
    each = spawns.select("*", F.explode(F.array_sort(F.array_distinct("dates"))).alias("date")).withColumn("id", F.sha2(F.concat_ws("|", "hub_id", "title", F.col("date").cast("string")), 256))
    each = each.withColumn("occurred_at", local_instant(F.col("date"), F.col("start_time"), tz)).withColumn("end_at", local_instant(F.col("date"), F.col("end_time"), tz))
    none = lambda kind: F.lit(None).cast(kind)
    nodes = each.select(
        "id", F.lit("plan").alias("kind"), "title", "body", none("array<float>").alias("embedding"), "occurred_at", none("timestamp").alias("expires_at"), none("timestamp").alias("verified_at"), F.lit(0).alias("access_count"),
        none("timestamp").alias("last_accessed_at"), F.lit("agent").alias("source"), "agent_id", at.alias("created_at"), at.alias("updated_at"),
    )
    plans = each.select("id", "end_at", F.lit(False), "time_zone", "rsvp", none("boolean"))

    def edge(src, dst, kind, properties):
        return each.where(src.isNotNull() & dst.isNotNull()).select(
            F.sha2(F.concat_ws("|", F.lit(kind), src, dst), 256).alias("id"), src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("type"), properties.alias("properties"),
            F.lit(1.0).alias("confidence"), at.alias("created_at"), at.alias("valid_from"), none("timestamp").alias("valid_to"),
        )

    empty = F.create_map().cast("map<string,string>")
    room = F.when(F.col("room").isNotNull(), F.create_map(F.lit("room"), F.col("room"))).otherwise(empty)
    edges = edge(F.col("hub_id"), F.col("id"), "HAS_PLAN", empty).union(edge(F.col("id"), F.col("place_id"), "AT_LOCATION", room))
    return graph.with_(nodes=graph.nodes.unionByName(nodes), plans=graph.plans.union(plans), edges=graph.edges.unionByName(edges))


def spawned_ids(spawns: DataFrame) -> DataFrame:
    """(temp_id, id, date) of the sessions that spawn_plans() makes."""
    each = spawns.select(value_of(spawns, "temp_id", "string").alias("temp_id"), "hub_id", "title", F.explode(F.array_distinct("dates")).alias("date"))
    return each.select("temp_id", F.sha2(F.concat_ws("|", "hub_id", "title", F.col("date").cast("string")), 256).alias("id"), "date")


def hub_sessions(graph: Graph, hub_id: str, first: str, last: str, zone: str) -> DataFrame:
    """Ids of the hub's sessions that start on the local dates first to last."""
    held = graph.edges.where(P.current() & (F.col("type") == "HAS_PLAN") & (F.col("src_id") == hub_id)).select(F.col("dst_id").alias("id"))
    lo, hi = day_start(F.lit(first).cast("date"), zone), day_start(F.date_add(F.lit(last).cast("date"), 1), zone)
    return graph.nodes.where((F.col("occurred_at") >= lo) & (F.col("occurred_at") < hi)).join(held, "id", "left_semi").select("id")


def move_sessions(graph: Graph, ids: DataFrame, at: Column, zone: str, start_time: str | None = None, end_time: str | None = None, room: str | None = None) -> Graph:
    """Sessions get another start (length kept), end or room; dates stay.  No history is written."""
    mark = ids.select("id").distinct().withColumn("m", F.lit(True))
    rows = graph.nodes.join(mark, "id", "left").join(graph.plans.withColumnRenamed("node_id", "id").select("id", "end_at", F.coalesce("time_zone", F.lit(zone)).alias("tz")), "id", "left")
    date = local_date(F.col("occurred_at"), F.col("tz"))
    start = local_instant(date, F.lit(start_time), F.col("tz")) if start_time else F.col("occurred_at")
    shift = (F.unix_micros(start) - F.unix_micros("occurred_at")) / 1_000_000
    end = local_instant(date, F.lit(end_time), F.col("tz")) if end_time else plus_seconds(F.col("end_at"), shift)
    rows = rows.withColumn("new_end", F.when(F.col("m"), end).otherwise(F.col("end_at"))).withColumn("new_start", F.when(F.col("m"), start).otherwise(F.col("occurred_at")))
    nodes = rows.withColumn("updated_at", F.when(F.col("m"), at).otherwise(F.col("updated_at"))).drop("occurred_at").withColumnRenamed("new_start", "occurred_at").select(*graph.nodes.columns)
    plans = graph.plans.drop("end_at").join(rows.select(F.col("id").alias("node_id"), F.col("new_end").alias("end_at")), "node_id", "left").select(*graph.plans.columns)
    edges = graph.edges
    if room is not None:
        edges = edges.join(mark.withColumnRenamed("id", "src_id"), "src_id", "left")
        kept = F.map_filter("properties", lambda k, v: k != "room")
        edges = edges.withColumn("properties", F.when(F.col("m") & P.current() & (F.col("type") == "AT_LOCATION"), F.map_concat(kept, F.create_map(F.lit("room"), F.lit(room)))).otherwise(F.col("properties"))).select(*graph.edges.columns)
    return graph.with_(nodes=nodes, plans=plans, edges=edges)


def edit_sessions(graph: Graph, edits: DataFrame, at: Column, zone: str) -> tuple[Graph, DataFrame, DataFrame]:
    """Changes of all live sessions of hubs within local dates: body, answer, attendance, start (the length is kept
    unless an end is set), end, room, or all closed.  Of several edits of a session the last by seq holds for each field.
    Raises if an edit matches no session.  Returns the graph, the ids changed and the neighbours of closed sessions."""
    rows = tri_state(edits, EDITS, "seq", "hub_id", value_of(edits, "from_date", "date").alias("from_date"), value_of(edits, "to_date", "date").alias("to_date"), F.coalesce(value_of(edits, "close", "boolean"), F.lit(False)).alias("close"))
    held = graph.edges.where(P.current() & (F.col("type") == "HAS_PLAN")).select(F.col("src_id").alias("hub_id"), F.col("dst_id").alias("id"))
    start = graph.nodes.where(P.live(at) & F.col("occurred_at").isNotNull()).select("id", "occurred_at")
    within = (F.col("occurred_at") >= day_start(F.col("from_date"), zone)) & (F.col("to_date").isNull() | (F.col("occurred_at") < day_start(F.date_add("to_date", 1), zone)))
    met = cut(rows.join(held, "hub_id").join(start, "id").where(within).drop("occurred_at"))
    lost = rows.join(met.select("seq").distinct(), "seq", "left_anti").select("hub_id", "from_date").first()
    if lost is not None:
        raise InvalidRequest(f"hub {lost.hub_id} has no session from {lost.from_date}")
    last = {c: F.max(F.when(F.col(f"has_{c}"), F.struct("seq", F.col(c).alias("v")))).alias(c) for c in EDITS}
    folded = met.groupBy("id").agg(F.max("close").alias("close"), *last.values())
    closed, changed = folded.where("close").select("id"), folded.where("not close").drop("close").withColumn("m", F.lit(True))
    beside = cut(neighbours(graph, closed))
    renamed = changed.select("id", "m", *[F.col(c).alias(f"e_{c}") for c in EDITS])
    set_ = lambda c, old: F.when(F.col(f"e_{c}").isNotNull(), F.col(f"e_{c}.v")).otherwise(old)
    nodes = graph.nodes.join(renamed, "id", "left").join(graph.plans.select(F.col("node_id").alias("id"), "end_at", F.coalesce("time_zone", F.lit(zone)).alias("tz")), "id", "left")
    date = local_date(F.col("occurred_at"), F.col("tz"))
    begin = F.when(F.col("e_start_time").isNotNull(), local_instant(date, F.col("e_start_time.v"), F.col("tz"))).otherwise(F.col("occurred_at"))
    kept = plus_seconds(F.col("end_at"), (F.unix_micros(begin) - F.unix_micros("occurred_at")) / 1_000_000)
    end = F.when(F.col("e_end_time").isNotNull(), local_instant(date, F.col("e_end_time.v"), F.col("tz"))).otherwise(kept)
    moved = nodes.withColumns({"new_start": F.when(F.col("m"), begin).otherwise(F.col("occurred_at")), "new_end": F.when(F.col("m"), end).otherwise(F.col("end_at")), "new_body": set_("body", F.col("body")), "updated_at": F.when(F.col("m"), at).otherwise(F.col("updated_at"))})
    after = moved.drop("occurred_at", "body").withColumnsRenamed({"new_start": "occurred_at", "new_body": "body"}).select(*graph.nodes.columns)
    shape = moved.select(F.col("id").alias("node_id"), "new_end", F.col("e_rsvp"), F.col("e_attended"))
    plans = graph.plans.join(shape, "node_id", "left").withColumns({"end_at": F.col("new_end"), "rsvp": set_("rsvp", F.col("rsvp")), "attended": set_("attended", F.col("attended"))}).select(*graph.plans.columns)
    rooms = changed.where("room is not null").select(F.col("id").alias("src_id"), F.lit(True).alias("m"), F.col("room.v").alias("new_room"))
    bare = F.map_filter("properties", lambda k, v: k != "room")
    placed = F.when(F.col("new_room").isNull(), bare).otherwise(F.map_concat(bare, F.create_map(F.lit("room"), F.col("new_room"))))
    edges = graph.edges.join(rooms, "src_id", "left").withColumn("properties", F.when(F.col("m") & P.current() & (F.col("type") == "AT_LOCATION"), placed).otherwise(F.col("properties"))).select(*graph.edges.columns)
    out = close_nodes(graph.with_(nodes=after, plans=plans, edges=edges), closed, at)
    return out, folded.select("id"), beside


def orphans(graph: Graph, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates without any current edge, dated plans excepted.  Ends of edges that close_edges() has marked as hit are
    candidates too.

    Edges are read once; what is said of a node is put together before the shuffle."""
    hit = F.col("hit") if "hit" in graph.edges.columns else F.lit(False)
    ends = graph.edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"), P.current().alias("held"), hit.alias("hit")).where("held or hit")
    if candidates is not None:
        ends = ends.union(candidates.select("id", F.lit(False), F.lit(True)))
    alone = ends.groupBy("id").agg(F.max("held").alias("held"), F.max("hit").alias("hit")).where("hit and not held").select("id")
    dated = (F.col("kind") == "plan") & F.col("occurred_at").isNotNull()
    return graph.nodes.where(~F.coalesce(dated, F.lit(False))).select("id").join(alone, "id", "left_semi")


def stale_edges(graph: Graph, edges: DataFrame) -> DataFrame:
    """(id) of edges to close that are gone, closed already, or not as they were read (valid_from)."""
    held = graph.edges.where(P.current()).select("id", F.col("valid_from").alias("held_from"))
    found = edges.join(held, "id", "left")
    read = F.lit(False) if "valid_from" not in edges.columns else F.col("valid_from").isNotNull() & (F.col("valid_from") != F.col("held_from"))
    return found.where(F.col("held_from").isNull() | read).select("id").distinct()


def stale_nodes(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id) of nodes that a batch refers to and that are gone."""
    return ids.select("id").join(graph.nodes.select("id"), "id", "left_anti").distinct()


def require_current(graph: Graph, edges: DataFrame) -> None:
    if not stale_edges(graph, edges).isEmpty():
        raise Conflict("an edge is no longer current")


def require_nodes(graph: Graph, ids: DataFrame) -> None:
    lost = stale_nodes(graph, ids).first()
    if lost is not None:
        raise Conflict(f"node {lost.id} is no longer current")


def operation_counts(ops: DataFrame, kinds: list[str]) -> DataFrame:
    """Operations of each kind, zero where there is none."""
    names = ops.sparkSession.createDataFrame([(k,) for k in kinds], "op string")
    return names.join(F.broadcast(ops.groupBy("op").agg(F.count("*").alias("n"))), "op", "left").select("op", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass
class Applied:
    """Of a batch: counts of each operation and of edges that were held already; (temp_id, id) of created nodes; (temp_id,
    id, date) of spawned sessions; ids of edited sessions; and, made and stored when one of them is first asked for, ids of
    orphans that were swept and the graph after it all."""

    counts: DataFrame
    temp_ids: DataFrame | None
    spawned: DataFrame | None
    sessions: DataFrame | None
    sweep: Callable[[], tuple[Graph, DataFrame | None]]

    @cached_property
    def _swept(self) -> tuple[Graph, DataFrame | None]:
        return self.sweep()

    @property
    def graph(self) -> Graph:
        return self._swept[0]

    @property
    def orphans(self) -> DataFrame | None:
        return self._swept[1]


def _union(found: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in found:
        out = df if out is None else out.union(df)
    return out


def referenced(creates=None, spawns=None, patches=None, edges=None, closed_nodes=None, noops=None, session_edits=None) -> DataFrame | None:
    """Ids of stored nodes that a batch refers to; temp ids of its own creates are none."""
    found = [x.select("id") for x in (patches, closed_nodes, noops) if x is not None]
    found += [session_edits.select(F.col("hub_id").alias("id"))] if session_edits is not None else []
    for ops, columns in ((edges, ("src_id", "dst_id")), (spawns, ("hub_id", "place_id"))):
        found += [ops.select(F.col(c).alias("id")).where("id is not null") for c in columns if ops is not None and c in ops.columns]
    ids = _union(found)
    if ids is not None and creates is not None:
        ids = ids.join(creates.select(F.col("temp_id").alias("id")), "id", "left_anti")
    return None if ids is None else ids.distinct()


def resolved(ops: DataFrame, temp_ids: DataFrame | None, at: Column, *columns: str) -> DataFrame:
    """The operations with temp ids in the columns replaced by the ids they stand for, which are made after the join: a long
    id is not shuffled."""
    if temp_ids is None:
        return ops
    for c in columns:
        if c in ops.columns:
            named = temp_ids.select(F.col("temp_id").alias(c), F.lit(True).alias("__made"))
            ops = ops.join(named, c, "left").withColumn(c, F.when(F.col("__made"), new_id(at, c)).otherwise(F.col(c))).drop("__made")
    return ops


def apply(
    graph: Graph, at: Column, zone: str, *, creates: DataFrame | None = None, spawns: DataFrame | None = None, patches: DataFrame | None = None, edges: DataFrame | None = None,
    closed_edges: DataFrame | None = None, closed_nodes: DataFrame | None = None, session_edits: DataFrame | None = None, noops: DataFrame | None = None,
) -> Applied:
    """A batch in the fixed order: creates, spawns, updates, new edges, closed edges, closed nodes, edited sessions, tasks
    that are restated (noops: id), verified hubs, and the sweep of what closed edges and sessions left alone."""
    known = referenced(creates, spawns, patches, edges, closed_nodes, noops, session_edits)
    if known is not None:
        require_nodes(graph, known)
    temp_ids = spawned = sessions = beside = None
    counted: dict[str, DataFrame] = {"create_node": creates, "update_node": patches, "close_node": closed_nodes, "close_edge": closed_edges, "spawn_plans": spawns, "update_plans": session_edits, "noop": noops}
    tasks: list[DataFrame] = []
    if creates is not None:
        graph = create_nodes(graph, anchor_all_day(creates, zone), at)
        temp_ids = cut(creates.select("temp_id")).select("temp_id", new_id(at).alias("id"))
        tasks.append(creates.where("kind = 'task'").select(new_id(at).alias("id")))
    if spawns is not None:
        spawns = resolved(spawns, temp_ids, at, "hub_id", "place_id")
        graph = spawn_plans(graph, spawns, at, zone)
        spawned = spawned_ids(spawns)
    if patches is not None:
        graph = update_nodes(graph, patches, at, zone)
        tasks.append(patches.select("id").join(graph.tasks.select(F.col("node_id").alias("id")), "id", "left_semi"))
    if edges is not None:
        edges = resolved(edges, temp_ids, at, "src_id", "dst_id")
        made = cut(new_edges(graph, edges))
        graph = graph.with_(edges=graph.edges.unionByName(made.select(*graph.edges.columns)))
        counted |= {"create_edge": made, "edge_exists": edges.join(made.select("id"), "id", "left_anti")}
    if closed_edges is not None:
        require_current(graph, closed_edges)
        graph = close_edges(graph, closed_edges, at, hit=True)
    if closed_nodes is not None:
        graph = close_nodes(graph, closed_nodes, at)
    if session_edits is not None:
        graph, sessions, beside = edit_sessions(graph, session_edits, at, zone)
    bare = graph  # stamps make nobody an orphan
    if "hit" in graph.edges.columns:
        graph = graph.with_(edges=graph.edges.drop("hit"))
    if noops is not None:
        tasks.append(noops.select("id"))
        graph = verify_tasks(graph, noops, at)
    if tasks:
        graph = stamp_hubs(graph, _union(tasks), at)

    def sweep() -> tuple[Graph, DataFrame | None]:
        if closed_edges is None and beside is None:
            return graph, None
        swept = cut(orphans(bare, beside))
        return close_nodes(graph, swept, at), swept

    listed = _union([df.select(F.lit(name).alias("op")) for name, df in counted.items() if df is not None])
    if listed is None:
        listed = graph.nodes.select(F.lit("noop").alias("op")).limit(0)
    return Applied(operation_counts(listed, list(OPERATIONS)), temp_ids, spawned, sessions, sweep)


def embedding_requests(graph: Graph, creates: DataFrame | None = None, patches: DataFrame | None = None) -> DataFrame:
    """(key, text): what an embedder is to turn into vectors, for created nodes, updated nodes, and the history of each
    field that changes."""
    found = []
    if creates is not None:
        found.append(creates.select(F.concat(F.lit("create:"), "temp_id").alias("key"), embedding_text(F.col("title"), value_of(creates, "body", "string")).alias("text")))
    if patches is not None:
        named = ("title", "body", "occurred_at")
        rows = tri_state(patches, {c: FIELDS[c] for c in named}, "id").select("id", *[f"has_{c}" for c in named], *[F.col(c).alias(f"new_{c}") for c in named]).join(graph.nodes.select("id", *named), "id")
        new = {c: F.when(F.col(f"has_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in named}
        differs = {c: ~F.col(c).eqNullSafe(v) for c, v in new.items()}
        found.append(rows.where(differs["title"] | differs["body"]).select(F.concat(F.lit("update:"), "id").alias("key"), embedding_text(new["title"], new["body"]).alias("text")))
        for c in named:
            text = iso if c == "occurred_at" else (lambda x: x)
            found.append(rows.where(differs[c]).select(F.concat(F.lit(c + ":"), "id").alias("key"), history_text(text(F.col(c)), text(new[c])).alias("text")))
    return _union(found)
