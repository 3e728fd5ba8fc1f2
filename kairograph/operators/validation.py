"""Checks of a batch of operations before it is applied: every broken rule as (op, key, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import EDGE_TYPES, InvalidRequest
from kairograph.functions import predicates as P
from kairograph.functions.time import local_date
from kairograph.operators.mutations import FIELDS, tri_state, value_of
from kairograph.sources.graph import Graph

VIOLATIONS = "op string, key string, rule string"


def broken(ops: DataFrame, op: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(op, key, rule) of each rule whose condition holds."""
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()])
    return ops.select(F.lit(op).alias("op"), key.cast("string").alias("key"), F.explode(each).alias("rule")).where("rule is not null")


def window_rules(opens: Column, closes: Column, zone: str, of: Column) -> dict[str, Column]:
    """A task that closes opens, on or before the local day it closes."""
    return {"close without open": of & closes.isNotNull() & opens.isNull(), "close before open": of & (local_date(closes, zone) < opens)}


def creates(ops: DataFrame, zone: str, key: str = "temp_id") -> DataFrame:
    """Rules of created nodes."""
    kind, at, end = F.col("kind"), F.col("occurred_at"), value_of(ops, "end_at", "timestamp")
    opens, closes = value_of(ops, "opens_on", "date"), value_of(ops, "closes_at", "timestamp")
    rules = {
        "plan without start": (kind == "plan") & at.isNull(),
        "task with occurred_at": (kind == "task") & at.isNotNull(),
        **window_rules(opens, closes, zone, kind == "task"),
        "ttl on person or place": kind.isin("person", "place") & value_of(ops, "ttl_days", "int").isNotNull(),
        "end before start": (kind == "plan") & (end <= at),
        "memory with detail": (kind == "memory") & F.coalesce(value_of(ops, "has_detail", "boolean"), F.lit(False)),
    }
    twice = ops.groupBy("temp_id").agg(F.count("*").alias("n")).where("n > 1").select("temp_id")
    return broken(ops, "create_node", F.col(key), rules).union(broken(ops.join(twice, "temp_id", "left_semi"), "create_node", F.col(key), {"duplicate temp_id": F.lit(True)}))


def known(ops: DataFrame, column: str, graph: Graph, made: DataFrame | None, name: str) -> DataFrame:
    """The operations with the kind of the node in the column as name: `new` for a temp id, null where there is none."""
    stored = graph.nodes.select(F.col("id").alias(column), F.col("kind").alias("__stored"))
    out = ops.join(stored, column, "left")
    if made is None:
        return out.withColumnRenamed("__stored", name)
    new = made.select(F.col("temp_id").alias(column), F.lit("new").alias("__made")).distinct()
    return out.join(new, column, "left").withColumn(name, F.coalesce("__made", "__stored")).drop("__made", "__stored")


def edges(ops: DataFrame, graph: Graph, made: DataFrame | None) -> DataFrame:
    """Rules of created edges."""
    found = known(known(ops, "src_id", graph, made, "__src"), "dst_id", graph, made, "__dst")
    rules = {
        "src is no node": F.col("__src").isNull(),
        "dst is no node": F.col("__dst").isNull(),
        "edge to itself": F.col("src_id") == F.col("dst_id"),
        "edge type not allowed": ~F.col("type").isin(*EDGE_TYPES),
        "confidence outside 0 to 1": ~value_of(ops, "confidence", "double").between(0, 1),
    }
    return broken(found, "create_edge", F.concat_ws("-", "type", "src_id", "dst_id"), rules)


def patches(ops: DataFrame, graph: Graph, zone: str) -> DataFrame:
    """Rules of updates, with what is stored where a patch gives nothing."""
    rows = tri_state(ops, FIELDS, "id", F.coalesce(value_of(ops, "has_detail", "boolean"), F.lit(False)).alias("has_detail"))
    stored = graph.tasks.select(F.col("node_id").alias("id"), F.col("opens_on").alias("was_opens"), F.col("closes_at").alias("was_closes"))
    found = known(rows, "id", graph, None, "__kind").join(stored, "id", "left")
    kind = F.col("__kind")
    now = {c: F.when(F.col(f"has_{c}"), F.col(c)).otherwise(F.col(w)) for c, w in (("opens_on", "was_opens"), ("closes_at", "was_closes"))}
    touched = (kind == "task") & (F.col("has_opens_on") | F.col("has_closes_at"))
    rules = {
        "no node": kind.isNull(),
        "memory with detail": (kind == "memory") & F.col("has_detail"),
        **window_rules(now["opens_on"], now["closes_at"], zone, touched),
        "plan without start": (kind == "plan") & F.col("has_occurred_at") & F.col("occurred_at").isNull(),
        "ttl on person or place": kind.isin("person", "place") & F.col("has_ttl_days") & F.col("ttl_days").isNotNull(),
    }
    return broken(found, "update_node", F.col("id"), rules)


def spawns(ops: DataFrame, graph: Graph, made: DataFrame | None) -> DataFrame:
    """Rules of spawned sessions."""
    rows = ops.withColumns({c: value_of(ops, c, "string") for c in ("end_time", "place_id", "room")})
    found = known(known(rows, "hub_id", graph, made, "__hub"), "place_id", graph, made, "__place")
    rules = {
        "hub is no node": F.col("__hub").isNull(),
        "place is no node": F.col("place_id").isNotNull() & F.col("__place").isNull(),
        "place is of another kind": F.col("place_id").isNotNull() & ~F.col("__place").isin("new", "place"),
        "dates repeat": F.size(F.array_distinct("dates")) < F.size("dates"),
        "end before start": F.col("end_time") <= F.col("start_time"),
        "room without place": F.col("room").isNotNull() & F.col("place_id").isNull(),
    }
    out = broken(found, "spawn_plans", F.col("temp_id"), rules)
    names = rows.select("temp_id") if made is None else rows.select("temp_id").union(made.select("temp_id"))
    twice = names.groupBy("temp_id").agg(F.count("*").alias("n")).where("n > 1").select("temp_id")
    return out.union(broken(rows.join(twice, "temp_id", "left_semi"), "spawn_plans", F.col("temp_id"), {"duplicate temp_id": F.lit(True)}))


def session_edits(ops: DataFrame, graph: Graph) -> DataFrame:
    """Rules of bulk edits; that one matches no session shows when it is applied."""
    end, start, close = value_of(ops, "end_time", "string"), value_of(ops, "start_time", "string"), F.coalesce(value_of(ops, "close", "boolean"), F.lit(False))
    given = [F.coalesce(F.col(f"has_{c}"), F.lit(False)) if f"has_{c}" in ops.columns else value_of(ops, c, "string").isNotNull() for c in ("body", "rsvp", "attended", "start_time", "end_time", "room")]
    some = reduce(lambda a, b: a | b, given)
    rules = {
        "hub is no node": F.col("__hub").isNull(),
        "to before from": value_of(ops, "to_date", "date") < value_of(ops, "from_date", "date"),
        "end before start": end <= start,
        "nothing to change": ~some & ~close,
        "close stands alone": some & close,
    }
    return broken(known(ops, "hub_id", graph, None, "__hub"), "update_plans", F.col("seq"), rules)


def violations(
    graph: Graph, zone: str, *, creates_: DataFrame | None = None, edges_: DataFrame | None = None, patches_: DataFrame | None = None, spawns_: DataFrame | None = None,
    session_edits_: DataFrame | None = None, closed_nodes: DataFrame | None = None, closed_edges: DataFrame | None = None, noops: DataFrame | None = None,
) -> DataFrame:
    """All broken rules of a batch as (op, key, rule)."""
    found = []
    if creates_ is not None:
        found.append(creates(creates_, zone))
    if edges_ is not None:
        found.append(edges(edges_, graph, creates_))
    if patches_ is not None:
        found.append(patches(patches_, graph, zone))
    if spawns_ is not None:
        found.append(spawns(spawns_, graph, creates_))
    if session_edits_ is not None:
        found.append(session_edits(session_edits_, graph))
    if closed_nodes is not None:
        found.append(broken(known(closed_nodes, "id", graph, None, "__kind"), "close_node", F.col("id"), {"no node": F.col("__kind").isNull()}))
    if noops is not None:
        kind = F.col("__kind")
        found.append(broken(known(noops, "id", graph, None, "__kind"), "noop", F.col("id"), {"no node": kind.isNull(), "not a task": kind != "task"}))
    if closed_edges is not None:
        current = graph.edges.where(P.current()).select("id")
        found.append(broken(closed_edges.join(current, "id", "left_anti"), "close_edge", F.col("id"), {"no current edge": F.lit(True)}))
    return reduce(DataFrame.union, found) if found else graph.nodes.sparkSession.createDataFrame([], VIOLATIONS)


def require_valid(found: DataFrame) -> None:
    """Raises an invalid request that names the first broken rules."""
    first = found.orderBy("op", "key", "rule").limit(5).collect()
    if first:
        raise InvalidRequest("; ".join(f"{r.op} {r.key}: {r.rule}" for r in first))
