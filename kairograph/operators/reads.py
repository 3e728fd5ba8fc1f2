"""Reads of nodes, edges, details, hubs, tasks and subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import CLOSEST_HUB_LIMIT, HISTORY_PAGE, KINDS, InvalidRequest, NotFound
from kairograph.functions import predicates as P
from kairograph.functions.text import normalize_title
from kairograph.functions.time import local_date
from kairograph.sources.graph import Graph, cut


def ids_frame(graph: Graph, ids) -> DataFrame:
    """A request's ids as a table; a request is small by nature."""
    return graph.nodes.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")


def node(graph: Graph, node_id: str) -> DataFrame:
    found = graph.nodes.where(F.col("id") == node_id).limit(1)
    if found.isEmpty():
        raise NotFound(node_id)
    return found


def edge(graph: Graph, edge_id: str) -> DataFrame:
    found = graph.edges.where((F.col("id") == edge_id) & P.current()).limit(1)
    if found.isEmpty():
        raise NotFound(edge_id)
    return found


def live_nodes(graph: Graph, now: Column) -> DataFrame:
    return graph.nodes.where(P.live(now)).drop("embedding")


def expired_nodes(graph: Graph, now: Column) -> DataFrame:
    return graph.nodes.where(P.expired(now)).drop("embedding")


def creation_order() -> list[Column]:
    return [F.asc("created_at"), F.asc("id")]


def nodes_by_ids(graph: Graph, ids, now: Column) -> DataFrame:
    return graph.nodes.where(P.live(now) & F.col("id").isin(*ids))


def live_edges(graph: Graph, now: Column) -> DataFrame:
    """Current edges with both ends live."""
    ids = live_nodes(graph, now).select("id")
    return graph.edges.where(P.current()).join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*graph.edges.columns)


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch the ids at either end: two equality joins instead of one on a disjunction."""
    by_src = edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    by_dst = edges.join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").join(ids.select(F.col("id").alias("src_id")), "src_id", "left_anti")
    return by_src.select(*edges.columns).union(by_dst.select(*edges.columns))


def edges_among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    out = edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return out.select(*edges.columns)


def persons(graph: Graph) -> DataFrame:
    return graph.nodes.where("kind = 'person'").join(graph.persons, F.col("id") == F.col("node_id")).drop("node_id")


def node_history(graph: Graph, node_id: str, limit: int = HISTORY_PAGE) -> DataFrame:
    return graph.history.where(F.col("node_id") == node_id).orderBy(F.desc("changed_at"), "id").limit(limit)


def counts(graph: Graph, now: Column) -> DataFrame:
    """Live nodes of each kind, zero for kinds without any, and the total."""
    found = live_nodes(graph, now).groupBy("kind").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias("n")) for k in KINDS])
    total = F.array(F.struct(F.lit("total").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    return found.agg(F.concat(each, total).alias("rows")).select(F.inline("rows"))  # one scan: a row a kind, then one row


def hubs(graph: Graph, now: Column) -> DataFrame:
    """Live nodes that hold a task or plan."""
    sources = graph.edges.where(P.current() & F.col("type").isin("HAS_ITEM", "HAS_PLAN")).select(F.col("src_id").alias("id")).distinct()
    return live_nodes(graph, now).join(sources, "id", "left_semi").select("id", "title", "agent_id")


def hub_matches(graph: Graph, label: str, now: Column) -> DataFrame:
    """Hubs that a label names: by id or whole title, else by normalised title or its first words."""
    key = normalize_title(F.lit(label))
    title = normalize_title(F.col("title"))
    exact = (F.col("id") == label) | (F.lower("title") == label.lower())
    loose = (title == key) | title.startswith(F.concat(key, F.lit(" ")))
    found = hubs(graph, now).select("id", "title", exact.alias("exact"), loose.alias("loose")).where("exact or loose")
    return found.join(F.broadcast(found.agg(F.max("exact").alias("any_exact"))), F.lit(True)).where("exact or not any_exact").select("id", "title")


def closest_hubs(graph: Graph, label: str, now: Column, limit: int = CLOSEST_HUB_LIMIT) -> DataFrame:
    """Hub titles that share most words with the label; repeated title words count each time."""
    words = F.split(normalize_title(F.lit(label)), " ")
    shared = F.size(F.filter(F.split(normalize_title(F.col("title")), " "), lambda w: F.array_contains(words, w)))
    return hubs(graph, now).select("title", shared.alias("shared")).where("shared > 0").distinct().orderBy(F.desc("shared"), "title").limit(limit)


def resolve_hubs(graph: Graph, label: str, now: Column) -> DataFrame:
    """(id) of the hubs that a label names; raises with the closest titles if there is none."""
    found = hub_matches(graph, label, now).select("id")
    if found.isEmpty():
        raise InvalidRequest("no hub " + label + "; closest: " + ", ".join(r.title for r in closest_hubs(graph, label, now).collect()))
    return found


def members(graph: Graph, hub_ids: list[str] | DataFrame) -> DataFrame:
    """(id) of the tasks and sessions of hubs, given as a few ids or as a table of any size."""
    held = graph.edges.where(P.current() & F.col("type").isin("HAS_ITEM", "HAS_PLAN"))
    if isinstance(hub_ids, DataFrame):
        held = held.join(hub_ids.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    else:
        held = held.where(F.col("src_id").isin(*hub_ids))
    return held.select(F.col("dst_id").alias("id")).distinct()


def hub_of(graph: Graph, now: Column, types=("HAS_ITEM", "HAS_PLAN"), items: DataFrame | None = None) -> DataFrame:
    """(item_id, hub_id, hub_title, hub_agent, hub_verified_at): each item's hub by its earliest current edge, live hubs
    only.  items: only these (id) are asked for, so that others are dropped before hubs are looked up."""
    held = graph.edges.where(P.current() & F.col("type").isin(*types)).select("src_id", "dst_id", "created_at", F.col("id").alias("edge_id"))
    if items is not None:
        held = held.join(items.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    hub = live_nodes(graph, now).select(F.col("id").alias("src_id"), F.col("title").alias("hub_title"), F.col("agent_id").alias("hub_agent"), F.col("verified_at").alias("hub_verified_at"))
    first = held.join(hub, "src_id").groupBy("dst_id").agg(F.min(F.struct("created_at", "edge_id", "src_id", "hub_title", "hub_agent", "hub_verified_at")).alias("h"))
    return first.select(F.col("dst_id").alias("item_id"), F.col("h.src_id").alias("hub_id"), *[F.col(f"h.{c}").alias(c) for c in ("hub_title", "hub_agent", "hub_verified_at")])


def touched_hubs(graph: Graph, ids, writer: str) -> DataFrame:
    """Hubs of tasks where the hub or the task is among ids, or the hub is the writer's."""
    held = graph.edges.where(P.current() & (F.col("type") == "HAS_ITEM")).select("src_id", "dst_id")
    own = held.join(graph.nodes.where(F.col("agent_id") == writer).select(F.col("id").alias("src_id")), "src_id", "left_semi")
    near = held.where(F.col("src_id").isin(*ids) | F.col("dst_id").isin(*ids))
    return own.select("src_id").union(near.select("src_id")).distinct().select(F.col("src_id").alias("id"))


def live_tasks(graph: Graph, now: Column, *where: Column) -> DataFrame:
    found = live_nodes(graph, now).where("kind = 'task'").join(graph.tasks, F.col("id") == F.col("node_id")).drop("node_id")
    for condition in where:
        found = found.where(condition)
    return found


def filter_nodes(graph: Graph, now: Column, zone: str, *, kind=None, name=None, occurred_from=None, occurred_to=None, relevant_on=None, hub_ids=None, closes_from=None, closes_to=None) -> DataFrame:
    """Live nodes that meet all filters, with plan and task columns; at least one filter is needed."""
    task_only = relevant_on is not None or closes_from is not None or closes_to is not None
    if not any(x is not None for x in (kind, name, occurred_from, occurred_to, hub_ids)) and not task_only:
        raise InvalidRequest("a filter is needed")
    if task_only and kind not in (None, "task"):
        raise InvalidRequest("task filters are for tasks")
    if (task_only or kind == "task") and (occurred_from is not None or occurred_to is not None):
        raise InvalidRequest("tasks have no occurred_at")
    kind = "task" if task_only else kind
    found = live_nodes(graph, now)
    if kind:
        found = found.where(F.col("kind") == kind)
    if hub_ids is not None:
        found = found.join(members(graph, hub_ids), "id", "left_semi")
    if name is not None:
        aliased = kind in (None, "person")
        if aliased:
            found = found.join(graph.persons.select(F.col("node_id").alias("id"), "aliases"), "id", "left")
        found = found.where(P.named(name, aliased)).drop("aliases")
    found = found.join(graph.plans.withColumnRenamed("node_id", "id"), "id", "left").join(graph.tasks.withColumnRenamed("node_id", "id"), "id", "left")
    stamp = lambda x: None if x is None else F.lit(x).cast("timestamp")
    if occurred_from is not None or occurred_to is not None:
        found = found.where(P.occurs_within(stamp(occurred_from), stamp(occurred_to)))
    if relevant_on is not None:
        found = found.where(P.relevant_recently(F.lit(relevant_on).cast("date"), zone))
    closes = local_date(F.col("closes_at"), zone)
    if closes_from is not None:
        found = found.where(closes >= F.lit(closes_from).cast("date"))
    if closes_to is not None:
        found = found.where(closes <= F.lit(closes_to).cast("date"))
    return found


def default_order() -> list[Column]:
    return [F.asc_nulls_last("occurred_at"), F.asc_nulls_last("closes_at"), F.asc("created_at"), F.asc("id")]


def relevant_order(date: str, zone: str) -> list[Column]:
    upcoming = local_date(F.col("closes_at"), zone) >= F.lit(date).cast("date")
    seconds = F.unix_micros("closes_at")
    return [F.when(F.col("closes_at").isNull(), 2).when(upcoming, 0).otherwise(1).asc(), F.when(upcoming, seconds).otherwise(-seconds).asc_nulls_last(), F.asc("created_at"), F.asc("id")]


def page(found: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    if not 0 < limit <= most:
        raise InvalidRequest(f"limit must be 1 to {most}")
    return found.orderBy(*order).offset(offset).limit(limit)


def sessions(graph: Graph) -> DataFrame:
    return graph.edges.where(P.current() & (F.col("type") == "HAS_PLAN")).select(F.col("dst_id").alias("id")).distinct()


def whole_graph(graph: Graph, now: Column) -> tuple[DataFrame, DataFrame]:
    """Live nodes and edges without sessions."""
    hidden = sessions(graph)
    nodes = live_nodes(graph, now).join(hidden, "id", "left_anti")
    edges = live_edges(graph, now)
    for end in ("src_id", "dst_id"):
        edges = edges.join(hidden.select(F.col("id").alias(end)), end, "left_anti")
    return nodes, edges.select(*graph.edges.columns)


def seeded_graph(graph: Graph, seeds, now: Column) -> tuple[DataFrame, DataFrame]:
    """Seeds and their live neighbours without sessions, and the edges among them."""
    ids = ids_frame(graph, seeds)
    here = nodes_by_ids(graph, seeds, now)
    if here.count() < len(set(seeds)):
        raise NotFound("seed")
    current = graph.edges.where(P.current())
    near = incident_edges(current, ids)
    reached = cut(ids.union(near.select("src_id")).union(near.select("dst_id")).distinct())
    nodes = live_nodes(graph, now).join(reached, "id", "left_semi").join(sessions(graph), "id", "left_anti")
    return nodes, edges_among(current, cut(nodes.select("id")))


def node_detail(graph: Graph, node_id: str) -> DataFrame:
    """The node, its details and its current edges both ways; expired nodes are served."""
    own = graph.nodes.where(F.col("id") == node_id).drop("embedding")
    touching = graph.edges.where(P.current())
    collected = lambda end, name: touching.where(F.col(end) == node_id).agg(F.array_sort(F.collect_list("id")).alias(name))
    found = own
    for table in (graph.persons, graph.plans, graph.tasks, graph.places):
        found = found.join(table.where(F.col("node_id") == node_id).withColumnRenamed("node_id", "id"), "id", "left")
    return found.join(collected("src_id", "outgoing"), F.lit(True)).join(collected("dst_id", "incoming"), F.lit(True))
