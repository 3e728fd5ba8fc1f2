"""Vector search, anchors, the graph walk, scoring and recall."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.config import HUB_DEGREE, TITLE_ANCHOR_LIMIT, EngineConfig, InvalidRequest, NotFound
from kairograph.functions import predicates as P
from kairograph.functions.text import person_names, query_words
from kairograph.functions.time import local_date
from kairograph.functions.vectors import cosine, frequency, proximity, recency
from kairograph.operators import planner, reads
from kairograph.operators.journal import AccessLog
from kairograph.sources.graph import Graph, cut, cuts


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(rows: DataFrame, query: Column, limit: int, floor: float | None = None) -> DataFrame:
    """The rows of most cosine similarity to the query, ties by id; exact."""
    found = rows.where(F.col("embedding").isNotNull()).withColumn("similarity", F.round(cosine(F.col("embedding"), query), 6)).drop("embedding")
    if floor is not None:
        found = found.where(F.col("similarity") >= floor)
    return found.orderBy(F.desc("similarity"), "id").limit(limit)


def ann_search(graph: Graph, query: Column, limit: int, now: Column) -> DataFrame:
    return nearest(graph.nodes.where(P.live(now)).select("id", "kind", "title", "embedding"), query, limit)


def history_search(graph: Graph, query: Column, limit: int, config: EngineConfig) -> DataFrame:
    """Top history rows by similarity; rows of expired or removed nodes count too."""
    if not 0 < limit <= config.search_max:
        raise InvalidRequest(f"limit must be 1 to {config.search_max}")
    return nearest(graph.history.select("id", "node_id", "field", "embedding"), query, limit)


def title_anchors(graph: Graph, query: str, now: Column, limit: int = TITLE_ANCHOR_LIMIT) -> DataFrame:
    """Live plans and tasks whose title has a naming word of the query, nearest in time first.

    The query's own words are the only ones that matter, so persons' names are cut down to them before they meet."""
    spoken = F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"(\p{L}{4,})"), F.lit(1))
    taken = F.explode(F.flatten(F.transform(person_names(F.col("title"), F.col("aliases")), lambda n: F.split(F.lower(n), r"\s+"))))
    known = reads.persons(graph).select(taken.alias("w")).where(F.array_contains(spoken, F.col("w"))).agg(F.collect_set("w").alias("w"))
    words = known.select(query_words(F.lit(query), F.col("w")).alias("words")).first().words  # of one request
    named = reduce(or_, [F.contains(F.lower("title"), F.lit(w)) for w in words], F.lit(False))
    found = reads.live_nodes(graph, now).where(F.col("kind").isin("plan", "task") & named).join(graph.tasks.select(F.col("node_id").alias("id"), "closes_at"), "id", "left")
    away = F.abs(F.unix_micros(F.coalesce("occurred_at", "closes_at")) - F.unix_micros(now))
    return found.withColumn("away", away).orderBy(F.asc_nulls_last("away"), "id").limit(limit).select("id", "kind", "title", "away")


def anchors(graph: Graph, query: str, vec: Column, now: Column, config: EngineConfig) -> DataFrame:
    """(id, rank): title anchors first, then the nearest above the floor; each once, anchor_limit at most."""
    by_title = title_anchors(graph, query, now).select("id", F.lit(0).alias("source"), F.coalesce("away", F.lit(1 << 62)).cast("double").alias("key"))
    by_vector = nearest(graph.nodes.where(P.live(now)).select("id", "embedding"), vec, config.anchor_limit, config.anchor_floor).select("id", F.lit(1).alias("source"), (-F.col("similarity")).alias("key"))
    first = by_title.union(by_vector).groupBy("id").agg(F.min(F.struct("source", "key", "id")).alias("rank"))
    return first.orderBy("rank").limit(config.anchor_limit).select("id", F.col("rank.source").alias("source"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): current edges at each node but session edges; a loop counts twice."""
    ends = edges.where(P.current() & (F.col("type") != "HAS_PLAN")).select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def expand(walk: DataFrame, frontier: DataFrame, edges: DataFrame, hop: int, prune_hubs: bool) -> DataFrame:
    """(id, hop, confidence): targets first reached in this hop, with the most confident way there."""
    if prune_hubs:  # counted where the edges lie, so that a hub's edges are never shuffled or stored
        near = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).join(frontier.select("id"), "id", "left_semi")
        frontier = frontier.join(near.groupBy("id").agg(F.count("*").alias("degree")).where(F.col("degree") > HUB_DEGREE).select("id"), "id", "left_anti")
    inc = reads.incident_edges(edges, frontier.select("id")).select("id", "src_id", "dst_id", "confidence")
    both = inc.select(F.col("src_id").alias("from"), F.col("dst_id").alias("to"), F.col("confidence").alias("c")).union(inc.select("dst_id", "src_id", "confidence"))
    start = frontier.select(F.col("id").alias("from"), F.col("confidence").alias("parent"))
    reached = both.join(start, "from").groupBy(F.col("to").alias("id")).agg(F.max(F.col("parent") * F.col("c")).alias("confidence"))
    return reached.join(walk.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "confidence")


def walk(graph: Graph, anchor_ids: DataFrame, hops: int, now: Column, prune_hubs: bool = True) -> DataFrame:
    """(id, hop, confidence) within hops of the anchors; expired nodes are reached but not walked through."""
    live = reads.live_nodes(graph, now).select("id")
    edges = graph.edges.where(P.current() & (F.col("type") != "HAS_PLAN"))
    reached = anchor_ids.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"))
    frontier = reached
    for hop in range(1, hops + 1):
        new = cut(expand(reached, frontier, edges, hop, prune_hubs))
        reached, frontier = reached.union(new), new.join(live, "id", "left_semi")
    return reached


def scored(rows: DataFrame, now: Column, config: EngineConfig, vec: Column | None = None) -> DataFrame:
    """Adds the components and total of each row of the walk; rows have hop, confidence and node columns."""
    most = rows.agg(F.max("access_count").alias("most"))
    semantic = F.lit(0.0) if vec is None else F.when(F.col("embedding").isNull(), 0.0).otherwise(cosine(F.col("embedding"), vec))
    parts = {
        "semantic": semantic,
        "proximity": proximity(F.col("hop")),
        "recency": recency(F.col("occurred_at"), F.col("created_at"), now, config.recency_half_life_days),
        "frequency": frequency(F.col("access_count"), F.col("most")),
        "edge_confidence": F.col("confidence"),
    }
    found = rows.join(F.broadcast(most), F.lit(True)).withColumns(parts).drop("most")  # one row
    prior = F.create_map(*[F.lit(x) for pair in config.kind_priors.items() for x in pair])[F.col("kind")]
    total = sum((config.weights[k] * F.col(k) for k in parts), F.lit(0.0)) * prior
    return found.withColumn("total", total)


@dataclass
class Recall:
    """Ranked nodes with details and readings, the current edges among them, the anchors (id), and the freshness of the
    courses that the nodes' tasks belong to.  coverage and sufficient are null without a query."""

    nodes: DataFrame
    edges: DataFrame
    hops_taken: int
    coverage: float | None
    sufficient: bool | None
    anchors: DataFrame
    courses: DataFrame


def described(graph: Graph, nodes: DataFrame, now: Column, zone: str, day: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes with the details of their kinds, local readings and the owner of a task's hub; and those hubs."""
    found = nodes
    ids = nodes.select(F.col("id").alias("node_id"))
    for table in (graph.persons, graph.plans, graph.tasks, graph.places):
        found = found.join(table.join(ids, "node_id", "left_semi").withColumnRenamed("node_id", "id"), "id", "left")
    hubs = cut(reads.hub_of(graph, now, ("HAS_ITEM",), nodes.where("kind = 'task'")))
    found = found.join(hubs.select(F.col("item_id").alias("id"), F.col("hub_agent").alias("owner")), "id", "left")
    return planner.plan_readings(planner.readings(found, zone, day), zone), hubs


def tokens(rows: DataFrame) -> Column:
    return F.ceil(F.sum(F.length("title") + F.length(F.coalesce("body", F.lit("")))) / 4)


def recall(graph: Graph, now: Column, zone: str, config: EngineConfig, *, query: str | None = None, vec: Column | None = None, start_ids=None, filters: dict | None = None, hops: int | None = None, limit: int | None = None, log: AccessLog | None = None) -> Recall:
    """Anchors, a walk that stops when it no longer pays, ranking, and the edges among what is returned.

    What the walk has stored on the way is deleted when it ends; the tables that the result reads stay for cuts() around
    the call, or for good.  log: where the nodes returned are noted as accessed."""
    with cuts(graph.nodes.sparkSession) as keep:
        found = _recall(graph, now, zone, config, query, vec, start_ids, filters, hops, limit, log)
        for df in (found.nodes, found.edges, found.anchors, found.courses):
            keep(df)
    return found


def _recall(graph: Graph, now: Column, zone: str, config: EngineConfig, query, vec, start_ids, filters, hops, limit, log) -> Recall:
    if query is None and start_ids is None and not filters:
        raise InvalidRequest("one of query, from or a filter is needed")
    if start_ids is not None and filters:
        raise InvalidRequest("from and filters exclude each other")
    if hops is not None and hops > config.hop_cap or limit is not None and limit > config.page_max:
        raise InvalidRequest("hops or limit too large")
    limit = limit or (config.page_max if filters else config.recall_default)
    if start_ids is not None:
        if reads.nodes_by_ids(graph, start_ids, now).count() < len(set(start_ids)):
            raise NotFound("from")
        first = reads.ids_frame(graph, start_ids).withColumn("position", F.lit(0))
    elif filters:
        order = reads.relevant_order(filters["relevant_on"], zone) if filters.get("relevant_on") else reads.default_order()
        most = config.page_max if query else limit
        rows = reads.page(reads.filter_nodes(graph, now, zone, **filters), order, most)
        first = rows.select("id", F.monotonically_increasing_id().alias("position"))
    else:
        first = anchors(graph, query, vec, now, config).select("id", F.col("source").alias("position"))
    first = cut(first)
    gated = hops is None and query is not None and not filters
    hop_limit = hops if hops is not None else config.hop_cap if gated else 0
    live = graph.nodes.where(P.live(now))
    edges = graph.edges.where(P.current() & (F.col("type") != "HAS_PLAN"))
    reached = first.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"))
    frontier, taken = reached, 0
    while taken < hop_limit and not frontier.isEmpty():
        taken += 1
        new = cut(expand(reached, frontier, edges, taken, start_ids is None))
        reached, frontier = reached.union(new), new.join(live.select("id"), "id", "left_semi")
        if gated:
            rows = scored(reached.join(live, "id"), now, config, vec).where(F.col("total") >= config.relevance_threshold)
            gain, spent = rows.agg(F.sum((F.col("hop") == taken).cast("int")), tokens(rows)).first()
            if (gain or 0) < config.marginal_yield_minimum or (spent or 0) >= config.token_budget:
                break
    rows = scored(reached.join(live, "id"), now, config, vec).join(first, "id", "left")
    if query is not None:
        order = [F.desc("total"), F.asc("hop"), F.asc("id")]
    else:
        order = [F.asc("hop"), *([F.asc_nulls_last("position")] if filters else []), F.asc_nulls_last("occurred_at"), F.asc("created_at"), F.asc("id")]
    top = cut(rows.orderBy(*order).limit(limit).drop("embedding"))
    coverage = None
    if query is not None:
        coverage = top.orderBy(F.desc("total"), "id").limit(config.coverage_top_n).agg(F.avg("total")).first()[0] or 0.0
    day = local_date(now, zone) if not (filters or {}).get("relevant_on") else F.lit(filters["relevant_on"]).cast("date")
    ranked = cut(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("position"))  # of at most page_max rows
    if log is not None:
        log.record(ranked, now)
    nodes, hubs = described(graph, ranked, now, zone, day)
    among = reads.edges_among(graph.edges.where(P.current()), ranked.select("id"))
    sufficient = None if coverage is None else coverage >= config.coverage_floor
    return Recall(nodes.orderBy("rank"), among, taken, coverage, sufficient, first.select("id"), planner.course_freshness(hubs, now, zone))


def fold_access(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Nodes with an access log (id, at) folded in: counts up, last access moved."""
    seen = log.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.max("at").alias("at"))
    joined = nodes.join(seen, "id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "at")).select(*nodes.columns)
