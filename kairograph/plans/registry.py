"""All registered queries of the graph engine, and their oracle SQL on the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.config import EDGE_TYPES, EngineConfig
from kairograph.functions import predicates as P
from kairograph.functions import text as X
from kairograph.functions import time as TM
from kairograph.functions import vectors as V
from kairograph.operators import candidates as C
from kairograph.operators import lint, mutations, planner, reads, recall, validation
from kairograph.plans.oracle import NOW, ZONE, local, oracle
from kairograph.sources.graph import Graph, derived, star_table
from kairograph.streaming.changes import change_events

CONFIG = EngineConfig(anchor_floor=0.25, dimension=64)
DAY = "1998-06-20"
SET = ("h1", "h2", "p3", "o4", "o8", "s5", "d9")
HUB = "Brand#17 red widget"
WHOLE = "as of today nobody of the household review team was at part 7"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_SQL_TEXT: dict[str, str] = {}


def now():
    return F.lit(NOW).cast("timestamp")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return derived(spark, sf_dir, NOW, ZONE)


class Late:
    """A graph that is derived when one of its tables is asked for first; a query that asks for none derives none."""

    def __init__(self, make: Callable[[], Graph]):
        self._make, self._made = make, None

    def __getattr__(self, name: str):
        if self._made is None:
            self._made = self._make()
        return getattr(self._made, name)


def seconds(column: str):
    return F.unix_seconds(column).alias(column)


def joined(column: str):
    return F.array_join(column, ",").alias(column)


def query(sql: str | None = None):
    """Registers f(graph, spark, sf_dir) under its name, with the oracle's SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Late(lambda: graph(spark, sf_dir)), spark, sf_dir)
        if sql:
            _SQL_TEXT[f.__name__], _SQL[f.__name__] = sql, oracle(sql)
        return f

    return add


def vec(spark: SparkSession, sf_dir: str, key: int = 3):
    """The query vector: one row of the embeddings table."""
    return recall.vector(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == key).first().embedding)


# scans


@query("SELECT id, kind, title, access_count FROM live")
def live_nodes(g, s, d):
    return reads.live_nodes(g, now()).orderBy(*reads.creation_order()).select("id", "kind", "title", "access_count")


@query("SELECT e.id, type, confidence FROM cur e WHERE src_id IN (SELECT id FROM live) AND dst_id IN (SELECT id FROM live)")
def live_edges(g, s, d):
    return reads.live_edges(g, now()).select("id", "type", "confidence")


@query("SELECT id, kind, title FROM nodes WHERE id = 'd20'")
def node_point(g, s, d):
    return reads.node(g, "d20").select("id", "kind", "title")


@query("SELECT id, src_id, dst_id FROM cur WHERE id = 'LIVES_AT-p3-n' || (SELECT c_nationkey FROM customer WHERE c_custkey = 3)")
def edge_point(g, s, d):
    home = star_table(s, d, "customer").where("c_custkey = 3").first().c_nationkey
    return reads.edge(g, f"LIVES_AT-p3-n{home}").select("id", "src_id", "dst_id")


_SET_SQL = "(" + ", ".join(f"'{i}'" for i in SET) + ")"


@query(f"SELECT id, title FROM live WHERE id IN {_SET_SQL}")
def nodes_by_ids(g, s, d):
    return reads.nodes_by_ids(g, SET, now()).select("id", "title")


@query(f"SELECT id, type FROM cur WHERE src_id IN {_SET_SQL} OR dst_id IN {_SET_SQL}")
def incident_edges(g, s, d):
    return reads.incident_edges(g.edges.where(P.current()), reads.ids_frame(g, SET)).select("id", "type")


@query("ids AS (SELECT id FROM hubs UNION SELECT node_id FROM plans) SELECT cur.id, type FROM cur JOIN ids a ON a.id = src_id JOIN ids b ON b.id = dst_id")
def edges_among(g, s, d):
    ids = reads.hubs(g, now()).select("id").union(g.plans.select("node_id"))
    return reads.edges_among(g.edges.where(P.current()), ids).select("id", "type")


@query("SELECT id, title, array_to_string(aliases, ',') AS aliases FROM nodes JOIN persons ON node_id = id")
def persons(g, s, d):
    return reads.persons(g).select("id", "title", joined("aliases"))


@query("SELECT id, field, CAST(floor(epoch(changed_at)) AS BIGINT) AS changed_at FROM history WHERE node_id = 'p8' ORDER BY history.changed_at DESC, id LIMIT 50")
def node_history(g, s, d):
    return reads.node_history(g, "p8").select("id", "field", seconds("changed_at"))



# predicates over tasks and nodes


def _tasks(where: str) -> str:
    return f"SELECT id, title FROM live_tasks, k WHERE {where}"


@query(_tasks(f"NOT done AND opens_on <= DATE '{DAY}'"))
def tasks_relevant_on(g, s, d):
    return reads.live_tasks(g, now(), P.relevant_on(F.lit(DAY).cast("date"))).select("id", "title")


@query(_tasks(f"NOT done AND opens_on <= DATE '{DAY}' AND (closes_at IS NULL OR close_day >= DATE '{DAY}' - 14)"))
def tasks_relevant_recently(g, s, d):
    return reads.live_tasks(g, now(), P.relevant_recently(F.lit(DAY).cast("date"), ZONE)).select("id", "title")


@query(_tasks("NOT done AND opens_on IS NULL"))
def tasks_someday(g, s, d):
    return reads.live_tasks(g, now(), P.someday()).select("id", "title")


@query(_tasks("NOT done AND (closes_at IS NULL OR closes_at BETWEEN now - INTERVAL 14 DAY AND now + INTERVAL 60 DAY)"))
def open_tasks(g, s, d):
    return reads.live_tasks(g, now(), P.open_task(now())).select("id", "title")


@query("SELECT kind, count(*) AS n FROM live GROUP BY kind UNION ALL SELECT 'total', count(*) FROM live")
def counts(g, s, d):
    return reads.counts(g, now())


_JOINED = "live LEFT JOIN plans ON plans.node_id = live.id LEFT JOIN tasks ON tasks.node_id = live.id"


@query(f"SELECT live.id, title FROM {_JOINED} WHERE kind = 'plan' AND occurred_at <= TIMESTAMP '1998-06-20' AND coalesce(end_at, occurred_at) >= TIMESTAMP '1998-06-10' ORDER BY occurred_at NULLS LAST, closes_at NULLS LAST, created_at, live.id LIMIT 50")
def query_kind_range(g, s, d):
    found = reads.filter_nodes(g, now(), ZONE, kind="plan", occurred_from="1998-06-10", occurred_to="1998-06-20")
    return reads.page(found, reads.default_order(), 50).select("id", "title")


@query("SELECT live.id, title FROM live LEFT JOIN persons ON node_id = live.id WHERE lower(title) = 'building' OR list_contains(list_transform(coalesce(aliases, []), lambda a: lower(a)), 'building')")
def query_name(g, s, d):
    return reads.filter_nodes(g, now(), ZONE, name="Building").select("id", "title")


@query("SELECT id, title FROM live WHERE id IN (SELECT dst_id FROM cur WHERE type IN ('HAS_ITEM', 'HAS_PLAN') AND src_id IN ('h1', 'h2'))")
def query_hub(g, s, d):
    return reads.filter_nodes(g, now(), ZONE, hub_ids=["h1", "h2"]).select("id", "title")


@query(_tasks("close_day BETWEEN DATE '1998-06-10' AND DATE '1998-06-20'"))
def query_closes(g, s, d):
    return reads.filter_nodes(g, now(), ZONE, closes_from="1998-06-10", closes_to="1998-06-20").select("id", "title")


@query(f"SELECT id, title FROM live_tasks WHERE NOT done AND opens_on <= DATE '{DAY}' AND (closes_at IS NULL OR close_day >= DATE '{DAY}' - 14) ORDER BY CASE WHEN closes_at IS NULL THEN 2 WHEN close_day >= DATE '{DAY}' THEN 0 ELSE 1 END, CASE WHEN close_day >= DATE '{DAY}' THEN epoch(closes_at) ELSE -epoch(closes_at) END NULLS LAST, created_at, id LIMIT 40 OFFSET 10")
def query_relevant_order(g, s, d):
    return reads.page(reads.filter_nodes(g, now(), ZONE, relevant_on=DAY), reads.relevant_order(DAY, ZONE), 40, 10).select("id", "title")


# hubs


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT id, title FROM hubs WHERE {_NORM.format('title')} = 'brand 17 red' OR starts_with({_NORM.format('title')}, 'brand 17 red ')")
def hub_labels(g, s, d):
    return reads.hub_matches(g, "Brand-17 (old) red", now())


@query(f"w AS (SELECT title, len(list_filter(string_split({_NORM.format('title')}, ' '), lambda x: list_contains(['brand', '17', 'red', 'widget'], x))) AS shared FROM hubs) SELECT DISTINCT title, CAST(shared AS INTEGER) AS shared FROM w WHERE shared > 0 ORDER BY shared DESC, title LIMIT 5")
def closest_hubs(g, s, d):
    return reads.closest_hubs(g, HUB, now())


@query("SELECT item_id, hub_id, hub_title, hub_agent FROM hub_of")
def hub_of_items(g, s, d):
    return reads.hub_of(g, now()).select("item_id", "hub_id", "hub_title", "hub_agent")


@query("SELECT DISTINCT src_id AS id FROM cur WHERE type = 'HAS_ITEM' AND (src_id = 'h1' OR src_id IN (SELECT id FROM nodes WHERE agent_id = 'agent-3'))")
def touched_hubs(g, s, d):
    return reads.touched_hubs(g, ["h1"], "agent-3")


# planner


_PLANS = f"""
lim AS (SELECT TIMESTAMP '1998-06-14 04:00:00' AS lo, TIMESTAMP '1998-06-21 04:00:00' AS hi),
ends AS (SELECT live.*, end_at, all_day, rsvp, CASE WHEN all_day THEN coalesce(end_at, occurred_at) + INTERVAL 23 HOUR ELSE end_at END AS last FROM live JOIN plans ON node_id = id),
it AS (SELECT ends.* FROM ends, lim WHERE CASE WHEN last IS NULL THEN occurred_at >= lo AND occurred_at < hi ELSE occurred_at < hi AND last > lo END),
venue AS (SELECT src_id, arg_min(dst_id, (cur.created_at, cur.id)) AS place_id, arg_min(room, (cur.created_at, cur.id)) AS room FROM cur JOIN live ON live.id = dst_id AND kind = 'place' WHERE type = 'AT_LOCATION' GROUP BY src_id),
note AS (SELECT src_id, string_agg(title, '|' ORDER BY cur.created_at, cur.id) AS notes FROM cur JOIN live ON live.id = dst_id AND kind = 'memory' WHERE type = 'HAS_NOTE' GROUP BY src_id),
tl AS (SELECT it.id, it.title, rsvp, all_day, hub_id, place_id, room, notes, end_at, occurred_at, agent_id FROM it LEFT JOIN hub_of ON item_id = it.id LEFT JOIN venue ON venue.src_id = it.id LEFT JOIN note ON note.src_id = it.id)
"""
_WEEK = ("1998-06-14 04:00:00", "1998-06-21 04:00:00")


@query(_PLANS + "SELECT id, title, rsvp, all_day, hub_id, place_id, room, notes, agent_id AS owner FROM tl")
def planner_plans(g, s, d):
    return planner.plans(g, *_WEEK, now()).select("id", "title", "rsvp", "all_day", "hub_id", "place_id", "room", F.array_join("notes.title", "|").alias("notes"), "owner")


@query(_PLANS + f"SELECT id FROM tl WHERE all_day OR hub_id IS NULL OR coalesce(CAST({local('occurred_at')} AS DATE) <> CAST({local('end_at - INTERVAL 1 MILLISECOND')} AS DATE), false)")
def timeline_month(g, s, d):
    return planner.timeline(g, *_WEEK, now(), ZONE, "month").select("id")


@query(_PLANS + "SELECT id FROM tl WHERE NOT all_day AND end_at IS NOT NULL")
def timeline_planner(g, s, d):
    return planner.timeline(g, *_WEEK, now(), ZONE, "planner").select("id")


_TASK_OUT = "SELECT t.id, t.title, done, NOT done AND coalesce(closes_at < now, false) AS past_due, hub_id, agent_id AS owner FROM t LEFT JOIN ih ON item_id = t.id, k"
_ITEM_HUB = "ih AS (SELECT dst_id AS item_id, arg_min(src_id, (e.created_at, e.id)) AS hub_id, arg_min(agent_id, (e.created_at, e.id)) AS hub_agent FROM cur e JOIN live ON live.id = src_id WHERE type = 'HAS_ITEM' GROUP BY dst_id)"
_BEGIN, _STOP = f"timezone('UTC', timezone('{ZONE}', TIMESTAMP '{DAY}'))", f"timezone('UTC', timezone('{ZONE}', TIMESTAMP '{DAY}' + INTERVAL 1 DAY))"


@query(f"{_ITEM_HUB}, fin AS (SELECT DISTINCT node_id FROM history WHERE field = 'done' AND new_value = 'true' AND changed_at >= {_BEGIN} AND changed_at < {_STOP}), t AS (SELECT * FROM live_tasks WHERE (NOT done AND opens_on <= DATE '{DAY}') OR (done AND (coalesce(opens_on <= DATE '{DAY}' AND (closes_at IS NULL OR closes_at >= {_BEGIN}), false) OR id IN (SELECT node_id FROM fin)))) {_TASK_OUT}")
def planner_tasks_on(g, s, d):
    return planner.day_tasks(g, DAY, now(), ZONE).select("id", "title", "done", "past_due", "hub_id", "owner")


@query(f"{_ITEM_HUB}, t AS (SELECT * FROM live_tasks WHERE NOT done AND opens_on IS NULL) {_TASK_OUT}")
def planner_someday(g, s, d):
    return planner.someday_tasks(g, now()).select("id", "title", "done", "past_due", "hub_id", "owner")


@query(f"SELECT id, strftime({local('closes_at')}, '%a %Y-%m-%d %H:%M') AS closes_local, strftime(opens_on, '%a %Y-%m-%d') AS opens_local, CASE WHEN close_day = DATE '{DAY}' THEN 'due_on_day' WHEN close_day > DATE '{DAY}' THEN 'upcoming' WHEN close_day < DATE '{DAY}' AND NOT done THEN 'past_due' END AS bucket FROM live_tasks")
def task_readings(g, s, d):
    return planner.readings(reads.live_tasks(g, now()), ZONE, DAY).select("id", "closes_local", "opens_local", "bucket")


# vectors, walk, recall


@query("SELECT id, kind, title, round(list_cosine_similarity(embedding, v), 6) AS similarity FROM live, q WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 20")
def ann_topk(g, s, d):
    return recall.ann_search(g, vec(s, d), 20, now())


@query("SELECT id, node_id, field, round(list_cosine_similarity(embedding, v), 6) AS similarity FROM history, q WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 10")
def history_topk(g, s, d):
    return recall.history_search(g, vec(s, d), 10, CONFIG)


@query("SELECT live.id, kind FROM live LEFT JOIN tasks ON node_id = live.id, k WHERE kind IN ('plan', 'task') AND (contains(lower(title), 'urgent') OR contains(lower(title), 'review')) ORDER BY abs(epoch_us(coalesce(occurred_at, closes_at)) - epoch_us(now)) NULLS LAST, live.id LIMIT 4")
def title_anchors(g, s, d):
    return recall.title_anchors(g, "when is the urgent review for building", now()).select("id", "kind")


@query(f"t AS (SELECT id FROM (SELECT live.id, kind FROM live LEFT JOIN tasks ON node_id = live.id, k WHERE kind IN ('plan', 'task') AND (contains(lower(title), 'urgent') OR contains(lower(title), 'review')) ORDER BY abs(epoch_us(coalesce(occurred_at, closes_at)) - epoch_us(now)) NULLS LAST, live.id LIMIT 4)), a AS (SELECT id, round(list_cosine_similarity(embedding, v), 6) AS sim FROM live, q WHERE embedding IS NOT NULL), b AS (SELECT id FROM a WHERE sim >= 0.25 ORDER BY sim DESC, id LIMIT 8), u AS (SELECT id, 0 AS source, 0.0 AS key FROM t UNION ALL SELECT a.id, 1, -sim FROM a JOIN b ON a.id = b.id) SELECT id, min(source) AS source FROM u GROUP BY id ORDER BY min(source), min(key), id LIMIT 8")
def query_anchors(g, s, d):
    return recall.anchors(g, "when is the urgent review for building", vec(s, d), now(), CONFIG)


@query("SELECT a AS id, count(*) AS degree FROM steps GROUP BY a")
def degrees(g, s, d):
    return recall.degrees(g.edges)


_HOP1 = "a0 AS (SELECT id FROM live WHERE id IN ('p3', 'o4', 'd9')), h1 AS (SELECT b AS id, max(c) AS confidence FROM steps WHERE a IN (SELECT id FROM a0) AND a NOT IN (SELECT a FROM steps WHERE a IN (SELECT id FROM a0) GROUP BY a HAVING count(*) > 100) GROUP BY b), w1 AS (SELECT id, 0 AS hop, 1.0::DOUBLE AS confidence FROM a0 UNION ALL SELECT id, 1, confidence FROM h1 WHERE id NOT IN (SELECT id FROM a0))"
_HOP2 = _HOP1 + ", f2 AS (SELECT id, confidence FROM w1 WHERE hop = 1 AND id IN (SELECT id FROM live) AND id NOT IN (SELECT a FROM steps GROUP BY a HAVING count(*) > 100)), h2 AS (SELECT b AS id, max(c * confidence) AS confidence FROM steps JOIN f2 ON a = f2.id GROUP BY b), w2 AS (SELECT * FROM w1 UNION ALL SELECT id, 2, confidence FROM h2 WHERE id NOT IN (SELECT id FROM w1))"


def _start(g):
    return reads.nodes_by_ids(g, ["p3", "o4", "d9"], now()).select("id")


@query(_HOP1 + " SELECT id, hop, round(confidence, 6) AS confidence FROM w1")
def walk_1hop(g, s, d):
    return recall.walk(g, _start(g), 1, now()).select("id", "hop", F.round("confidence", 6).alias("confidence"))


@query(_HOP2 + " SELECT id, hop, round(confidence, 6) AS confidence FROM w2")
def walk_2hop(g, s, d):
    return recall.walk(g, _start(g), 2, now()).select("id", "hop", F.round("confidence", 6).alias("confidence"))


_SCORE = "r AS (SELECT live.*, hop, confidence FROM {w} JOIN live USING (id)), sc AS (SELECT r.id, hop, occurred_at, created_at, CASE WHEN embedding IS NULL THEN 0.0 ELSE list_cosine_similarity(embedding, v) END AS semantic, 1.0 / (1 + hop) AS proximity, exp(-ln(2) * greatest(0, (epoch_us(now) - epoch_us(coalesce(occurred_at, created_at))) / 86400e6) / 30) AS recency, CASE WHEN (SELECT max(access_count) FROM r) <= 0 THEN 0 ELSE ln(1 + access_count) / ln(1 + (SELECT max(access_count) FROM r)) END AS frequency, confidence FROM r, q, k)"


@query(_HOP2 + ", " + _SCORE.format(w="w2") + " SELECT id, round(semantic, 5) AS semantic, round(proximity, 5) AS proximity, round(recency, 5) AS recency, round(frequency, 5) AS frequency, round(0.4 * semantic + 0.2 * proximity + 0.15 * recency + 0.1 * frequency + 0.15 * confidence, 5) AS total FROM sc")
def score_components(g, s, d):
    rows = recall.walk(g, _start(g), 2, now()).join(g.nodes.where(P.live(now())), "id")
    found = recall.scored(rows, now(), CONFIG, vec(s, d))
    return found.select("id", *[F.round(c, 5).alias(c) for c in ("semantic", "proximity", "recency", "frequency", "total")])


@query("a0 AS (SELECT id, row_number() OVER (ORDER BY occurred_at, created_at, id) AS pos FROM (SELECT live.* FROM live JOIN plans ON node_id = id WHERE kind = 'plan' AND occurred_at <= TIMESTAMP '1998-06-20' AND coalesce(end_at, occurred_at) >= TIMESTAMP '1998-06-18' ORDER BY occurred_at, created_at, id LIMIT 30)), big AS (SELECT a FROM steps GROUP BY a HAVING count(*) > 100), h AS (SELECT DISTINCT b AS id FROM steps WHERE a IN (SELECT id FROM a0) AND a NOT IN (SELECT a FROM big) AND b NOT IN (SELECT id FROM a0)) SELECT id, hop FROM (SELECT id, 0 AS hop FROM a0 UNION ALL SELECT h.id, 1 FROM h JOIN live ON live.id = h.id) JOIN live USING (id) LEFT JOIN a0 USING (id) ORDER BY hop, pos NULLS LAST, occurred_at NULLS LAST, created_at, id LIMIT 30")
def recall_filter(g, s, d):
    return recall.recall(g, now(), ZONE, CONFIG, filters={"kind": "plan", "occurred_from": "1998-06-18", "occurred_to": "1998-06-20"}, hops=1, limit=30).nodes.select("id", "hop")


@query("h AS (SELECT DISTINCT b AS id FROM steps WHERE a IN ('p3', 's5') AND b NOT IN ('p3', 's5')) SELECT id, hop FROM (SELECT 'p3' AS id, 0 AS hop UNION ALL SELECT 's5', 0 UNION ALL SELECT id, 1 FROM h) JOIN live USING (id) ORDER BY hop, occurred_at NULLS LAST, created_at, id LIMIT 100")
def recall_from(g, s, d):
    return recall.recall(g, now(), ZONE, CONFIG, start_ids=["p3", "s5"], hops=1, limit=100).nodes.select("id", "hop")


# graph reads


@query("SELECT id FROM live WHERE id NOT IN (SELECT id FROM hidden)")
def graph_nodes(g, s, d):
    return reads.whole_graph(g, now())[0].select("id")


@query("SELECT id FROM cur WHERE src_id IN (SELECT id FROM live) AND dst_id IN (SELECT id FROM live) AND src_id NOT IN (SELECT id FROM hidden) AND dst_id NOT IN (SELECT id FROM hidden)")
def graph_edges(g, s, d):
    return reads.whole_graph(g, now())[1].select("id")


_SEED = "r AS (SELECT id FROM (VALUES ('p3'), ('h2')) t(id) UNION SELECT dst_id FROM cur WHERE src_id IN ('p3', 'h2') UNION SELECT src_id FROM cur WHERE dst_id IN ('p3', 'h2')), sn AS (SELECT id, title FROM live WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM hidden))"


@query(_SEED + " SELECT id, title FROM sn")
def graph_seeded_nodes(g, s, d):
    return reads.seeded_graph(g, ["p3", "h2"], now())[0].select("id", "title")


@query(_SEED + " SELECT id, type FROM cur WHERE src_id IN (SELECT id FROM sn) AND dst_id IN (SELECT id FROM sn)")
def graph_seeded_edges(g, s, d):
    return reads.seeded_graph(g, ["p3", "h2"], now())[1].select("id", "type")


@query("SELECT id, title, rsvp, all_day, (SELECT string_agg(id, ',' ORDER BY id) FROM cur WHERE src_id = 'o4') AS outgoing, (SELECT string_agg(id, ',' ORDER BY id) FROM cur WHERE dst_id = 'o4') AS incoming FROM nodes LEFT JOIN plans ON node_id = id WHERE id = 'o4'")
def node_detail(g, s, d):
    return reads.node_detail(g, "o4").select("id", "title", "rsvp", "all_day", joined("outgoing"), joined("incoming"))


# lint


_TXT = "title || ' ' || coalesce(body, '')"
_TYPES = ", ".join(f"'{t}'" for t in EDGE_TYPES)
#: As the rule's pattern, but for the wake that no word follows: DuckDB's patterns have no look-ahead, so that part is put below.
_WAKE = r"(?is)/var/lib|\bworktree|\bbranch\b|\bcommit\b|this agent|credentials? (set up|exist|stored)|site lesson|\bhow-to\b|shadow dom|\bdom\b|\bref [a-z]\d|accessibility tree|browser (task|helper)|terminal (task|helper)|steer_(browser|terminal)|\.(tsx?|py|go|aspx)\b|\bline \d+"
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec".split("|")


def _any(text: str, *patterns: str) -> str:
    """Whether the text has one of the patterns, each looked for by itself; written beside the rules, not taken from them."""
    return "(" + " OR ".join(f"regexp_matches(lower({text}), '(?s){p}')" for p in patterns) + ")"


_STATUS = _any(_TXT, *(rf"\b{w}\b" for w in ("as of", "not yet", "so far", "still need", "still needs", "unconfirmed")), *(rf"\bno\b.{{0,60}}\b{w}\b" for w in ("found", "posted", "yet")))
_DATED = _any("title", *(rf"\b{t} 20[0-9][0-9]\b" for t in ("fall", "spring", "summer", "winter")), *(rf"\b{m}[a-z]* [0-9]{{1,2}}\b" for m in _MONTHS), *(rf"[0-9]{{1,2}}{m} ?{h}\b" for m in ("", ":[0-9][0-9]") for h in ("am", "pm")), r"\bsection [0-9]")
_AGENTS = _any(
    _TXT, *(rf"\bno {a} {v}\b" for a in ("agent", "agents") for v in ("may", "should", "can")), *(rf"\b{a} {v} {w}\b" for a in ("agent", "agents") for v in ("must", "should", "may") for w in ("never", "not", "always", "only")),
    *(rf"\bwants {t}{a} to\b" for t in ("", "the ") for a in ("agent", "agents", "specialist", "specialists")), *(rf"\b{a} {v} {w}\b" for k in ("specialist", "manager", "helper") for a in (k, k + "s") for v in ("must", "should") for w in ("never", "always")),
)
_LINT_SQL = {
    "status_snapshot": f"SELECT id AS node_ids, title FROM nodes WHERE kind = 'memory' AND expires_at IS NULL AND {_STATUS}",
    "working_note": f"SELECT id AS node_ids, title FROM live WHERE kind = 'memory' AND (regexp_matches({_TXT}, '{_WAKE}') OR regexp_matches(regexp_replace({_TXT}, '(?i)\\bwake[ -]word', '', 'g'), '(?i)\\bwake\\b'))",
    "noon_placeholder": f"SELECT id AS node_ids, title FROM live JOIN plans ON node_id = id WHERE NOT all_day AND strftime({local('occurred_at')}, '%H:%M:%S') = '12:00:00'",
    "dated_plan_title": f"SELECT id AS node_ids, title FROM live WHERE kind = 'plan' AND {_DATED}",
    "agent_instruction": f"SELECT id AS node_ids, title FROM live WHERE kind = 'memory' AND {_AGENTS}",
    "dated_hub": "SELECT id AS node_ids, title FROM live WHERE kind = 'plan' AND occurred_at IS NOT NULL AND id IN (SELECT src_id FROM cur WHERE type = 'HAS_ITEM')",
    "long_span": "SELECT id AS node_ids, title FROM live JOIN plans ON node_id = id WHERE end_at - occurred_at > INTERVAL 7 DAY",
    "duplicate": f"SELECT string_agg(id, ',' ORDER BY created_at, id) AS node_ids, min(title) AS title FROM live GROUP BY kind, {_NORM.format('title')}, CASE WHEN kind = 'plan' THEN date_trunc('hour', occurred_at) END HAVING count(*) > 1",
    "unaliased_person": "f AS (SELECT id, title, aliases, regexp_extract(title, '^(\\S{3,})\\s', 1) AS fn FROM nodes JOIN persons ON node_id = id) SELECT id AS node_ids, title FROM f WHERE fn <> '' AND NOT list_contains(list_transform(aliases, lambda a: lower(a)), lower(fn))",
    "place_without_address": f"u AS (SELECT dst_id, string_agg(DISTINCT src_id, ',' ORDER BY src_id) AS ps FROM cur WHERE type = 'AT_LOCATION' AND src_id IN (SELECT id FROM live WHERE kind = 'plan') GROUP BY dst_id) SELECT id || ',' || ps AS node_ids, title FROM nodes JOIN places ON node_id = id JOIN u ON u.dst_id = id WHERE address IS NULL OR NOT regexp_matches(address, '{lint.STREET}')",
    "floating": "SELECT id AS node_ids, title FROM live WHERE id NOT IN (SELECT src_id FROM cur UNION SELECT dst_id FROM cur)",
    "unknown_edge_type": f"o AS (SELECT type, src_id AS id FROM cur WHERE type NOT IN ({_TYPES}) UNION SELECT type, dst_id FROM cur WHERE type NOT IN ({_TYPES})) SELECT string_agg(id, ',' ORDER BY id) AS node_ids, type AS title FROM o GROUP BY type",
}
for _name, _rule in lint.RULES.items():

    def _run(g, s, d, rule=_rule):
        return rule(g, now(), ZONE).select(joined("node_ids"), "title")

    _run.__name__ = f"lint_{_name}"
    query(_LINT_SQL[_name])(_run)


# scalar functions


@query(f"SELECT id, {_NORM.format('title')} AS n, array_to_string(list_distinct(list_filter(string_split({_NORM.format('title')}, ' '), lambda w: length(w) >= 4 AND w NOT IN ('class', 'session', 'with', 'meeting'))), ',') AS first_word FROM nodes".replace("array_to_string(list_distinct(", "array_to_string(list_sort(list_distinct(").replace(")), ',') AS first_word", "))), ',') AS first_word"))
def normalized_titles(g, s, d):
    return g.nodes.select("id", X.normalize_title(F.col("title")).alias("n"), F.array_join(F.array_sort(X.identifying_words(F.col("title"))), ",").alias("first_word"))


@query("SELECT id, array_to_string([title] || aliases || list_filter(list_transform(regexp_split_to_array(title, '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}''-]', '', 'g')), lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{Lu}')), '|') AS names FROM nodes JOIN persons ON node_id = id")
def person_names(g, s, d):
    return reads.persons(g).select("id", F.array_join(X.person_names(F.col("title"), F.col("aliases")), "|").alias("names"))


@query(f"SELECT id, strftime({local('occurred_at')}, '%Y-%m-%d') AS day, strftime({local('occurred_at')}, '%H:%M') AS clock, strftime({local('occurred_at')}, '%a') AS weekday, CAST(epoch(timezone('UTC', timezone('{ZONE}', date_trunc('day', {local('occurred_at')})))) AS BIGINT) AS midnight FROM nodes WHERE kind = 'plan'")
def local_times(g, s, d):
    at = F.col("occurred_at")
    return g.nodes.where("kind = 'plan'").select("id", TM.local_date(at, ZONE).cast("string").alias("day"), TM.local_time(at, ZONE).alias("clock"), TM.weekday(at, ZONE).alias("weekday"), F.unix_seconds(TM.local_midnight(at, ZONE)).alias("midnight"))


@query("SELECT id, CAST(epoch(occurred_at + to_days(CAST(1 + access_count AS INTEGER))) AS BIGINT) AS expires, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM nodes WHERE kind = 'plan'")
def ttl_and_iso(g, s, d):
    return g.nodes.where("kind = 'plan'").select("id", F.unix_seconds(TM.expires_at(F.col("occurred_at"), F.col("access_count") + 1)).alias("expires"), TM.iso(F.col("occurred_at")).alias("iso"))


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, q")
def cosine_round_trip(g, s, d):
    parsed = V.parse_vector(F.to_json("embedding"))
    return star_table(s, d, "embeddings").select("vec_id", F.round(V.cosine(parsed, vec(s, d)), 6).alias("similarity"))


@query("c AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+|' || chr(1)), lambda p: length(trim(p)) >= 12)) AS n FROM conversations) SELECT conv_id, turn, CAST(CASE WHEN n <= 1 THEN 0 WHEN n <= 12 THEN n ELSE ceil(n / ceil(n / 12.0)) END AS INTEGER) AS n FROM c")
def text_segments(g, s, d):
    texts = star_table(s, d, "conversations")
    return texts.select("conv_id", "turn", F.size(X.segments(F.col("text"), 12)).alias("n"))


# candidates and lookalikes


@query("SELECT id FROM nodes JOIN persons ON node_id = id WHERE regexp_matches('As of today nobody of the household review team was at part 7', '(?i)(^|[^\\p{L}\\p{N}])(' || array_to_string([title] || aliases || list_filter(list_transform(regexp_split_to_array(title, '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}''-]', '', 'g')), lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{Lu}')), '|') || ')($|[^\\p{L}\\p{N}])')")
def mentioned_persons(g, s, d):
    return C.mentioned_persons(g, "As of today nobody of the household review team was at part 7")


@query("under AS (SELECT dst_id AS id FROM cur WHERE type = 'HAS_ITEM' AND src_id IN (SELECT src_id FROM cur WHERE type = 'HAS_ITEM' AND src_id IN (SELECT id FROM nodes WHERE agent_id = 'agent-3'))) SELECT id FROM live_tasks, k WHERE NOT done AND (closes_at IS NULL OR closes_at BETWEEN now - INTERVAL 14 DAY AND now + INTERVAL 60 DAY) AND (id IN (SELECT id FROM under) OR contains(title, ' part '))")
def open_task_candidates(g, s, d):
    return C.open_task_candidates(g, WHOLE, "agent-3", now())


@query("ids AS (SELECT id FROM live_tasks WHERE title = 'HW 3 part 7' UNION SELECT 'p3' UNION SELECT 'o4' UNION SELECT id FROM hubs WHERE title LIKE 'Brand#17 red%'), inc AS (SELECT * FROM cur WHERE type <> 'HAS_PLAN' AND (src_id IN (SELECT id FROM ids) OR dst_id IN (SELECT id FROM ids))), dg AS (SELECT id FROM (SELECT src_id AS id FROM inc UNION ALL SELECT dst_id FROM inc) GROUP BY id HAVING count(*) > 100), pr AS (SELECT id, type, created_at, CASE WHEN type = 'HAS_ITEM' AND dst_id IN (SELECT id FROM ids) THEN 0 WHEN src_id IN (SELECT id FROM ids) AND dst_id IN (SELECT id FROM ids) THEN CASE WHEN src_id IN (SELECT id FROM dg) OR dst_id IN (SELECT id FROM dg) THEN 2 ELSE 1 END ELSE 3 END AS priority FROM inc) SELECT id, type, priority FROM pr WHERE priority = 0 UNION ALL SELECT id, type, priority FROM (SELECT * FROM pr WHERE priority > 0 ORDER BY priority, created_at, id LIMIT 50)")
def context_edges(g, s, d):
    ids = reads.live_tasks(g, now()).where("title = 'HW 3 part 7'").select("id").union(reads.ids_frame(g, ["p3", "o4"])).union(reads.hubs(g, now()).where("title like 'Brand#17 red%'").select("id"))
    return C.context_edges(g, ids.distinct(), 50)


_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) >= 4 AND x NOT IN ('class', 'session', 'with', 'meeting')))"


@query(
    f"nw AS (SELECT 'n' || o_orderkey AS temp_id, {_NORM.format("o_orderpriority || ' ' || o_orderkey % 50")} AS k, epoch(o_orderdate) AS tm FROM orders), lv AS (SELECT id, {_NORM.format('title')} AS k, epoch(occurred_at) AS tm FROM live WHERE kind = 'plan'), "
    f"n2 AS (SELECT *, CAST(floor(tm / 43200) AS BIGINT) + unnest([-1, 0, 1]) AS b, {_WORDS.format('k')} AS w FROM nw), l2 AS (SELECT *, CAST(floor(tm / 43200) AS BIGINT) AS b, {_WORDS.format('k')} AS w FROM lv) "
    "SELECT temp_id, lv.id FROM nw JOIN lv ON lv.k = nw.k UNION SELECT temp_id, l2.id FROM n2 JOIN l2 ON l2.b = n2.b WHERE abs(l2.tm - n2.tm) <= 43200 AND len(list_intersect(l2.w, n2.w)) > 0"
)
def lookalike_plans(g, s, d):
    orders = star_table(s, d, "orders")
    news = orders.select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("temp_id"), F.lit("plan").alias("kind"), F.concat("o_orderpriority", F.lit(" "), (F.col("o_orderkey") % 50).cast("string")).alias("title"), F.col("o_orderdate").alias("occurred_at"), F.lit(None).cast("timestamp").alias("closes_at"), F.lit(None).cast("string").alias("hub_id"))
    return C.lookalikes(g, news, now(), ZONE)


# mutations: what a batch leaves


@query("SELECT id, type FROM cur WHERE NOT (src_id IN ('o4', 'd9', 'h2') OR dst_id IN ('o4', 'd9', 'h2'))")
def close_nodes_edges(g, s, d):
    return mutations.close_nodes(g, reads.ids_frame(g, ["o4", "d9", "h2"]), now()).edges.where(P.current()).select("id", "type")


@query("SELECT id AS node_id, title AS old_value FROM nodes WHERE id IN ('o4', 'd9', 'h2')")
def close_nodes_history(g, s, d):
    after = mutations.close_nodes(g, reads.ids_frame(g, ["o4", "d9", "h2"]), now())
    return after.history.where("source = 'ingest' and field = 'deleted'").select("node_id", "old_value")


@query("SELECT id FROM nodes WHERE kind <> 'plan' AND id NOT IN (SELECT src_id FROM cur WHERE type <> 'HAS_ITEM' UNION SELECT dst_id FROM cur WHERE type <> 'HAS_ITEM')")
def sweep_orphans(g, s, d):
    closed = mutations.close_edges(g, g.edges.where("type = 'HAS_ITEM'").select("id"), now())
    return mutations.orphans(closed, g.nodes.select("id"))


@query(f"dts AS (SELECT unnest([DATE '1998-10-20', DATE '1998-10-27', DATE '1998-04-01']) AS dd), st AS (SELECT dd, timezone('UTC', timezone('{ZONE}', dd + TIME '10:20:00')) AS b, timezone('UTC', timezone('{ZONE}', dd + TIME '11:40:00')) AS e FROM dts) SELECT h.id AS hub_id, CAST(epoch(b) AS BIGINT) AS occurred_at, CAST(epoch(e) AS BIGINT) AS end_at, 's5' AS place_id, '1345' AS room FROM hubs h, st")
def spawn_plans(g, s, d):
    dates = F.array(*[F.lit(x).cast("date") for x in ("1998-10-20", "1998-10-27", "1998-04-01")])
    spawns = reads.hubs(g, now()).select(F.col("id").alias("hub_id"), F.lit("lecture").alias("title"), "agent_id", dates.alias("dates"), F.lit("10:20").alias("start_time"), F.lit("11:40").alias("end_time"), F.lit(None).cast("string").alias("time_zone"), F.lit("s5").alias("place_id"), F.lit("1345").alias("room"))
    after = mutations.spawn_plans(g, spawns, now(), ZONE)
    made = after.nodes.where("title = 'lecture'").join(after.plans, F.col("id") == F.col("node_id")).select("id", "occurred_at", "end_at")
    held = after.edges.where("type = 'HAS_PLAN'").select(F.col("src_id").alias("hub_id"), F.col("dst_id").alias("id"))
    at = after.edges.where("type = 'AT_LOCATION'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("place_id"), F.col("properties")["room"].alias("room"))
    return made.join(held, "id").join(at, "id").select("hub_id", seconds("occurred_at"), seconds("end_at"), "place_id", "room")


@query("SELECT 'x' || key AS id FROM raw_edges WHERE type = 'LIVES_AT' AND (key % 13 = 0 OR key % 2 = 1)")
def create_edges_skips_held(g, s, d):
    people = g.edges.where("type = 'LIVES_AT'").withColumn("key", F.expr("cast(substring(src_id, 2) as bigint)"))
    wanted = people.withColumn("id", F.concat(F.lit("x"), F.col("key").cast("string"))).withColumn("properties", F.when(F.col("key") % 2 == 1, F.create_map(F.lit("since"), F.lit("1998"))).otherwise(F.create_map().cast("map<string,string>"))).drop("key")
    return mutations.new_edges(g, wanted).select("id")


@query("SELECT id, CASE WHEN access_count % 5 = 0 THEN 'renamed' ELSE title END AS title, CAST(epoch(CASE WHEN access_count % 5 = 0 THEN now ELSE created_at END) AS BIGINT) AS updated_at FROM nodes, k WHERE kind = 'plan'")
def update_nodes(g, s, d):
    patches = g.nodes.where("kind = 'plan' and access_count % 5 = 0").select("id", F.lit(True).alias("has_title"), F.lit("renamed").alias("title"), F.lit(False).alias("has_body"), F.lit(None).cast("string").alias("body"), F.lit(False).alias("has_occurred_at"), F.lit(None).cast("timestamp").alias("occurred_at"), F.lit(None).cast("int").alias("ttl_days"), F.lit(False).alias("has_done"), F.lit(None).cast("boolean").alias("done"))
    return mutations.update_nodes(g, patches, now()).nodes.where("kind = 'plan'").select("id", "title", seconds("updated_at"))


@query("SELECT node_id, CAST(done AS VARCHAR) AS old_value FROM tasks WHERE done")
def mark_done_history(g, s, d):
    marks = g.tasks.select(F.col("node_id").alias("id"), F.lit(True).alias("has_done"), F.lit(False).alias("new_done"))
    after = mutations.mark_done(g, marks, now())
    return after.history.where((F.col("field") == "done") & (F.col("new_value") == "false")).select("node_id", "old_value")


_SESSION = f"ses AS (SELECT live.id, occurred_at, end_at, coalesce(time_zone, '{ZONE}') AS tz FROM nodes live JOIN plans ON node_id = live.id WHERE live.id IN (SELECT dst_id FROM cur WHERE type = 'HAS_PLAN'))"


@query(_SESSION + " SELECT id, CAST(epoch(timezone('UTC', timezone(tz, date_trunc('day', timezone(tz, timezone('UTC', occurred_at))) + INTERVAL 11 HOUR))) AS BIGINT) AS occurred_at FROM ses")
def move_sessions(g, s, d):
    ids = reads.sessions(g)
    return mutations.move_sessions(g, ids, now(), ZONE, start_time="11:00").nodes.join(ids, "id", "left_semi").select("id", seconds("occurred_at"))


@query(f"SELECT id FROM nodes WHERE id IN (SELECT dst_id FROM cur WHERE type = 'HAS_PLAN' AND src_id = 'h2') AND occurred_at >= timezone('UTC', timezone('{ZONE}', TIMESTAMP '1997-01-01')) AND occurred_at < timezone('UTC', timezone('{ZONE}', TIMESTAMP '1999-01-01'))")
def hub_sessions(g, s, d):
    return mutations.hub_sessions(g, "h2", "1997-01-01", "1998-12-31", ZONE)


@query("SELECT DISTINCT src_id AS id FROM cur JOIN nodes ON nodes.id = src_id WHERE type = 'HAS_ITEM'")
def verified_hubs(g, s, d):
    ids = g.tasks.select(F.col("node_id").alias("id"))
    return mutations.verify_tasks(g, ids, now()).nodes.where("verified_at is not null").select("id")


@query("SELECT id, access_count + CASE WHEN ord % 10 = 0 THEN 2 ELSE 0 END AS access_count FROM (SELECT id, access_count, CAST(substr(id, 2) AS BIGINT) AS ord FROM nodes WHERE kind = 'plan')")
def fold_access(g, s, d):
    plans = g.nodes.where("kind = 'plan'")
    log = plans.where("cast(substring(id, 2) as bigint) % 10 = 0").select("id", F.explode(F.array(now(), TM.plus_seconds(now(), F.lit(5)))).alias("at"))
    return recall.fold_access(plans, log).select("id", "access_count")


@query(f"SELECT id, CASE WHEN kind = 'plan' AND pk THEN 'task' ELSE kind END AS kind FROM (SELECT nodes.id, kind, coalesce(end_at IS NULL AND NOT all_day AND strftime(timezone(coalesce(time_zone, '{ZONE}'), timezone('UTC', occurred_at)), '%H:%M:%S') = '00:00:00', false) AS pk FROM nodes LEFT JOIN plans ON node_id = nodes.id) WHERE kind = 'plan'")
def timeless_to_tasks(g, s, d):
    return C.timeless_to_tasks(g, now(), ZONE).nodes.join(g.plans.select(F.col("node_id").alias("id")), "id", "left_semi").select("id", "kind")


@query(f"SELECT id, CASE WHEN type IN ({_TYPES}) THEN type ELSE 'RELATED_TO' END AS type, CASE WHEN type NOT IN ({_TYPES}) THEN type END AS was FROM edges")
def retype_edges(g, s, d):
    return C.retype_edges(g.edges).select("id", "type", F.try_element_at("properties", F.lit("was")).alias("was"))


def _operations(s, d):
    """Create operations made of lines: some break a rule."""
    lines = star_table(s, d, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("plan", "task", "memory", "person")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    begin = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    return lines.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("n"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("temp_id"), kind.alias("kind"), F.col("o_orderpriority").alias("title"), begin.alias("occurred_at"), begin.alias("end_at"), F.when(F.col("o_orderkey") % 5 == 0, F.to_date("o_orderdate")).alias("opens_on"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderdate")).alias("closes_at"), F.when(F.col("o_orderkey") % 7 == 0, 3).alias("ttl_days"))


_OPS = "ops AS (SELECT o_orderkey AS seq, o_orderkey // 2 AS temp_id, ['plan', 'task', 'memory', 'person'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS occurred_at, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) END AS opens_on, CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate END AS closes_at, o_orderkey % 7 = 0 AS ttl, o_orderpriority AS title FROM orders)"


@query(f"{_OPS} SELECT seq, 'plan without start' AS rule FROM ops WHERE kind = 'plan' AND occurred_at IS NULL UNION ALL SELECT seq, 'task with occurred_at' FROM ops WHERE kind = 'task' AND occurred_at IS NOT NULL UNION ALL SELECT seq, 'close without open' FROM ops WHERE kind = 'task' AND closes_at IS NOT NULL AND opens_on IS NULL UNION ALL SELECT seq, 'close before open' FROM ops WHERE kind = 'task' AND CAST({local('closes_at')} AS DATE) < opens_on UNION ALL SELECT seq, 'ttl on person or place' FROM ops WHERE kind = 'person' AND ttl UNION ALL SELECT seq, 'end before start' FROM ops WHERE kind = 'plan' AND occurred_at IS NOT NULL UNION ALL SELECT seq, 'duplicate temp_id' FROM ops WHERE temp_id IN (SELECT temp_id FROM ops GROUP BY temp_id HAVING count(*) > 1)")
def operation_violations(g, s, d):
    return validation.creates(_operations(s, d), ZONE, "seq").select(F.col("key").cast("long").alias("seq"), "rule")


@query(f"{_OPS} SELECT kind AS op, count(*) AS n FROM ops GROUP BY kind UNION ALL SELECT 'place', 0")
def operation_counts(g, s, d):
    return mutations.operation_counts(_operations(s, d).withColumnRenamed("kind", "op"), ["person", "memory", "plan", "place", "task"])


@query(f"{_OPS} SELECT count(*) = 0 AS \"none\", count(*) FILTER (occurred_at IS NOT NULL) > 0 AS \"some\", coalesce(bool_and(occurred_at IS NOT NULL), false) AS \"each\", count(DISTINCT title) > 1 AS varied FROM ops WHERE kind = 'plan' AND regexp_matches(title, '(?i)urgent')")
def expectations(g, s, d):
    ops = _operations(s, d)
    return C.expectation(ops, C.matches(ops, kind="plan", title_like="urgent"), F.col("occurred_at").isNotNull())


@query("SELECT doc_id AS seq FROM documents WHERE NOT (length(trim(regexp_replace(lower(substr(text, 5, doc_id % 40)), '\\s+', ' ', 'g'))) >= 8)")
def evidence_failures(g, s, d):
    docs = star_table(s, d, "documents")
    claims = docs.select(F.col("doc_id").alias("seq"), F.expr("substring(text, 5, cast(doc_id % 40 as int))").alias("evidence"), "text")
    return C.evidence_failures(claims, F.col("text")).select("seq")


@query("SELECT 'changed' AS type, CAST(epoch_us(ts) AS BIGINT) AS at FROM events WHERE event_type <> 'view' AND event_type <> 'error' AND event_type <> 'click'")
def event_changes(g, s, d):
    events = star_table(s, d, "events")
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    path = F.when(F.col("event_type") == "click", "/recall").otherwise("/ingest")
    requests = events.select(F.col("ts").alias("at"), method.alias("method"), path.alias("path"), F.when(F.col("event_type") == "error", 422).otherwise(200).alias("status"))
    return change_events(requests).select("type", F.unix_micros("at").alias("at"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of a few days, one hop around them, ranked."""
    return _QUERIES["recall_filter"](spark, sf_dir)


def _whole() -> None:
    """Registers the queries of the other modules."""
    for name in ("changes", "evolution"):
        importlib.import_module(f"kairograph.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _whole()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _whole()
    return dict(_SQL)
