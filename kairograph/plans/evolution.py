"""Registered queries on the vector index, series, migrations, journals, fan-out and ingest, and their oracle SQL."""

from __future__ import annotations

import inspect
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.config import EngineConfig, UpstreamError
from kairograph.functions import predicates as P
from kairograph.functions import time as TM
from kairograph.operators import candidates as C
from kairograph.operators import ingest, migrations, mutations, planner, reads, series, vector_index
from kairograph.operators.journal import AccessLog, history_journal
from kairograph.plans.oracle import NOW, ZONE, local
from kairograph.plans.registry import _ITEM_HUB, _PLANS, _TASK_OUT, _WEEK, DAY, now, query, seconds
from kairograph.sources.graph import cut, file_state, shared_dir, star_table, state_root
from kairograph.streaming.changes import FanOut, request_log, stream

# approximate vector search


def vector_rows(s, d) -> DataFrame:
    return star_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


def indexed(s, d) -> vector_index.VectorIndex:
    """The index of the embeddings table, built once for each state of its files and of the index's code."""
    state = [inspect.getsource(vector_index), *file_state(s, f"{d}/embeddings.parquet")]
    return vector_index.opened(vector_rows(s, d), state_root(s, "vectors", state))


def _probes(index) -> int:
    """These vectors have hardly any clusters: at half of the cells the recall is 0.82 to 0.88, at four fifths 0.95 and more."""
    return max(1, -(-4 * len(index.quantiser.centres) // 5))


@query()
def vector_cells(g, s, d):
    """The ten nearest of every vector whose id is divisible by 20, by codes first and exact re-ranking."""
    index = indexed(s, d)
    return vector_index.search(index, vector_rows(s, d).where("id % 20 = 0"), _probes(index), 10)


@query("SELECT count(*) AS queries, true AS recall_met, true AS bytes_met FROM embeddings WHERE vec_id % 20 = 0")
def vector_recall(g, s, d):
    """Whether that search finds 0.9 of the exact ten at a fifth of the bytes that 1,000 or more vectors have."""
    index, rows = indexed(s, d), vector_rows(s, d)
    asked = rows.where("id % 20 = 0")
    found = vector_index.search(index, asked, _probes(index), 10).select("query_id", "id", F.lit(1).alias("hit"))
    exact = vector_index.exact(rows, asked, 10).select("query_id", "id")
    recall = exact.join(found, ["query_id", "id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("recall_met"))
    share = vector_index.read_share(index, asked, _probes(index)).agg(F.count("*").alias("queries"), (F.avg("share") <= 0.2).alias("bytes_met"))
    return share.join(F.broadcast(recall), F.lit(True)).select("queries", "recall_met", "bytes_met")  # one row each


# series


def _series(s, d) -> DataFrame:
    """A rule for each order."""
    key = F.col("o_orderkey")
    first = F.to_date("o_orderdate")
    return star_table(s, d, "orders").select(
        F.concat(F.lit("r"), key.cast("string")).alias("id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("hub_id"), F.col("o_orderpriority").alias("title"), F.lit("agent-1").alias("agent_id"), first.alias("first"),
        F.element_at(F.array(F.lit("DAILY"), F.lit("WEEKLY"), F.lit("MONTHLY")), (key % 3 + 1).cast("int")).alias("freq"), (key % 4 + 1).cast("int").alias("every"),
        F.when(key % 2 == 0, F.array(F.lit(1), F.lit(3), F.lit(6))).alias("days"), F.when(key % 5 != 0, (key % 7).cast("int")).alias("times"), F.when(key % 5 < 2, F.date_add(first, (key % 60).cast("int"))).alias("until"),
        F.array(F.date_add(first, 7), F.date_add(first, (key % 9).cast("int"))).alias("skipped"), F.lit("10:20").alias("start_time"), F.lit("11:40").alias("end_time"), F.when(key % 6 == 0, "Europe/Paris").alias("time_zone"),
    )


_RULES = """sr AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d0, ['DAILY', 'WEEKLY', 'MONTHLY'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS freq, CAST(o_orderkey % 4 + 1 AS INTEGER) AS every,
  CASE WHEN o_orderkey % 2 = 0 THEN [1, 3, 6] ELSE [CAST(isodow(o_orderdate) AS INTEGER)] END AS days, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS INTEGER) END AS times,
  CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS until, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN 'Europe/Paris' END, '""" + ZONE + """') AS tz FROM orders),
 can AS (SELECT *, CASE freq WHEN 'MONTHLY' THEN CAST(d0 + to_months(CAST(i * every AS INTEGER)) AS DATE) ELSE d0 + CAST(i AS INTEGER) END AS day FROM (SELECT *, unnest(range(0, CASE freq WHEN 'MONTHLY' THEN 60 ELSE 260 END)) AS i FROM sr)),
 ok AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS nth FROM can WHERE (until IS NULL OR day <= until) AND CASE freq WHEN 'DAILY' THEN i % every = 0 WHEN 'WEEKLY' THEN list_contains(days, CAST(isodow(day) AS INTEGER)) AND ((day - CAST(date_trunc('week', d0) AS DATE)) // 7) % every = 0 ELSE day(day) = day(d0) END),
 oc AS (SELECT key, day, tz FROM ok WHERE (times IS NULL OR nth <= times) AND (times IS NOT NULL OR until IS NOT NULL) AND day <> d0 + 7 AND day <> d0 + CAST(key % 9 AS INTEGER))"""


@query(f"{_RULES} SELECT 'r' || key AS id, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY key ORDER BY day) AS number, CAST(epoch(timezone('UTC', timezone(tz, day + TIME '10:20:00'))) AS BIGINT) AS occurred_at, CAST(epoch(timezone('UTC', timezone(tz, day + TIME '11:40:00'))) AS BIGINT) AS end_at FROM oc")
def series_occurrences(g, s, d):
    found = series.occurrences(_series(s, d), ZONE)
    return found.select("id", F.col("day").cast("string").alias("day"), F.col("number").cast("long").alias("number"), seconds("occurred_at"), seconds("end_at"))


@query(f"{_RULES} SELECT sha256('series|r' || key || '|' || day) AS id, CAST(epoch(timezone('UTC', timezone(tz, day + TIME '10:20:00'))) AS BIGINT) AS occurred_at, 'p' || o_custkey AS hub_id FROM oc JOIN orders ON o_orderkey = key")
def series_written_out(g, s, d):
    """Written out twice; the second run adds nothing."""
    once = series.write_out(g, _series(s, d), now(), ZONE)
    twice = series.write_out(once, _series(s, d), now(), ZONE)
    bytes_of = lambda df, column: df.where(F.length(column) == 64).withColumn("key", series.id_key(F.col(column)))  # noqa: E731  half of what is shuffled
    nodes = bytes_of(twice.nodes.where("kind = 'plan'"), "id").select("key", seconds("occurred_at"))
    plans = bytes_of(twice.plans, "node_id").select("key")
    held = bytes_of(twice.edges.where(P.current() & (F.col("type") == "HAS_PLAN") & (F.length("id") == 64)), "dst_id").select("key", F.col("src_id").alias("hub_id"))
    return nodes.join(plans, "key").join(held, "key").select(series.id_of(F.col("key")).alias("id"), "occurred_at", "hub_id")


_TAKEN = "SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 1"


@query(f"gone AS ({_TAKEN}) SELECT 'history' AS what, nodes.id, title AS value FROM nodes JOIN gone USING (id) UNION ALL SELECT 'plan', node_id, NULL FROM plans WHERE node_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', id, NULL FROM cur WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone)")
def series_taken_back(g, s, d):
    """Plans of a series go with a history row each, plans of none stay; twice, the second run changes nothing."""
    key = F.expr("try_cast(substring(node_id, 2) as bigint)")
    written = g.plans.select("node_id", F.when(key % 4 == 1, F.concat(F.lit("r"), F.floor(key / 40).cast("string"))).alias("series_id"))
    once = series.take_back(g, written, now())
    after = series.take_back(once, written, now())
    history = after.history.where("field = 'deleted' and source = 'manual' and length(id) = 64").select(F.lit("history").alias("what"), F.col("node_id").alias("id"), F.col("old_value").alias("value"))
    plans = after.plans.select(F.lit("plan"), "node_id", F.lit(None).cast("string"))
    return history.union(plans).union(after.edges.where(P.current()).select(F.lit("edge"), "id", F.lit(None).cast("string")))


# migrations


_LEGACY_TITLES = ("CSE 300 lab", "MAT 126 lecture", "Report due", "AMS 310 quiz", "Rent", "Loan payment", "Lunch", "PHY 131 recitation")


def _legacy(g, s, d) -> tuple:
    """The graph with legacy titles and items, and its legacy plans."""
    key = F.expr("try_cast(substring(node_id, 2) as bigint)")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    titles = g.plans.select(F.col("node_id").alias("id"), pick(_LEGACY_TITLES, (key % 8 + 1).cast("int")).alias("t"))
    nodes = g.nodes.join(titles, "id", "left").withColumn("title", F.coalesce("t", "title")).select(*g.nodes.columns)
    items = g.plans.where(key % 3 == 0).select(
        F.concat(F.lit("it-"), "node_id").alias("id"), F.lit("h1").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("HAS_ITEM").alias("type"), F.create_map(F.lit("item"), pick(("lab", "session", "milestone", "exam", "other"), (key % 5 + 1).cast("int"))).alias("properties"),
        F.lit(1.0).alias("confidence"), now().alias("created_at"), now().alias("valid_from"), F.when(key % 7 == 0, now()).alias("valid_to"),
    )
    legacy = g.plans.select(
        "node_id", F.when(key % 4 == 0, "FREQ=MONTHLY;INTERVAL=1").when(key % 4 == 1, "FREQ=WEEKLY").alias("recurrence"), pick(("task", "bill", "class", "meeting"), (key % 4 + 1).cast("int")).alias("kind"), "end_at",
        F.when(key % 10 == 0, now()).alias("due_at"), pick(("confirmed", "cancelled", "tentative"), (key % 3 + 1).cast("int")).alias("status"), pick(("done", "missed", ""), (key % 3 + 1).cast("int")).alias("outcome"),
    )
    return g.with_(nodes=nodes, edges=g.edges.unionByName(items)), legacy


_LEGACY = """lg AS (SELECT node_id AS id, CAST(substr(node_id, 2) AS BIGINT) AS key, end_at FROM plans),
lt AS (SELECT *, ['CSE 300 lab', 'MAT 126 lecture', 'Report due', 'AMS 310 quiz', 'Rent', 'Loan payment', 'Lunch', 'PHY 131 recitation'][key % 8 + 1] AS t, CASE WHEN key % 3 = 0 AND key % 7 <> 0 THEN ['lab', 'session', 'milestone', 'exam', 'other'][key % 5 + 1] END AS item,
  CASE key % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'W' END AS rec FROM lg),
lc AS (SELECT *, t LIKE 'CSE %' OR t LIKE 'MAT %' OR t LIKE 'AMS %' OR t LIKE 'PHY %' AS course FROM lt)"""


@query(f"{_LEGACY} SELECT id, kind FROM (SELECT id, CASE WHEN coalesce(item = 'lab', false) OR (rec IS NOT NULL AND course AND t LIKE '%lab') THEN 'lab' WHEN course AND (rec IS NOT NULL OR coalesce(item = 'session', false)) THEN 'class' WHEN coalesce(item = 'milestone', false) OR t LIKE '% due' THEN 'task' WHEN coalesce(item = 'exam', false) THEN 'exam' WHEN rec = 'M' AND t IN ('Rent', 'Loan payment') THEN 'bill' END AS kind FROM lc) WHERE kind IS NOT NULL")
def classified_plans(g, s, d):
    held, legacy = _legacy(g, s, d)
    return migrations.classify(migrations.plan_facts(held, legacy), migrations.rules_table(s))


@query("lg AS (SELECT nodes.id, occurred_at, CAST(substr(id, 2) AS BIGINT) AS key, end_at FROM nodes JOIN plans ON node_id = id), hit AS (SELECT *, key % 4 < 2 AND end_at IS NULL AS m FROM lg), out AS (SELECT *, CASE WHEN m THEN occurred_at WHEN key % 10 = 0 THEN now END AS due FROM hit, k) SELECT id, CAST(epoch(due) AS BIGINT) AS due_at, CASE WHEN NOT m THEN CAST(epoch(occurred_at) AS BIGINT) END AS occurred_at, CASE WHEN m THEN strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS old_value FROM out")
def moved_deadlines(g, s, d):
    _, legacy = _legacy(g, s, d)
    once, due = migrations.move_deadlines(g, legacy, now(), ZONE)
    after, due = migrations.move_deadlines(once, due, now(), ZONE)
    history = after.history.where("field = 'occurred_at' and source = 'manual' and length(id) = 64").select(F.col("node_id").alias("id"), "old_value")
    rows = due.select(F.col("node_id").alias("id"), seconds("due_at")).join(after.nodes.select("id", seconds("occurred_at")), "id")
    return rows.join(history, "id", "left")


def _blocks(s, d) -> DataFrame:
    key = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in ("meal", "fixed", "recruiting", "class", "gym", "wake")])
    start = TM.plus_seconds(F.col("o_orderdate"), (key % 24) * 3600 + F.when(key % 5 == 0, 0).otherwise(60))
    return star_table(s, d, "orders").select(
        key.alias("id"), F.element_at(kinds, (key % 6 + 1).cast("int")).alias("kind"), F.col("o_orderpriority").alias("title"), F.lit("n").alias("note"), start.alias("start_at"), TM.plus_seconds(start, F.lit(1800)).alias("end_at"),
        F.when(key % 7 == 0, start).alias("done_at"), F.when(key % 2 == 0, "manual").otherwise("agent-2").alias("source"), start.alias("created_at"),
    )


_BLOCKS = f"""bl AS (SELECT o_orderkey AS key, ['meal', 'fixed', 'recruiting', 'class', 'gym', 'wake'][CAST(o_orderkey % 6 + 1 AS INTEGER)] AS kind, o_orderdate + to_seconds(CAST((o_orderkey % 24) * 3600 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 60 END AS BIGINT)) AS st FROM orders),
 pk AS (SELECT *, sha256('block|' || key) AS id FROM bl, k WHERE kind NOT IN ('class', 'wake') AND st >= timezone('UTC', timezone('{ZONE}', date_trunc('day', {local('now')}))) AND st NOT IN (SELECT occurred_at FROM live JOIN plans ON node_id = live.id WHERE occurred_at IS NOT NULL))"""


@query(f"{_BLOCKS} SELECT 'node' AS what, id, CAST(epoch(st) AS BIGINT) AS at, CASE WHEN key % 2 = 0 THEN 'manual' ELSE 'agent-2' END AS value FROM pk UNION ALL SELECT 'plan', id, CAST(epoch(st) AS BIGINT) + 1800, CASE kind WHEN 'fixed' THEN 'meeting' WHEN 'recruiting' THEN 'focus' ELSE kind END FROM pk UNION ALL SELECT 'session', id, CAST(epoch(st) AS BIGINT), strftime({local('st')}, '%Y-%m-%d') FROM pk WHERE key % 7 = 0")
def planner_blocks(g, s, d):
    """One pick feeds three tables; run twice, the second run picks nothing."""
    none = s.createDataFrame([], "plan_id string, day date, state string, outcome string, outcome_at timestamp, source string")
    once, sessions, picked = migrations.blocks_to_plans(g, _blocks(s, d), none, now(), ZONE)
    after, sessions, again = migrations.blocks_to_plans(once, _blocks(s, d), sessions, now(), ZONE)
    kinds = picked.union(again)
    nodes = after.nodes.where("length(id) = 64").select(F.lit("node").alias("what"), "id", F.unix_seconds("occurred_at").alias("at"), F.coalesce("agent_id", "source").alias("value"))
    plans = after.plans.join(kinds, "node_id").select(F.lit("plan"), "node_id", F.unix_seconds("end_at"), "kind")
    return nodes.union(plans).union(sessions.select(F.lit("session"), "plan_id", F.unix_seconds("outcome_at"), F.col("day").cast("string")))


@query("gone AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 1) SELECT 'history' AS what, nodes.id, title AS value FROM nodes JOIN gone USING (id) UNION ALL SELECT 'closed edge', id, NULL FROM cur WHERE src_id IN (SELECT id FROM gone) OR dst_id IN (SELECT id FROM gone)")
def cancelled_plans(g, s, d):
    _, legacy = _legacy(g, s, d)
    after = migrations.close_cancelled(migrations.close_cancelled(g, legacy, now()), legacy, now())
    history = after.history.where("field = 'deleted' and source = 'ingest' and length(id) = 64").select(F.lit("history").alias("what"), F.col("node_id").alias("id"), F.col("old_value").alias("value"))
    return history.union(after.edges.where(F.col("valid_to") == now()).select(F.lit("closed edge"), "id", F.lit(None).cast("string")))


@query("SELECT 'plan' AS what, node_id AS id, CASE CAST(substr(node_id, 2) AS BIGINT) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS value, NULL::BIGINT AS at FROM plans UNION ALL SELECT 'task', node_id, closes_at IS NOT NULL, NULL FROM tasks UNION ALL SELECT 'history', node_id, true, CAST(epoch(closes_at) AS BIGINT) FROM tasks WHERE closes_at IS NOT NULL")
def plan_outcomes(g, s, d):
    _, legacy = _legacy(g, s, d)
    ticks = g.tasks.select("node_id", F.col("closes_at").alias("done_at"))
    once = migrations.outcomes(g, legacy, ticks)
    after = migrations.outcomes(once, legacy, ticks)
    history = after.history.where("field = 'done' and source = 'ingest' and length(id) = 64").select(F.lit("history").alias("what"), F.col("node_id").alias("id"), (F.col("new_value") == "true").alias("value"), F.unix_seconds("changed_at").alias("at"))
    none = F.lit(None).cast("long")
    return after.plans.select(F.lit("plan").alias("what"), F.col("node_id").alias("id"), F.col("attended").alias("value"), none.alias("at")).union(after.tasks.select(F.lit("task"), "node_id", "done", none)).union(history)


@query(f"tn AS (SELECT nodes.id, CAST(substr(nodes.id, 2) AS BIGINT) AS key, end_at IS NULL AND NOT all_day AND strftime(timezone(coalesce(time_zone, '{ZONE}'), timezone('UTC', occurred_at)), '%H:%M:%S') = '00:00:00' AS shape FROM nodes JOIN plans ON node_id = nodes.id) SELECT 'with' AS archive, id FROM tn WHERE shape AND (key % 3 = 2 OR key % 4 = 1)")
def archived_tentative(g, s, d):
    """From two archives of unlike columns and one that does not exist; without any, nothing is moved."""
    folder = f"{shared_dir(s)}/kairograph/archive-{uuid.uuid4().hex}"
    key = F.expr("try_cast(substring(node_id, 2) as bigint)")
    g.plans.where(key % 2 == 0).select("node_id", F.when(key % 3 == 2, "tentative").when(key % 4 == 1, "tentative").otherwise("confirmed").alias("status"), "rsvp").write.parquet(f"{folder}/one")
    g.plans.where(key % 2 == 1).select(F.when((key % 4 == 1) | (key % 3 == 2), "tentative").otherwise("cancelled").alias("Status"), F.lit(1).alias("note"), "node_id").write.parquet(f"{folder}/two")
    columns = {"node_id": "string", "status": "string"}
    moved = lambda held: migrations.tentative_to_tasks(g, held, now(), ZONE).nodes.where("kind = 'task'").join(g.plans.select(F.col("node_id").alias("id")), "id", "left_semi").select("id")
    found = moved(migrations.archived(s, [f"{folder}/one", f"{folder}/none", f"{folder}/two"], columns)).select(F.lit("with").alias("archive"), "id")
    return found.union(moved(migrations.archived(s, [f"{folder}/none"], columns)).select(F.lit("without"), "id"))


# journals


@query("SELECT id, access_count + CASE kind WHEN 'plan' THEN 3 WHEN 'person' THEN 1 ELSE 0 END AS access_count, CASE kind WHEN 'plan' THEN CAST(epoch(now) AS BIGINT) + 60 WHEN 'person' THEN CAST(epoch(now) AS BIGINT) END AS last_accessed_at FROM nodes, k")
def folded_access_log(g, s, d):
    """Batches in two folds; one that is noted again and a fold without batches add nothing."""
    log = AccessLog(s, f"{shared_dir(s)}/kairograph/access-{uuid.uuid4().hex}")
    plans, people = (g.nodes.where(F.col("kind") == k).select("id") for k in ("plan", "person"))
    log.record(plans, now(), "first")
    log.record(plans, now(), "second")
    log.record(plans, now(), "second")
    log.fold()
    log.record(people, now())
    log.record(plans, TM.plus_seconds(now(), F.lit(60)))
    log.fold()
    log.fold()
    return log.accessed(g.nodes).select("id", "access_count", seconds("last_accessed_at"))


@query("SELECT node_id, 'deleted' AS field, title AS old_value FROM nodes JOIN (SELECT node_id FROM plans UNION SELECT node_id FROM places) ON node_id = id")
def journaled_history(g, s, d):
    """The history rows of two overlapping batches and of a rerun: each once, and only the batch's own are written."""
    journal = history_journal(s, f"{shared_dir(s)}/kairograph/history-{uuid.uuid4().hex}")
    bare = g.with_(history=g.history.limit(0))
    plans, places = (getattr(g, t).select(F.col("node_id").alias("id")) for t in ("plans", "places"))
    for batch, ids in (("plans", plans), ("both", plans.union(places)), ("plans", plans)):
        journal.append(mutations.close_nodes(bare, ids, now()).history, batch, key="id", time="changed_at")
    return journal.read().select("node_id", "field", "old_value")


# fan-out


@query("ch AS (SELECT ts FROM events WHERE event_type IN ('purchase', 'signup')) SELECT name, count(*) AS changes, max(CAST(epoch_us(ts) AS BIGINT)) AS last FROM ch, (SELECT unnest(['before', 'throughout']) AS name) GROUP BY name")
def fan_out(g, s, d):
    """What named subscribers are told over a stream that is stopped and begun again; one is away for the second half and
    told afterwards."""
    root = f"{shared_dir(s)}/kairograph/requests-{uuid.uuid4().hex}"
    kind = F.col("event_type")
    requests = star_table(s, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.when(kind == "view", "GET").otherwise("POST").alias("method"), F.when(kind == "click", "/recall").otherwise("/ingest").alias("path"), F.when(kind == "error", 422).otherwise(200).alias("status"), F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("part"))
    requests.where("part < 2").drop("part").repartition(2).write.parquet(f"{root}/log")
    told: list[tuple] = []
    note = lambda name: lambda c: told.append((name, c.batch, c.n, c.at))
    for away in (False, True):
        fan = FanOut(s, f"{root}/checkpoint")
        for name in ("throughout",) if away else ("before", "throughout"):
            fan.subscribe(note(name), name)
        stream(s, f"{root}/log", f"{root}/checkpoint", fan, files=1, until_now=True).awaitTermination()
        if not away:
            requests.where("part >= 2").drop("part").repartition(2).write.mode("append").parquet(f"{root}/log")
    FanOut(s, f"{root}/checkpoint").subscribe(note("before"), "before")
    rows = s.createDataFrame(told, "name string, batch long, n long, at timestamp").dropDuplicates(["name", "batch"])  # a row a batch and name
    return rows.groupBy("name").agg(F.sum("n").alias("changes"), F.max(F.unix_micros("at")).alias("last"))


# lookalikes by title


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"nw AS (SELECT 'n' || o_orderkey AS id, {_NORM.format("o_orderpriority || ' REVIEW! ' || o_orderkey % 100")} AS title FROM orders), lv AS (SELECT id, {_NORM.format('title')} AS title FROM live WHERE kind = 'plan') SELECT 'plan' AS kind, title, 'new' AS side, id FROM nw WHERE title IN (SELECT title FROM lv) UNION ALL SELECT 'plan', title, 'stored', id FROM lv WHERE title IN (SELECT title FROM nw)")
def title_groups(g, s, d):
    key = F.col("o_orderkey")
    news = star_table(s, d, "orders").select(F.concat(F.lit("n"), key.cast("string")).alias("temp_id"), F.lit("plan").alias("kind"), F.concat("o_orderpriority", F.lit(" REVIEW! "), (key % 100).cast("string")).alias("title"))
    return C.title_groups(g, news, now())


# the order of planner reads


def _placed(df: DataFrame, *columns) -> DataFrame:
    """The rows with their place in the order in which they come."""
    return df.withColumn("came", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("came"))).select(*columns, "place")


@query(_PLANS + "SELECT id, row_number() OVER (ORDER BY occurred_at, title, id) AS place FROM tl")
def planner_plans_order(g, s, d):
    return _placed(planner.plans(g, *_WEEK, now()), "id")


@query(f"{_ITEM_HUB}, t AS (SELECT * FROM live_tasks WHERE NOT done AND opens_on IS NULL), o AS ({_TASK_OUT}) SELECT o.id, row_number() OVER (ORDER BY closes_at NULLS LAST, o.title, o.id) AS place FROM o JOIN t USING (id)")
def planner_someday_order(g, s, d):
    return _placed(planner.someday_tasks(g, now()), "id")


@query(f"fin AS (SELECT DISTINCT node_id FROM history WHERE field = 'done' AND new_value = 'true' AND changed_at >= timezone('UTC', timezone('{ZONE}', TIMESTAMP '{DAY}')) AND changed_at < timezone('UTC', timezone('{ZONE}', TIMESTAMP '{DAY}' + INTERVAL 1 DAY))), t AS (SELECT * FROM live_tasks WHERE (NOT done AND opens_on <= DATE '{DAY}') OR (done AND (coalesce(opens_on <= DATE '{DAY}' AND (closes_at IS NULL OR closes_at >= timezone('UTC', timezone('{ZONE}', TIMESTAMP '{DAY}'))), false) OR id IN (SELECT node_id FROM fin)))) SELECT id, row_number() OVER (ORDER BY closes_at NULLS LAST, title, id) AS place FROM t")
def planner_tasks_order(g, s, d):
    return _placed(planner.day_tasks(g, DAY, now(), ZONE), "id")


# ingest


def _failing_once(width: int = 3):
    """An embedder that does not answer the first time in each task, and then gives lengths as vectors."""
    state = {"asked": 0}

    def embed(texts: list[str]) -> list[list[float]]:
        state["asked"] += 1
        if state["asked"] == 1:
            raise UpstreamError("no answer")
        return [[float(len(t)), float(t.count(" ")), 1.0][:width] for t in texts]

    return embed


@query("SELECT 'd' || doc_id AS key, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents")
def embedded_texts(g, s, d):
    """Every document's text through an embedder, batch by batch in the tasks, each first batch after a retry."""
    texts = star_table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    found = ingest.embedded(texts, _failing_once(), EngineConfig(dimension=3), backoff=(0.0,))
    return found.select("key", F.col("embedding")[0].cast("double").alias("length"), F.col("embedding")[1].cast("double").alias("spaces"))


@query("ref AS (SELECT 'p' || o_custkey AS id FROM orders UNION SELECT 'o' || (o_orderkey + 5) FROM orders), gone AS (SELECT id FROM ref WHERE id NOT IN (SELECT id FROM nodes)), ce AS (SELECT id, src_id, key FROM (SELECT edges.id, edges.src_id, valid_to, CAST(substr(edges.src_id, 2) AS BIGINT) AS key FROM edges WHERE type = 'LIVES_AT')) SELECT 'node' AS what, id FROM gone UNION ALL SELECT 'edge', id FROM ce WHERE key % 13 = 0 OR key % 5 = 0")
def stale_references(g, s, d):
    """What a batch refers to and is no longer so: nodes that are gone, edges that are closed or were read at another time."""
    orders = star_table(s, d, "orders")
    ids = orders.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id")).union(orders.select(F.concat(F.lit("o"), (F.col("o_orderkey") + 5).cast("string"))))
    homes = g.edges.where("type = 'LIVES_AT'").withColumn("key", F.expr("cast(substring(src_id, 2) as bigint)"))
    closing = homes.select("id", F.when(F.col("key") % 5 == 0, now()).otherwise(F.col("valid_from")).alias("valid_from"))
    return mutations.stale_nodes(g, ids).select(F.lit("node").alias("what"), "id").union(mutations.stale_edges(g, closing).select(F.lit("edge"), "id"))


@query(f"SELECT 'memory' AS kind, 'Order ' || o_orderkey || ' was noted' AS title, 'p' || o_custkey AS beside, CAST(length('Order ' || o_orderkey || ' was noted') AS DOUBLE) AS length FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def ingested(g, s, d):
    """An utterance whose extractor notes every order beside its customer; the first answer lacks the edges and is asked
    for again."""
    key = F.col("o_orderkey").cast("string")
    orders = star_table(s, d, "orders").join(star_table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    temp = F.concat(F.lit("new-"), key)
    creates = orders.select(temp.alias("temp_id"), F.lit("memory").alias("kind"), F.concat(F.lit("Order "), key, F.lit(" was noted")).alias("title"), F.lit(None).cast("timestamp").alias("occurred_at"))
    edges = orders.select(
        F.concat(F.lit("noted-"), key).alias("id"), temp.alias("src_id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("dst_id"), F.lit("KNOWS").alias("type"), F.create_map().cast("map<string,string>").alias("properties"),
        F.lit(1.0).alias("confidence"), now().alias("created_at"), now().alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )

    def extract(request: ingest.Request) -> ingest.Batch:
        return ingest.Batch(creates=creates, edges=edges if request.recheck else None)

    done = ingest.ingest(g.with_(nodes=g.nodes.withColumn("embedding", F.lit(None).cast("array<float>"))), "Every order was noted", lambda texts: [[float(len(t)), 0.0, 0.0] for t in texts], extract, occurred_at=NOW, at=now(), zone=ZONE, writer="agent-1", config=EngineConfig(dimension=3))
    made = done.graph.nodes.join(done.temp_ids.select("id"), "id")
    beside = done.graph.edges.where("type = 'KNOWS'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("beside"))
    return made.join(beside, "id").select("kind", "title", "beside", F.col("embedding")[0].cast("double").alias("length"))


_QUOTE = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(f"pr AS (SELECT a.doc_id, a.text, substr(CASE WHEN a.doc_id % 2 = 0 THEN a.text ELSE b.text END, 10, 30) AS said FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id AS seq FROM pr WHERE length({_QUOTE.format('said')}) < 8 OR NOT contains({_QUOTE.format('text')}, {_QUOTE.format('said')})")
def evidence_elsewhere(g, s, d):
    """Quotations of each document, every other one from the next document's text: those that its own does not have."""
    docs = star_table(s, d, "documents").select("doc_id", "text")
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    said = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("next"))
    claims = both.select(F.col("doc_id").alias("seq"), F.substring(said, 10, 30).alias("evidence"), "text")
    return C.evidence_failures(claims, F.col("text")).select("seq")


@query("SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'warning' WHEN 'click' THEN 'error' ELSE 'info' END AS level, '/nodes/' || user_id AS path, CAST(event_id % 1000 AS BIGINT) AS duration_ms FROM events")
def request_lines(g, s, d):
    """The log line of each request: level by status, the path without its query, milliseconds."""
    kind, key = F.col("event_type"), F.col("event_id")
    rows = star_table(s, d, "events").select(
        key.cast("string").alias("request_id"), F.lit("GET").alias("method"), F.concat(F.lit("/nodes/"), F.col("user_id").cast("string"), F.lit("?full=1")).alias("url"),
        F.when(kind == "error", 404).when(kind == "click", 503).otherwise(200).alias("status"), (key % 1000 / 1000.0).alias("seconds"),
    )
    return request_log(rows).select(F.col("request_id").cast("long").alias("id"), "level", "path", "duration_ms")
