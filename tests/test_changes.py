"""Batches, ingest, streams, configuration and approximate search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.config import Conflict, EngineConfig, InvalidRequest, NotFound, UnlinkedNode, UpstreamError, load_config, request_line
from kairograph.functions import time as TM
from kairograph.operators import candidates, ingest, mutations, recall, validation
from kairograph.sources.graph import current_version, load_snapshot, open_session, save_snapshot
from kairograph.streaming.changes import REQUEST_DDL, FanOut, stream
from tests.test_graph import NOW, NY, graph, ids, stamp  # noqa: F401


def at():
    return stamp(NOW)


CONFIG = EngineConfig(dimension=3)


def table(spark, ddl, *rows):
    text = spark.createDataFrame(list(rows), ", ".join(c.replace(" timestamp", " string").replace(" date", " string") for c in ddl.split(", ")))
    return text.select(*[F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in ddl.split(", ")])


EDGE = "id string, src_id string, dst_id string, type string, properties map<string,string>, confidence double, created_at timestamp, valid_from timestamp, valid_to timestamp"


def edge(spark, *ends):
    return table(spark, EDGE, *[(f"new-{a}-{b}", a, b, t, {}, 1.0, NOW, NOW, None) for a, b, t in ends])


def test_a_batch_is_swept_once_and_when_asked(graph, spark, monkeypatch):  # noqa: F811
    swept, real = [], mutations.orphans
    monkeypatch.setattr(mutations, "orphans", lambda *a: swept.append(a) or real(*a))
    done = mutations.apply(graph, at(), NY, closed_edges=table(spark, "id string", ("e2",)))
    assert {r.op: r.n for r in done.counts.collect()}["close_edge"] == 1 and not swept
    assert ids(done.orphans) == ["c"] and "c" not in ids(done.graph.nodes) and len(swept) == 1
    assert done.graph.edges.columns == graph.edges.columns


def test_a_sweep_reads_edges_once_and_new_edges_only_their_types(graph, spark):  # noqa: F811
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = plan(mutations.orphans(graph, graph.nodes.select("id")))
    assert "LeftAnti" not in found and found.count("Generate explode") == 1
    two = graph.with_(edges=edge(spark, ("a", "b", "KNOWS")).withColumn("type", F.lit("KNOWS")).union(edge(spark, ("a", "x", "LIVES_AT")).withColumn("type", F.lit("LIVES_AT"))))
    made = mutations.new_edges(two, edge(spark, ("a", "b", "KNOWS"), ("a", "y", "KNOWS")))
    assert ids(made) == ["new-a-y"] and "Union" not in plan(made)  # the branch of the other type is gone


def test_a_batch_in_order(graph, spark):  # noqa: F811
    creates = table(spark, "temp_id string, kind string, title string, occurred_at timestamp, agent_id string, birthday date, opens_on date, done boolean", ("n1", "person", "New Person", None, "w", "1990-05-01", None, None), ("n2", "task", "Read it", None, "w", None, "2026-11-12", True))
    spawns = table(spark, "temp_id string, hub_id string, title string, agent_id string, start_time string, place_id string", ("s1", "h", "lecture", "w", "10:20", "n3")).withColumn("dates", F.array(F.lit("2026-10-27").cast("date"), F.lit("2026-11-03").cast("date"))).drop("place_id")
    done = mutations.apply(graph, at(), NY, creates=creates, spawns=spawns, edges=edge(spark, ("a", "n1", "KNOWS"), ("h", "n2", "HAS_ITEM"), ("a", "b", "PARTICIPANT")), closed_edges=table(spark, "id string", ("e2",)), noops=table(spark, "id string", ("t1",)))
    counts = {r.op: r.n for r in done.counts.collect()}
    assert counts == {"create_node": 2, "update_node": 0, "close_node": 0, "create_edge": 2, "close_edge": 1, "spawn_plans": 1, "update_plans": 0, "noop": 1, "edge_exists": 1}
    assert ids(done.orphans) == ["c"] and "c" not in ids(done.graph.nodes)
    named = {r.temp_id: r.id for r in done.temp_ids.collect()}
    assert done.graph.persons.where(F.col("node_id") == named["n1"]).first().birthday.year == 1990
    assert done.graph.edges.where((F.col("src_id") == "a") & (F.col("dst_id") == named["n1"])).count() == 1
    sessions = [r.occurred_at.hour for r in done.graph.nodes.join(done.spawned.select("id"), "id").orderBy("occurred_at").collect()]
    assert sessions == [14, 15]  # over a change of the clock
    assert done.graph.nodes.where("id = 'h' and verified_at is not null").count() == 1
    with pytest.raises(Conflict):
        mutations.apply(graph, at(), NY, closed_edges=table(spark, "id string, valid_from timestamp", ("e2", "2020-01-01 00:00:00")))
    with pytest.raises(Conflict):
        mutations.apply(graph, at(), NY, closed_nodes=table(spark, "id string", ("nobody",)))


def test_sessions_are_edited_together(graph, spark):  # noqa: F811
    spawns = table(spark, "temp_id string, hub_id string, title string, agent_id string, start_time string, end_time string", ("s1", "h", "lecture", "w", "10:20", "11:40")).withColumn("dates", F.array(*[F.lit(x).cast("date") for x in ("2026-10-27", "2026-11-03", "2026-11-10")]))
    held = mutations.apply(graph, at(), NY, spawns=spawns).graph
    moved, changed, _ = mutations.edit_sessions(held, table(spark, "seq int, hub_id string, from_date date, start_time string, rsvp string", (1, "h", "2026-11-01", "11:00", None), (2, "h", "2026-11-10", None, "yes")), at(), NY)
    rows = moved.nodes.join(moved.plans, F.col("id") == F.col("node_id")).where("title = 'lecture'").orderBy("occurred_at").collect()
    assert [(r.occurred_at.strftime("%d %H:%M"), r.end_at.strftime("%H:%M"), r.rsvp) for r in rows] == [("27 14:20", "15:40", None), ("03 16:00", "17:20", None), ("10 16:00", "17:20", "yes")]
    assert changed.count() == 2
    after = mutations.apply(held, at(), NY, session_edits=table(spark, "seq int, hub_id string, from_date date, close boolean", (1, "h", "2026-11-05", True)))
    assert after.sessions.count() == 1 and after.graph.history.where("field = 'deleted' and old_value = 'lecture'").count() == 1
    with pytest.raises(InvalidRequest):
        mutations.edit_sessions(held, table(spark, "seq int, hub_id string, from_date date, close boolean", (1, "h", "2027-01-01", True)), at(), NY)


def test_all_day_patches_move_to_midnight(graph, spark):  # noqa: F811
    after = mutations.update_nodes(graph, table(spark, "id string, all_day boolean", ("b", True)), at(), NY)
    assert after.nodes.where("id = 'b'").first().occurred_at.strftime("%Y-%m-%d %H:%M") == "2026-11-12 05:00"
    assert [r.field for r in after.history.collect()] == ["occurred_at"]


def test_marks_by_hand(graph, spark):  # noqa: F811
    after = mutations.mark_attended(graph, table(spark, "id string, attended boolean", ("b", True)), at())
    assert {r.node_id: r.attended for r in after.plans.collect()} == {"b": True, "w": None}
    with pytest.raises(NotFound):
        mutations.mark_attended(graph, table(spark, "id string, attended boolean", ("nobody", True)), at())
    with pytest.raises(InvalidRequest):
        mutations.mark_tasks(graph, table(spark, "id string, done boolean", ("b", True)), at())
    with pytest.raises(InvalidRequest):
        mutations.verify_by_hand(graph, table(spark, "id string", ("a",)), at())


def test_broken_rules_are_named(graph, spark):  # noqa: F811
    found = validation.violations(graph, NY, edges_=edge(spark, ("a", "nobody", "KNOWS")), noops=table(spark, "id string", ("b",)))
    assert {(r.op, r.rule) for r in found.collect()} == {("create_edge", "dst is no node"), ("noop", "not a task")}
    with pytest.raises(InvalidRequest, match="dst is no node"):
        validation.require_valid(found)
    assert validation.violations(graph, NY).isEmpty()


def embed(texts):
    return [[1.0, 0.0, float(len(t) % 3)] for t in texts]


def test_ingest_asks_again_once_and_applies(graph, spark):  # noqa: F811
    creates = table(spark, "temp_id string, kind string, title string, body string, occurred_at timestamp", ("m1", "memory", "New fact", None, None))
    seen = []

    def extract(request):
        seen.append(request)
        return ingest.Batch(creates=creates, edges=None if request.recheck is None else edge(spark, ("a", "m1", "ABOUT")))

    done = ingest.ingest(graph, "Torben said a new fact about it today", embed, extract, occurred_at=NOW, at=at(), zone=NY, writer="w", config=CONFIG, participants=("a",))
    assert len(seen) == 2 and seen[0].recheck is None and "New fact" in seen[1].recheck and seen[0].occurred_at == "2026-11-12T07:00:00-05:00"
    assert "a" in ids(seen[0].nodes)
    made = done.graph.nodes.where("title = 'New fact'").first()
    assert made.agent_id == "w" and list(made.embedding) == embed(["New fact"])[0] and {r.op: r.n for r in done.counts.collect()}["create_edge"] == 1
    with pytest.raises(UnlinkedNode):
        ingest.ingest(graph, "a new fact of today", embed, lambda r: ingest.Batch(creates=creates), occurred_at=NOW, at=at(), zone=NY, writer="w", config=CONFIG)
    with pytest.raises(InvalidRequest, match="participant"):
        ingest.ingest(graph, "a new fact of today", embed, extract, occurred_at=NOW, at=at(), zone=NY, writer="w", config=CONFIG, participants=("x",))
    closing = ingest.Batch(closed_nodes=table(spark, "id string, evidence string", ("c", "words nobody said")))
    with pytest.raises(InvalidRequest, match="evidence"):
        ingest.ingest(graph, "a new fact of today", embed, lambda r: closing, occurred_at=NOW, at=at(), zone=NY, writer="w", config=CONFIG)


def test_lookalikes_that_were_shown_are_no_news(graph, spark):  # noqa: F811
    news = candidates.news_of(table(spark, "temp_id string, kind string, title string, occurred_at timestamp", ("n", "plan", "advising", "2026-11-12 18:00:00")), None)
    assert ids(candidates.lookalikes(graph, news, at(), NY)) == ["b"]
    assert ids(candidates.lookalikes(graph, news, at(), NY, table(spark, "id string", ("b",)))) == []


def test_prompt_files_are_joined(tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name * 2)
    assert ingest.read_prompt(str(tmp_path / "a"), str(tmp_path / "b")) == "aa\n---\n\nbb"


def test_session_settings(spark):
    assert open_session(spark_sql_shuffle_partitions="4").conf.get("spark.sql.session.timeZone") == "UTC"


def test_retry_and_vectors():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise UpstreamError("later", 503 if len(calls) == 1 else None)
        return "well"

    assert ingest.with_retry(flaky, sleep=slept.append) == "well" and slept == [0.5, 1.0]
    with pytest.raises(UpstreamError):
        ingest.with_retry(lambda: (_ for _ in ()).throw(UpstreamError("no", 400)), sleep=slept.append)
    assert len(slept) == 2
    sizes = []
    assert len(ingest.embed_all(lambda t: sizes.append(len(t)) or embed(t), ["x"] * 130, 3)) == 130 and sizes == [64, 64, 2]
    with pytest.raises(UpstreamError):
        ingest.embed_all(lambda t: [[1.0]], ["x"], 3)


def test_recall_tells_details_and_courses(graph, spark):  # noqa: F811
    verified = mutations.verify_tasks(graph, table(spark, "id string", ("t1",)), at())
    got = recall.recall(verified, at(), NY, EngineConfig(), start_ids=["h"], hops=1)
    rows = {r.id: r for r in got.nodes.collect()}
    assert rows["t1"].closes_local == "Wed 2026-11-18 23:59" and rows["t1"].opens_local == "Tue 2026-11-10" and rows["t1"].bucket == "upcoming" and rows["t1"].owner == "keeper"
    course = got.courses.first()
    assert course.title == "GEO 12 class" and course.verified_today and course.owner == "keeper"
    plan = recall.recall(graph, at(), NY, EngineConfig(), start_ids=["b"]).nodes.first()
    assert plan.starts_local == "Thu 2026-11-12 12:00" and plan.ends_local is None
    assert [r.id for r in got.anchors.collect()] == ["h"]


def test_local_iso(spark):
    for zone, want in ((NY, "2026-11-12T07:00:00-05:00"), ("Asia/Kolkata", "2026-11-12T17:30:00+05:30"), ("UTC", "2026-11-12T12:00:00+00:00")):
        assert spark.range(1).select(TM.local_iso(at(), zone).alias("x")).first().x == want


def test_configuration(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[page]\ndefault_size = 20\n[recall.weights]\nsemantic = 0.5\n[other]\nx = 'y'\n")
    config, zone = load_config(str(path), {"TZ": NY})
    assert (config.page_default, config.weights, zone) == (20, {"semantic": 0.5}, NY)
    for text, env in (("[page]\nodd = 1\n", {"TZ": NY}), ("[page]\ndefault_size = 'a'\n", {"TZ": NY}), ("[page]\ndefault_size = 900\n", {"TZ": NY}), ("", {"TZ": "Nowhere"}), ("", {})):
        path.write_text(text)
        with pytest.raises(ValueError):
            load_config(str(path), env)
    assert request_line("r1", "GET", "/x?y=1", 404, 0.0123) == ("warning", {"request_id": "r1", "method": "GET", "path": "/x", "status": 404, "duration_ms": 12})
    assert NotFound("it").body() == {"error": {"type": "not_found", "message": "it"}}


def test_stream_tells_all_subscribers(spark, tmp_path):
    told, failing = [], []
    fan = FanOut(spark, f"file://{tmp_path}/checkpoint")
    stop = fan.subscribe(lambda c: told.append(c.n))
    fan.subscribe(lambda c: failing.append(c.n) or 1 / 0)
    log = f"file://{tmp_path}/log"
    rows = [("2026-01-01", "GET", "/counts", 200), ("2026-01-01", "POST", "/ingest", 200), ("2026-01-02", "POST", "/recall?x=1", 200), ("2026-01-02", "PUT", "/tasks/done", 200)]
    for part in (rows, rows[:1], rows[1:2]):
        table(spark, REQUEST_DDL, *part).coalesce(1).write.mode("append").parquet(log)
        query = stream(spark, log, f"file://{tmp_path}/checkpoint", fan)
        query.processAllAvailable()
        query.stop()
    assert told == [2, 1] and failing == [2]
    stop()
    assert not fan._held


def test_of_two_writers_one_wins(graph, spark, tmp_path):  # noqa: F811
    root = f"file://{tmp_path}/snap"
    assert save_snapshot(graph, root) == 1 and current_version(spark, root) == 1
    with pytest.raises(Conflict):
        save_snapshot(graph, root, expected=0)
    assert save_snapshot(graph, root, expected=1) == 2
    assert sorted(ids(load_snapshot(spark, root, 1).nodes)) == sorted(ids(load_snapshot(spark, root).nodes))


def test_planted_notes_are_told_from_stored_texts(spark):
    """A stored text with a telling wording is a finding of the report, and none of the query on planted notes."""
    from kairograph.plans import registry

    d = "/root/testdata/sf0.001"
    g = registry.graph(spark, d)
    worded = g.with_(nodes=g.nodes.withColumn("body", F.when(F.col("id") == "d3", "on the branch").otherwise(F.col("body"))))
    from kairograph.operators import lint
    from kairograph.plans.changes import _rule

    assert "d3" in {i for r in lint.working_note(worded, at(), NY).collect() for i in r.node_ids}
    assert {r.node_ids[0] for r in _rule("working_note")(worded, spark, d).collect()} == {"w"}


def test_a_recheck_of_many_nodes_names_a_few(graph, spark):  # noqa: F811
    """What an extractor is told stays short; the table of loose nodes beside it is whole, and so are lookalikes given as a table."""
    creates = spark.range(3000).selectExpr("concat('m', id) as temp_id", "'memory' as kind", "concat('Fact ', lpad(id, 5, '0')) as title", "cast(null as string) as body", "cast(null as timestamp) as occurred_at")
    seen = []

    def extract(request):
        seen.append(request)
        return ingest.Batch(creates=creates)

    with pytest.raises(UnlinkedNode, match="3000 in all") as e:
        ingest.ingest(graph, "Torben said new facts today", embed, extract, occurred_at=NOW, at=at(), zone=NY, writer="w", config=CONFIG)
    assert len(str(e.value)) < 1000 and len(seen[1].recheck) < 1000 and '"Fact 00000"' in seen[1].recheck and seen[1].loose.count() == 3000
    found = candidates.candidates(graph, "nothing", [], "nobody", table(spark, "id string", ("c",), ("x",)), at(), CONFIG)
    assert "c" in ids(found) and "x" not in ids(found)
