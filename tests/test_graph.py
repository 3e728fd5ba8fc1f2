"""Operators on a small graph."""

import pytest
from pyspark.sql import functions as F

from kairograph.config import EngineConfig, InvalidRequest, NotFound
from kairograph.operators import lint, mutations, planner, reads, recall
from kairograph.sources.graph import DDL, Graph, integrity, load_snapshot, save_snapshot
from kairograph.streaming.changes import REQUEST_DDL, change_events

NY = "America/New_York"


def stamp(text):
    return F.lit(text).cast("timestamp")


NOW = "2026-11-12 12:00:00"


@pytest.fixture(scope="module")
def graph(spark):
    def nodes(rows):
        full = [(i, k, t, b, None, o, e, None, 0, None, "agent", "keeper", "2026-01-01 00:00:00", "2026-01-01 00:00:00") for i, k, t, b, o, e in rows]
        raw = spark.createDataFrame(full, ", ".join(c.replace("timestamp", "string") for c in DDL["nodes"].split(", ")))
        return raw.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in DDL["nodes"].split(", ")])

    n = nodes([
        ("a", "person", "Torben Alder", None, None, None), ("b", "plan", "Advising", None, "2026-11-12 17:00:00", None), ("c", "memory", "Fact", "as of today", None, None),
        ("x", "memory", "Gone", None, None, "2026-11-01 00:00:00"), ("y", "memory", "Behind", None, None, None), ("h", "memory", "GEO 12 class", None, None, None),
        ("t1", "task", "HW 3", None, None, None), ("t2", "task", "HW 4", None, None, None), ("w", "plan", "Trip", None, "2026-11-03 00:00:00", None),
    ])
    edges = [("e1", "a", "b", "PARTICIPANT"), ("e2", "b", "c", "HAS_NOTE"), ("e3", "a", "x", "ABOUT"), ("e4", "x", "y", "ABOUT"), ("e5", "h", "t1", "HAS_ITEM"), ("e6", "h", "t2", "HAS_ITEM"), ("e7", "a", "a", "ODD")]
    e = spark.createDataFrame([(*x, {}, 1.0 if x[0] != "e2" else 0.5) for x in edges], "id string, src_id string, dst_id string, type string, properties map<string,string>, confidence double")
    e = e.withColumn("created_at", stamp("2026-01-01 00:00:00")).withColumn("valid_from", F.col("created_at")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    plans = spark.createDataFrame([("b", None, False, None, None, None), ("w", "2026-11-08 00:00:00", False, None, None, None)], "node_id string, end_at string, all_day boolean, time_zone string, rsvp string, attended boolean").withColumn("end_at", F.col("end_at").cast("timestamp"))
    tasks = spark.createDataFrame([("t1", "2026-11-10", "2026-11-19 04:59:00", False), ("t2", "2026-11-13", None, False)], "node_id string, opens_on string, closes_at string, done boolean")
    tasks = tasks.select("node_id", F.col("opens_on").cast("date"), F.col("closes_at").cast("timestamp"), "done", F.lit(None).cast("timestamp").alias("task_verified_at"))
    empty = lambda name: spark.createDataFrame([], DDL[name])
    persons = spark.createDataFrame([("a", None, ["tor"])], DDL["persons"])
    return Graph(n, e, persons, plans, tasks, empty("places"), empty("history"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_reads(graph):
    now = stamp(NOW)
    assert {r.kind: r.n for r in reads.counts(graph, now).collect()} == {"person": 1, "memory": 3, "plan": 2, "place": 0, "task": 2, "total": 8}
    assert ids(reads.filter_nodes(graph, now, NY, relevant_on="2026-11-12")) == ["t1"]
    assert ids(reads.filter_nodes(graph, now, NY, name="TOR")) == ["a"]
    assert ids(reads.filter_nodes(graph, now, NY, name="to")) == []
    assert ids(reads.filter_nodes(graph, now, NY, occurred_from="2026-11-05", occurred_to="2026-11-06")) == ["w"]
    assert ids(reads.resolve_hubs(graph, "GEO 12", now)) == ["h"]
    with pytest.raises(InvalidRequest):
        reads.resolve_hubs(graph, "GEO 1", now)
    with pytest.raises(InvalidRequest):
        reads.filter_nodes(graph, now, NY)
    with pytest.raises(NotFound):
        reads.node(graph, "none")
    assert integrity(graph).isEmpty()


def test_expired_nodes_are_no_bridge(graph):
    start = graph.nodes.where("id = 'a'").select("id")
    found = {r.id: (r.hop, r.confidence) for r in recall.walk(graph, start, 2, stamp(NOW)).collect()}
    assert found == {"a": (0, 1.0), "b": (1, 1.0), "x": (1, 1.0), "c": (2, 0.5)}


def test_recall_from(graph):
    got = recall.recall(graph, stamp(NOW), NY, EngineConfig(), start_ids=["a"], hops=1)
    assert [r.id for r in got.nodes.collect()] == ["a", "b"]
    assert got.coverage is None and got.sufficient is None
    with pytest.raises(InvalidRequest):
        recall.recall(graph, stamp(NOW), NY, EngineConfig(), start_ids=["a"], hops=9)


def test_planner_and_lint(graph):
    now = stamp(NOW)
    assert ids(planner.plans(graph, "2026-11-12 05:00:00", "2026-11-13 05:00:00", now)) == ["b"]
    assert ids(planner.day_tasks(graph, "2026-11-12", now, NY)) == ["t1"]
    found = {(r.rule, tuple(r.node_ids)) for r in lint.report(graph, now, NY).collect()}
    assert ("status_snapshot", ("c",)) in found and ("noon_placeholder", ("b",)) in found and ("unknown_edge_type", ("a",)) in found
    assert ("unaliased_person", ("a",)) in found and ("floating", ("w",)) in found


def test_changes(graph, spark, tmp_path):
    now = stamp(NOW)
    after = mutations.close_nodes(graph, spark.createDataFrame([("c",)], "id string"), now)
    assert "c" not in ids(after.nodes) and after.edges.where("id = 'e2' and valid_to is not null").count() == 1
    assert after.history.select("field", "old_value").collect() == [("deleted", "Fact")]
    assert ids(mutations.orphans(after, graph.nodes.select("id"))) == []
    wanted = graph.edges.where("id = 'e1'").withColumn("id", F.lit("new"))
    assert mutations.new_edges(graph, wanted).isEmpty()
    assert ids(mutations.new_edges(graph, wanted.withColumn("properties", F.create_map(F.lit("k"), F.lit("v"))))) == ["new"]
    root = f"file://{tmp_path}/snap"
    assert save_snapshot(graph, root) == 1
    assert load_snapshot(spark, root).edges.count() == 7


def test_change_events(spark):
    rows = [("2026-01-01", "GET", "/counts", 200), ("2026-01-01", "POST", "/recall", 200), ("2026-01-01", "POST", "/ingest", 422), ("2026-01-01", "POST", "/ingest", 200)]
    requests = spark.createDataFrame(rows, REQUEST_DDL.replace("timestamp", "string"))
    assert change_events(requests).count() == 1


def test_word_ends_are_those_of_ascii_letters(graph, spark):
    """A pattern's word may begin after any other letter, as in the SQL's patterns."""
    texts = {"c": "se ñdom é", "y": "se dómo", "h": "sedom a"}
    body = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[F.col("id")]
    found = lint.working_note(graph.with_(nodes=graph.nodes.withColumn("body", body)), stamp(NOW), NY)
    assert [list(r.node_ids) for r in found.collect()] == [["c"]]
