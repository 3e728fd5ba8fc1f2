"""The vector index, durable fan-out, series, migrations, journals, and what stored tables are left behind."""

import os
import subprocess
import sys
import time
import tracemalloc
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairograph.config import Conflict, EngineConfig, InvalidRequest, UpstreamError
from kairograph.operators import candidates, ingest, migrations, mutations, recall, series, vector_index
from kairograph.operators.journal import AccessLog, Journal, history_journal
from kairograph.plans import registry
from kairograph.sources import graph as G
from kairograph.streaming.changes import REQUEST_DDL, FanOut, stream
from tests.test_changes import table
from tests.test_graph import NOW, NY, graph, ids, stamp  # noqa: F401

SF = "/root/testdata/sf0.01"
CONFIG = EngineConfig(dimension=3)


def at():
    return stamp(NOW)


# vector index


def clustered(spark, n, dimension=64, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, dimension))
    vectors = (centre[rng.integers(0, 60, n)] + 0.6 * rng.normal(size=(n, dimension))).astype(np.float32)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"id": range(n), "embedding": list(vectors.tolist())}), "id long, embedding array<float>")
    return vectors, rows


def truth(vectors, keys, limit):
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in keys:
        score = np.round(unit @ unit[q], 6)
        score[q] = -9
        out[q] = np.argsort(-score, kind="stable")[:limit].tolist()
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    vectors, rows = clustered(spark, 12_000)
    root = f"file://{tmp_path_factory.mktemp('vectors')}"
    return vectors, rows, vector_index.opened(rows, root, 64), root


def test_recall_and_bytes(index):
    vectors, rows, held, _ = index
    assert held.count() == len(vectors)
    asked = rows.where("id % 20 = 0")
    found, want = by_query(vector_index.search(held, asked, 12, 10)), truth(vectors, range(0, len(vectors), 20), 10)
    assert np.mean([len(set(found[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.9
    share = [r.share for r in vector_index.read_share(held, asked, 12).collect()]
    assert len(share) == len(want) and np.mean(share) <= 0.2


def test_exact_in_tiles(index, monkeypatch):
    vectors, rows, _, _ = index
    monkeypatch.setattr(vector_index, "TILE_ROWS", 1500)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 50)
    assert by_query(vector_index.exact(rows, rows.where("id % 40 = 0"), 10)) == truth(vectors, range(0, len(vectors), 40), 10)


def test_small_tiles_change_nothing(index, monkeypatch):
    _, rows, held, _ = index
    asked = rows.where("id % 60 = 0")
    want = by_query(vector_index.search(held, asked, 6, 5))
    monkeypatch.setattr(vector_index, "TILE_ROWS", 100)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 20)
    assert by_query(vector_index.search(held, asked, 6, 5)) == want


def bytes_read(spark):
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in stats if s.getScheme() == "file")


def test_a_search_reads_few_bytes(spark, index):
    """What the file system hands out for one query, all footers and ids included, against the vectors' bytes."""
    vectors, rows, held, root = index
    query = spark.createDataFrame([(-1, vectors[777].tolist())], "id long, embedding array<float>")
    vector_index.search(held, query, 6, 10).collect()
    whole = vectors.nbytes
    before = bytes_read(spark)
    found = by_query(vector_index.search(held, query, 6, 10))
    assert found[-1][0] == 777
    assert bytes_read(spark) - before <= 0.2 * whole


def test_opened_again_and_by_two(spark, index):
    vectors, rows, held, root = index
    again = vector_index.opened(rows.limit(0), root)
    assert again.sizes == held.sizes and np.array_equal(again.quantiser.entries, held.quantiser.entries)
    asked = rows.where("id = 40")
    first = vector_index.search(held, asked, 6, 3)
    vector_index.search(again, asked, 6, 3).collect()
    assert first.count() == 3  # nobody has overwritten what it reads


def test_a_hot_vector_and_odd_rows(spark, tmp_path):
    same = [1.0, 2.0, 3.0, 4.0, 5.0]
    rng = np.random.default_rng(1)
    rows = [(i, same) for i in range(700)] + [(i, rng.normal(size=5).tolist()) for i in range(700, 1000)] + [(1000, None), (1001, []), (1002, [1.0, 2.0]), (1003, [1.0, None, 2.0, 3.0, 4.0]), (1004, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    held = vector_index.opened(df, f"file://{tmp_path}/hot", 8)
    assert held.count() == 1001
    found = by_query(vector_index.search(held, df.where("id in (650, 1000, 1001, 1002)"), 8, 10))
    assert found == {650: list(range(10))}
    assert by_query(vector_index.exact(df, df.where("id = 650"), 10)) == {650: list(range(10))}
    none = vector_index.opened(df.limit(0), f"file://{tmp_path}/none", 8)
    assert vector_index.search(none, df.where("id < 3"), 8, 10).collect() == []
    assert vector_index.exact(df.limit(0), df.where("id < 3"), 10).collect() == []


def test_a_task_of_the_vector_search_holds_a_bounded_part_of_the_scores(monkeypatch):
    column = pa.array([[1.0, 0.0], None, [3.0, None], [0.0, 2.0], [1.0], [], [0.6, 0.8]], pa.list_(pa.float32()))
    at, unit = vector_index._known(column.slice(1), 2)
    assert at.tolist() == [2, 5] and np.allclose(unit, [[0, 1], [0.6, 0.8]])
    at, unit = vector_index._known(column.slice(1, 2), 2)
    assert at.tolist() == [] and unit.shape == (0, 2)
    monkeypatch.setattr(vector_index, "SCORES", 1000)
    batch = pa.record_batch([pa.array(range(64))], ["id"])
    parts = list(vector_index._slices([batch], 100))
    assert {p.num_rows for p in parts} == {10, 4} and pa.Table.from_batches(parts).column("id").to_pylist() == list(range(64))
    rng = np.random.default_rng(5)
    index = vector_index.Quantiser(vector_index._unit(rng.normal(size=(400, 64)).astype(np.float32)), np.zeros((32, 256, 2), np.float32))
    points = vector_index._unit(rng.normal(size=(10_000, 64)).astype(np.float32))
    assert (index.cells(points[:50], 1) == index.cells(points[:50], 400)[:, :1]).all()
    tracemalloc.start()
    index.cells(points, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 10_000 * 400 * 4  # products and their negatives, no sorted places besides



# fan-out


def requests(spark, path, n, begin=0):
    rows = [(f"2026-11-01 00:{(begin + k) // 60:02d}:{(begin + k) % 60:02d}", "POST", "/ingest", 200) for k in range(n)]
    table(spark, REQUEST_DDL, *rows).coalesce(1).write.mode("append").parquet(path)


RUN = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from kairograph.streaming.changes import FanOut, stream
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
fan = FanOut(spark, {checkpoint!r})
told = open({told!r}, "a")
def note(change):
    told.write(f"{{change.batch}} {{change.n}}\\n")
    told.flush()
    if {stop} == change.batch:
        os._exit(9)  # after it was told, before that is written down
fan.subscribe(note, "screen")
stream(spark, {log!r}, {checkpoint!r}, fan, files=1, until_now=True).awaitTermination()
spark.stop()
"""


def process(tmp_path, stop=-1):
    """One process that listens until all is read; the lines it has noted."""
    values = {"repo": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "checkpoint": f"file://{tmp_path}/checkpoint", "told": f"{tmp_path}/told", "log": f"file://{tmp_path}/log", "stop": stop}
    done = subprocess.run([sys.executable, "-c", RUN.format(**values)], capture_output=True, text=True, timeout=300)
    with open(f"{tmp_path}/told") as f:
        return done.returncode, [tuple(map(int, line.split())) for line in f]


def test_processes_tell_each_batch_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    requests(spark, log, 3)
    requests(spark, log, 4, 10)
    assert process(tmp_path) == (0, [(0, 3), (1, 4)])
    assert process(tmp_path) == (0, [(0, 3), (1, 4)])
    requests(spark, log, 5, 20)
    assert process(tmp_path) == (0, [(0, 3), (1, 4), (2, 5)])
    requests(spark, log, 6, 30)
    code, told = process(tmp_path, stop=3)
    assert code != 0 and told[-1] == (3, 6)
    assert process(tmp_path)[1] == [(0, 3), (1, 4), (2, 5), (3, 6), (3, 6)]  # ended between telling and writing down: its number shows it


def test_who_was_away_is_told_later(spark, tmp_path):
    log, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"
    requests(spark, log, 2)
    here, away, loose = [], [], []
    fan = FanOut(spark, checkpoint)
    fan.subscribe(lambda c: here.append(c.n), "here")
    stop = fan.subscribe(lambda c: away.append(c.n), "away")
    fan.subscribe(lambda c: loose.append(c.n))
    run = lambda sink: stream(spark, log, checkpoint, sink, files=1, until_now=True).awaitTermination()
    run(fan)
    stop()
    requests(spark, log, 3, 5)
    run(fan)
    fan = FanOut(spark, checkpoint)  # begun again
    fan.subscribe(lambda c: here.append(c.n), "here")
    assert (here, away, loose) == ([2, 3], [2], [2, 3])
    fan.subscribe(lambda c: 1 / 0, "away")  # fails, so it is not written down
    fan.subscribe(lambda c: away.append(c.n), "away")
    assert away == [2, 3]
    late: list = []
    fan.subscribe(lambda c: late.append(c.n), "late")
    fan.forget("away")
    assert late == [] and sorted(FanOut(spark, checkpoint)._places) == ["here", "late"]
    fan = FanOut(spark, f"file://{tmp_path}/checkpoint-2")  # another stream over the same log begins at its own start
    fan.subscribe(lambda c: late.append(c.n), "here")
    stream(spark, log, f"file://{tmp_path}/checkpoint-2", fan, until_now=True).awaitTermination()
    assert late == [5]
    beats: list = []
    fan.subscribe(lambda c: None, alive=lambda: beats.append(1))
    fan.subscribe(lambda c: None, alive=lambda: 1 / 0)
    fan.beat()
    fan.beat()
    assert beats == [1, 1] and len(fan._held) == 2
    with pytest.raises(InvalidRequest):
        fan.subscribe(lambda c: None, "a/b")


# series


def plain_dates(first, freq, every=1, days=None, times=None, until=None, skipped=(), horizon=None):
    out, day, monday = [], first, first - timedelta(first.weekday())
    end = until or horizon
    while times is None and end and day <= end or times is not None and len(out) < times and (until is None or day <= until):
        months = (day.year - first.year) * 12 + day.month - first.month
        hit = {"DAILY": (day - first).days % every == 0, "WEEKLY": (day - monday).days // 7 % every == 0 and day.isoweekday() in (days or [first.isoweekday()]), "MONTHLY": day.day == first.day and months % every == 0}
        if hit[freq]:
            out.append(day)
        day += timedelta(1)
    return [d for d in out if d not in skipped]


SERIES_DDL = "id string, hub_id string, title string, first date, freq string, every int, days array<int>, times int, until date, skipped array<date>, start_time string, time_zone string, day string"


def test_series_dates(spark):
    rows = []
    for i, first in enumerate((date(2026, 1, 31), date(2024, 2, 29), date(2026, 10, 28), date(2026, 12, 30))):
        for freq in ("DAILY", "WEEKLY", "MONTHLY"):
            for every in (1, 2, 5, 12):
                for k, (times, until) in enumerate(((3, None), (None, first + timedelta(200)), (9, first + timedelta(40)), (0, None), (None, None), (None, first - timedelta(2)))):
                    days = [1, 5, 7] if k % 2 else None
                    rows.append((f"{i}{freq}{every}.{k}", None, "t", first, freq, every, days, times, until, [first, first + timedelta(28)] if k < 2 else None, "10:20", None, "x"))
    found: dict = {}
    horizon = date(2026, 12, 31)
    for r in series.occurrences(spark.createDataFrame(rows, SERIES_DDL), NY, F.lit("2026-12-31").cast("date")).orderBy("id", "number").collect():
        found.setdefault(r.id, []).append(r.day)
    for r in rows:
        assert found.get(r[0], []) == plain_dates(*r[3:6], r[6], r[7], r[8], r[9] or (), horizon), r


def test_series_are_written_out_once_and_taken_back(graph, spark):  # noqa: F811
    rule = spark.createDataFrame([("s", "h", "lecture", date(2026, 10, 27), "WEEKLY", 1, None, 3, None, [date(2026, 11, 3)], "10:20", None, "x")], SERIES_DDL)
    once = series.write_out(graph, rule, at(), NY)
    twice = series.write_out(once, rule, at(), NY)
    made = twice.nodes.where("title = 'lecture'").orderBy("occurred_at").collect()
    assert [r.occurred_at for r in made] == [datetime(2026, 10, 27, 14, 20), datetime(2026, 11, 10, 15, 20)]  # over a change of the clock
    assert twice.nodes.count() == graph.nodes.count() + 2 and twice.edges.count() == graph.edges.count() + 2
    written = series.members(rule, NY)
    back = series.take_back(series.take_back(twice, written, at()), written, at())
    assert ids(back.nodes) == ids(graph.nodes)
    assert back.history.where("old_value = 'lecture' and field = 'deleted' and source = 'manual'").count() == 2
    assert back.edges.where("valid_to is null").count() == graph.edges.where("valid_to is null").count()
    with pytest.raises(InvalidRequest):
        series.write_out(graph, rule.drop("freq"), at(), NY)


def test_written_plans_are_looked_up_by_bytes_where_there_are_any(graph, spark):  # noqa: F811
    """A first run joins nothing; later ones look ids up by 32 bytes, and an id in other letters holds no plan back."""
    rule = spark.createDataFrame([("s", "h", "lecture", date(2026, 10, 27), "WEEKLY", 1, None, 3, None, None, "10:20", None, "x")], SERIES_DDL)
    once = series.write_out(graph, rule, at(), NY)
    assert "Join" not in once.nodes.select("id")._jdf.queryExecution().optimizedPlan().toString()
    plans = once.nodes.where("title = 'lecture'")
    for change, n in ((F.upper("id"), 3), (F.regexp_replace("id", ".$", "é"), 3), (F.col("id"), 0)):
        held = graph.with_(nodes=graph.nodes.unionByName(plans.withColumn("id", change)))
        assert series.write_out(held, rule, at(), NY).nodes.count() == held.nodes.count() + n
        keys = plans.select(change.alias("id")).select("id", series.id_key(F.col("id")).alias("k"))
        assert keys.where(series.id_of(F.col("k")) == F.col("id")).count() == 3
    assert {len(r[0]) for r in plans.select(series.id_key(F.col("id"))).collect()} == {32}
    longer = rule.withColumn("times", F.lit(5))
    later = series.write_out(once, longer, at(), NY)
    assert sorted(ids(later.nodes)) == sorted(ids(series.write_out(graph, longer, at(), NY).nodes))
    assert later.plans.count() == graph.plans.count() + 5


def test_what_is_no_plan_any_more_is_not_closed(graph, spark):  # noqa: F811
    """Its edges are not looked for, so a second run shuffles none."""
    loose = graph.edges.limit(1).withColumns({"id": F.lit("loose"), "src_id": F.lit("none"), "dst_id": F.lit("nobody"), "valid_to": F.lit(None).cast("timestamp")})
    plan = graph.nodes.where("kind = 'plan'").first().id
    held = graph.with_(edges=graph.edges.unionByName(loose))
    ends = held.edges.where(F.col("src_id").eqNullSafe(plan) | F.col("dst_id").eqNullSafe(plan)).where("valid_to is null").count()
    open_ = held.edges.where("valid_to is null").count()
    back = series.take_back(held, table(spark, "series_id string, node_id string", ("s", "none"), ("s", plan), ("s", plan)), at())
    called = migrations.close_cancelled(held, table(spark, "node_id string, status string", ("none", "cancelled"), (plan, "cancelled")), at())
    for after in (back, called):
        assert "loose" in ids(after.edges.where("valid_to is null")) and after.edges.count() == held.edges.count()
        assert after.edges.where("valid_to is null").count() == open_ - ends and plan not in ids(after.nodes)
        assert after.history.where("field = 'deleted'").count() == 1


# migrations


def test_the_first_rule_decides_and_ties_go_to_the_least_kind(spark):
    facts = spark.createDataFrame([("a", "title", "CSE 300 lab"), ("a", "item", "quiz"), ("a", "item", "quiz"), ("b", "title", "x"), ("c", "item", "quiz"), ("c", "item", "lab"), ("d", "title", "both")], "id string, field string, value string")
    rules = [*migrations.PLAN_RULES, (9, "zebra", 1, "title", "both"), (9, "ant", 1, "title", "both"), (9, "bee", 1, "title", "both"), (9, "bee", 1, "title", "never")]
    found = {r.id: r.kind for r in migrations.classify(facts, migrations.rules_table(spark, rules)).collect()}
    assert found == {"a": "exam", "c": "lab", "d": "ant"}
    assert migrations.classify(facts.limit(0), migrations.rules_table(spark)).count() == 0


def test_archives_that_differ_or_do_not_exist(spark, tmp_path):
    one, two, none = (f"file://{tmp_path}/{n}" for n in ("one", "two", "none"))
    spark.createDataFrame([("a", "tentative", 1)], "node_id string, STATUS string, extra int").write.parquet(one)
    spark.createDataFrame([("b",)], "node_id string").write.parquet(two)
    spark.createDataFrame([("c", "tentative")], "node_id string, status string").write.mode("append").parquet(two)
    columns = {"node_id": "string", "status": "string"}
    found = migrations.archived(spark, [one, none, two], columns)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "tentative"), ("b", None), ("c", "tentative")]
    assert migrations.archived(spark, [none], columns).collect() == []


BLOCK = "id long, kind string, title string, note string, start_at timestamp, end_at timestamp, done_at timestamp, source string, created_at timestamp"


def test_blocks_twice(graph, spark):  # noqa: F811
    begin = graph.nodes.where("kind = 'plan' and occurred_at > timestamp'2026-11-01'").orderBy("occurred_at").first().occurred_at
    later = "2027-01-05 12:00:00"
    blocks = table(spark, BLOCK, (1, "gym", "gym", None, later, later, later, "manual", later), (2, "fixed", "twin", None, str(begin), later, None, "a", later), (3, "wake", "wake", None, later, later, None, "a", later), (4, "recruiting", "r", None, later, later, None, "a", later), (5, "meal", "past", None, "2020-01-01 00:00:00", later, None, "a", later))
    none = spark.createDataFrame([], "plan_id string, day date, state string, outcome string, outcome_at timestamp, source string")
    now = F.lit("2026-11-01 00:00:00").cast("timestamp")
    once, sessions, picked = migrations.blocks_to_plans(graph, blocks, none, now, NY)
    assert sorted(r.kind for r in picked.collect()) == ["focus", "gym"] and sessions.count() == 1
    again, same, nothing = migrations.blocks_to_plans(once, blocks, sessions, now, NY)
    assert nothing.count() == 0 and same.count() == 1 and sorted(ids(again.nodes)) == sorted(ids(once.nodes))


# journals


def test_a_journal_writes_a_batch_once(spark, tmp_path):
    journal = Journal(spark, f"file://{tmp_path}/j", "id string, at timestamp")
    rows = table(spark, "id string, at timestamp", ("a", "2026-01-01"), ("b", "2026-01-02"))
    assert journal.append(rows, "one") and not journal.append(rows, "one")
    assert journal.append(rows.union(table(spark, "id string, at timestamp", ("c", "2026-01-03"), ("c", "2026-01-03"))), "two", key="id", time="at")
    assert ids(journal.read()) == ["a", "b", "c"] and ids(journal.read(["two"])) == ["c"]
    assert journal.batches() == ["one", "two"]
    with pytest.raises(InvalidRequest):
        journal.append(rows, "../x")
    assert Journal(spark, f"file://{tmp_path}/none", "id string").read().count() == 0


def test_history_is_appended(graph, spark, tmp_path):  # noqa: F811
    journal = history_journal(spark, f"file://{tmp_path}/h")
    bare = graph.with_(history=graph.history.limit(0))
    for batch in ("b1", "b1", "b2"):
        journal.append(mutations.close_nodes(bare, table(spark, "id string", ("a",), ("b",)), at()).history, batch, key="id", time="changed_at")
    assert sorted(r.node_id for r in journal.read().collect()) == ["a", "b"]
    assert journal.read(["b2"]).count() == 0


def test_recalls_are_logged_and_folded(graph, spark, tmp_path):  # noqa: F811
    log = AccessLog(spark, f"file://{tmp_path}/log")
    ask = lambda **k: sorted(ids(recall.recall(graph, at(), NY, CONFIG, log=log, **k).nodes))
    first, second = ask(start_ids=["a"], hops=1), ask(start_ids=["b"], hops=0)
    assert len(log.batches()) == 2 and log.read().count() == len(first) + len(second)
    assert log.fold() == 2 and log.batches() == [] and log.fold() == 0
    n = {r.id: r.n for r in log.totals().collect()}
    assert n == {i: (i in first) + (i in second) for i in {*first, *second}}
    counts = {r.id: r.access_count for r in graph.nodes.collect()}
    assert {r.id: r.access_count for r in log.accessed(graph.nodes).collect()} == {i: c + n.get(i, 0) for i, c in counts.items()}


def test_a_fold_that_ended_early_counts_nothing_twice(spark, tmp_path, monkeypatch):
    log = AccessLog(spark, f"file://{tmp_path}/log")
    log.record(table(spark, "id string", ("a",)), at(), "one")
    with monkeypatch.context() as m:
        m.setattr(AccessLog, "drop", lambda self, batches: 1 / 0 if batches else None)
        with pytest.raises(ZeroDivisionError):
            log.fold()
    log.record(table(spark, "id string", ("a",)), at(), "two")
    assert AccessLog(spark, f"file://{tmp_path}/log").fold() == 1
    assert [(r.id, r.n) for r in log.totals().collect()] == [("a", 2)] and log.batches() == []
    log.record(table(spark, "id string", ("b",)), at())
    with monkeypatch.context() as m:
        m.setattr("kairograph.operators.journal.current_version", lambda spark, root: 1)  # another fold was faster
        with pytest.raises(Conflict):
            log.fold()
    assert log.fold() == 1 and log.totals().count() == 2


# stored tables


def test_recall_leaves_no_tables_behind(graph, spark):  # noqa: F811
    fs, path = G.files_of(spark, f"{G.shared_dir(spark)}/kairograph")
    held = lambda: {s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("cut-")} if fs.exists(path) else set()
    before = held()
    with G.cuts(spark):
        found = recall.recall(graph, at(), NY, CONFIG, start_ids=["a"], hops=2)
        inside = held() - before
        assert found.nodes.count() and found.edges.count() >= 0 and len(inside) <= 3
    assert held() == before
    with G.cuts(spark) as keep:
        kept = keep(G.cut(spark.range(3).toDF("id")))
        G.cut(spark.range(4).toDF("id")).count()
    assert kept.count() == 3 and len(held() - before) == 1


def test_derivation_is_keyed_by_its_source(spark, monkeypatch):
    roots = []
    monkeypatch.setattr(G, "current_version", lambda spark, root: roots.append(root) or 1)
    monkeypatch.setattr(G, "load_snapshot", lambda spark, root: root)
    source = G.inspect.getsource
    G.derived(spark, SF, NOW, NY)
    G.derived(spark, SF, NOW, NY)
    monkeypatch.setattr(G.inspect, "getsource", lambda m: source(m).replace("694_224_000", "694_224_001"))
    G.derived(spark, SF, NOW, NY)
    assert roots[0] == roots[1] != roots[2]


# ingest and lookalikes


def test_embedding_in_tasks(spark):
    texts = spark.createDataFrame([(f"k{i}", "x" * i if i else None) for i in range(300)], "key string, text string").repartition(3)
    found = {r.key: r.embedding[0] for r in ingest.embedded(texts, lambda t: [[float(len(x)), 0.0, 0.0] for x in t], CONFIG).collect()}
    assert found == {f"k{i}": float(i) for i in range(300)}
    with pytest.raises(Exception, match="vectors for|wide"):
        ingest.embedded(texts, lambda t: [[1.0]] * len(t), CONFIG).collect()
    with pytest.raises(UpstreamError):
        ingest.embed_all(lambda t: [], ["a"], 3)


def test_lookalikes_by_all_pairs(spark):
    """Every pair of new and stored plans within twelve hours that share a word, on shared words and close times."""
    rng = np.random.default_rng(8)
    words = ["budget", "dentist", "lecture", "swimming", "with", "of"]
    rows = [(f"n{i}", " ".join(rng.choice(words, 3)), f"2026-11-{rng.integers(1, 4):02d} {rng.integers(0, 24):02d}:00:00") for i in range(80)]
    ddl = "id string, title string, at timestamp"
    stored, news = table(spark, ddl, *rows[:40]), table(spark, ddl, *rows[40:])
    none = lambda k: F.lit(None).cast(k)
    node = stored.select("id", F.lit("plan").alias("kind"), "title", none("string").alias("body"), none("array<float>").alias("embedding"), F.col("at").alias("occurred_at"), none("timestamp").alias("expires_at"), none("timestamp").alias("verified_at"), F.lit(0).alias("access_count"), none("timestamp").alias("last_accessed_at"), F.lit("a").alias("source"), none("string").alias("agent_id"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    empty = {n: spark.createDataFrame([], G.DDL[n]) for n in G.DDL}
    held = G.Graph(**(empty | {"nodes": node}))
    asked = news.select(F.col("id").alias("temp_id"), F.lit("plan").alias("kind"), "title", F.col("at").alias("occurred_at"), none("timestamp").alias("closes_at"), none("string").alias("hub_id"))
    found = {tuple(r) for r in candidates.lookalikes(held, asked, at(), NY).collect()}
    naming = lambda t: {w for w in t.split() if len(w) >= 4 and w != "with"}
    hours = lambda x: datetime.fromisoformat(x)
    want = {(n[0], o[0]) for n in rows[40:] for o in rows[:40] if n[1] == o[1] or abs(hours(n[2]) - hours(o[2])) <= timedelta(hours=12) and naming(n[1]) & naming(o[1])}
    assert found == want
    groups = {tuple(r) for r in candidates.title_groups(held, asked, at()).collect()}
    shared = {n[1] for n in rows[40:]} & {o[1] for o in rows[:40]}
    assert groups == {("plan", t, side, i) for side, part in (("new", rows[40:]), ("stored", rows[:40])) for i, t, _ in part if t in shared}


def test_registered_queries_are_quick_enough(spark):
    began = time.perf_counter()
    assert registry.queries()["lookalike_plans"](spark, SF).count() > 0
    assert time.perf_counter() - began < 120


def test_a_query_without_the_graph_derives_none(spark, monkeypatch):
    def derive(*args):
        raise AssertionError("derived")

    monkeypatch.setattr(registry, "graph", derive)
    assert registry.queries()["evidence_elsewhere"](spark, SF).columns == ["seq"]
    with pytest.raises(AssertionError, match="derived"):
        registry.queries()["retype_edges"](spark, SF)


def test_what_is_kept_of_the_derivation(spark):
    """Rows of the graph are made where they are read: what is kept is groups and joins, and reading edges shuffles nothing."""
    g = G.derived(spark, SF, NOW, NY)
    assert "Exchange" not in g.edges._jdf.queryExecution().executedPlan().toString()
    kept = {f.rsplit("/", 2)[1] for t in g.tables().values() for f in t.inputFiles() if "/kairograph/graph-" in f}
    assert kept == {"lines", "venues", "notes", "texts", "marks"}
    bare = G.from_star_schema(spark, SF, NOW, NY)
    for name in ("tasks", "edges"):
        held, made = (x.select(F.xxhash64(*[c for c in x.columns if c != "properties"]).alias("h")) for x in (getattr(g, name), getattr(bare, name)))
        assert held.exceptAll(made).isEmpty() and made.exceptAll(held).isEmpty()


def test_lookalikes_are_made_once_without_a_distinct(spark):
    """Two common words, three buckets and an equal title make a pair once; pairs are not shuffled again."""
    ddl = "temp_id string, kind string, title string, occurred_at timestamp, closes_at timestamp, hub_id string"
    news = table(spark, ddl, ("n1", "plan", "budget dentist", "2026-11-01 12:00:00", None, None), ("n2", "plan", "dentist budget visit", "2026-11-01 14:00:00", None, None))
    node = news.select(F.concat(F.lit("o"), "temp_id").alias("id"), "kind", "title", F.lit(None).cast("timestamp").alias("expires_at"), "occurred_at", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("body"))
    empty = {n: spark.createDataFrame([], G.DDL[n]) for n in G.DDL}
    held = G.Graph(**(empty | {"nodes": node}))
    found = candidates.lookalikes(held, news, at(), NY)
    assert sorted(map(tuple, found.collect())) == [("n1", "on1"), ("n1", "on2"), ("n2", "on1"), ("n2", "on2")]
    assert "Aggregate [temp_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert candidates.lookalikes(held, news.union(news), at(), NY).count() == 4


def test_pairs_of_lookalikes_are_made_by_many_tasks(spark):
    """A few rows make many pairs: their number of tasks does not follow from the rows' size, and no words are intersected for a pair."""
    ddl = "temp_id string, kind string, title string, occurred_at timestamp, closes_at timestamp, hub_id string"
    titles = ("budget dentist visit", "dentist visit", "visit", "class with", None, "", "(aside) Budget", "zebra budget apple")
    news = table(spark, ddl, *((f"n{i}", "plan", t, "2026-11-01 12:00:00", None, None) for i, t in enumerate(titles)))
    node = news.select(F.concat(F.lit("o"), "temp_id").alias("id"), "kind", "title", F.lit(None).cast("timestamp").alias("expires_at"), "occurred_at", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("body"))
    empty = {n: spark.createDataFrame([], G.DDL[n]) for n in G.DDL}
    found = candidates.lookalikes(G.Graph(**(empty | {"nodes": node})), news, at(), NY)
    naming = [set((t or "").lower().replace("(aside)", "").split()) - {"class", "with"} for t in titles]
    want = [(f"n{i}", f"on{j}") for i in range(8) for j in range(8) if i == j and titles[i] is not None or naming[i] & naming[j]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_batchs_earliest_time_is_read_before_rows_are_put_together(spark, tmp_path, monkeypatch):
    """A batch is put together by its key once, where it is written."""
    seen, real = [], Journal._earliest
    monkeypatch.setattr(Journal, "_earliest", lambda self, rows, time: seen.append(rows._jdf.queryExecution().analyzed().toString()) or real(self, rows, time))
    journal = Journal(spark, f"file://{tmp_path}/j", "id string, at timestamp")
    rows = table(spark, "id string, at timestamp", ("a", NOW), ("a", NOW), ("b", NOW))
    assert journal.append(rows, "one", key="id", time="at") and journal.append(rows.union(table(spark, "id string, at timestamp", ("c", NOW))), "two", key="id", time="at")
    assert ids(journal.read()) == ["a", "b", "c"]
    assert len(seen) == 2 and not any("Deduplicate" in plan for plan in seen)


def test_outcomes_that_are_told_are_found_by_node_and_time(graph, spark):  # noqa: F811
    """Long ids are not joined; another row of that node and time does not hold the outcome back."""
    ticks = graph.tasks.select("node_id", at().alias("done_at"))
    other = graph.tasks.select(F.concat(F.lit("x-"), "node_id").alias("id"), "node_id", F.lit("done").alias("field"), F.lit("false").alias("old_value"), F.lit("true").alias("new_value"), F.lit(None).cast("array<float>").alias("embedding"), at().alias("changed_at"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("agent_id"))
    none = spark.createDataFrame([], "node_id string, outcome string")
    held = graph.with_(history=graph.history.limit(0).unionByName(other))
    once = migrations.outcomes(held, none, ticks)
    twice = migrations.outcomes(once, none, ticks)
    n = graph.tasks.count()
    assert n and once.history.count() == twice.history.count() == 2 * n
    joins = [line for line in twice.history._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftAnti" in line]
    assert joins and not any("sha2" in line or "(id#" in line and "done_at" not in line for line in joins)
