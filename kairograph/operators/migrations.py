"""One-off conversions of older shapes of the graph, each written so that a second run changes nothing.

Legacy plans: node_id, kind, status, recurrence, outcome, due_at, end_at, all_day, time_zone.  Legacy tasks: node_id, done_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.config import EngineError
from kairograph.functions import predicates as P
from kairograph.functions.time import day_start, iso, local_date
from kairograph.operators.mutations import close_plans, history_key, history_rows
from kairograph.sources.graph import Graph, cut, files_of

#: Rules of a table of rules at most: it goes to every task.
MOST_RULES = 1000
RULE_DDL = "rank int, kind string, way int, field string, pattern string"
#: What a plan is, by its title, its rule of recurrence and what its hub holds it as.  A row is one condition
#: of a way (rank, kind, way) to be of a kind; the least rank wins.
PLAN_RULES = [
    (1, "lab", 1, "recurrence", "."),
    (1, "lab", 1, "title", "^[A-Z]{2,4} ?[0-9]{3}"),
    (1, "lab", 1, "title", r"(?i)\blab\b"),
    (1, "lab", 2, "item", "^lab$"),
    (2, "class", 1, "title", "^[A-Z]{2,4} ?[0-9]{3}"),
    (2, "class", 1, "recurrence", "."),
    (2, "class", 2, "title", "^[A-Z]{2,4} ?[0-9]{3}"),
    (2, "class", 2, "item", "^session$"),
    (3, "task", 1, "item", "^(assignment|deadline|milestone)$"),
    (3, "task", 2, "title", "(?i) due$"),
    (4, "exam", 1, "item", "^(quiz|exam)$"),
    (5, "bill", 1, "recurrence", "(?i)FREQ=MONTHLY"),
    (5, "bill", 1, "title", r"(?i)\b(rent|payments?|bills?|transfers?|credit card|loan|insurance|subscription|tuition)\b"),
]


def rules_table(spark: SparkSession, rules: Sequence[tuple] = PLAN_RULES) -> DataFrame:
    """(rank, kind, way, field, pattern)."""
    return spark.createDataFrame(list(rules), RULE_DDL)


def plan_facts(graph: Graph, legacy: DataFrame) -> DataFrame:
    """(id, field, value): what rules look at, of legacy plans (node_id, recurrence): title, recurrence, and item of each
    current HAS_ITEM edge."""
    ids = legacy.select(F.col("node_id").alias("id"))
    titles = graph.nodes.join(ids, "id", "left_semi").select("id", F.lit("title").alias("field"), F.col("title").alias("value"))
    rules = legacy.select(F.col("node_id").alias("id"), F.lit("recurrence").alias("field"), F.col("recurrence").alias("value"))
    items = graph.edges.where(P.current() & (F.col("type") == "HAS_ITEM")).select(F.col("dst_id").alias("id"), F.lit("item").alias("field"), F.try_element_at("properties", F.lit("item")).alias("value"))
    return titles.union(rules).union(items.join(ids, "id", "left_semi")).where("value is not null")


def classify(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, kind): of the ways all of whose conditions hold, the one of least rank, then of least kind.

    facts: (id, field, value), any number of each.  rules: (rank, kind, way, field, pattern), a condition a row; a field may
    have several conditions of a way.  A condition holds if any value of its field has the pattern.  What holds is counted for
    each way before the shuffle, and the first way is a minimum, so no sort and no chain in code."""
    listed = rules.select("rank", "kind", "way", "field", "pattern").distinct().limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise EngineError(f"more than {MOST_RULES} rules")
    table = facts.sparkSession.createDataFrame([tuple(r) for r in listed], rules.select("rank", "kind", "way", "field", "pattern").schema)
    needed = table.groupBy("rank", "kind", "way").agg(F.count("*").alias("needed"))
    held = facts.join(F.broadcast(table), "field").where(F.expr("value rlike pattern")).groupBy("id", "rank", "kind", "way").agg(F.count_distinct("field", "pattern").alias("n"))
    ways = held.join(F.broadcast(needed), ["rank", "kind", "way"]).where("n = needed")
    return ways.groupBy("id").agg(F.min(F.struct("rank", "kind")).alias("first")).select("id", F.col("first.kind").alias("kind"))


def move_deadlines(graph: Graph, legacy: DataFrame, at: Column, zone: str) -> tuple[Graph, DataFrame]:
    """Tasks and bills that start and never end are deadlines: the start becomes due_at, a history row keeps it as ISO text,
    and the node has no start any more.  legacy: node_id, kind, end_at, due_at; returned with due_at filled in."""
    picked = cut(graph.nodes.where("occurred_at is not null").join(legacy.where("kind in ('task', 'bill') and end_at is null").select(F.col("node_id").alias("id")), "id", "left_semi"))
    moved = picked.select("id", F.col("occurred_at").alias("was"))
    history = graph.history.unionByName(history_rows(picked, "occurred_at", iso(F.col("occurred_at")), F.lit(None), at, "manual"))
    hit = F.col("was").isNotNull()
    nodes = graph.nodes.join(moved, "id", "left").withColumn("occurred_at", F.when(~hit, F.col("occurred_at"))).withColumn("updated_at", F.when(hit, at).otherwise(F.col("updated_at")))
    due = legacy.join(moved.withColumnRenamed("id", "node_id"), "node_id", "left").withColumn("due_at", F.coalesce("was", "due_at")).select(*legacy.columns)
    return graph.with_(nodes=nodes.select(*graph.nodes.columns), history=history), due


#: Kinds of planner blocks that become plans, and the plan kinds of two of them.
BLOCK_KINDS = ("fixed", "gym", "meal", "recruiting", "shower", "study")
BLOCK_AS = {"recruiting": "focus", "fixed": "meeting"}


def blocks_to_plans(graph: Graph, blocks: DataFrame, sessions: DataFrame, at: Column, zone: str) -> tuple[Graph, DataFrame, DataFrame]:
    """Planner blocks from today on become plans; one that starts when a live plan does is its twin and is dropped.

    blocks: id, kind, title, note, start_at, end_at, done_at, source, created_at.  One stored pick feeds the nodes, the plan
    details and the sessions (plan_id, day, state, outcome, outcome_at, source).  Returns the graph, all sessions, and the
    pick with its kinds (node_id, kind).  A plan that was made starts when its block does, so a second run picks nothing."""
    live = graph.nodes.where(P.live(at) & F.col("occurred_at").isNotNull()).join(graph.plans.select(F.col("node_id").alias("id")), "id", "left_semi")
    taken = live.select(F.col("occurred_at").alias("start_at")).distinct()
    ahead = blocks.where(F.col("kind").isin(*BLOCK_KINDS) & (F.col("start_at") >= day_start(local_date(at, zone), zone)))
    renamed = F.coalesce(F.create_map(*[F.lit(x) for pair in BLOCK_AS.items() for x in pair])[F.col("kind")], F.col("kind"))
    picked = cut(ahead.join(taken, "start_at", "left_anti").withColumn("node_id", F.sha2(F.concat_ws("|", F.lit("block"), F.col("id").cast("string")), 256)).withColumn("plan_kind", renamed))
    by_hand = F.col("source") == "manual"
    none = lambda kind: F.lit(None).cast(kind)
    nodes = picked.select(
        F.col("node_id").alias("id"), F.lit("plan").alias("kind"), "title", F.col("note").alias("body"), none("array<float>").alias("embedding"), F.col("start_at").alias("occurred_at"), none("timestamp").alias("expires_at"),
        none("timestamp").alias("verified_at"), F.lit(0).alias("access_count"), none("timestamp").alias("last_accessed_at"), F.when(by_hand, "manual").otherwise("agent").alias("source"),
        F.when(~by_hand, F.col("source")).alias("agent_id"), "created_at", at.alias("updated_at"),
    )
    plans = picked.select("node_id", "end_at", F.lit(False).alias("all_day"), none("string").alias("time_zone"), none("string").alias("rsvp"), none("boolean").alias("attended"))
    done = picked.where("done_at is not null").select(F.col("node_id").alias("plan_id"), local_date(F.col("start_at"), zone).alias("day"), F.lit("scheduled").alias("state"), F.lit("done").alias("outcome"), F.col("done_at").alias("outcome_at"), "source")
    after = graph.with_(nodes=graph.nodes.unionByName(nodes), plans=graph.plans.unionByName(plans))
    return after, sessions.unionByName(done), picked.select("node_id", F.col("plan_kind").alias("kind"))


def close_cancelled(graph: Graph, legacy: DataFrame, at: Column) -> Graph:
    """Plans whose status is cancelled are closed as close_node closes: edges end, a history row keeps the title.  An id that
    is no plan's any more does nothing."""
    return close_plans(graph, legacy.where("status = 'cancelled'").select(F.col("node_id").alias("id")), at)


def outcomes(graph: Graph, legacy_plans: DataFrame, legacy_tasks: DataFrame) -> Graph:
    """attended from a plan's outcome (done, missed), done from a task's done_at, with a history row of that time for each
    task that has one.  What has no legacy row stays as it is, and a history row that is there is not added again."""
    attended = F.when(F.col("outcome") == "done", True).when(F.col("outcome") == "missed", False)
    plans = graph.plans.join(legacy_plans.select("node_id", attended.alias("was"), F.lit(True).alias("m")), "node_id", "left")
    ticks = legacy_tasks.select("node_id", "done_at", F.lit(True).alias("m"))
    tasks = graph.tasks.join(ticks, "node_id", "left")
    done = ticks.where("done_at is not null").select(F.col("node_id").alias("id"), "done_at")
    told = graph.history.where("field = 'done'").select(F.col("node_id").alias("id"), F.col("changed_at").alias("done_at"), F.col("id").alias("held"))
    told = told.where(F.col("held") == history_key("done", F.col("done_at"))).drop("held")  # an id says node, field and time, so the join takes those
    rows = history_rows(done.join(told, ["id", "done_at"], "left_anti"), "done", F.lit("false"), F.lit("true"), F.col("done_at"), "ingest")
    return graph.with_(
        plans=plans.withColumn("attended", F.when(F.col("m"), F.col("was")).otherwise(F.col("attended"))).select(*graph.plans.columns),
        tasks=tasks.withColumn("done", F.when(F.col("m"), F.col("done_at").isNotNull()).otherwise(F.col("done"))).select(*graph.tasks.columns),
        history=graph.history.unionByName(rows),
    )


def archived(spark: SparkSession, paths: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """The rows of those tables that exist, by name: a column that a table lacks is null, others are left out.  The columns of
    each file of a table are merged too.  Without any table there are no rows."""
    out = spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in columns.items()))
    for path in paths:
        fs, place = files_of(spark, path)
        if not fs.exists(place):
            continue
        held = spark.read.option("mergeSchema", "true").parquet(path)
        names = {c.lower(): c for c in held.columns}
        out = out.unionByName(held.select(*[F.col(f"`{names[c]}`").cast(k).alias(c) for c, k in columns.items() if c in names]), allowMissingColumns=True)
    return out


def tentative_to_tasks(graph: Graph, archives: DataFrame, at: Column, zone: str) -> Graph:
    """Plans that an archive (node_id, status) calls tentative, and that have the shape of timeless ones, become someday tasks.
    A plan that is in several archives is moved once; what is moved is a plan no more."""
    from kairograph.operators.candidates import timeless_to_tasks

    ids = archives.where("status = 'tentative'").select("node_id").distinct()
    held = graph.with_(plans=graph.plans.join(ids, "node_id", "left_semi"))
    after = timeless_to_tasks(held, at, zone)
    return after.with_(plans=after.plans.unionByName(graph.plans.join(ids, "node_id", "left_anti")))
