"""What an ingest is shown: candidate nodes, context edges, lookalikes; checks of its evidence; one-off migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import EDGE_TYPES, HUB_DEGREE, KINDS, LOOKALIKE_HOURS, MIN_EVIDENCE_CHARS, EngineConfig, InvalidRequest
from kairograph.functions import predicates as P
from kairograph.functions.text import identifying_words, mentions, naming_words, normalize_quote, normalize_title, person_names
from kairograph.functions.time import iso, local_date, local_time, plus_seconds
from kairograph.operators import reads
from kairograph.operators.mutations import history_rows, value_of
from kairograph.operators.recall import nearest
from kairograph.sources.graph import Graph, cut


def mentioned_persons(graph: Graph, text: str) -> DataFrame:
    """Persons one of whose names stands in the text as a whole word or phrase."""
    names = reads.persons(graph).select("id", F.explode(person_names(F.col("title"), F.col("aliases"))).alias("name"))
    return names.where(mentions(F.lit(text), F.col("name"))).select("id").distinct()


def open_task_candidates(graph: Graph, text: str, writer: str, now: Column) -> DataFrame:
    """Open tasks under a hub that the writer touches, or whose title shares an identifying word with the text."""
    tasks = reads.live_tasks(graph, now, P.open_task(now))
    touched = reads.touched_hubs(graph, [], writer).withColumnRenamed("id", "src_id")
    under = graph.edges.where(P.current() & (F.col("type") == "HAS_ITEM")).join(touched, "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct().withColumn("under", F.lit(True))
    shares = F.arrays_overlap(identifying_words(F.col("title")), identifying_words(F.lit(text)))
    return tasks.join(under, "id", "left").where(F.coalesce("under", F.lit(False)) | shares).select("id")


def candidates(graph: Graph, text: str, vectors: list[Column], writer: str, extra_ids, now: Column, config: EngineConfig, participants=()) -> DataFrame:
    """Ids from the whole text's vector, its segments' vectors, open tasks, mentioned persons, participants (which must
    be live) and named ids (a request's own, or a table of any size with the column id)."""
    if participants and reads.nodes_by_ids(graph, participants, now).count() < len(set(participants)):
        raise InvalidRequest("a participant is unknown or expired")
    rows = graph.nodes.where(P.live(now)).select("id", "embedding")
    told = extra_ids if isinstance(extra_ids, DataFrame) else None
    found = reads.nodes_by_ids(graph, [*(extra_ids if told is None else ()), *participants] or ["-"], now).select("id")
    if told is not None:
        found = found.union(rows.select("id").join(told.select("id").distinct(), "id", "left_semi"))
    for i, vec in enumerate(vectors):
        found = found.union(nearest(rows, vec, config.candidate_limit if i == 0 else config.segment_candidate_limit, config.similarity_floor).select("id"))
    return found.union(open_task_candidates(graph, text, writer, now)).union(mentioned_persons(graph, text)).distinct()


def context_edges(graph: Graph, ids: DataFrame, limit: int) -> DataFrame:
    """All item edges of tasks among the ids, then up to limit others: between no hubs, between hubs, the rest."""
    ids = cut(ids)
    inc = cut(reads.incident_edges(graph.edges.where(P.current() & (F.col("type") != "HAS_PLAN")), ids))
    sizes = inc.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count("*").alias("d")).where(F.col("d") > HUB_DEGREE)
    flag = lambda end, name: sizes.select(F.col("id").alias(end), F.lit(True).alias(name))
    inside = lambda end, name: ids.select(F.col("id").alias(end), F.lit(True).alias(name)).distinct()
    marked = inc.join(flag("src_id", "hs"), "src_id", "left").join(flag("dst_id", "hd"), "dst_id", "left").join(inside("src_id", "is"), "src_id", "left").join(inside("dst_id", "id2"), "dst_id", "left")
    item = (F.col("type") == "HAS_ITEM") & F.coalesce("id2", F.lit(False))
    between = F.coalesce("is", F.lit(False)) & F.coalesce("id2", F.lit(False))
    hub = F.coalesce("hs", F.lit(False)) | F.coalesce("hd", F.lit(False))
    ranked = marked.withColumn("priority", F.when(item, 0).when(between & ~hub, 1).when(between, 2).otherwise(3))
    rest = ranked.where("priority > 0").orderBy("priority", "created_at", "id").limit(limit)
    return ranked.where("priority = 0").select("id", "type", "priority").union(rest.select("id", "type", "priority"))


def lookalikes(graph: Graph, news: DataFrame, now: Column, zone: str, shown: DataFrame | None = None) -> DataFrame:
    """(temp_id, id): live nodes that new ones may repeat, but those that were shown (id) already.  news: temp_id, kind,
    title, occurred_at, closes_at, hub_id.

    Same normalised title and kind; plans within twelve hours that share an identifying word, met by buckets of hours and
    word, so that plans of other words never meet; tasks of the same hub that close on the same local day.

    Pairs are many more than the rows that they are made of: a number of tasks that these rows' size does not lessen makes
    them, and what decides about a pair is made for each row before."""
    asked = [r[0] for r in news.where(F.col("kind").isin(*KINDS)).select("kind").distinct().collect()]
    live = reads.live_nodes(graph, now).where(F.col("kind").isin(*asked) | ~F.col("kind").isin(*KINDS)).select("id", "kind", "title", "occurred_at")
    key = normalize_title(F.col("title")).alias("k")
    titled = lambda df, k: df.where("title is not null").withColumn(k, F.coalesce(key, F.lit("")))  # noqa: E731  never null, so that no filter makes it again
    same = titled(news, "k").select("temp_id", "kind", "k").join(titled(live, "k").select("id", "kind", "k"), ["kind", "k"]).select("temp_id", "id")
    width = LOOKALIKE_HOURS * 3600
    bucket = F.floor(F.unix_seconds("occurred_at") / width)
    dated = "kind = 'plan' and occurred_at is not null"

    def worded(df: DataFrame, *columns: str) -> DataFrame:
        """A row for each identifying word of a title (k), with the words that come before it."""
        words = df.withColumn("words", F.sort_array(naming_words(F.col("k")))).select("*", F.posexplode_outer("words").alias("i", "word"))
        return words.where("word is not null").select(*columns, "k", "word", F.slice("words", F.lit(1), F.col("i")).alias("before"))

    around = worded(titled(news.where(dated), "k").select("temp_id", F.unix_micros("occurred_at").alias("new_at"), bucket.alias("at_b"), "k"), "temp_id", "new_at", "at_b")
    around = around.select("temp_id", "new_at", F.col("k").alias("new_k"), F.col("before").alias("new_before"), "word", F.explode(F.array(F.col("at_b") - 1, F.col("at_b"), F.col("at_b") + 1)).alias("b"))
    plans = worded(titled(live.where(dated), "k").select("id", F.unix_micros("occurred_at").alias("at"), bucket.alias("b"), "k"), "id", "at", "b")
    close = F.abs(F.col("at") - F.col("new_at")) <= width * 1_000_000
    first = (F.size("before") == 0) | (F.size("new_before") == 0) | ~F.arrays_overlap("before", "new_before")  # of several common words one makes the pair
    spark = news.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    near = around.repartition(parts, "b", "word").join(plans.repartition(parts, "b", "word"), ["b", "word"])
    near = near.where(close & first & (F.col("k") != F.col("new_k"))).select("temp_id", "id")
    held = graph.edges.where(P.current() & (F.col("type") == "HAS_ITEM")).select(F.col("src_id").alias("hub_id"), F.col("dst_id").alias("id")).distinct()
    tasks = reads.live_tasks(graph, now).where("closes_at is not null").select("id", local_date(F.col("closes_at"), zone).alias("day"), key).distinct().join(held, "id")
    siblings = news.where("kind = 'task' and closes_at is not null").select("temp_id", "hub_id", local_date(F.col("closes_at"), zone).alias("day"), key.alias("new_k")).join(tasks, ["hub_id", "day"])
    siblings = siblings.where(~F.col("k").eqNullSafe(F.col("new_k"))).select("temp_id", "id")
    found = same.union(near).union(siblings)
    twice = lambda df, c: not df.groupBy(c).count().where("count > 1").isEmpty()
    if twice(news, "temp_id") or twice(live, "id"):  # else each pair is made once, so that none has to be shuffled
        found = found.distinct()
    return found if shown is None else found.join(shown.select("id").distinct(), "id", "left_anti").select("temp_id", "id")


def title_groups(graph: Graph, news: DataFrame, now: Column) -> DataFrame:
    """(kind, title, side, id): new and live nodes of one kind and normalised title, where both sides have any.

    A row for each member, `new` or `stored`; the pairs that lookalikes() gives for equal titles are all of one side with all
    of the other, and their number grows with the square of a title that everyone uses."""
    key = normalize_title(F.col("title")).alias("title")
    sides = news.select("kind", key, F.lit("new").alias("side"), F.col("temp_id").alias("id")).union(reads.live_nodes(graph, now).select("kind", key, F.lit("stored"), "id"))
    both = sides.groupBy("kind", "title").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select("kind", "title")
    return sides.join(both, ["kind", "title"], "left_semi").select("kind", "title", "side", "id").distinct()


def news_of(creates: DataFrame, edges: DataFrame | None) -> DataFrame:
    """What lookalikes() is asked of a batch: its creates, tasks with the stored hub that a new edge gives them."""
    news = creates.select("temp_id", "kind", "title", value_of(creates, "occurred_at", "timestamp").alias("occurred_at"), value_of(creates, "closes_at", "timestamp").alias("closes_at"))
    if edges is None:
        return news.withColumn("hub_id", F.lit(None).cast("string"))
    hubs = edges.where("type = 'HAS_ITEM'").join(creates.select(F.col("temp_id").alias("src_id")), "src_id", "left_anti").groupBy(F.col("dst_id").alias("temp_id")).agg(F.min("src_id").alias("hub_id"))
    return news.join(hubs, "temp_id", "left")


def evidence_failures(claims: DataFrame, text: Column) -> DataFrame:
    """Claims (seq, evidence) whose quotation is too short or not in the text."""
    quote = normalize_quote(F.col("evidence"))
    return claims.where((F.length(quote) < MIN_EVIDENCE_CHARS) | ~F.contains(normalize_quote(text), quote))


def unlinked(creates: DataFrame, edges: DataFrame | None, spawns: DataFrame | None = None) -> DataFrame:
    """Created nodes that no new edge touches and no spawn names as its hub or place."""
    out = creates
    for ops, columns in ((edges, ("src_id", "dst_id")), (spawns, ("hub_id", "place_id"))):
        for c in columns if ops is not None else ():
            if c in ops.columns:
                out = out.join(ops.select(F.col(c).alias("temp_id")), "temp_id", "left_anti")
    return out


def unknown_edge_types(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("type").isin(*EDGE_TYPES)).select("type").distinct()


#: Of the titles and types that a message names, so many are spelled out; the tables beside it have them all.
NAMED = 20


def named(rows: DataFrame, column: str) -> str:
    """The first values in order, quoted, and how many rows there are where they are more."""
    first = [r[0] for r in rows.select(column).orderBy(column).limit(NAMED + 1).collect()]
    text = ", ".join(f'"{t}"' for t in first[:NAMED])
    return text if len(first) <= NAMED else f"{text} and more, {rows.count()} in all"


def recheck_reasons(missed: DataFrame | None, loose: DataFrame | None, odd: DataFrame | None) -> list[str]:
    """Why a first extraction is run again, in words for the extractor; empty where it stands."""
    notes = []
    if missed is not None and not missed.isEmpty():
        notes.append("Some created nodes look like stored ones that were not shown; these are candidates now: reuse or update them.")
    if loose is not None and (titles := named(loose, "title")):
        notes.append(f"Some created nodes have no edge: {titles}. Link each to its subject or hub, or leave it out.")
    if odd is not None and (types := named(odd, "type").replace('"', "")):
        notes.append(f"Some edge types are not allowed: {types}. Use RELATED_TO with a relation where none fits.")
    return notes


def timeless_to_tasks(graph: Graph, at: Column, zone: str) -> Graph:
    """Plans that start at 00:00 in their zone, have no end and are not all-day become someday tasks; a history row keeps
    the start.  What it picks is a plan no more, so a second run changes nothing."""
    shape = graph.plans.where("end_at is null and not all_day").select(F.col("node_id").alias("id"), F.coalesce("time_zone", F.lit(zone)).alias("tz"))
    local_clock = F.date_format(F.from_utc_timestamp("occurred_at", F.col("tz")), "HH:mm:ss")
    picked = graph.nodes.where("kind = 'plan' and occurred_at is not null").join(shape, "id").where(local_clock == "00:00:00")
    moved = F.coalesce("m", F.lit(False))
    history = graph.history.unionByName(history_rows(picked, "occurred_at", iso(F.col("occurred_at")), F.lit(None), at, "ingest"))
    none = F.lit(None)
    tasks = graph.tasks.union(picked.select("id", none.cast("date"), none.cast("timestamp"), F.lit(False), none.cast("timestamp")))
    ids = picked.select("id", F.lit(True).alias("m"))
    nodes = graph.nodes.join(ids, "id", "left").withColumn("kind", F.when(moved, "task").otherwise(F.col("kind"))).withColumn("occurred_at", F.when(moved, none).otherwise(F.col("occurred_at"))).withColumn("updated_at", F.when(moved, at).otherwise(F.col("updated_at")))
    return graph.with_(nodes=nodes.select(*graph.nodes.columns), plans=graph.plans.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti"), tasks=tasks, history=history)


def fold_timeline(plans: DataFrame, sessions: DataFrame, zone: str) -> DataFrame:
    """Plans of the former timeline as nodes of today: (id, kind, occurred_at, end_at, status, opens_on, closes_at, done_at).

    plans: id, created_at, occurred_at, end_at, due_at, opens_at, status, recurrence.  sessions: plan_id, state, start_at,
    end_at, outcome, outcome_at, updated_at.  A dated plan without a rule takes what its session says: cancelled, or moved
    in time with its length kept.  An undated one without a rule becomes a task if it has a due, an open or is an idea; it
    opens on its open day, else on the day it was made, but no later than it closes.  Other undated ones become memories,
    and what is still an idea among plans becomes tentative."""
    one = sessions.groupBy(F.col("plan_id").alias("id")).agg(
        F.min(F.struct("start_at", "state", "end_at")).alias("s"), F.min(F.when(F.col("outcome") == "done", F.coalesce("outcome_at", "updated_at"))).alias("finished")
    )
    rows = plans.join(one, "id", "left")
    single, dated = F.col("recurrence").isNull(), F.col("occurred_at").isNotNull()
    state = F.when(single & dated, F.col("s.state"))
    moved = F.coalesce(state == "moved", F.lit(False))
    length = (F.unix_micros("end_at") - F.unix_micros("occurred_at")) / 1_000_000
    task = ~dated & single & (F.col("due_at").isNotNull() | F.col("opens_at").isNotNull() | (F.col("status") == "idea"))
    kind = F.when(task, "task").when(~dated & single, "memory").otherwise("plan")
    opened, made, due = (local_date(F.col(c), zone) for c in ("opens_at", "created_at", "due_at"))
    opens = F.when(F.col("due_at").isNull(), opened).otherwise(F.least(F.coalesce(opened, made), due))
    status = F.when(state == "cancelled", "cancelled").when(F.col("status") == "idea", "tentative").otherwise(F.col("status"))
    return rows.select(
        "id", kind.alias("kind"), F.when(moved, F.col("s.start_at")).otherwise(F.col("occurred_at")).alias("occurred_at"),
        F.when(moved, F.coalesce("s.end_at", plus_seconds(F.col("s.start_at"), length))).otherwise(F.col("end_at")).alias("end_at"),
        F.when(kind == "plan", status).alias("status"), F.when(task, opens).alias("opens_on"), F.when(task, F.col("due_at")).alias("closes_at"), F.when(task, F.col("finished")).alias("done_at"),
    )


def retype_edges(edges: DataFrame) -> DataFrame:
    """HAS_SESSION becomes HAS_PLAN; other types outside the vocabulary become RELATED_TO, the old type kept as `was`."""
    renamed = edges.withColumn("type", F.when(F.col("type") == "HAS_SESSION", "HAS_PLAN").otherwise(F.col("type")))
    odd = ~F.col("type").isin(*EDGE_TYPES)
    return renamed.withColumn("properties", F.when(odd, F.map_concat("properties", F.create_map(F.lit("was"), F.col("type")))).otherwise(F.col("properties"))).withColumn("type", F.when(odd, "RELATED_TO").otherwise(F.col("type")))


def matches(ops: DataFrame, **wanted) -> Column:
    """Whether an operation meets an expectation: equal fields, or patterns for names that end in _like."""
    found = F.lit(True)
    for name, value in wanted.items():
        found &= F.col(name.removesuffix("_like")).rlike("(?i)" + value) if name.endswith("_like") else F.col(name).eqNullSafe(F.lit(value))
    return found


def expectation(ops: DataFrame, condition: Column, check: Column) -> DataFrame:
    """Quantifiers over the operations that meet a condition: none, some, each, and varied values of title."""
    hit = ops.where(condition)
    return hit.agg((F.count("*") == 0).alias("none"), (F.coalesce(F.sum(check.cast("int")), F.lit(0)) > 0).alias("some"), (F.coalesce(F.min(check), F.lit(False))).alias("each"), (F.countDistinct("title") > 1).alias("varied"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, value): values that only one side has, as `missing` (only left) or `extra` (only right)."""
    left, right = left.toDF("value").distinct(), right.toDF("value").distinct()
    return left.join(right, "value", "left_anti").select(F.lit("missing").alias("side"), "value").union(right.join(left, "value", "left_anti").select(F.lit("extra"), "value"))


def checked(ops: DataFrame, zone: str, **wanted) -> Column:
    """Whether an operation's fields are as expected: x=value or None for null, x_date and x_time for the local date and
    clock of an instant, x_from and x_to for a closed range of local dates, x_like for a pattern."""
    found = F.lit(True)
    for name, value in wanted.items():
        base, _, how = name.rpartition("_")
        if how == "date" and base in ops.columns:
            found &= local_date(F.col(base), zone).eqNullSafe(F.lit(value).cast("date"))
        elif how == "time" and base in ops.columns:
            found &= local_time(F.col(base), zone).eqNullSafe(F.lit(value))
        elif how == "from" and base in ops.columns:
            found &= F.coalesce(local_date(F.col(base), zone) >= F.lit(value).cast("date"), F.lit(False))
        elif how == "to" and base in ops.columns:
            found &= F.coalesce(local_date(F.col(base), zone) <= F.lit(value).cast("date"), F.lit(False))
        elif how == "like" and base in ops.columns:
            found &= F.coalesce(F.col(base).rlike("(?i)" + value), F.lit(False))
        else:
            found &= F.col(name).eqNullSafe(F.lit(value))
    return found
