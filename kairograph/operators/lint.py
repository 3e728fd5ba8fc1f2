"""Data-quality rules: each gives (rule, node_ids, title, note, at), one row for each finding.

Ids of a finding are a list; the findings that name a group of nodes are as long as the group.  report() puts all
findings in the order of RULES and, within a rule, of at and the first id."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import EDGE_TYPES, LONG_SPAN_DAYS
from kairograph.functions import predicates as P
from kairograph.functions.text import first_name, normalize_title
from kairograph.operators.reads import live_nodes, persons
from kairograph.sources.graph import Graph

# Wordings that the rules look for, as Java patterns.  Two wordings that are proper names of one household
# (one in WORKING_NOTE, one in AGENT_INSTRUCTION) are not here: working_note() and agent_instruction() take such names.
STATUS = r"(?is)\b(as of|not yet|so far|still needs?|unconfirmed)\b|\bno\b.{0,60}\b(found|posted|yet)\b"
WORKING_NOTE = r"(?is)/var/lib|\bworktree|\bbranch\b|\bcommit\b|this agent|\bwake\b(?![ -]word)|credentials? (set up|exist|stored)|site lesson|\bhow-to\b|shadow dom|\bdom\b|\bref [a-z]\d|accessibility tree|browser (task|helper)|terminal (task|helper)|steer_(browser|terminal)|\.(tsx?|py|go|aspx)\b|\bline \d+"
AGENT_INSTRUCTION = r"(?is)\bno agents? (may|should|can)\b|\bagents? (must|should|may) (never|not|always|only)\b|\bwants (the )?(agents?|specialists?) to\b|\b(specialists?|managers?|helpers?) (must|should) (never|always)\b"
DATED_TITLE = r"(?is)\b(fall|spring|summer|winter) 20\d\d\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}\b|\d{1,2}(:\d\d)? ?(am|pm)\b|\bsection \d"
STREET = r"\b\d+[A-Za-z]?\s+[A-Za-z]"


NOTES = {
    "status_snapshot": "reads as a status that never expires",
    "working_note": "reads as a note on how tools work, not as a fact",
    "noon_placeholder": "starts at exactly noon, which stands for no stated time",
    "dated_plan_title": "the title has a term, date, time or section",
    "agent_instruction": "reads as a rule for agents",
    "dated_hub": "holds dated items and has a date of its own",
    "long_span": "spans more than a week",
    "duplicate": "same kind and title, plans in the same hour",
    "unaliased_person": "the first name is no alias",
    "place_without_address": "plans happen here, but there is no full street address",
    "floating": "has no current edge",
    "unknown_edge_type": "is not an allowed edge type",
}


def _finding(found: DataFrame, rule: str, ids: Column, at: Column) -> DataFrame:
    return found.select(F.lit(rule).alias("rule"), ids.alias("node_ids"), "title", F.lit(NOTES[rule]).alias("note"), at.cast("timestamp").alias("at"))


def _one(found: DataFrame, rule: str, at: str = "created_at") -> DataFrame:
    return _finding(found, rule, F.array("id"), F.col(at))


_WORD = "[A-Za-z0-9_]"
#: The place between a word's character and another one.
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _ascii(pattern: str) -> str:
    r"""The pattern with each \b between A-Z, a-z, 0-9 or _ and anything else; Java's own takes other letters for parts of words.

    One look is enough where the pattern itself has a word on the other side: before a letter, a digit or a group, or else
    after one.  At a {} there may be anything."""
    found = pattern.replace(r"\b{}", _EDGE + "{}").replace(r"{}\b", "{}" + _EDGE)
    return re.sub(r"\\b(?=[A-Za-z]|\\d|\((?!\?))", f"(?<!{_WORD})", found).replace(r"\b", f"(?!{_WORD})")


def _worded(pattern: str, names: tuple[str, ...], form: str) -> Column:
    """Whether the text has the pattern, or the form with one of the names in place of {}."""
    more = [_ascii(form).replace("{}", re.escape(n)) for n in names]
    return _text().rlike("|".join([_ascii(pattern), *more]))


def _text() -> Column:
    return F.concat_ws(" ", "title", F.coalesce("body", F.lit("")))


def status_snapshot(g: Graph, now: Column, zone: str) -> DataFrame:
    return _one(g.nodes.where((F.col("kind") == "memory") & F.col("expires_at").isNull() & _text().rlike(_ascii(STATUS))), "status_snapshot")


def working_note(g: Graph, now: Column, zone: str, names: tuple[str, ...] = ()) -> DataFrame:
    """names: of tools, each of which makes a note."""
    return _one(live_nodes(g, now).where((F.col("kind") == "memory") & _worded(WORKING_NOTE, names, r"\b{}\b")), "working_note")


def _plans(g: Graph, now: Column) -> DataFrame:
    return live_nodes(g, now).where("kind = 'plan'").join(g.plans, F.col("id") == F.col("node_id"))


def noon_placeholder(g: Graph, now: Column, zone: str) -> DataFrame:
    clock = F.date_format(F.from_utc_timestamp("occurred_at", zone), "HH:mm:ss")
    return _one(_plans(g, now).where(~F.col("all_day") & (clock == "12:00:00")), "noon_placeholder", "occurred_at")


def dated_plan_title(g: Graph, now: Column, zone: str) -> DataFrame:
    return _one(live_nodes(g, now).where((F.col("kind") == "plan") & F.col("title").rlike(_ascii(DATED_TITLE))), "dated_plan_title")


def agent_instruction(g: Graph, now: Column, zone: str, names: tuple[str, ...] = ()) -> DataFrame:
    """names: of agents that someone may want to do something."""
    return _one(live_nodes(g, now).where((F.col("kind") == "memory") & _worded(AGENT_INSTRUCTION, names, r"\bwants (the )?{} to\b")), "agent_instruction")


def dated_hub(g: Graph, now: Column, zone: str) -> DataFrame:
    holders = g.edges.where(P.current() & (F.col("type") == "HAS_ITEM")).select(F.col("src_id").alias("id"))
    return _one(live_nodes(g, now).where("kind = 'plan' and occurred_at is not null").join(holders, "id", "left_semi"), "dated_hub")


def long_span(g: Graph, now: Column, zone: str) -> DataFrame:
    return _one(_plans(g, now).where(F.unix_micros("end_at") - F.unix_micros("occurred_at") > LONG_SPAN_DAYS * 86_400_000_000), "long_span", "occurred_at")


def duplicate(g: Graph, now: Column, zone: str) -> DataFrame:
    hour = F.when(F.col("kind") == "plan", F.date_trunc("hour", "occurred_at"))
    groups = live_nodes(g, now).groupBy("kind", normalize_title(F.col("title")).alias("key"), hour.alias("hour"))
    found = groups.agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("all"), F.min("title").alias("title")).where(F.size("all") > 1)
    return _finding(found, "duplicate", F.col("all.id"), F.element_at("all", 1)["created_at"])


def unaliased_person(g: Graph, now: Column, zone: str) -> DataFrame:
    name = first_name(F.col("title"))
    known = F.exists("aliases", lambda a: F.lower(a) == F.lower(name))
    return _one(persons(g).where((name != "") & ~F.coalesce(known, F.lit(False))), "unaliased_person")


def place_without_address(g: Graph, now: Column, zone: str) -> DataFrame:
    used = g.edges.where(P.current() & (F.col("type") == "AT_LOCATION")).select("src_id", "dst_id")
    used = used.join(live_nodes(g, now).where("kind = 'plan'").select(F.col("id").alias("src_id")), "src_id", "left_semi").groupBy("dst_id").agg(F.array_sort(F.collect_set("src_id")).alias("plans"))
    bad = g.nodes.where("kind = 'place'").join(g.places, F.col("id") == F.col("node_id")).where(F.col("address").isNull() | ~F.col("address").rlike(_ascii(STREET)))
    found = bad.join(used, F.col("id") == F.col("dst_id"))
    return _finding(found, "place_without_address", F.concat(F.array("id"), "plans"), F.lit(None))


def floating(g: Graph, now: Column, zone: str) -> DataFrame:
    current = g.edges.where(P.current())
    ends = current.select(F.col("src_id").alias("id")).union(current.select("dst_id"))
    return _one(live_nodes(g, now).join(ends, "id", "left_anti"), "floating")


def unknown_edge_type(g: Graph, now: Column, zone: str) -> DataFrame:
    odd = g.edges.where(P.current() & ~F.col("type").isin(*EDGE_TYPES))
    ends = odd.select("type", F.col("src_id").alias("id")).union(odd.select("type", "dst_id"))
    found = ends.groupBy(F.col("type").alias("title")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return _finding(found, "unknown_edge_type", F.col("ids"), F.lit(None))


RULES = {f.__name__: f for f in (status_snapshot, working_note, noon_placeholder, dated_plan_title, agent_instruction, dated_hub, long_span, duplicate, unaliased_person, place_without_address, floating, unknown_edge_type)}


def report(g: Graph, now: Column, zone: str) -> DataFrame:
    """All findings as one job, in order."""
    found = reduce(DataFrame.unionByName, [rule(g, now, zone) for rule in RULES.values()])
    place = F.array_position(F.lit(list(RULES)), F.col("rule"))
    return found.orderBy(place, F.asc_nulls_first("at"), F.when(F.col("at").isNull(), F.col("title")), F.element_at("node_ids", 1))
