"""Repair of a conversation's structure by a retained-subsequence program.

Wanted is the cheapest set of edits after which the role initials read `(s?(ua)+)?`: a turn is kept, made the user's or the
assistant's (rerole), deleted, or an empty turn is inserted.  Blank and repeated turns must go; a truncated turn that stays
has a price.  Only which turns stay is chosen: a gap between two retained turns costs the difference of prefix sums of
deletions plus the inserts that their pair of roles asks for.  With a running minimum for each role, the cheapest rest
after a turn is found in constant time.  Among the cheapest ways the one whose audit (the edits' initials) comes first in
ASCII order is walked: deletions before inserts, inserts before kept turns, kept before reroled ones.

On the cluster the rows are sorted by conversation and turn over ranges, so that a long conversation spreads over many
tasks.  A conversation that lies inside one task and one chunk is answered there.  Others become chunks; a chunk is
summed up as the cheapest cost between each two states and the order of their audits, the summaries of a conversation (a
few hundred bytes a chunk) are chained in both directions, and then each chunk is walked for itself.

Defined results: rows are taken by turn (nulls first), then role, then the text's hash; equal rows of one turn are copies
of one another, counted before the sort, of which all but the first are duplicates.  Nulls in conversation, turn, role and
text are told from empty strings only by the id that is returned; role and text become one space.  A conversation that is
null is a conversation.  Very long texts lie in one row each and are never joined but in the digest, which reads them as a
stream.  An empty table gives an empty result; only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.llm.common import stored, table

#: Turns and bytes of text of a chunk; a longer single text is a chunk of its own.
CHUNK_TURNS, CHUNK_BYTES = 512, 1 << 20
FAR = 1 << 60
#: The states: nothing retained yet, and the initial that was retained last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts between a state and the next retained role (None: not possible), and after the last one.
INSERTS = {START: {SYSTEM: 0, USER: 0, ASSISTANT: 1}, SYSTEM: {USER: 0, ASSISTANT: 1}, USER: {ASSISTANT: 0, USER: 1}, ASSISTANT: {USER: 0, ASSISTANT: 1}}
AFTER = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
SPACES = " \\t\\n\\u000B\\f\\r"


@dataclass(frozen=True)
class Prices:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def last(self) -> list[int]:
        """The price of each state at the end of a conversation."""
        return [self.insert * AFTER[p] for p in range(4)]


def retained(initial: str, fault: int, prices: Prices) -> dict[int, tuple[int, str]]:
    """The roles that a turn may be retained as: price and letter."""
    if fault in (BLANK, DUPLICATE):
        return {}
    extra = prices.truncated if fault == TRUNCATED else 0
    found = {r: (prices.rerole + extra, "R") for r in (USER, ASSISTANT)}
    if initial in STATE:
        found[STATE[initial]] = (extra, "K")
    return found


@functools.lru_cache(4096)
def _choices(initial: str, fault: int, prices: Prices) -> tuple[tuple[tuple[int, int], ...], tuple[tuple, ...]]:
    """Role and price of each way to retain a turn; and, for each state, (letters, role, price with the inserts) in order."""
    ways = retained(initial, fault, prices)
    steps = tuple(
        tuple(sorted(("I" * INSERTS[p][r] + letter, r, INSERTS[p][r] * prices.insert + price) for r, (price, letter) in ways.items() if r in INSERTS[p])) for p in range(4)
    )
    return tuple((r, price) for r, (price, _) in ways.items()), steps


def rest(turns: list[tuple[str, int, int]], right: list[int], prices: Prices) -> list[tuple[int, ...]]:
    """For each turn, the cheapest price from it on in each state; right: the price of each state after the last turn.

    turns: (initial, fault, copies).  The prices are taken from the end: gone[i] is the price of deleting the first i turns,
    least[r] the cheapest of gone before a retained turn and all that comes with it and after it."""
    spent = [0]
    for _, _, copies in turns:
        spent.append(spent[-1] + copies * prices.delete)
    total = spent[-1]
    ends = [total + v for v in right]
    least = {SYSTEM: FAR, USER: FAR, ASSISTANT: FAR}
    gaps = [tuple((r, k * prices.insert) for r, k in INSERTS[p].items()) for p in range(4)]
    out: list[tuple[int, ...]] = [tuple(right)]
    for i in range(len(turns) - 1, -1, -1):
        initial, fault, copies = turns[i]
        following, gone = out[-1], spent[i] + (copies - 1) * prices.delete
        for r, price in _choices(initial, fault, prices)[0]:
            least[r] = min(least[r], gone + price + following[r])
        out.append(tuple(min(ends[p], min(least[r] + k for r, k in gaps[p])) - spent[i] for p in range(4)))
    out.reverse()
    return out


def walk(turns: list[tuple[str, int, int]], costs: list[tuple[int, ...]], state: int, prices: Prices) -> tuple[list[str], int]:
    """The letters of each turn on the cheapest way of least audit from a state, and the state after the last turn."""
    letters = []
    for i, (initial, fault, copies) in enumerate(turns):
        cost, after = costs[i][state], costs[i + 1]
        if copies * prices.delete + after[state] == cost:
            letters.append("D" * copies)
            continue
        cost -= (copies - 1) * prices.delete
        for own, r, price in _choices(initial, fault, prices)[1][state]:
            if price + after[r] == cost:
                letters.append(own + "D" * (copies - 1))
                state = r
                break
    return letters, state


def summary(turns: list[tuple[str, int, int]], prices: Prices) -> list[int]:
    """Price and order of audit between each two states of a chunk: 16 prices, then 16 places, both by (from, to)."""
    one = [FAR] * 4
    price, audit = [FAR] * 16, [""] * 16
    for end in range(4):
        costs = rest(turns, [*one[:end], 0, *one[end + 1 :]], prices)
        for start in range(4):
            if costs[0][start] < FAR:
                price[4 * start + end] = costs[0][start]
                audit[4 * start + end] = "".join(walk(turns, costs, start, prices)[0])
    place = [0] * 16
    for start in range(4):
        for k, end in enumerate(sorted(range(4), key=lambda e: audit[4 * start + e])):
            place[4 * start + end] = k
    return price + place


def chain(summaries: list[list[int]], prices: Prices) -> list[tuple[int, int]]:
    """(state before, state after) of each chunk of a conversation on its cheapest way of least audit."""
    right = [prices.last()]
    for s in reversed(summaries):
        right.append([min(s[4 * p + q] + right[-1][q] for q in range(4)) for p in range(4)])
    right.reverse()
    state, out = START, []
    for k, s in enumerate(summaries):
        after = min(range(4), key=lambda q: (s[4 * state + q] + right[k + 1][q], s[16 + 4 * state + q]))
        out.append((state, after))
        state = after
    return out


def repaired(turns, roles: list[str], texts: list[str], letters: list[str], state: int, last: bool, prices: Prices) -> tuple[str, list[str], list[str], int]:
    """Audit, and roles and texts of the repaired turns of a chunk, and its price; last: the chunk ends the conversation."""
    out_roles, out_texts, cost = [], [], 0
    for (initial, fault, _), role, text, own in zip(turns, roles, texts, letters):
        for letter in own:
            if letter == "D":
                cost += prices.delete
                continue
            if letter == "K":
                state, name = STATE[initial], role
            else:
                state = ASSISTANT if state == USER else USER
                name = NAMES[state]
                cost += prices.insert if letter == "I" else prices.rerole
            cost += prices.truncated if letter != "I" and fault == TRUNCATED else 0
            out_roles.append(name)
            out_texts.append("" if letter == "I" else text)
    more = AFTER[state] if last else 0
    for _ in range(more):
        state = ASSISTANT if state == USER else USER
        out_roles.append(NAMES[state])
        out_texts.append("")
    return "".join(letters) + "I" * more, out_roles, out_texts, cost + more * prices.insert


CHUNK = "part int, seq int, whole boolean, turns array<long>, roles array<string>, texts array<string>, faults array<int>, copies array<long>, summary array<long>"
PIECE = (
    "part int, seq int, audit string, roles array<string>, texts array<string>, cost long, first_turn long, last_turn long, distinct_turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
)


def _piece(turns: list, roles: list, texts: list, faults: list, copies: list, states: tuple[int, int] | None, last: bool, prices: Prices) -> list:
    """The columns of PIECE after seq; states: before and after a chunk of many, None for a whole conversation."""
    rows = [(r[:1], f, n) for r, f, n in zip(roles, faults, copies)]
    right = prices.last() if states is None else [0 if p == states[1] else FAR for p in range(4)]
    begin = START if states is None else states[0]
    letters, _ = walk(rows, rest(rows, right, prices), begin, prices)
    audit, out_roles, out_texts, cost = repaired(rows, roles, texts, letters, begin, last, prices)
    known = [t for t in turns if t is not None]
    initials = [r[0] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(n - 1 for n in copies)  # no role may follow itself
    count = [sum((f == k) for f in faults) for k in (BLANK, DUPLICATE, TRUNCATED)]
    for f, n in zip(faults, copies):  # a copy's first fault: blank like the first, else duplicate
        count[0 if f == BLANK else 1] += n - 1
    return [audit, out_roles, out_texts, cost, known[0] if known else None, known[-1] if known else None, len(set(known)), *count, illegal, roles[0], roles[-1]]


def _batch(rows: list[list], schema: T.StructType, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], schema.names)


_INT, _LONG, _TEXT = pa.int32(), pa.int64(), pa.string()
_CHUNK_TYPES = [_INT, _INT, pa.bool_(), pa.list_(_LONG), pa.list_(_TEXT), pa.list_(_TEXT), pa.list_(_INT), pa.list_(_LONG), pa.list_(_LONG)]
_PIECE_TYPES = [_INT, _INT, _TEXT, pa.list_(_TEXT), pa.list_(_TEXT), *[_LONG] * 8, _TEXT, _TEXT]


def _schema(rows: DataFrame, ddl: str) -> T.StructType:
    """The column conv as it is in rows, and others."""
    return T.StructType([rows.schema["conv"], *T.StructType.fromDDL(ddl).fields])


def _key_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def chunks_of(rows: DataFrame, prices: Prices, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """rows, sorted in their partitions: conv, key, part, turn, role, text, fault, copies.  Whole conversations have no
    summary; of others each chunk has one."""
    schema = _schema(rows, "key string, " + CHUNK)
    types = [_key_type(rows.schema["conv"]), _TEXT, *_CHUNK_TYPES]

    def run(batches):
        held: list = []  # the conversation's turns that are in no chunk yet
        held_bytes = seq = 0
        key = conv = part = None
        at_edge = True  # the partition's first conversation may have begun in another one
        ready: list[list] = []
        ready_bytes = 0

        def close(whole: bool):
            nonlocal held, held_bytes, seq, ready_bytes
            turns, roles, texts, faults, copies = map(list, zip(*held))
            own = [] if whole else summary([(r[:1], f, n) for r, f, n in zip(roles, faults, copies)], prices)
            ready.append([conv, key, part, seq, whole, turns, roles, texts, faults, copies, own])
            ready_bytes += held_bytes
            held, held_bytes, seq = [], 0, seq + 1

        for batch in batches:
            for c, k, p, *turn in zip(*(batch.column(n).to_pylist() for n in ("conv", "key", "part", "turn", "role", "text", "fault", "copies"))):
                if held and k != key:
                    close(whole=not at_edge and not seq)
                    seq, at_edge = 0, False
                elif held and (len(held) >= chunk_turns or held_bytes + len(turn[2]) > CHUNK_BYTES):
                    close(whole=False)
                conv, key, part = c, k, p
                held.append(turn)
                held_bytes += len(turn[2])
                if len(ready) >= 256 or ready_bytes >= CHUNK_BYTES:
                    yield _batch(ready, schema, types)
                    ready, ready_bytes = [], 0
        if held:
            close(whole=False)  # it may go on in the next partition
        if ready:
            yield _batch(ready, schema, types)

    return rows.mapInArrow(run, schema)


def pieces_of(chunks: DataFrame, prices: Prices) -> DataFrame:
    """Repairs whole conversations, and chunks whose states (before, after) and end (last) are known."""
    schema = _schema(chunks, "key string, " + PIECE)
    types = [_key_type(chunks.schema["conv"]), _TEXT, *_PIECE_TYPES]
    names = ("conv", "key", "part", "seq", "turns", "roles", "texts", "faults", "copies", "before", "after", "last")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in names))
            yield _batch([[*r[:4], *_piece(*r[4:9], None if r[9] is None else (r[9], r[10]), r[11], prices)] for r in rows], schema, types)

    return chunks.mapInArrow(run, schema)


def chained(chunks: DataFrame, prices: Prices) -> DataFrame:
    """(key, part, seq, before, after, last) of the chunks of conversations that have several; from their summaries."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("seq", "ascending")])
        found = chain(t.column("summary").to_pylist(), prices)
        before, after = (pa.array([f[i] for f in found], _INT) for i in (0, 1))
        last = pa.array([i == len(found) - 1 for i in range(len(found))])
        return pa.table([t.column("key"), t.column("part"), t.column("seq"), before, after, last], ["key", "part", "seq", "before", "after", "last"])

    return chunks.select("key", "part", "seq", "summary").groupBy("key").applyInArrow(one, "key string, part int, seq int, before int, after int, last boolean")


def faulty(turns: DataFrame) -> DataFrame:
    """Equal rows once, with copies (their number) and fault.  turns: conv, key, turn, role, text, copies."""
    rows = turns.groupBy("key", "turn", "role", "text").agg(F.first("conv").alias("conv"), F.sum("copies").alias("copies"))
    rows = rows.withColumn("hash", F.md5(F.col("text").cast("binary"))).withColumn("place", F.coalesce(F.col("turn"), F.lit(-(1 << 63))))
    seen = rows.groupBy("key", "role", "hash").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(seen, ["key", "role", "hash"], "left")  # only what is said in several turns
    bare = F.expr(f"rtrim('{SPACES}', text)")
    fault = F.when(bare == "", BLANK).when(F.col("place") > F.col("earliest"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.withColumn("fault", fault)


def repair(turns: DataFrame, prices: Prices = Prices(), chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The repaired conversations in pieces, by (key, part, seq): conv, audit, roles, texts, cost and counts (see PIECE).

    turns: conv (any type), turn (long), role and text (no nulls), copies (long)."""
    keyed = turns.withColumn("key", F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))))
    order = ["key", "place", "role", "hash"]
    rows = faulty(keyed).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    chunks = stored(chunks_of(rows.select("conv", "key", "part", "turn", "role", "text", "fault", "copies"), prices, chunk_turns), "chunks")
    none = F.lit(None).cast("int")
    whole = chunks.where("whole").withColumns({"before": none, "after": none, "last": F.lit(True)})
    parts = chunks.where("not whole")
    joined = parts.join(chained(parts, prices), ["key", "part", "seq"])
    return pieces_of(whole, prices).unionByName(pieces_of(joined, prices))


def summed(pieces: DataFrame) -> DataFrame:
    """One row a conversation: counts, audit and the SHA-256 of the repaired `role:text` lines, read piece by piece."""
    schema = _schema(pieces, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    types = [_key_type(pieces.schema["conv"]), *[_LONG] * 6, _TEXT, _TEXT]
    names = [f.name for f in pieces.schema]

    def run(batches):
        now: dict | None = None
        ready: list[list] = []

        def close():
            gaps = now["last"] - now["first"] + 1 - now["distinct"] if now["first"] is not None else 0
            ready.append([now["conv"], gaps, *now["counts"], now["cost"], "".join(now["audit"]), now["digest"].hexdigest()])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                r = dict(zip(names, row))
                if now is None or r["key"] != now["key"]:
                    if now is not None:
                        close()
                    now = {"key": r["key"], "conv": r["conv"], "first": None, "last": None, "distinct": 0, "counts": [0] * 4, "cost": 0, "audit": [], "digest": hashlib.sha256(), "said": False, "role": None}
                if r["first_turn"] is not None:
                    now["distinct"] += r["distinct_turns"] - (r["first_turn"] == now["last"])
                    now["first"] = r["first_turn"] if now["first"] is None else now["first"]
                    now["last"] = r["last_turn"]
                seam = now["role"] is not None and now["role"] + r["first_role"][:1] not in LEGAL
                now["counts"] = [a + r[c] for a, c in zip(now["counts"], ("blank", "duplicate", "truncated", "illegal"))]
                now["counts"][3] += seam
                now["role"], now["cost"] = r["last_role"][:1], now["cost"] + r["cost"]
                now["audit"].append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    now["digest"].update(f"{chr(10) if now['said'] else ''}{role}:{text}".encode())
                    now["said"] = True
            if len(ready) >= 1024:
                yield _batch(ready, schema, types)
                ready = []
        if now is not None:
            close()
        if ready:
            yield _batch(ready, schema, types)

    return pieces.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by the CRC-32 of `conv_id:turn`: conv, turn, role, text, copies (0 for dropped rows)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    own = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(text("role")).alias("role"), own.alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    found = summed(repair(rows.where("copies > 0")))
    lost = rows.groupBy("conv").agg(F.sum("copies").alias("n")).where("n = 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = lost.select("conv", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    return found.union(empty).withColumnRenamed("conv", "conv_id")


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
