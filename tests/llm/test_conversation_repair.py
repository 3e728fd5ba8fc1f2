"""The repair against all edit scripts of short conversations, and the query against a plain reading of its rules."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from kairograph.llm import conversation_repair as CR

SF = "/root/testdata/sf0.01"
PRICES = [CR.Prices(), CR.Prices(rerole=3, delete=4, insert=1, truncated=2), CR.Prices(rerole=2, delete=7, insert=2, truncated=0), CR.Prices(1, 1, 1, 1)]


def scripts(turns, prices):
    """The cheapest (cost, audit, role initials) over all scripts with at most two inserts at a place."""
    places = [""] + [a for n in (1, 2) for a in map("".join, itertools.product("ua", repeat=n))]
    best = None
    for kinds in itertools.product(*[("D",) if f in (CR.BLANK, CR.DUPLICATE) else ("D", "K", "Ru", "Ra") for _, f, _ in turns]):
        cost = sum({"D": prices.delete, "K": 0}.get(k, prices.rerole) + (prices.truncated if k != "D" and f == CR.TRUNCATED else 0) for k, (_, f, _) in zip(kinds, turns))
        if best and cost > best[0]:
            continue
        for fills in itertools.product(places, repeat=len(turns) + 1):
            whole = cost + prices.insert * sum(map(len, fills))
            if best and whole > best[0]:
                continue
            roles = "".join(f + ("" if k == "D" else k[1] if k[0] == "R" else t[0]) for f, k, t in zip(fills, kinds, turns)) + fills[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                found = (whole, "".join("I" * len(f) + k[0] for f, k in zip(fills, kinds)) + "I" * len(fills[-1]), roles)
                best = found if best is None else min(best, found)
    return best


def solve(turns, prices, cuts):
    """The library's answer over the chunks that the cuts make."""
    parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)]) if a < b]
    out, roles, cost = [], "", 0
    states = CR.chain([CR.summary(p, prices) for p in parts], prices)
    for i, (p, (before, after)) in enumerate(zip(parts, states)):
        right = [0 if q == after else CR.FAR for q in range(4)]
        letters, _ = CR.walk(p, CR.rest(p, right, prices), before, prices)
        audit, named, _, own = CR.repaired(p, [t[0] for t in p], [""] * len(p), letters, before, i == len(parts) - 1, prices)
        out.append(audit)
        roles, cost = roles + "".join(n[0] for n in named), cost + own
    return cost, "".join(out), roles


@pytest.mark.parametrize("prices", PRICES)
def test_all_scripts_of_short_conversations(prices):
    rng = random.Random(5)
    for n in (1, 2, 3):
        for _ in range(60 if n < 3 else 40):
            turns = [(rng.choice("uuaasx"), rng.choice([0, 0, 0, 1, 2, 3]), 1) for _ in range(n)]
            want = scripts(turns, prices)
            assert solve(turns, prices, []) == want, turns
            assert solve(turns, prices, sorted(rng.sample(range(1, n), rng.randint(0, n - 1)))) == want, turns


@pytest.mark.parametrize("prices", PRICES)
def test_chunks_change_nothing(prices):
    rng = random.Random(6)
    for _ in range(40):
        turns = [(rng.choice("uuaasx"), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 2, 4])) for _ in range(rng.randint(1, 60))]
        cuts = sorted(rng.sample(range(1, len(turns)), rng.randint(0, min(9, len(turns) - 1)))) if len(turns) > 1 else []
        assert solve(turns, prices, cuts) == solve(turns, prices, [])


def plain(rows):
    """conv_id -> the query's columns, by its rules, with a program over (cost, audit) pairs."""
    spaces = " \t\n\x0b\x0c\r"
    text = lambda v: " " if v is None else v if isinstance(v, str) else str(v)
    held = defaultdict(list)
    for c, t, role, body in rows:
        held[c]
        draw = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        body = "" if draw == 1 else re.sub("[.!?]", "", text(body)) if draw == 2 else text(body)
        row = (t is not None, t or 0, "user" if draw == 4 else text(role), hashlib.md5(body.encode()).hexdigest(), body)
        held[c] += [] if draw == 0 else [row] * 2 if draw == 3 else [row]
    out = {}
    for c, own in held.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, _, body in own:
            bare = body.strip(spaces)
            faults.append(1 if not bare else 2 if (role, body) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, body))
        known = [r[1] for r in own if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        best = {"": (0, "", ())}
        step = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

        def offer(new, state, cost, audit, said):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, said)

        def filled(now):
            new = dict(now)
            for _ in range(3):
                for state, (cost, audit, said) in list(new.items()):
                    for r in "ua":
                        if (state, r) in step:
                            offer(new, r, cost + 5, audit + "I", (said, {"u": "user", "a": "assistant"}[r] + ":"))
            return new

        for (_, _, role, _, body), fault in zip(own, faults):
            new, extra = {}, 5 if fault == 3 else 0
            for state, (cost, audit, said) in filled(best).items():
                offer(new, state, cost + 2, audit + "D", said)
                if fault not in (1, 2):
                    if (state, role[:1]) in step:
                        offer(new, role[:1], cost + extra, audit + "K", (said, f"{role}:{body}"))
                    for r in ("user", "assistant"):
                        if (state, r[0]) in step:
                            offer(new, r[0], cost + 1 + extra, audit + "R", (said, f"{r}:{body}"))
            best = new
        cost, audit, said = min(v for k, v in filled(best).items() if k in ("", "a"))
        lines = []
        while said:
            said, line = said
            lines.append(line)
        digest = hashlib.sha256("\n".join(reversed(lines)).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def answered(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert answered(CR.op12_conversation_repair(spark, SF)) == plain(rows)


DDL = "conv_id long, turn long, role string, text string, conv string, `KEY` int"


def test_nulls_ties_copies_and_chunks(spark, tmp_path):
    rng = random.Random(7)
    said = ["Yes.", "No!", "why", " ", None, "", "What?\n", "so", "x" * 5000 + "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(said)) for c in [None, *range(40)] for _ in range(rng.randint(1, 30))]
    rows += [(99, 5, "user", "Hi.")] * 500 + [(98, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No!", f"{t}."])) for t in range(3000)]
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "c", 1) for r in rows], DDL).write.parquet(folder)
    assert answered(CR.op12_conversation_repair(spark, str(tmp_path))) == plain(rows)
    turns = CR.damaged(spark.read.parquet(folder)).where("copies > 0")
    few = CR.summed(CR.repair(turns, chunk_turns=7)).withColumnRenamed("conv", "conv_id")
    want = plain(rows)
    assert all(want[k] == v for k, v in answered(few).items())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    assert CR.op12_conversation_repair(spark, str(tmp_path)).collect() == []


def test_lost_conversations(spark, tmp_path):
    lost = [(c, 0, "user", "Hi.", "c", 1) for c in range(200)]
    spark.createDataFrame(lost, DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    found = answered(CR.op12_conversation_repair(spark, str(tmp_path)))
    assert len(found) == 200
    assert sum(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in found.values()) >= 1
