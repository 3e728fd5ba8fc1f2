"""Secret scans: fixed patterns and a battery of randomness tests.

Patterns find assignments, access keys and hexadecimal strings.  Besides, each longest run of 20 or more characters of
one of the usual encodings that has a letter and a digit is a candidate; an equals sign ends one, unless it pads it.
Runs that are found and overlap are reported as one.  The encoding is the smallest alphabet that holds it.  It must look
random: the chi-squared test of uniformity over that alphabet, the runs test about the middle of the alphabet and the lag-one serial correlation do not reject randomness together (Bonferroni, RANDOM_LEVEL).  And it must not look
like text: the p-value is the chance that a string as uneven as the document's own characters would come out so even
at this length, or that a string that changes character class as rarely as text would change it so often, whichever is
less, doubled.  The p-values of a document are one family, taken through the Benjamini-Hochberg procedure with weights
in proportion to length, at FALSE_DISCOVERIES.  A candidate that overlaps a pattern's span is not reported again.

Spans are in code points, the end excluded.  Null and empty texts have none.  Repeated rows get equal answers; spans of
equal start are ordered by kind as in KINDS.  Only the named columns are read.  An empty table gives an empty result.
Very long texts are scanned whole, in time in proportion to their length but for sorting.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import fresh, map_steps, table, texts_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Every access key, hexadecimal string and candidate lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Parts of a run that one alphabet may hold: an equals sign only pads the end.
PARTS = tuple(re.compile(rf"[A-Za-z0-9{x}]+(?:=+(?![A-Za-z0-9+/_=-]))?") for x in ("+/", "_-"))
LEAST_ASSIGN, LEAST_ACCESS, LEAST_CANDIDATE = 12, 18, 20

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet up, each in the order of its values.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, DIGITS + UPPER + LOWER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
VALUES = tuple({c: i for i, c in enumerate(a)} for a in ALPHABETS)
RANDOM_LEVEL, FALSE_DISCOVERIES = 0.001, 0.01
#: Chance that neighbours in text differ in class (lower, upper, digit), and the least unevenness taken for text.
TEXT_CHANGES, LEAST_UNEVEN = 0.2, 0.5


def _tail(z: float) -> float:
    """Of the normal distribution, above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> int:
    """The index of the smallest alphabet that holds the token, -1 if none does."""
    body = set(token.rstrip("="))
    return next((i for i, v in enumerate(VALUES) if body <= v.keys()), -1)


def battery(values: list[int], size: int) -> tuple[float, float]:
    """The chi-squared statistic and the least of the three p-values for randomness, times three."""
    n = len(values)
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi = size * sum(c * c for c in counts.values()) / n - n
    k = size - 1
    p_chi = _tail(((max(chi, 0) / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))
    high = [2 * v >= size for v in values]
    a = sum(high)
    b = n - a
    p_runs = 1.0
    if a and b and n > 2:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    elif n > 2:
        p_runs = 2.0 ** (1 - n)
    middle = sum(values) / n
    around = [v - middle for v in values]
    square = sum(v * v for v in around)
    p_serial = 2 * _tail(abs(sum(x * y for x, y in zip(around, around[1:])) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return chi, min(1.0, 3 * min(p_chi, p_runs, p_serial))


def text_p(token: str, values: list[int], size: int, chi: float, uneven: float) -> float:
    """How probable it is that text comes out so even, or changes class so often, at this length."""
    n = len(values)
    mean, spread = size - 1 + n * uneven, math.sqrt(2 * (size - 1) + 4 * n * uneven)
    p_even = _tail((mean - chi) / spread)
    kinds = [c.isdigit() + 2 * c.isupper() for c in token[:n]]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    p_changes = sum(math.comb(n - 1, k) * TEXT_CHANGES**k * (1 - TEXT_CHANGES) ** (n - 1 - k) for k in range(changes, n)) if n <= 400 else _tail((changes - 0.5 - (n - 1) * TEXT_CHANGES) / math.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES)))
    return min(1.0, 2 * min(p_even, p_changes))


def discoveries(found: list[tuple[float, int]], level: float) -> set[int]:
    """Benjamini-Hochberg over (p, length), with weights in proportion to length whose mean is one."""
    mean = sum(n for _, n in found) / max(len(found), 1)
    order = sorted(range(len(found)), key=lambda i: found[i][0] * mean / found[i][1])
    last = max((k for k, i in enumerate(order, 1) if found[i][0] * mean / found[i][1] <= level * k / len(found)), default=0)
    return set(order[:last])


def outermost(found: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other, by start."""
    out, end = [], -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if b > end:
            out.append((a, b))
            end = b
    return out


def disjoint(found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(found):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def tested(text: str, candidates: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
    """(p, length, start, end) of the candidates that one encoding holds and no base span touches."""
    starts, ends = disjoint(base)
    counts: Counter = Counter()
    own: dict[int, float] = {}
    out = []
    for a, b in candidates:
        token = text[a:b]
        kind = infer(token)
        before = bisect.bisect_left(starts, b) - 1
        if kind < 0 or not any(c.isalpha() for c in token) or before >= 0 and ends[before] > a:
            continue
        values, size = [VALUES[kind][c] for c in token.rstrip("=")], len(ALPHABETS[kind])
        chi, p_random = battery(values, size)
        p = 1.0
        if p_random >= RANDOM_LEVEL:
            if kind not in own:
                counts = counts or Counter(text)
                n = [counts[c] for c in ALPHABETS[kind]]
                own[kind] = max(LEAST_UNEVEN, size * sum(x * x for x in n) / sum(n) ** 2 - 1)
            p = text_p(token, values, size, chi, own[kind])
        out.append((p, b - a, a, b))
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    candidates = []
    for run in RUN.finditer(text):
        a, b = run.span()
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text, a, b)]
        if b - a >= LEAST_CANDIDATE and any(c in run[0] for c in DIGITS):
            parts = outermost({m.span() for part in PARTS for m in part.finditer(text, a, b)})
            candidates += [(x, y) for x, y in parts if y - x >= LEAST_CANDIDATE and any(c in DIGITS for c in text[x:y])]
    if candidates:
        found = tested(text, candidates, [s[1:] for s in out])
        end = -1
        for a, b in sorted(found[i][2:] for i in discoveries([t[:2] for t in found], FALSE_DISCOVERIES)):
            if a < end:  # parts of two alphabets that share characters are one secret
                a, b = out.pop()[1], max(b, end)
            out.append(("random", a, b))
            end = b
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column and spans, an array of (kind, start, end)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts_of(batch)]
        return pa.record_batch([batch.column(id_column), pa.array(found, SPANS)], ["id", "spans"])

    rows = fresh(docs, id_column, text_column).withColumnRenamed(text_column, "text")
    kind = rows.schema[id_column].dataType.simpleString()
    return map_steps(rows, work, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_column)


def masked(text: str, mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, at, end = [], 0, 0
    for _, a, b in spans(text):
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, mark: str = "[SECRET]", text_column: str = "text") -> DataFrame:
    """The same rows and columns, secrets in the text replaced by the mark; a null text stays null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_column)
        texts = [t if t is None else masked(t, mark) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_steps(docs, work, docs.schema, text_column)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    named = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(named(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE_SQL: dict[str, str] = {}
