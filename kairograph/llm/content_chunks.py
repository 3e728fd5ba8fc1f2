"""Document fingerprints by content-defined chunking.

A gear hash rolls over the last 32 bytes.  A chunk ends where the hash's high bits are zero: more of them before the
normal size and fewer after it (normalised chunking), within a least and a greatest size.  A fingerprint is the set of
its chunks' digests with their lengths, so text that is moved or inserted changes only the chunks around it.  The
containment of one fingerprint in another is the length of the shared chunks over the length of its own.

Null texts count as empty: an empty fingerprint, which is like another empty one (1) and like no other (0).  Rows are
ordered by id, nulls first, then by the text's checksum; the row after the last is the first, so a single row is its own
neighbour.  Repeated rows get equal fingerprints.  Ids must be integers, anything else raises a TypeError.  Very long
texts are chunked whole.  Only the named columns are read, so others may have any name.  An empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.llm.common import STEP_BYTES, fresh, table, take_turn

LEAST, NORMAL, GREATEST = 32, 128, 512
#: Two bits more and two fewer than the normal size has.
STRICT, LOOSE = np.uint32(0xFF800000), np.uint32(0xF8000000)
#: A random number for each byte, from its own digest.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:4], "big") for b in range(256)], np.uint32)
#: Rows of a range of ids that one task works on.
RANGE_ROWS, MOST_RANGES = 1000, 20_000
NULL_KEY = -(1 << 63)


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes up to each byte, summed by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h[:-k] << np.uint32(k)
        h[k:] += more
    return h


def chunk_sets(texts: list[bytes]) -> list[dict[str, int]]:
    """For each text its chunks: digest (16 hex digits) to length."""
    joined = b"".join(texts)
    if not joined:
        return [{} for _ in texts]
    h = rolled(np.frombuffer(joined, np.uint8))
    at = np.flatnonzero((h & LOOSE) == 0)
    strict = (at[(h[at] & STRICT) == 0] + 1).tolist()
    loose = (at + 1).tolist()
    digest, first, out, begin = xxhash.xxh64_hexdigest, bisect.bisect_left, [], 0
    n_strict, n_loose = len(strict), len(loose)
    s = k = 0
    for text in texts:
        found: dict[str, int] = {}
        start, stop = begin, begin + len(text)
        while start < stop:
            end = min(start + GREATEST, stop)
            s = first(strict, start + LEAST, s)
            if s < n_strict and strict[s] <= min(start + NORMAL, end):
                end = strict[s]
            elif start + NORMAL < end:
                k = first(loose, start + NORMAL, k)
                if k < n_loose and loose[k] < end:
                    end = loose[k]
            found[digest(joined[start:end])] = end - start
            start = end
        out.append(found)
        begin = stop
    return out


def containment(own: dict[str, int], other: dict[str, int]) -> float:
    """The share of own's length whose chunks other has too; of an empty one 1 if other is empty too, else 0."""
    total = sum(own.values())
    return sum(n for d, n in own.items() if d in other) / total if total else float(not other)


def written(chunks: dict[str, int]) -> str:
    return ",".join([f"{d}:{n}" for d, n in sorted(chunks.items())])


def in_order(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(part, borrowed, id, crc, text): rows dealt by ranges of ids, each range with the first rows of the next one."""
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise TypeError(f"{id_column} must be an integer, to put the rows in order")
    rows = fresh(docs, id_column, text_column).toDF("id", "text").select("id", "text", F.coalesce(F.col("id").cast("long"), F.lit(NULL_KEY)).alias("key"))
    n, low = rows.agg(F.count("*"), F.min("key")).first()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 10_000).alias("q")).first().q if parts > 1 else []
    cuts = np.array(sorted({c for c in cuts or [] if c > low}), np.int64)
    heads = {int(c): i for i, c in enumerate(cuts)} | ({low: len(cuts)} if low is not None else {})

    def deal(batches):
        take_turn()
        for batch in batches:
            key = batch.column("key").to_numpy()
            part = np.searchsorted(cuts, key, side="right")
            crc = pa.array([zlib.crc32(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.int64())
            own = [pa.array(part, pa.int64()), pa.array(np.zeros(len(key), np.int32)), batch.column("id"), batch.column("key"), crc, batch.column("text")]
            names = ["part", "borrowed", "id", "key", "crc", "text"]
            whole = pa.record_batch(own, names)
            yield whole
            lent = [(i, heads[k]) for i, k in enumerate(key.tolist()) if k in heads]
            if lent:
                copy = whole.take(pa.array([i for i, _ in lent]))
                yield copy.set_column(0, "part", pa.array([p for _, p in lent], pa.int64())).set_column(1, "borrowed", pa.array([1] * len(lent), pa.int32()))

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"part long, borrowed int, id {kind}, key long, crc long, text string")
    return dealt.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "borrowed", "key", "crc")


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: n_chars, the digest of the edited text (its second half replaced by the start of the next row's
    text), both fingerprints, and the containment of its own fingerprint in the edited text's and in the next row's."""
    ordered = in_order(docs, id_column, text_column)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answer(rows: list, nexts: list[str], kind) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        edited = []
        for t, other in zip(texts, nexts):
            half = len(t) // 2
            edited.append((t[: len(t) - half] + other[:half]).encode())
        chunks = chunk_sets([t.encode() for t in texts] + [nexts[-1].encode()])
        changed = chunk_sets(edited)
        out = [
            [r[0] for r in rows],
            [len(t) for t in texts],
            [hashlib.sha256(e).hexdigest() for e in edited],
            [written(c) for c in chunks[:-1]],
            [written(c) for c in changed],
            [containment(a, b) for a, b in zip(chunks, changed)],
            [containment(a, b) for a, b in zip(chunks, chunks[1:])],
        ]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def run(batches):
        take_turn()
        held, size, part, after = [], 0, None, None
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for p, borrowed, name, text in zip(batch.column("part").to_pylist(), batch.column("borrowed").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if p != part:
                    if held:
                        yield answer(held, [r[1] for r in held[1:]] + [after], kind)
                    held, size, part, after = [], 0, p, None
                text = text or ""
                if borrowed:
                    after = text if after is None else after
                    continue
                held.append((name, text))
                size += len(text)
                if size >= STEP_BYTES and len(held) > 1:
                    yield answer(held[:-1], [r[1] for r in held[1:]], kind)
                    held, size = held[-1:], len(text)
        if held:
            yield answer(held, [r[1] for r in held[1:]] + [after], kind)

    kind = ordered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op6_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op6_content_chunks": op6_content_chunks}
ORACLE_SQL: dict[str, str] = {}
