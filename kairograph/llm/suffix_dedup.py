"""Exact substring dedup: bytes under any string of `length` bytes that also starts elsewhere are removed.

Places that cannot repeat are ruled out first.  Of each window of `length` bytes the 32 bytes with the least hash are its
anchor, so equal windows have equal anchors at equal offsets, and a window whose anchor occurs once cannot repeat.  The
windows of each anchor that occurs again lie side by side; their stretch of text goes to the anchor's bucket.  Equal
stretches are combined before the shuffle and keep their number as a weight.  In a bucket the stretches form shards, each
shard's Burrows-Wheeler transform is built, and shards are merged by interleave refinement (bwt.py); rows that share a
prefix of `length` bytes are the repeated windows.  A bucket with over WIDE distinct stretches is dealt again: each
stretch is cut into groups of GROUP windows, and the bytes common to a group's windows name its bucket, so text around a
passage that a third of the documents share does not meet in one task.

Exact copies of a text of at least `length` bytes are removed whole and take part once in the search.  Null texts count
as empty and keep nothing; the digest is then that of no bytes.  Repeated rows are copies of each other.  Matches never
cross rows, spans are judged on the input, and very long texts are searched whole.  Only the named columns are read, so
others may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.bwt import repeated_ranges
from kairograph.llm.common import bytes_of, free_name, fresh, map_steps, stored, table, take_turn
from kairograph.llm.content_chunks import rolled

LENGTH = 400
ANCHOR = 32
#: Bytes of stretches merged at a time, and of a shard.
MERGE_BYTES, SHARD_BYTES = 1 << 20, 1 << 19
WIDE, GROUP = 1000, 4


def anchored(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each anchor, ascending, and the first window of each (and the number of windows as a last entry)."""
    windows = len(text) - length + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    h = rolled(text)[ANCHOR - 1 :] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    least = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)  # the first of equals
    span, width = 1, length - ANCHOR + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], np.r_[first, windows]


def _array(data: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(tid, text): each text once.  docs has tid and text."""
    return docs.groupBy("tid").agg(F.first("text").alias("text"))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(a, tid, at): the anchors of the texts of at least length bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        a, tid, at = [], [], []
        for key, text in zip(batch.column("tid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            places, _ = anchored(_array(text), length)
            a += [digest(text[p : p + ANCHOR]) for p in places.tolist()]
            at.append(places)
            tid += [key] * len(places)
        return pa.record_batch([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(tid, pa.binary()), pa.array(np.concatenate(at).astype(np.int32))], ["a", "tid", "at"])

    return map_steps(docs.where(F.octet_length("text") >= length).select("tid", "text"), work, "a long, tid binary, at int")


def stretches(texts: DataFrame, length: int) -> DataFrame:
    """(a, key, offset, stretch, tid, start): the windows of each repeated anchor.  texts has tid, text and at, the
    places of the repeated anchors."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(6)]
        for key, text, at in zip(batch.column("tid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("at").to_pylist()):
            places, first = anchored(_array(text), length)
            for k in np.flatnonzero(np.isin(places, np.array(at, np.int64))).tolist():
                p, a, b = int(places[k]), int(first[k]), int(first[k + 1])
                part = text[a : b - 1 + length]
                for column, value in zip(rows, (xxhash.xxh64_intdigest(text[p : p + ANCHOR]), hashlib.md5(part).digest(), p - a, part, key, a)):
                    column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        rows[0] = np.array(rows[0], np.uint64).view(np.int64)
        return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], ["a", "key", "offset", "stretch", "tid", "start"])

    return map_steps(texts, work, "a long, key binary, offset int, stretch binary, tid binary, start long")


def _buckets(batches):
    """Lists of (key, stretch, weight), one for each run of equal a."""
    bucket, rows = None, []
    for batch in batches:
        for a, key, part, weight in zip(*[batch.column(c).to_pylist() for c in ("a", "key", "stretch", "weight")]):
            if a != bucket and rows:
                yield rows
                rows = []
            bucket = a
            rows.append((key, part, weight))
    if rows:
        yield rows


def merged_ranges(parts: DataFrame, length: int) -> DataFrame:
    """(key, ranges): of distinct weighted stretches (a, key, stretch, weight) the repeated windows, by bucket a.

    Windows of one stretch differ, so a stretch that is alone in its bucket is repeated as often as its weight says."""

    def answer(found: list[tuple[bytes, list[tuple[int, int]]]]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.record_batch([pa.array([k for k, _ in found], pa.binary()), pa.array([[{"lo": x, "hi": y} for x, y in r] for _, r in found], kind)], ["key", "ranges"])

    def solve(held: list[tuple]) -> list[tuple]:
        keys, strings, weights = zip(*held)
        found = repeated_ranges(list(strings), np.array(weights, np.int64), length, SHARD_BYTES)
        return [(k, r) for k, r in zip(keys, found) if r]

    def run(batches):
        take_turn()
        held, size, alone = [], 0, []
        for rows in _buckets(batches):
            if len(rows) == 1:
                key, part, weight = rows[0]
                if weight > 1:
                    alone.append((key, [(0, len(part) - length + 1)]))
            else:
                held += rows
                size += sum(len(r[1]) for r in rows)
            if size >= MERGE_BYTES:
                yield answer(solve(held))
                held, size = [], 0
            if len(alone) >= 10_000:
                yield answer(alone)
                alone = []
        yield answer(alone + (solve(held) if held else []))

    ordered = parts.select("a", "key", "stretch", "weight").repartition("a").sortWithinPartitions("a", "key")
    return ordered.mapInArrow(run, "key binary, ranges array<struct<lo:int,hi:int>>")


def wide_ranges(parts: DataFrame, length: int) -> DataFrame:
    """merged_ranges() for buckets of many stretches: by groups of windows named by the bytes that they have in common."""
    cores = parts.select("key", "stretch", "offset", "weight")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(5)]
        for key, text, offset, weight in zip(*[batch.column(c).to_pylist() for c in ("key", "stretch", "offset", "weight")]):
            windows = len(text) - length + 1
            for q in range((offset - windows + 1) // GROUP, offset // GROUP + 1):
                lo, hi = max(0, offset - GROUP * q - GROUP + 1), min(windows - 1, offset - GROUP * q)
                core = text[max(0, offset - GROUP * q) : offset - GROUP * q - GROUP + 1 + length]
                for column, value in zip(rows, (xxhash.xxh64_intdigest(core, q & 0xFFFF), key, lo, hi + 1, weight)):
                    column.append(value)
        rows[0] = np.array(rows[0], np.uint64).view(np.int64)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], ["b", "key", "lo", "hi", "weight"])

    groups = stored(map_steps(cores, work, "b long, key binary, lo int, hi int, weight long", "stretch"), "groups")
    again = stored(groups.groupBy("b").agg(F.sum("weight").alias("w")).where("w > 1").select("b"), "group-buckets")
    cut = groups.join(again, "b").join(parts.select("key", "stretch"), "key")
    cut = cut.select("b", "key", "lo", F.expr(f"substring(stretch, lo + 1, hi - lo - 1 + {length})").alias("stretch"), "weight")
    cut = stored(cut.select("b", F.unhex(F.md5(F.concat(F.col("stretch"), F.col("b").cast("string").cast("binary")))).alias("part_key"), "key", "lo", "stretch", "weight"), "group-stretches")
    distinct = cut.groupBy(F.col("b").alias("a"), F.col("part_key").alias("key")).agg(F.first("stretch").alias("stretch"), F.sum("weight").alias("weight"))
    found = stored(merged_ranges(distinct, length).select(F.col("key").alias("part_key"), F.explode("ranges").alias("r")), "group-ranges")
    back = cut.select("part_key", "key", "lo").join(found, "part_key").select("key", (F.col("lo") + F.col("r.lo")).alias("lo"), (F.col("lo") + F.col("r.hi")).alias("hi"))
    return back.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # at most a stretch's windows


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, spans) of the texts with repeated bytes, as byte ranges that may overlap; docs has tid and text.  What a text
    shares with its exact copies does not count here."""
    found = stored(anchors(docs, length), "anchors")
    seen = F.xxhash64("tid", "at")
    again = stored(found.groupBy("a").agg(F.min(seen).alias("x"), F.max(seen).alias("y")).where("x < y").select("a"), "repeated-anchors")
    places = found.join(again, "a").groupBy("tid").agg(F.collect_set("at").alias("at"))  # within one text
    texts = distinct_texts(docs.where(F.octet_length("text") >= length))
    parts = stored(stretches(texts.join(places, "tid").select("tid", "text", "at"), length), "stretches")
    distinct = parts.groupBy("a", "key").agg(F.first("stretch").alias("stretch"), F.first("offset").alias("offset"), F.count("*").alias("weight"))
    wide = stored(parts.select("a", "key").distinct().groupBy("a").count().where(F.col("count") > WIDE).select("a"), "wide")
    if wide.isEmpty():
        ranges = merged_ranges(distinct, length)
    else:
        narrow = merged_ranges(distinct.join(wide, "a", "left_anti"), length)
        ranges = narrow.union(wide_ranges(stored(distinct.join(wide, "a", "left_semi"), "wide-stretches"), length))
    ranges = stored(ranges.select("key", F.explode("ranges").alias("r")), "ranges")
    spans = parts.select("key", "tid", "start").join(ranges, "key").select("tid", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") - 1 + length).alias("hi"))
    return spans.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # within one text


def with_tid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tid", F.unhex(F.md5("text")))


def kept_parts(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return [*out, text[at:]]


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, spans, whole) of the texts that lose bytes; whole: it has an exact copy of at least length bytes and goes
    whole.  docs has tid and text."""
    copied = docs.where(F.octet_length("text") >= length).groupBy("tid").count().where("count > 1").select("tid", F.lit(True).alias("whole"))
    return stored(repeated_spans(docs, length).join(copied, "tid", "full"), "removals")


def _cut(text: bytes, spans: list[dict] | None, whole: bool | None) -> tuple[list[tuple[int, int]], bytes]:
    """The removed ranges and the remaining bytes."""
    gone = [(0, len(text))] if whole else _union([(r["lo"], r["hi"]) for r in spans or ()])
    return gone, b"".join(kept_parts(text, gone))


RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def dedup(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) and text (what
    remains; characters cut in part are left out of it, not out of the digest)."""
    rows = with_tid(fresh(docs, id_column, text_column).toDF("id", "text"))
    joined = rows.join(removals(rows.select("tid", "text"), length), "tid", "left").select("id", "text", "spans", "whole")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_of(batch)
        done = [(t, *_cut(t, r, w)) if r or w else (t, [], t) for t, r, w in zip(texts, batch.column("spans").to_pylist(), batch.column("whole").to_pylist())]
        columns = [
            pa.array([len(t) for t, _, _ in done], pa.int64()),
            pa.array([sum(b - a for a, b in gone) for _, gone, _ in done], pa.int64()),
            pa.array([len(gone) for _, gone, _ in done], pa.int64()),
            pa.array([hashlib.sha256(kept).hexdigest() for _, _, kept in done], pa.string()),
            pa.array([[{"lo": a, "hi": b} for a, b in gone] for _, gone, _ in done], RANGES),
            pa.array([kept.decode("utf-8", "ignore") if gone else kept for _, gone, kept in done], pa.string()),
        ]
        return pa.record_batch([batch.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, text string"
    found = map_steps(joined, work, schema)
    return found.withColumnRenamed("id", id_column) if id_column != "id" else found


def without_repeats(docs: DataFrame, length: int = LENGTH, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, repeated bytes cut from the text; characters cut in part go as a whole.  Every
    occurrence of a passage goes, the first too.  A row whose text is removed whole is dropped; null and empty texts
    stay as they are."""
    key, cut, whole = (free_name(docs, n) for n in ("__tid", "__spans", "__whole"))
    found = removals(with_tid(docs.select(F.col(f"`{text_column}`").alias("text"))).select("tid", "text"), length).toDF(key, cut, whole)
    joined = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))).join(found, key, "left").drop(key)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, spans, all_ = batch.schema.get_field_index(text_column), batch.column(cut).to_pylist(), batch.column(whole).to_pylist()
        texts = batch.column(at).to_pylist()
        for i, (ranges, w) in enumerate(zip(spans, all_)):
            if ranges or w:
                texts[i] = _cut(texts[i].encode(), ranges, w)[1].decode("utf-8", "ignore")
        out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns([cut, whole])
        return out.filter(pa.array([not (r or w) or bool(t) for r, w, t in zip(spans, all_, texts)], pa.bool_()))

    return map_steps(joined, work, docs.schema, text_column)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    named = F.array_join(F.transform("spans", lambda r: F.concat_ws(":", r["lo"], r["hi"])), ",")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", named.alias("spans"), "text")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
