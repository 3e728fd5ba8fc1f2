"""SimHash near-duplicates: 64-bit fingerprints linked by tiled exact comparison.

Equal fingerprints are one node.  Fingerprints within the radius of each other agree on two whole blocks of the
radius + 2 that a fingerprint is cut into, so each node is dealt out once for each pair of blocks, by their values.  A
group of equal block values is compared exactly, in tiles, by numpy exclusive-or and bit counts; tiles are ordered by
bit count and a pair of tiles whose counts differ by more than the radius is skipped.  A group of more than TILE_ROWS
nodes is cut into parts, and pairs of parts go to different tasks.  A task returns a spanning forest of the links it
found, never all pairs; connected() joins the forests.

Null texts and texts without a word have fingerprint zero and are linked like any other.  Repeated rows get equal
answers.  Null ids: such rows get the smallest non-null id of their component, null if it has none.  An empty table
gives an empty result.  Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import bytes_of, fresh, map_steps, numbered, stored, table, take_turn
from kairograph.llm.components import connected, local_labels

#: Nodes of a part of a large group; an item of work holds two parts at most.
TILE_ROWS = 1024
#: Rows of a tile within an item.
TILE = 256
#: Groups of up to this many nodes are compared by shifting the rows against themselves.
SMALL = 16
#: Shingles hashed at once.
HASHED = 1 << 16


def majority(hashed: np.ndarray) -> np.uint64:
    """64 bits: each is set if it is set in over half of the hashes."""
    ones = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64 bits: bit k is set if it is set in over half of the shingles' hashes (XXH64, seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts, ends = (stops - sizes)[: 1 - width].tolist() if width > 1 else (stops - sizes).tolist(), stops[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), HASHED):
        hashed = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + HASHED], ends[k : k + HASHED])], np.uint64)
        total += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(id_column), pa.array([fingerprint(t, width) for t in bytes_of(batch)], pa.int64())], ["id", "fp"])

    rows = fresh(docs, id_column, text_column).withColumnRenamed(text_column, "text")
    return map_steps(rows, work, f"id {rows.schema[id_column].dataType.simpleString()}, fp long")


def tiled_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the fingerprints (uint64, ordered by bit count) that differ in at most radius bits."""
    ones = np.bitwise_count(fp).astype(np.int64)
    a, b = [], []
    for i in range(0, len(fp), TILE):
        for j in range(i, len(fp), TILE):
            if ones[j] - ones[min(i + TILE, len(fp)) - 1] > radius:
                break  # later tiles have no fewer bits
            x, y = np.nonzero(np.bitwise_count(fp[i : i + TILE, None] ^ fp[None, j : j + TILE]) <= radius)
            keep = x + i < y + j
            a.append(x[keep] + i)
            b.append(y[keep] + j)
    return np.concatenate(a), np.concatenate(b)


def _forest(item: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each component within each run of equal items."""
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    sizes = np.diff(np.r_[starts, len(item)])
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, len(fp))):
        near = (item[d:] == item[:-d]) & small[d:]
        near[near] = np.bitwise_count(fp[d:][near] ^ fp[:-d][near]) <= radius
        at = np.flatnonzero(near)
        a.append(at)
        b.append(at + d)
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        order = np.argsort(np.bitwise_count(fp[s : s + n]), kind="stable") + s
        x, y = tiled_links(fp[order], radius)
        a.append(order[x])
        b.append(order[y])
    if not a:
        return fp[:0], fp[:0]
    label = local_labels(len(fp), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints fp of nodes within the radius as all such pairs would."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    value = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1))
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.xxhash64(value(i), value(j), F.lit(k)).alias("g")) for k, (i, j) in enumerate(combinations(range(blocks), 2))])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.g").alias("g"))
    groups = dealt.groupBy("g").count().where("count > 1")
    parts = F.ceil(F.col("count") / TILE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    items = (
        dealt.join(groups.withColumn("parts", parts), "g")
        .withColumn("own", own)
        .withColumn("other", other)
        .select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("item"), "fp")
    )
    items = items.repartition("item").sortWithinPartitions("item", "fp")

    def compare(batches):
        take_turn()
        item, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            item = np.r_[item, batch.column("item").to_numpy()]
            fp = np.r_[fp, batch.column("fp").to_numpy().view(np.uint64)]
            whole = np.searchsorted(item, item[-1]) if len(item) else 0  # the last item may go on
            if whole:
                x, y = _forest(item[:whole], fp[:whole], radius)
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
                item, fp = item[whole:], fp[whole:]
        if len(item):
            x, y = _forest(item, fp, radius)
            yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return items.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, fp (long) and component_id, the smallest id that links reach."""
    found = stored(fingerprints(docs, width, id_column, text_column), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labels = connected(links(nodes, radius))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    answer = stored(named.join(least, "label").select("fp", "component_id"), "components")
    return found.join(answer, "fp", "left").select(F.col("id").alias(id_column), "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, one of each component: that of the smallest id, of equals the first row."""
    rows, row = numbered(docs, "numbered")
    found = near_duplicates(rows, radius, width, row, text_column).select(row, F.col("component_id").alias("c"))
    ids = rows.select(row, F.col(f"`{id_column}`").alias("id"))
    first = ids.join(found, row).groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", F.col(row).alias("row"))).alias("k"))
    kept = stored(first.select(F.col("k.row").alias(row)), "kept-rows")
    return rows.join(kept, row, "left_semi").drop(row)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
