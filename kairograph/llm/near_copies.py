"""SimHash near-dedup with a similarity of its own: near copies by word shingles, checked exactly.

A text is the set of its shingles of WIDTH words (lower case; a shorter text is one shingle).  Equal sets are one node.
Nodes are dealt out by what may link them: nodes that agree on ROWS minima of hashes at once in one of BANDS bands, and
nodes connected through such, are a group; a pair at the least similarity of 0.8 agrees in none with a chance of 5e-10.
A group is cut into parts.  Each part is compared in itself; then one node of each component found so, of all parts of a
group; and only in groups that are still apart all pairs of parts meet, so that no link is lost and a large group of
copies costs no more than its size.  Where nodes meet, the 64-bit SimHash fingerprints of the sets are compared by the
tiled exact comparison of simhash_dedup, at RADIUS: sets of similarity 0.8 differ in 10 +- 3 bits, so 22 loses about one
such pair in 100,000, most of which other links connect.  Whether a pair within the radius is linked is decided by the
Jaccard similarity of the sets alone.  A task leaves out pairs that its links already connect and returns a spanning
forest; connected() joins the forests.

Null texts and texts without a word are one node.  Repeated rows are copies.  Very long texts are read whole.  Other
columns are kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bytes_of, map_steps, numbered, stored, take_turn
from kairograph.llm.components import connected
from kairograph.llm.simhash_dedup import majority, tiled_links

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 30, 3
#: Bits that fingerprints of linked sets may differ in.
RADIUS = 22
#: Nodes of a part; an item of work holds two parts at most.
PART = 512
#: Shingles whose minima are taken at once.
HASHED = 1 << 10
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
MASKS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes)[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops[width - 1 :].tolist())], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), HASHED):
        least = np.minimum(least, ((found[None, k : k + HASHED] ^ MASKS[:, None]) * FACTORS[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_key(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 7)], np.uint64).view(np.int64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, each in order and without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(len(both) - common, 1)


def forest(sets: list[np.ndarray], least: float, radius: int = RADIUS, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all pairs within the radius and of at least that similarity would; known: sets of
    equal numbers are connected already."""
    fp = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    a, b = (order[x] for x in tiled_links(fp[order], radius))
    fits = np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b])
    a, b = a[fits], b[fits]
    near = np.argsort(np.bitwise_count(fp[a] ^ fp[b]), kind="stable")
    a, b = a[near], b[near]
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    apart = label[a] != label[b]
    a, b, out, at_once = a[apart], b[apart], [], 64
    while len(a):
        joined = False
        for i, j in zip(a[:at_once].tolist(), b[:at_once].tolist()):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= least:
                out.append((i, j))
                label[label == label[i]] = label[j]
                joined = True
        a, b = a[at_once:], b[at_once:]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        at_once = 64 if joined else 2 * at_once
    return out


def links(texts: DataFrame, least: float, width: int, across: bool) -> DataFrame:
    """(a, b) of nodes.  texts: text, key of its set, group and label; only nodes of one group are compared, and nodes of
    one label are connected already.  across: pairs of different parts of a group meet too."""
    parts = texts.groupBy("group").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if across else F.col("own")
    items = texts.join(parts, "group").withColumn("own", own).withColumn("other", other)
    items = items.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("item"), "key", "label", "text")
    items = items.repartition("item").sortWithinPartitions("item", "key")

    def compare(batches):
        take_turn()
        item, names, known, held = None, [], [], []

        def ready():
            found = forest(held, least, known=np.array(known, np.int64)) if len(held) > 1 and len(set(known)) > 1 else []
            return pa.record_batch([pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for at, key, label, text in zip(batch.column("item").to_pylist(), batch.column("key").to_pylist(), batch.column("label").to_pylist(), batch.column("text").cast(pa.binary())):
                if at != item:
                    yield ready()
                    item, names, known, held = at, [], [], []
                names.append(key)
                known.append(label)
                held.append(shingles(text.as_py() or b"", width))
        yield ready()

    return items.mapInArrow(compare, "a long, b long")


def labelled(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (key, group, row) with label: the component of found (node, label) that a node is in, else itself."""
    return groups.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def component_links(rows: DataFrame, groups: DataFrame, least: float, width: int) -> DataFrame:
    """(node, label) of linked nodes.  rows: row and text; groups: key, group and row, stored."""
    texts = lambda wanted: rows.join(wanted, "row").select("group", "key", "label", "text")
    within = stored(links(texts(groups.withColumn("label", F.col("key"))), least, width, False), "links-within")
    parted = groups.groupBy("group").count().where(F.col("count") > PART).select("group")
    named = stored(labelled(groups, connected(within)).join(parted, "group", "left_semi"), "parted")
    if named.isEmpty():
        return connected(within)
    heads = named.where("label = key")
    between = stored(within.union(links(texts(heads), least, width, True)), "links-between")
    labels = connected(between)
    again = labelled(named.drop("label"), labels)
    apart = again.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("group")
    rest = stored(again.join(apart, "group", "left_semi"), "apart")
    return labels if rest.isEmpty() else connected(between.union(links(texts(rest), least, width, True)))


def keep_one(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, one of each component: that of the smallest id, of equals the first row."""
    whole, row = numbered(docs, "numbered")
    rows = whole.select(F.col(row).alias("row"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, width) for t in bytes_of(batch)]
        keys = pa.array([set_key(s) for s in found], pa.int64())
        return pa.record_batch([batch.column("row"), batch.column("id"), keys, pa.array([bands(s) for s in found], pa.list_(pa.int64()))], ["row", "id", "key", "bands"])

    signed = stored(map_steps(rows, work, f"row long, id {rows.schema['id'].dataType.simpleString()}, key long, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row"))
    nodes = stored(signed.groupBy("key").agg(first.alias("k"), F.any_value("bands").alias("bands")), "nodes")
    dealt = nodes.select("key", F.explode("bands").alias("band"))
    # each node of a band with the least of it: rows in proportion to the nodes, and they connect what may be linked
    least_of = dealt.groupBy("band").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    groups = connected(dealt.join(least_of, "band").select("a", F.col("key").alias("b")))
    groups = groups.union(groups.select("label", "label").distinct()).toDF("key", "group")  # the least node is not listed itself
    wanted = stored(nodes.select("key", F.col("k.row").alias("row")).join(groups, "key"), "grouped")
    labels = component_links(rows.select("row", "text"), wanted, least, width)
    named = nodes.join(labels, nodes.key == labels.node, "left").select("k", F.coalesce("label", "key").alias("label"))
    kept = named.groupBy("label").agg(F.min("k").alias("k")).select(F.col("k.row").alias(row))
    gone = stored(signed.select(F.col("row").alias(row)).join(stored(kept, "kept-rows"), row, "left_anti"), "dropped-rows")
    return whole.join(gone, row, "left_anti").drop(row)  # far fewer rows than are kept
