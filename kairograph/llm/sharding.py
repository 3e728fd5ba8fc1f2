"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size, given by an offset and a stride from two
hashes of its name.  The shards take turns, each claiming the first slot of its order that is still free, until the table
is full.  A key's slot is its hash modulo the table's size; the table (its size is a parameter, so its size is bounded)
is broadcast and placement is one lookup.  When a shard leaves or joins, few keys move.  write_shards() lays whole rows
out by shard; the rows of one shard are dealt to PARTS tasks, so a key with a third of all rows is not one task's work.

A null key has slot and shard of the empty string.  Equal keys have equal shards, repeated rows stay, an empty table
gives an empty result, and very long texts are moved as they are.  The key and other columns may have any name: place()
gives its own columns free names where `slot` or `shard` is taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.llm.common import free_name, fresh, scratch_path, table

#: A prime, over 100 slots for each of the production shards, so that loads differ by about a hundredth.
SLOTS = 65_537
#: Tasks that the rows of a shard are dealt to.
PARTS = 4
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's order over the slots."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard of each slot."""
    if not _prime(slots) or len(shards) > slots or not shards or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime of at least the number of distinct shards")
    orders = [preference(s, slots) for s in shards]
    filled, at, left = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while left:
        for i, (offset, stride) in enumerate(orders):
            while filled[slot := (offset + at[i] * stride) % slots] >= 0:
                at[i] += 1
            filled[slot] = i
            at[i] += 1
            left -= 1
            if not left:
                break
    return filled


def slot_of(key, slots: int = SLOTS):
    """The slot of a key column: the first 60 bits of the MD5 of its text modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def placed(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, str, str]:
    """The rows with all their columns and their slot and shard; the names of those two."""
    slot, shard = free_name(rows, "slot"), free_name(rows, "shard")
    filled = lookup_table(shards, slots)
    lookup = rows.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(filled.tolist())], f"`{slot}` int, `{shard}` string")
    return rows.withColumn(slot, slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(lookup), slot).select(*[F.col(f"`{c}`") for c in rows.columns], slot, shard), slot, shard


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per row: the key, its slot and its shard."""
    return placed(fresh(rows, key), key, shards, slots)[0]


def write_shards(rows: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """Writes the rows, with all their columns, slot and shard, to a folder for each shard and reads them back."""
    found, _, shard = placed(rows, key, shards, slots)
    part = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, T.MapType)]), F.lit(parts))
    found.repartition(F.col(shard), part).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lays the documents out by shard; per document its slot and the shard it lies in, and n_bytes of the text there."""
    docs = table(spark, sf_dir, "documents")
    return write_shards(docs, "doc_id", scratch_path(spark, "shards")).select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"))


def op4_sql() -> str:
    """The same in DuckDB, with the table of slots as a list; the hash and the look-up are DuckDB's own."""
    filled = ", ".join(map(str, lookup_table(SHARDS).tolist()))
    slot = f"CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER)"
    return f"WITH t AS (SELECT [{filled}] AS filled) SELECT doc_id, {slot} AS slot, 'shard-' || lpad(CAST(filled[{slot} + 1] AS VARCHAR), 4, '0') AS shard, strlen(text) AS n_bytes FROM documents, t"


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL = {"op4_sharding": op4_sql()}
