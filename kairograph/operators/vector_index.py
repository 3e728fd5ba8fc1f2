"""Approximate vector search: cells around centres, product-quantised codes that are scored first, and exact re-ranking.

A unit vector is kept as the number of its nearest centre and, for each `width` dimensions of what is left after the centre
is taken away, the number of one of 256 entries: one byte for eight bytes of a vector at two dimensions.  A search reads the
codes of the cells nearest to a query, takes the SHORT best of them and reads the vectors of these alone.

Centres and entries are fitted on a bounded sample (SAMPLE rows, chosen by hash); every row that has a vector is indexed.
The index is a table of (id, code, embedding) partitioned by cell and sorted by id, so codes are read without vectors, and
single vectors page by page.

Searches are laid out in tiles of at most TILE_ROWS rows and about TILE_QUERIES queries: small cells share a bin, a large
cell is cut into parts, many queries of a bin are cut by salt.  So a cell that holds a third of all rows is many tiles.
exact() lays out the vectors themselves in the same way.

Rows without a vector, and vectors of another length, are not indexed.  Ids must be unique.  Ties go to the smaller id.  An
empty table gives an index that finds nothing.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.config import Conflict
from kairograph.functions.vectors import cosine
from kairograph.sources.graph import claim, cut, folder_of

SAMPLE, ROUNDS, ENTRIES, WIDTH = 20_000, 10, 256, 2
SHORT = 40
TILE_ROWS, TILE_QUERIES = 65_536, 4_096
#: Queries of a request that counts as small.
BLOCK = 128
#: Numbers of a table of scores that a task holds at a time (16 MB in double precision), whatever the tiles and cells.
SCORES = 1 << 21
#: Short lists of up to so many ids are asked for by id, so that only their pages are read.
ASKED = 2_000
#: Rows of a page of the index.
PAGE_ROWS = 128


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _means(points: np.ndarray, k: int, unit: bool) -> np.ndarray:
    """k centres by rounds of assignment and mean; of unit length if told so."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T - (0 if unit else 0.5 * (centres**2).sum(axis=1))).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, points)
        means = _unit(sums) if unit else sums / np.maximum(n, 1)[:, None]
        centres = np.where((n > 0)[:, None], means, centres)
    return centres.astype(np.float32)


@dataclass(frozen=True)
class Quantiser:
    """centres: cells x dimension; entries: subspaces x ENTRIES x width of the residuals."""

    centres: np.ndarray
    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def cells(self, unit: np.ndarray, probes: int) -> np.ndarray:
        near = -(unit @ self.centres.T)
        return near.argmin(axis=1)[:, None] if probes == 1 else np.argsort(near, axis=1, kind="stable")[:, :probes]

    def split(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The residuals in subspaces, the last one filled up with zeros."""
        spaces, _, width = self.entries.shape
        rest = np.zeros((len(unit), spaces * width), np.float32)
        rest[:, : unit.shape[1]] = unit - self.centres[cell]
        return rest.reshape(len(unit), spaces, width)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.split(unit, cell)
        code = np.empty(rest.shape[:2], np.uint8)
        for k, entries in enumerate(self.entries):
            code[:, k] = (rest[:, k] @ entries.T - 0.5 * (entries**2).sum(axis=1)).argmax(axis=1)
        return code

    def decode(self, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = np.concatenate([entries[code[:, k]] for k, entries in enumerate(self.entries)], axis=1)
        return self.centres[cell] + rest[:, : self.dimension]

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, entries=self.entries)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Quantiser:
        held = np.load(io.BytesIO(data))
        return Quantiser(held["centres"], held["entries"])


def _whole() -> Column:
    """Whether a row has a vector without gaps."""
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE, width: int = WIDTH, id_column: str = "id") -> Quantiser:
    """The quantiser of about `sample` rows of the most common length; vectors: id, embedding."""
    rows = vectors.where(_whole()).select(F.xxhash64(id_column).alias("h"), F.col(id_column).alias("id"), "embedding")
    n = rows.count()
    grain = 1 << 40
    some = rows.where(F.pmod("h", F.lit(grain)) < F.lit(grain if n <= sample else sample * grain // n))
    found = [r.embedding for r in some.orderBy("h", "id").limit(2 * sample).select("embedding").collect()]  # bounded by sample
    if not found:
        return Quantiser(np.zeros((0, 0), np.float32), np.zeros((0, 0, width), np.float32))
    lengths = np.bincount([len(v) for v in found])
    points = _unit(np.array([v for v in found if len(v) == lengths.argmax()], np.float32))
    centres = _means(points, cells, unit=True)
    bare = Quantiser(centres, np.zeros((-(-centres.shape[1] // width), 1, width), np.float32))
    rest = bare.split(points, bare.cells(points, 1)[:, 0])
    return Quantiser(centres, np.stack([_means(rest[:, k], ENTRIES, unit=False) for k in range(rest.shape[1])]))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Vectors of that length as rows; without an object for each number."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _known(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of that length, and these as unit vectors."""
    long = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
    mine = column.take(pa.array(at))
    whole = ~_matrix(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pc.is_null(pc.list_flatten(mine))), width, bool).any(axis=1)
    return at[whole], _unit(_matrix(mine.take(pa.array(np.flatnonzero(whole))), width, np.float32))


def _slices(batches, columns: int):
    """The batches cut so that a number for each row and column stays within SCORES."""
    step = max(1, SCORES // max(columns, 1))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def with_codes(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(id, code, embedding, cell) of the rows (id, embedding) that have a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        own = shared.value
        for batch in _slices(batches, len(own.centres)):
            at, unit = _known(batch.column("embedding"), own.dimension)
            if not len(at):
                continue
            cell = own.cells(unit, 1)[:, 0]
            code = own.encode(unit, cell)
            kept = batch.take(pa.array(at))
            yield pa.record_batch([kept.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), kept.column("embedding"), pa.array(cell.astype(np.int32))], ["id", "code", "embedding", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "embedding").mapInArrow(run, f"id {kinds['id']}, code binary, embedding {kinds['embedding']}, cell int")


@dataclass(frozen=True)
class VectorIndex:
    """rows: (id, code, embedding, cell); sizes: the number of rows of each cell that has any."""

    rows: DataFrame
    quantiser: Quantiser
    sizes: dict[int, int]

    def count(self) -> int:
        return sum(self.sizes.values())


def write(rows: DataFrame, quantiser: Quantiser, path: str) -> None:
    """Writes the index of the rows (id, embedding) to a new folder."""
    spark = rows.sparkSession
    coded = with_codes(rows, quantiser)
    spread = coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    spread.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", 64 << 20).partitionBy("cell").parquet(f"{path}/rows")
    held = spark.read.schema(coded.schema).parquet(f"{path}/rows")
    held.groupBy("cell").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")  # a row a cell
    spark.createDataFrame([(quantiser.dumped(),)], "quantiser binary").coalesce(1).write.parquet(f"{path}/quantiser")


def read(spark: SparkSession, path: str, id_type: str) -> VectorIndex:
    """The index that write() left there.  id_type: of the rows' ids."""
    rows = spark.read.schema(f"id {id_type}, code binary, embedding array<float>, cell int").parquet(f"{path}/rows")
    sizes = {r.cell: r.n for r in spark.read.schema("cell int, n long").parquet(f"{path}/sizes").collect()}
    return VectorIndex(rows, Quantiser.loaded(bytes(spark.read.parquet(f"{path}/quantiser").first().quantiser)), sizes)


def opened(rows: DataFrame, root: str, cells: int | None = None, width: int = WIDTH) -> VectorIndex:
    """The index under root, built if there is none yet; of two builders one wins.  rows: id, embedding (array<float>)."""
    spark = rows.sparkSession
    if folder_of(spark, root, 1) is None:
        quantiser = fit(rows, cells or max(1, round(rows.count() ** 0.5)), width=width)
        with contextlib.suppress(Conflict):  # another session built it meanwhile
            claim(spark, root, 1, lambda folder: write(rows, quantiser, folder))
    return read(spark, folder_of(spark, root, 1), rows.schema["id"].dataType.simpleString())


# tiles


def _bins(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bin, parts) of each cell: small cells share a bin of TILE_ROWS rows, larger ones have parts."""
    out, bin_, filled = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if filled and filled + n > TILE_ROWS:
            bin_, filled = bin_ + 1, 0
        out[cell] = (bin_, max(1, -(-n // TILE_ROWS)))
        filled += n
    return out


def _best(scores: np.ndarray, limit: int) -> list[np.ndarray]:
    """The places of the `limit` highest of each row, the first of equals; minus infinity counts as none."""
    k = min(limit, scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = []
    for row, bound in zip(scores, least):
        at = np.flatnonzero((row >= bound) & (row > -np.inf))
        out.append(at[np.argsort(-row[at], kind="stable")][:k])
    return out


def _scored(rows: DataFrame, asked: DataFrame, limit: int, points: Callable, id_type: str, query_type: str) -> DataFrame:
    """(query_id, id, cell, score): the `limit` best rows of each query in each tile it meets.

    rows: id, cell, bin, part, parts and what points() makes unit vectors of.  asked: query_id, q, bin, cells (null: all)."""
    spark = rows.sparkSession
    many = {r.bin: -(-r.n // TILE_QUERIES) for r in asked.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row a bin
    if not many:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, cell int, score float")
    salts = spark.createDataFrame(list(many.items()), "bin int, salts int")
    parts = rows.select("bin", "parts").distinct()  # a row a bin
    spread = rows.join(F.broadcast(salts), "bin").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "parts")
    met = asked.join(F.broadcast(salts), "bin").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")).join(F.broadcast(parts), "bin")
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("salts", "parts")

    def run(mine: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "id", "cell", "score"]
        if not mine.num_rows or not queries.num_rows:
            return pa.table([queries.column("query_id").slice(0, 0), mine.column("id").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float32())], names)
        mine = mine.sort_by("id")
        cell = mine.column("cell").to_numpy()
        vectors = points(mine)
        wanted = queries.column("cells")
        ids, places, found = [], [], []
        step = max(1, SCORES // len(vectors))
        for begin in range(0, queries.num_rows, step):
            block = queries.slice(begin, step)
            unit = _unit(np.array(block.column("q").to_pylist(), vectors.dtype))
            scores = np.round(unit @ vectors.T, 6)
            for i, cells in enumerate(wanted.slice(begin, step).to_pylist()):
                if cells is not None:
                    scores[i, ~np.isin(cell, cells)] = -np.inf
            for i, at in enumerate(_best(scores, limit)):
                ids.append(np.full(len(at), begin + i))
                places.append(at)
                found.append(scores[i, at])
        who, where = np.concatenate(ids), np.concatenate(places)
        return pa.table([queries.column("query_id").take(pa.array(who)), mine.column("id").take(pa.array(where)), pa.array(cell[where].astype(np.int32)), pa.array(np.concatenate(found).astype(np.float32))], names)

    keys = ["bin", "part", "salt"]
    return spread.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, f"query_id {query_type}, id {id_type}, cell int, score float")


def _types(rows: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return rows.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()


def _ranked(found: DataFrame, score: str, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, bin, cells): the queries (id, embedding) in each bin that holds one of their nearest cells."""
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    shared = queries.sparkSession.sparkContext.broadcast((index.quantiser, _bins(index.sizes)))

    def run(batches):
        own, bins = shared.value
        for batch in _slices(batches, 8 * len(own.centres)):  # of each query and cell there are objects, too
            at, unit = _known(batch.column("embedding"), own.dimension)
            if not len(at):
                continue
            rows, by_bin, cells = [], [], []
            for i, near in zip(at.tolist(), own.cells(unit, probes).tolist()):
                mine: dict[int, list[int]] = {}
                for c in near:
                    if c in bins:
                        mine.setdefault(bins[c][0], []).append(c)
                for b, own_cells in mine.items():
                    rows.append(i)
                    by_bin.append(b)
                    cells.append(own_cells)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch([kept.column("id"), kept.column("embedding"), pa.array(by_bin, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "q", "bin", "cells"])

    return queries.select("id", "embedding").mapInArrow(run, f"query_id {kinds['id']}, q {kinds['embedding']}, bin int, cells array<int>")


def short_list(index: VectorIndex, queries: DataFrame, probes: int, short: int = SHORT) -> DataFrame:
    """(query_id, id, cell): the rows whose codes are nearest to each query (id, embedding), itself excluded."""
    id_type, query_type = _types(index.rows, queries)
    spark = queries.sparkSession
    bins = _bins(index.sizes)
    if not bins:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, cell int")
    dealt = spark.createDataFrame([(c, b, p) for c, (b, p) in bins.items()], "cell int, bin int, parts int")  # a row a cell
    rows = index.rows.select("id", "cell", "code")
    if index.count() and (few := _few_cells(index, queries, probes)) is not None:
        rows = rows.where(F.col("cell").isin(few))
    rows = rows.join(F.broadcast(dealt), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    shared = spark.sparkContext.broadcast(index.quantiser)

    def points(mine: pa.Table) -> np.ndarray:
        code = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(mine.num_rows, -1)
        return shared.value.decode(code, mine.column("cell").to_numpy())

    found = _scored(rows, probed(index, queries, probes), short + 1, points, id_type, query_type)
    return _ranked(found.where("id <> query_id"), "score", short).select("query_id", "id", "cell")


def _few_cells(index: VectorIndex, queries: DataFrame, probes: int) -> list[int] | None:
    """The cells that a few queries ask for, to read these only; None for many queries."""
    few = queries.where("embedding is not null").limit(BLOCK + 1).select("embedding").collect()  # bounded
    if len(few) > BLOCK:
        return None
    vectors = [r.embedding for r in few if len(r.embedding) == index.quantiser.dimension]
    return sorted({int(c) for c in index.quantiser.cells(_unit(np.array(vectors, np.float32)), probes).ravel()}) if vectors else []


def vectors_of(index: VectorIndex, wanted: DataFrame) -> DataFrame:
    """wanted (query_id, id, cell) with the rows' embedding; a few are asked for by id, so that only their pages are read."""
    few = wanted.select("cell", "id").distinct().limit(ASKED + 1).collect()  # bounded
    rows = index.rows.select("id", "cell", "embedding")
    if len(few) <= ASKED:
        by_cell: dict[int, list] = {}
        for r in few:
            by_cell.setdefault(r.cell, []).append(r.id)
        rows = rows.where(reduce(or_, [(F.col("cell") == c) & reduce(or_, [F.col("id") == i for i in own]) for c, own in by_cell.items()], F.lit(False)))
    return wanted.join(rows, ["cell", "id"])


def search(index: VectorIndex, queries: DataFrame, probes: int, limit: int, short: int = SHORT) -> DataFrame:
    """(query_id, id, similarity, rank): the nearest rows of each query (id, embedding), itself excluded."""
    wanted = cut(short_list(index, queries, probes, short))
    met = vectors_of(index, wanted).join(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return _ranked(met.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")), "similarity", limit)


def read_share(index: VectorIndex, queries: DataFrame, probes: int, short: int = SHORT) -> DataFrame:
    """(query_id, share): the bytes of codes and vectors that a query reads, over those of all vectors."""
    spark, whole = queries.sparkSession, max(index.count(), 1) * 4 * max(index.quantiser.dimension, 1)
    sizes = spark.createDataFrame(list(index.sizes.items()), "cell int, n long")
    near = probed(index, queries, probes).select("query_id", F.explode("cells").alias("cell"))
    scored = near.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("n"))
    read_bytes = F.col("n") * len(index.quantiser.entries) + F.least(F.col("n"), F.lit(short)) * 4 * index.quantiser.dimension
    return scored.select("query_id", (read_bytes / whole).alias("share"))


def exact(rows: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """search() over all rows (id, embedding): every vector is scored, in tiles.  Vectors of the queries' length count."""
    id_type, query_type = _types(rows, queries)
    known = rows.where(_whole())
    lengths = known.select("id", "embedding", F.size("embedding").alias("cell"))  # only equal lengths can be compared
    sizes = {r.cell: r.n for r in lengths.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a length
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.size("embedding").alias("bin"), F.lit(None).cast("array<int>").alias("cells"))
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, max(1, -(-n // TILE_ROWS)))]) if sizes else F.lit(None).cast("map<int,int>")
    dealt = lengths.withColumn("bin", F.col("cell")).withColumn("parts", parts[F.col("cell")]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def points(mine: pa.Table) -> np.ndarray:
        column = mine.column("embedding")
        return _unit(_matrix(column, len(column[0]), np.float64))

    found = _scored(dealt, asked, limit + 1, points, id_type, query_type).where("id <> query_id")
    return _ranked(found.select("query_id", "id", F.round(F.col("score").cast("double"), 6).alias("similarity")), "similarity", limit)
