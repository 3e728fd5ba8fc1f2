"""Plumbing shared by the training-data operators: tables, shared scratch storage and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python operator works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset a local one, which is an
    error unless all run on this machine (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        found = "file://" + os.path.join(tempfile.gettempdir(), "kairograph-checkpoints")
        sc.setCheckpointDir(found)
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kairograph/{label}-{uuid.uuid4().hex}"


_owners: list[str] = []
_scratch: dict[str, list[str]] = {}


@contextlib.contextmanager
def scratch_of(owner: str):
    """What stored() writes inside is the owner's, to be dropped when its results are written."""
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def drop_scratch(spark: SparkSession, owner: str, reader: DataFrame | None = None) -> None:
    """Deletes what the owner's operators have stored so far, but what the reader's plan still reads."""
    paths = _scratch.pop(owner, [])
    read = {part for f in (reader.inputFiles() if reader is not None and paths else []) for part in f.split("/")}
    for path in paths:
        if path.rsplit("/", 1)[1] in read:
            _scratch.setdefault(owner, []).append(path)
            continue
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _owners:
        _scratch.setdefault(_owners[-1], []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it (in either case)."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows with a number each, stored, so that a row keeps its number when a task is run again; the column's name."""
    name = free_name(docs, "__row")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def fresh(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of any name cannot clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about size bytes of the column each."""
    for batch in batches:
        start, total = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            total += n or 0
            if total >= size:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


_memos: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """Registers what an operator keeps in a Python worker between tasks."""
    _memos[owner] = release


def take_turn(owner: str = "") -> None:
    """At a task's start: workers outlive a stage, so what other operators keep in this one is given back first."""
    for name in [k for k in _memos if k != owner]:
        _memos.pop(name)()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_steps(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", owner: str = "", size: int = STEP_BYTES) -> DataFrame:
    """Run work over slices of bounded size of the column; work may return None for no rows.

    owner: of the memos that work uses, so that they last from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(owner)
        for part in steps(batches, column, size):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, nulls as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, nulls as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


#: Longer keys are computed each time, so that a memo's bytes are bounded by its entries.
LONG_KEY = 64


class TwoGenerations(dict):
    """A memo of bounded size: when the young generation is full it becomes the old one; what is used again comes back."""

    def __init__(self, compute: Callable, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONG_KEY:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def release(self) -> None:
        self.clear()
        self.old = {}
