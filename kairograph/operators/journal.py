"""Append-only tables in the shared folder: history rows as they are written, and the log of accesses with its fold.

A journal is a folder of batches.  A batch is written beside the journal and then moved into its place, so it is there as a
whole or not at all, and a batch that is there already is not written again: a job that is run again adds nothing.  Only the
batch's own rows are written.  Names of batches are letters, digits, `_`, `.` and `-`.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.config import InvalidRequest
from kairograph.sources.graph import DDL, claim, current_version, files_of, folder_of

NAME = re.compile(r"[\w.-]+")


class Journal:
    def __init__(self, spark: SparkSession, root: str, ddl: str):
        self.spark, self.root, self.ddl = spark, root, ddl

    def _place(self, batch: str) -> str:
        if not NAME.fullmatch(batch):
            raise InvalidRequest(f"{batch!r} is no name of a batch")
        return f"{self.root}/batches/{batch}"

    def batches(self) -> list[str]:
        fs, path = files_of(self.spark, f"{self.root}/batches")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _earliest(self, rows: DataFrame, time: str):
        return rows.agg(F.min(time)).first()[0]

    def append(self, rows: DataFrame, batch: str, key: str | None = None, time: str | None = None) -> bool:
        """Adds the rows as a batch; False where the batch is there already.

        key: rows whose key is held, or came before in the batch, are left out; time: a column that grows, so that only held
        rows from the batch's earliest time on are looked at."""
        place = self._place(batch)
        fs, target = files_of(self.spark, place)
        if fs.exists(target):
            return False
        if key is not None:
            held = self.read()
            if time is not None:
                earliest = self._earliest(rows, time)  # before rows are put together by key, which shuffles them whole
                held = held.where(F.col(time) >= F.lit(earliest)) if earliest is not None else held.limit(0)
            rows = rows.dropDuplicates([key]).join(held.select(key), key, "left_anti")
        names = self.spark.createDataFrame([], self.ddl).columns
        beside = f"{self.root}/new/{batch}-{uuid.uuid4().hex}"
        rows.select(*names).write.parquet(beside)
        fs.mkdirs(target.getParent())
        written = files_of(self.spark, beside)[1]
        if fs.exists(target) or not fs.rename(written, target):
            fs.delete(written, True)
            return False
        return True

    def read(self, batches: list[str] | None = None) -> DataFrame:
        """The rows of the batches, of all by default."""
        paths = [self._place(b) for b in (self.batches() if batches is None else batches)]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.ddl)

    def drop(self, batches: list[str]) -> None:
        for b in batches:
            fs, path = files_of(self.spark, self._place(b))
            fs.delete(path, True)


def history_journal(spark: SparkSession, root: str) -> Journal:
    """The correction log as a journal: append(rows, batch, key="id", time="changed_at")."""
    return Journal(spark, root, DDL["history"])


class AccessLog(Journal):
    """(id, at) of nodes that were returned, and their totals as of the last fold."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, f"{root}/log", "id string, at timestamp")
        self.folds = f"{root}/folds"

    def record(self, ids: DataFrame, at: Column, batch: str | None = None) -> None:
        """Notes an access of each id."""
        self.append(ids.select("id", at.cast("timestamp").alias("at")), batch or uuid.uuid4().hex)

    def _last(self) -> str | None:
        version = current_version(self.spark, self.folds)
        return folder_of(self.spark, self.folds, version) if version else None

    def totals(self) -> DataFrame:
        """(id, n, at): accesses and the last one's time of each node, up to the last fold."""
        last = self._last()
        ddl = "id string, n long, at timestamp"
        return self.spark.read.schema(ddl).parquet(f"{last}/totals") if last else self.spark.createDataFrame([], ddl)

    def fold(self) -> int:
        """Adds the batches to the totals and takes them out of the log; returns how many.

        The totals and the names of the batches in them become visible together, then the batches go.  A fold that ended in
        between is finished by the next one, which counts nothing twice; of two folds at a time one raises Conflict."""
        last, version = self._last(), current_version(self.spark, self.folds)
        held = self.batches()
        done = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{last}/folded").collect()} if last else set()  # names, one a batch
        self.drop([b for b in held if b in done])
        todo = [b for b in held if b not in done]
        if not todo:
            return 0
        new = self.read(todo).groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
        both = self.totals().unionByName(new).groupBy("id").agg(F.sum("n").alias("n"), F.max("at").alias("at"))

        def write(folder: str) -> None:
            both.write.parquet(f"{folder}/totals")
            self.spark.createDataFrame([(b,) for b in todo], "batch string").coalesce(1).write.parquet(f"{folder}/folded")

        claim(self.spark, self.folds, version + 1, write)
        self.drop(todo)
        if version > 1 and (old := folder_of(self.spark, self.folds, version - 1)):  # the one before may still be read
            fs, path = files_of(self.spark, old)
            fs.delete(path, True)
        return len(todo)

    def accessed(self, nodes: DataFrame) -> DataFrame:
        """The nodes with the totals added to their counts."""
        joined = nodes.join(self.totals(), "id", "left")
        count = (F.col("access_count") + F.coalesce("n", F.lit(0))).cast("int")
        return joined.withColumn("access_count", count).withColumn("last_accessed_at", F.greatest("last_accessed_at", "at")).select(*nodes.columns)
