"""The change stream: one event for each request that changed something, handed to all who listen."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.config import InvalidRequest
from kairograph.operators.journal import NAME
from kairograph.sources.graph import files_of

# Fixed values (sorted here): POST routes that only read.
READ_ONLY = ("/graph", "/history/search", "/planner/plans", "/planner/tasks", "/query", "/recall", "/tasks", "/timeline")
REQUEST_DDL = "at timestamp, method string, path string, status int"


def change_events(requests: DataFrame) -> DataFrame:
    """Requests that changed something as (type, at): no GET, no failure, no read by POST.  Works on streams too."""
    path = F.regexp_replace("path", r"\?.*$", "")
    changed = (F.upper("method") != "GET") & (F.col("status") < 400) & ~((F.upper("method") == "POST") & path.isin(*READ_ONLY))
    return requests.where(changed).select(F.lit("changed").alias("type"), "at")


def stream(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files: int | None = None, until_now: bool = False):
    """Reads request logs as they arrive and hands each batch of change events to sink(df, batch_id).

    files: of a batch at most; until_now: ends when all that is there is read."""
    reader = spark.readStream.schema(REQUEST_DDL)
    requests = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    writer = change_events(requests).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if until_now else writer).start()


def request_log(requests: DataFrame) -> DataFrame:
    """The log line of each request (request_id, method, url, status, seconds), as config.request_line() writes one; works on
    streams too.  A request without an id gets one."""
    own = F.trim(F.coalesce("request_id", F.lit("")))
    level = F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warning").otherwise("info")
    return requests.select(level.alias("level"), F.when(own == "", F.expr("uuid()")).otherwise(own).alias("request_id"), "method", F.regexp_replace("url", r"\?.*$", "").alias("path"), "status", F.round(F.col("seconds") * 1000).cast("long").alias("duration_ms"))


@dataclass(frozen=True)
class Change:
    """A batch that changed something: the number of its changes and the last one's time."""

    batch: int
    n: int
    at: datetime


class FanOut:
    """A sink of stream() that tells each subscriber of every batch with changes, in order.

    The batches' summaries and each named subscriber's last batch are files under the stream's own checkpoint, so they live
    and go with it.  A batch is written down before anyone is told, and a subscriber's place after it was told.  So a process
    that is started again with the same checkpoint tells a named subscriber what it has missed and nothing twice; only if
    the process ends between telling and writing down is one batch told again, which its number shows.  A new name begins
    after the last batch that is written down.  A subscriber that fails is dropped, its place stays.  Unnamed subscribers
    are told from then on, and nothing of them is kept.  Batches that every name was told are forgotten but for the last.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.root = spark, f"{checkpoint}/fan-out"
        self._lock = threading.RLock()
        self._held: dict[str | int, tuple[Callable[[Change], None], Callable[[], None] | None]] = {}
        self._places: dict[str, int] = {}
        self._next = 0
        self._batches = {int(n): None for n in self._names("batches")}
        for name in self._names("places"):
            self._places[name] = max(map(int, self._names(f"places/{name}")), default=-1)

    def _names(self, folder: str) -> list[str]:
        fs, path = files_of(self.spark, f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _write(self, file: str, content: str) -> None:
        """A file that is there whole or not at all."""
        fs, path = files_of(self.spark, f"{self.root}/{file}")
        beside = files_of(self.spark, f"{self.root}/new-{file.replace('/', '-')}")[1]
        out = fs.create(beside, True)
        out.write(content.encode())
        out.close()
        fs.mkdirs(path.getParent())
        fs.rename(beside, path)

    def _change(self, batch: int) -> Change | None:
        """The summary of a batch that is written down; None if nothing changed in it."""
        fs, path = files_of(self.spark, f"{self.root}/batches/{batch:012d}")
        reader = fs.open(path)
        held = json.loads(bytes(reader.readAllBytes()).decode())
        reader.close()
        return Change(batch, held["n"], datetime.fromisoformat(held["at"])) if held["n"] else None

    def _told(self, name: str, batch: int) -> None:
        before = self._places.get(name)
        self._write(f"places/{name}/{batch:012d}", "")
        self._places[name] = batch
        if before is not None and before != batch:
            self._delete(f"places/{name}/{before:012d}")

    def _delete(self, file: str) -> None:
        fs, path = files_of(self.spark, f"{self.root}/{file}")
        fs.delete(path, False)

    def subscribe(self, told: Callable[[Change], None], name: str | None = None, alive: Callable[[], None] | None = None) -> Callable[[], None]:
        """Begins to tell a subscriber, first what a known name has missed.  alive: called by beat().  Returns what ends the
        subscription; the name's place stays, see forget()."""
        with self._lock:
            if name is None:
                key, self._next = self._next, self._next + 1
            elif not NAME.fullmatch(name):
                raise InvalidRequest(f"{name!r} is no name of a subscriber")
            else:
                key = name
                if name not in self._places:
                    self._told(name, max(self._batches, default=-1))
            self._held[key] = (told, alive)
            if name is not None:
                for batch in sorted(b for b in self._batches if b > self._places[name]):
                    self._tell(key, self._change(batch), batch)
        return lambda: self._held.pop(key, None)

    def forget(self, name: str) -> None:
        """Ends a name: its place is deleted, and batches are no longer kept for it."""
        with self._lock:
            self._held.pop(name, None)
            if self._places.pop(name, None) is not None:
                fs, path = files_of(self.spark, f"{self.root}/places/{name}")
                fs.delete(path, True)

    def _tell(self, key: str | int, change: Change | None, batch: int) -> None:
        if key not in self._held:
            return
        if change is not None:
            try:
                self._held[key][0](change)
            except Exception:
                self._held.pop(key, None)
                return
        if isinstance(key, str):
            self._told(key, batch)

    def beat(self) -> None:
        """Asks every subscriber whether it is still there; one that fails is dropped."""
        with self._lock:
            for key, (_, alive) in list(self._held.items()):
                try:
                    if alive:
                        alive()
                except Exception:
                    self._held.pop(key, None)

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        n, last = events.agg(F.count("*"), F.unix_micros(F.max("at"))).first()
        with self._lock:
            new = batch_id not in self._batches
            if new:
                at = None if last is None else datetime.fromtimestamp(last / 1e6, UTC).isoformat()
                self._write(f"batches/{batch_id:012d}", json.dumps({"n": n, "at": at}))
                self._batches[batch_id] = None
            change = self._change(batch_id)
            for key in list(self._held):
                if new if isinstance(key, int) else batch_id > self._places[key]:
                    self._tell(key, change, batch_id)
            seen = min(self._places.values(), default=batch_id)
            for old in [b for b in self._batches if b <= seen and b < max(self._batches)]:
                self._delete(f"batches/{old:012d}")
                del self._batches[old]
