"""Watching a tree: polled snapshots as a change feed, debounced, and a rebuild on change.

The stream is driven by a clock (a rate source); each micro-batch lists the
files again and compares their hashes with the state of the last batch, which
is a table in the shared folder.  Changes are appended to a feed; a rebuild
runs once no change came for the quiet time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POLL, QUIET = "1 second", 1.0
INACCESSIBLE = "__INACCESSIBLE__"


def poll_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(file_path, change)``: new, modified or deleted between two snapshots ``(file_path, hash)``."""
    b = before.select("file_path", F.coalesce("hash", F.lit(INACCESSIBLE)).alias("b"))
    n = now.select("file_path", F.coalesce("hash", F.lit(INACCESSIBLE)).alias("n"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("b") != F.col("n"), "modified")
    return b.join(n, "file_path", "full_outer").select("file_path", change.alias("change")).where("change is not null")


def quiet_sessions(changes: DataFrame, key: str, at: str, quiet: str) -> DataFrame:
    """``(key, first_change, n_changes)``: changes of a key, one session until ``quiet`` passes without one.

    Works on batches and, with a watermark set by the caller, on streams.
    """
    rows = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at).alias("_at"), F.col(at).cast("timestamp").alias("_ts"))
    rows = rows if changes.isStreaming else rows.distinct()
    # A session window closes strictly after its gap; a change exactly at the gap still belongs to it.
    window = F.session_window("_ts", f"{quiet} 1 microsecond")
    return rows.groupBy(key, window).agg(F.min("_at").alias("first_change"), F.count("*").alias("n_changes")).select(key, "first_change", "n_changes")


class Watcher:
    """Polls ``snapshot()`` and calls ``on_change(changes)`` after a quiet time.

    ``snapshot`` returns ``(file_path, hash)``.  The last state is a Parquet
    table below ``state_dir``, written to a new folder each time and switched
    by name, so a batch that is run again finds what it started from.
    """

    def __init__(self, spark: SparkSession, snapshot: Callable[[], DataFrame], state_dir: str, on_change: Callable[[DataFrame], None], *, quiet: float = QUIET):
        self.spark, self.snapshot, self.state_dir, self.on_change, self.quiet = spark, snapshot, state_dir.rstrip("/"), on_change, quiet
        self.last_change: float | None = None
        self.generation = -1
        self._remember(snapshot())
        self.reported = self.generation

    def _path(self, generation: int) -> str:
        return f"{self.state_dir}/state-{generation}"

    def _remember(self, now: DataFrame) -> None:
        now.write.mode("overwrite").parquet(self._path(self.generation + 1))
        self.generation += 1

    def poll(self) -> int:
        """Compare with the last state; the number of changes. Fires when changes have settled."""
        now = self.snapshot()
        n = poll_changes(self.spark.read.parquet(self._path(self.generation)), now).count()
        if n:
            self._remember(now)
            self.last_change = time.monotonic()
        elif self.last_change is not None and time.monotonic() - self.last_change >= self.quiet:
            settled = poll_changes(self.spark.read.parquet(self._path(self.reported)), self.spark.read.parquet(self._path(self.generation)))
            self.reported, self.last_change = self.generation, None
            self.on_change(settled)
        return n

    def start(self, interval: str = POLL) -> StreamingQuery:
        """Poll on a clock until the query is stopped."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.trigger(processingTime=interval).foreachBatch(lambda _, __: self.poll()).start()


def change_stream(changes: DataFrame, *, late: str = "1 minute") -> DataFrame:
    """The newest state of each path in a stream ``(file_path, hash, at)``: rows with a change, repeated states dropped."""
    return changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["file_path", "hash"])
