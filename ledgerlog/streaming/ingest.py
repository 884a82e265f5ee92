"""Streaming ingestion: arrival becomes a strictly increasing timestamp, and each micro-batch one commit.

An entry is acknowledged when its micro-batch is committed, not one by one.  A batch that is run again after a failure
finds its number in the manifest and adds nothing; a run that was written without a commit is an orphan that `vacuum`
deletes.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import LONG_MAX, FlushMode
from ..operators import reports, sequence
from ..sources.lines import ARRIVAL
from ..store import LogStore

#: How often a commit may come.  Normal trades the latest entries for throughput; an emergency waits for nothing.
TRIGGER = {FlushMode.NORMAL: "5 seconds", FlushMode.CAUTIOUS: "1 second", FlushMode.EMERGENCY: "0 seconds"}


def stamp(arrivals: DataFrame, now_ns: int, last_ns: int) -> DataFrame:
    """(timestamp_ns, data): max(now, previous + 1) in order of arrival, which is the order of files' names and of lines.

    Spark packs files into tasks by size, so a line's place is its file, its block there (where ``arrivals`` has them as
    `ARRIVAL`) and then its number in the task, which reads a block from its beginning.
    """
    places = [c for c in ARRIVAL if c in arrivals.columns]
    placed = arrivals.select("data", *places, F.monotonically_increasing_id().alias("_arrival"), F.lit(now_ns).alias("_now"))
    return sequence.monotonic(placed, "_now", [*places, "_arrival"], last=last_ns).select("timestamp_ns", "data")


class Ingest:
    """A stream of (data) into a log store.

    ``escalate`` commits all that has landed and pauses compaction from then on; ``drain`` takes what is there and
    ends.  ``counters`` has entries taken, entries above the size limit, and bytes.
    """

    def __init__(self, store: LogStore, arrivals: DataFrame, checkpoint: str, *, name: str = "ingest", mode: FlushMode = FlushMode.CAUTIOUS, clock: Callable[[], int] = time.time_ns):
        self.store, self.arrivals, self.checkpoint, self.name, self.mode, self.clock = store, arrivals, checkpoint, name, mode, clock
        self.counters = {"ingested": 0, "failed": 0, "bytes": 0}
        self.query: StreamingQuery | None = None
        self.compaction: threading.Thread | None = None
        self.failures: list[Exception] = []  # of compactions, which leave the log as it was

    def batch(self, arrivals: DataFrame, number: int) -> None:
        manifest = self.store.manifest()
        if dict(manifest.batches).get(self.name, -1) >= number:
            return
        log = stamp(arrivals, self.clock(), min(manifest.checkpoint_timestamp_ns, LONG_MAX))
        counted = reports.ingest_counters(log, self.store.entry_limit).first()
        self.store.append(log, self.name, number)
        for k in self.counters:
            self.counters[k] += counted[k]
        if self.mode is not FlushMode.EMERGENCY and not (self.compaction and self.compaction.is_alive()):
            self.compaction = threading.Thread(target=self._compact, daemon=True)
            self.compaction.start()

    def _compact(self) -> None:
        """Beside the stream: appends don't wait for it, and its commit goes on top of theirs."""
        try:
            self.store.compact()
        except Exception as e:
            self.failures.append(e)

    def _start(self, **trigger) -> StreamingQuery:
        writer = self.arrivals.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint).queryName(self.name)
        self.query = writer.trigger(**trigger).start()
        return self.query

    def start(self) -> StreamingQuery:
        return self._start(processingTime=TRIGGER[self.mode])

    def drain(self) -> None:
        """Takes everything that has landed, in one or more batches, and ends."""
        self.stop()
        self._start(availableNow=True).awaitTermination()
        self._settle()

    def escalate(self) -> None:
        self.mode = FlushMode.EMERGENCY
        if self.query and self.query.isActive:
            self.query.processAllAvailable()

    def stop(self) -> None:
        if self.query and self.query.isActive:
            self.query.processAllAvailable()
            self.query.stop()
        self._settle()

    def _settle(self) -> None:
        if self.compaction:
            self.compaction.join()
            if self.mode is not FlushMode.EMERGENCY and not self.failures:
                self.store.compact()  # what came while the last one ran


def deduplicated(messages: DataFrame, delay: str = "1 hour", identifier: str = "message_id", event_time: str = "arrived") -> DataFrame:
    """A stream without repeats of an identifier that come within the delay; those later are for the stored check."""
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([identifier])
