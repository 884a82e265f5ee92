"""A log in a folder: sorted Parquet runs, and numbered manifests of which the highest counts.

    <folder>/runs/<min>_<max>-<token>.parquet/   one sorted run (a Parquet data set), immutable
    <folder>/manifest/v<N>.json                  a whole manifest; made under a temporary name, then renamed

A commit is the rename of a manifest to a name that must not exist yet, under a claim that only one writer can create: of
two writers one fails and tries again on top of the other's.  Readers pin a manifest and read exactly its runs, which nothing deletes before `vacuum`.  Paths
go through Hadoop's file systems, so the folder may lie anywhere the cluster reaches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .files import Folder
from .functions.render import CSV_HEADER
from .model import MAX_ENTRY_BYTES, SCHEMA, OutputFormat, entry_size
from .operators import compaction, reads, reports, sequence

RUN_SCHEMA = "path string, min_timestamp_ns bigint, max_timestamp_ns bigint, entry_count bigint, bytes bigint"
FORMAT = 1


class StoreError(RuntimeError):
    pass


class CommitConflict(StoreError):
    """Another writer committed the same version first."""


@dataclass(frozen=True)
class Run:
    path: str
    min_timestamp_ns: int
    max_timestamp_ns: int
    entry_count: int
    bytes: int
    crc: int | None = None  # of the entries' CRC-32 the exclusive or; runs of older manifests have none


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    checkpoint_timestamp_ns: int = 0
    runs: tuple[Run, ...] = ()
    batches: tuple[tuple[str, int], ...] = ()  # of each stream the last micro-batch that is in

    def register(self, run: Run) -> Manifest:
        """With one more run.  A flush must not end before the checkpoint, which then rises to its end."""
        if any(r.path == run.path for r in self.runs):
            raise StoreError(f"run {run.path} is registered already")
        if run.max_timestamp_ns < self.checkpoint_timestamp_ns:
            raise StoreError(f"run {run.path} ends at {run.max_timestamp_ns}, before the checkpoint {self.checkpoint_timestamp_ns}")
        return replace(self, runs=(*self.runs, run), checkpoint_timestamp_ns=max(self.checkpoint_timestamp_ns, run.max_timestamp_ns))

    def swap(self, gone: set[str], new: Run | None) -> Manifest:
        """Compaction's step: runs go and one comes; the checkpoint stays."""
        rest = tuple(r for r in self.runs if r.path not in gone)
        return replace(self, runs=(*rest, new) if new else rest)

    def remove(self, path: str) -> Manifest:
        return replace(self, runs=tuple(r for r in self.runs if r.path != path))

    def dumps(self) -> str:
        return json.dumps({"format": FORMAT} | asdict(self))

    @staticmethod
    def loads(text: str) -> Manifest:
        raw = json.loads(text)
        if raw.get("format", 0) > FORMAT:
            raise StoreError(f"the manifest has format {raw['format']}; this program knows {FORMAT}")
        return Manifest(raw["version"], raw["checkpoint_timestamp_ns"], tuple(Run(**r) for r in raw["runs"]), tuple((s, b) for s, b in raw["batches"]))


def _measures() -> list[Column]:
    return [F.count("*").alias("n"), F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high"), F.sum(entry_size()).alias("bytes"), F.coalesce(F.bit_xor(reports.entry_crc()), F.lit(0)).alias("crc")]


class LogStore:
    def __init__(self, spark: SparkSession, folder: str, *, compaction_threshold: int = 4, compaction_enabled: bool = True, entry_limit: int = MAX_ENTRY_BYTES, flush_threshold: int | None = None):
        self.spark, self.folder, self.flush_threshold = spark, folder.rstrip("/"), flush_threshold
        self.compaction_threshold, self.compaction_enabled, self.entry_limit = compaction_threshold, compaction_enabled, entry_limit
        self.files = Folder(spark, self.folder)
        self.files.make("runs", "manifest")
        self._known: set[str] = set()  # runs of the latest manifest seen

    # -- manifests

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names("manifest") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of a version; an empty log has version 0."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        if version not in known:
            raise StoreError(f"there is no version {version}")
        found = Manifest.loads(self.files.read_text(f"manifest/v{version:020d}.json"))
        if version == known[-1]:
            self._known = {r.path for r in found.runs}
        return found

    def _commit(self, manifest: Manifest) -> Manifest:
        """Validated before, visible at once, or not at all.  Runs that a committed manifest had are not looked for again."""
        new = replace(manifest, version=manifest.version + 1)
        missing = [r.path for r in new.runs if r.path not in self._known and not self.files.exists(f"runs/{r.path}")]
        if missing:
            raise StoreError(f"runs of the manifest are missing: {missing[:3]}")
        if not self.files.publish(f"manifest/v{new.version:020d}.json", new.dumps()):
            raise CommitConflict(f"version {new.version} was committed by another writer")
        self._known = {r.path for r in new.runs}
        return new

    # -- writing

    def _write_run(self, log: DataFrame) -> Run | None:
        """A sorted run in files that don't overlap in time; None for an empty log.  Counts come from what was written."""
        token = uuid.uuid4().hex
        temporary = f"runs/.{token}.tmp"
        log.select("timestamp_ns", "data").orderBy("timestamp_ns").write.parquet(self.files.uri(temporary))
        row = self._measured(temporary)
        if not row.n:
            self.files.delete(temporary)
            return None
        name = f"{row.low:016x}_{row.high:016x}-{token[:12]}.parquet"
        if not self.files.rename(temporary, f"runs/{name}"):
            raise StoreError(f"{temporary} can't be renamed")
        return Run(name, row.low, row.high, row.n, row.bytes, row.crc)

    def _measured(self, part: str) -> Row:
        """Count, bounds, size and checksum of what a run's files hold."""
        written = self.spark.read.schema(SCHEMA).parquet(self.files.uri(part))
        return written.agg(*_measures()).first()

    def check(self, runs: Sequence[Run]) -> None:
        """StoreError unless the runs' files hold what the manifest says, to the checksum; one pass over all of them."""
        if not runs:
            return
        source = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([^/]+)/", 1)
        read = self.spark.read.schema(SCHEMA).parquet(*(self.files.uri(f"runs/{r.path}") for r in runs))
        found = {r.run: Run(r.run, r.low, r.high, r.n, r.bytes, r.crc) for r in read.groupBy(source.alias("run")).agg(*_measures()).collect()}  # a row per run
        for run in runs:
            there = found.get(run.path)
            if there is None or (replace(there, crc=None) if run.crc is None else there) != run:
                raise StoreError(f"run {run.path} is not what was committed: {there} instead of {run}")

    def append(self, log: DataFrame, stream: str | None = None, batch: int | None = None) -> Manifest:
        """Adds a log of timestamps above the checkpoint; entries above the size limit are left out (`reads.oversize` has them).

        With ``stream`` and ``batch`` (of a streaming query) a batch that is in already is not added again.  With the
        store's ``flush_threshold`` a log of more bytes becomes several runs, flushed where the sizes of its entries
        reach the threshold; all of them come with one commit.
        """
        manifest = self.manifest()
        if stream is not None and batch is not None and dict(manifest.batches).get(stream, -1) >= batch:
            return manifest
        runs = self._write_runs(reads.storable(log, self.entry_limit).select("timestamp_ns", "data"))
        while True:
            new = manifest
            for run in runs:
                new = new.register(run)
            if stream is not None and batch is not None:
                new = replace(new, batches=tuple(sorted((dict(manifest.batches) | {stream: batch}).items())))
            if new == manifest:
                return manifest
            try:
                return self._commit(new)
            except CommitConflict:
                time.sleep(0.05)
                manifest = self.manifest()

    def _write_runs(self, log: DataFrame) -> list[Run]:
        """One run, or one per flush: all are written by one job and then take their places."""
        whole = self._write_run(log)
        if whole is None or self.flush_threshold is None or whole.bytes <= self.flush_threshold:
            return [whole] if whole else []
        token = uuid.uuid4().hex
        read = self.spark.read.schema(SCHEMA).parquet(self.files.uri(f"runs/{whole.path}"))
        cut = sequence.flush_segments(read, self.flush_threshold)
        cut.write.partitionBy("segment").parquet(self.files.uri(f"runs/.{token}.tmp"))
        by = self.spark.read.schema("timestamp_ns bigint, data binary, segment bigint").parquet(self.files.uri(f"runs/.{token}.tmp"))
        out = []
        for r in by.groupBy("segment").agg(*_measures()).orderBy("segment").collect():  # a row per flush
            name = f"{r.low:016x}_{r.high:016x}-{token[:12]}.parquet"
            if not self.files.rename(f"runs/.{token}.tmp/segment={r.segment}", f"runs/{name}"):
                raise StoreError(f"{name} can't be renamed")
            out.append(Run(name, r.low, r.high, r.n, r.bytes, r.crc))
        self.files.delete(f"runs/.{token}.tmp")
        self.files.delete(f"runs/{whole.path}")
        return out

    def compact(self, force: bool = False) -> Manifest:
        """Merges runs, if there are enough of them; of equal timestamps the entry of the earlier run stays.

        Runs are taken by tiers (`compaction.picked`): neighbours of like size, and all that overlap them in time; large
        runs stay as they are, so an entry is written again only as often as its tier grows.  ``force`` takes all.  The
        inputs are checked against their checksums first.  A run that is appended meanwhile stays as it is.
        """
        manifest = self.manifest()
        taken = manifest.runs if force else compaction.picked(manifest.runs, self.compaction_threshold) if self.compaction_enabled else ()
        if len(taken) < 2:
            return manifest
        self.check(taken)
        run = self._write_run(compaction.first_wins(self._runs(tuple(taken)), "rank"))
        gone = {r.path for r in taken}
        while True:
            latest = self.manifest()
            if not gone <= {r.path for r in latest.runs}:
                raise StoreError("another compaction took the same runs")
            try:
                return self._commit(latest.swap(gone, run))
            except CommitConflict:
                time.sleep(0.05)

    def vacuum(self, keep_versions: int = 1, older_than_s: float = 3600.0) -> list[str]:
        """Deletes runs that none of the last versions has, leftovers of writers, and older manifests.

        Nothing younger than ``older_than_s`` goes: it may belong to a writer that has not committed yet, or be read.
        """
        known = self.versions()
        kept = known[-max(1, keep_versions) :]
        used = {r.path for v in kept for r in self.manifest(v).runs}
        limit = (time.time() - older_than_s) * 1000
        doomed = []
        for part in ("runs", "manifest"):
            for status in self.files.statuses(part):
                name = status.getPath().getName()
                old = status.getModificationTime() <= limit
                stale = name.endswith((".tmp", ".claim")) or (part == "runs" and name not in used) or (part == "manifest" and name.startswith("v") and int(name[1:-5]) not in kept)
                if old and stale:
                    doomed.append(f"{part}/{name}")
        for name in doomed:
            self.files.delete(name)
        return doomed

    # -- reading

    def _runs(self, runs: tuple[Run, ...]) -> DataFrame:
        """(timestamp_ns, data, rank): rank is the run's place in the manifest."""
        if not runs:
            return self.spark.createDataFrame([], SCHEMA).withColumn("rank", F.lit(0))
        rank = F.lit(len(runs))
        source = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([^/]+)/", 1)
        places = F.create_map(*(x for i, r in enumerate(runs) for x in (F.lit(r.path), F.lit(i)))) if len(runs) > 1 else None
        read = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/runs/{r.path}" for r in runs))
        return read.select("timestamp_ns", "data", (F.coalesce(places[source], rank) if places is not None else F.lit(0)).alias("rank"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    def entries(self) -> DataFrame:
        return self.snapshot().entries()

    def scan(self, low: int | None = None, high: int | None = None) -> DataFrame:
        return self.snapshot().scan(low, high)

    def get(self, timestamp_ns: int) -> bytes | None:
        return self.snapshot().get(timestamp_ns)

    def stats(self) -> DataFrame:
        return self.snapshot().stats()

    def view(self, name: str, version: int | None = None) -> DataFrame:
        """The log of a version as a temporary view for SQL; later versions don't change it."""
        log = self.snapshot(version).log()
        log.createOrReplaceTempView(name)
        return log

    def export(self, output: str, kind: OutputFormat, low: int | None = None, high: int | None = None, limit: int = reads.DEFAULT_LIMIT) -> int:
        """One file of rendered lines in order, which appears whole or not at all; the number of entries.

        Executors sort, render and write the lines as parts; the parts' bytes are copied into one file, which then takes
        the place of the old one in one step.
        """
        snapshot = self.snapshot()
        above, _, last = output.rpartition("/")
        target = Folder(self.spark, above or ("/" if output.startswith("/") else "."))
        work, io = f".{last}.{uuid.uuid4().hex}.tmp", self.spark._jvm.org.apache.hadoop.io.IOUtils
        n = snapshot.log(low, high).count()
        try:
            snapshot.write_lines(target.uri(f"{work}/parts"), kind, low, high, limit)
            stream = target.fs.create(target.path(f"{work}/whole"), False)
            try:
                if kind is OutputFormat.CSV:
                    stream.write(bytearray(f"{CSV_HEADER}\n".encode()))
                for part in target.names(f"{work}/parts"):
                    if part.startswith("part-"):
                        source = target.fs.open(target.path(f"{work}/parts/{part}"))
                        try:
                            io.copyBytes(source, stream, 1 << 20, False)
                        finally:
                            source.close()
                stream.hsync()
            finally:
                stream.close()
            target.replace(f"{work}/whole", last)
        finally:
            target.delete(work)
        return min(n, limit) if limit else n

    def export_parts(self, folder: str, kind: OutputFormat, low: int | None = None, high: int | None = None) -> None:
        """All lines of a range as numbered text files in order, written by the executors: for exports too large for one file."""
        self.snapshot().write_lines(folder, kind, low, high)


@dataclass(frozen=True)
class Snapshot:
    """The log at one version: later appends, compactions and vacuums within their retention don't change it."""

    store: LogStore
    manifest: Manifest

    def catalog(self) -> DataFrame:
        return self.store.spark.createDataFrame([(r.path, r.min_timestamp_ns, r.max_timestamp_ns, r.entry_count, r.bytes) for r in self.manifest.runs], RUN_SCHEMA)

    def log(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Entries of a range, unordered: only the runs that overlap it are opened, and the bounds reach their scans."""
        reads.check_range(low, high)
        runs = tuple(r for r in self.manifest.runs if (high is None or r.min_timestamp_ns <= high) and (low is None or r.max_timestamp_ns >= low))
        return reads.within(self.store._runs(runs), low, high).select("timestamp_ns", "data")

    def entries(self) -> DataFrame:
        return reads.scan_all(self.log())

    def scan(self, low: int | None = None, high: int | None = None) -> DataFrame:
        return reads.scan_all(self.log(low, high))

    def write_lines(self, folder: str, kind: OutputFormat, low: int | None = None, high: int | None = None, limit: int = 0) -> None:
        reads.render(self.log(low, high), kind, limit=limit).select(F.col("line").alias("value")).write.text(folder, lineSep="\n")

    def get(self, timestamp_ns: int) -> bytes | None:
        runs = tuple(r for r in self.manifest.runs if r.min_timestamp_ns <= timestamp_ns <= r.max_timestamp_ns)
        row = reads.get(self.store._runs(runs), timestamp_ns, F.col("rank")).first() if runs else None
        return bytes(row.data) if row else None

    def stats(self) -> DataFrame:
        """(runs, entries, first_ns, last_ns, bytes, checkpoint_ns) from the manifest: no file is opened."""
        runs = self.manifest.runs
        row = (len(runs), sum(r.entry_count for r in runs), min((r.min_timestamp_ns for r in runs), default=None), max((r.max_timestamp_ns for r in runs), default=None), sum(r.bytes for r in runs), self.manifest.checkpoint_timestamp_ns)
        return self.store.spark.createDataFrame([row], "runs bigint, entries bigint, first_ns bigint, last_ns bigint, bytes bigint, checkpoint_ns bigint")

    def replay(self, checkpoint: int) -> DataFrame:
        return reports.replay(self.log(checkpoint + 1), checkpoint)
