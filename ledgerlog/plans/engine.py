"""Queries that take the store, its files and its stream through whole tables, with their equivalents in DuckDB's SQL.

Each works in a folder of its own below the shared checkpoint folder.  Its result is written there, apart, before the
folder goes, so that what it returns depends on nothing that was deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model, timeparse
from ..files import Folder
from ..model import OutputFormat
from ..operators import reads, reports
from ..operators.lineage import checkpoint_dir, cut_lineage
from ..sources import binary, lines
from ..store import RUN_SCHEMA, LogStore, Manifest, Run
from ..streaming.ingest import Ingest
from .logs import FIRST, FLUSH_BYTES, events_log
from .tables import table

#: Appends that the log of events comes in.
PARTS = 3


@contextmanager
def _folder(spark: SparkSession) -> Iterator[Folder]:
    work = Folder(spark, f"{checkpoint_dir(spark)}/engine-{uuid.uuid4().hex}")
    work.make("")
    try:
        yield work
    finally:
        work.delete("")


def _bounds(log: DataFrame) -> list[int]:
    """The upper bounds of equal parts of the log's time."""
    row = reports.stats(log).first()
    low, high = row.first_ns or 0, row.last_ns or 0
    return [low + (high - low) * k // PARTS for k in range(PARTS + 1)]


def _filled(spark: SparkSession, folder: str, work: Folder, **settings) -> tuple[LogStore, list[int]]:
    """The log of events in a store, appended in parts."""
    log, store = events_log(spark, folder), LogStore(spark, work.uri("log"), **settings)
    cuts = _bounds(log)
    for k in range(PARTS):
        store.append(reads.within(log, cuts[k] + (k > 0), cuts[k + 1]))
    return LogStore(spark, work.uri("log"), **settings), cuts


def _shown(log: DataFrame) -> DataFrame:
    return cut_lineage(log.select("timestamp_ns", F.hex("data").alias("data_hex")))


def q_store_roundtrip(spark, folder):
    """All entries of a store that is opened again."""
    with _folder(spark) as work:
        return _shown(_filled(spark, folder, work)[0].entries())


def q_store_scan(spark, folder):
    """A range of a stored log: the second part of its time."""
    with _folder(spark) as work:
        store, cuts = _filled(spark, folder, work)
        return _shown(store.scan(cuts[1], cuts[2]))


def q_store_get(spark, folder):
    """The stored entry at the last timestamp."""
    with _folder(spark) as work:
        store, cuts = _filled(spark, folder, work)
        data = store.get(cuts[-1])
        return spark.createDataFrame([(cuts[-1], data.hex().upper())] if data is not None else [], "timestamp_ns bigint, data_hex string")


def q_snapshot_version(spark, folder):
    """What the version after the second append holds, once a third came and all was compacted."""
    with _folder(spark) as work:
        store, _ = _filled(spark, folder, work)
        store.compact(force=True)
        return _shown(store.snapshot(2).entries())


def q_compact_store(spark, folder):
    """A stored log whose second append repeats and changes the first one's timestamps, compacted and vacuumed."""
    with _folder(spark) as work:
        log, store = events_log(spark, folder), LogStore(spark, work.uri("log"))
        store.append(reads.within(log, None, _bounds(log)[2]))
        store.append(log.withColumn("data", F.concat(F.lit(b"second "), "data")))
        store.compact(force=True)
        store.vacuum(older_than_s=0.0)
        return _shown(store.entries())


def q_store_stats(spark, folder):
    """Counts and bounds from the manifest alone."""
    with _folder(spark) as work:
        return _filled(spark, folder, work)[0].stats()


def q_flushed_runs(spark, folder):
    """The runs of one append that is flushed by size."""
    with _folder(spark) as work:
        store = LogStore(spark, work.uri("log"), flush_threshold=4 * FLUSH_BYTES)
        store.append(events_log(spark, folder))
        return store.snapshot().catalog().select("min_timestamp_ns", "max_timestamp_ns", "entry_count", "bytes")


def q_export_lines(spark, folder):
    """The lines of an exported file."""
    with _folder(spark) as work:
        store, _ = _filled(spark, folder, work)
        store.export(work.uri("out.jsonl"), OutputFormat.JSON, limit=0)
        return cut_lineage(spark.read.text(work.uri("out.jsonl")).select(F.col("value").alias("line")))


def q_printed_lines(spark, folder):
    """What the query command prints with its usual limit, and whether it says that there is more."""
    log = events_log(spark, folder)
    more = reads.truncated(log, FIRST)
    return spark.createDataFrame([(x, more) for x in reads.lines(log, OutputFormat.HEX, limit=FIRST)], "line string, more boolean")


def q_ingest_stream(spark, folder):
    """Lines that a stream took from files into a store."""
    with _folder(spark) as work:
        table(spark, folder, "events").select("props").write.text(work.uri("in"), lineSep="\n")
        store = LogStore(spark, work.uri("log"))
        Ingest(store, lines.stream_lines(spark, work.uri("in")), work.uri("checkpoint"), name=f"ingest-{uuid.uuid4().hex}", clock=lambda: 0).drain()
        line = F.expr("substring(cast(data as string), locate('] ', cast(data as string)) + 2)")
        return cut_lineage(store.entries().select(line.alias("line")))


def q_read_lines(spark, folder):
    """Lines of text files, their ends trimmed."""
    with _folder(spark) as work:
        table(spark, folder, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value")).write.text(work.uri("in"), lineSep="\n")
        line = F.expr("substring(cast(data as string), locate('] ', cast(data as string)) + 2)")
        return cut_lineage(lines.read_lines(spark, work.uri("in")).select(line.alias("line")))


def _native(spark: SparkSession, folder: str, pack: Callable, unpack: Callable) -> DataFrame:
    """Every run written as native files, an hour of a run each, and read again."""
    hours = table(spark, folder, "run_entries").select("run_id", F.expr("timestamp_ns div 3600000000000").alias("hour"), "timestamp_ns", "data")

    def write(frame):
        import pandas as pd

        entries = sorted(zip(frame.timestamp_ns, map(bytes, frame.data)))
        return pd.DataFrame({"run_id": frame.run_id[:1], "content": [pack(entries)]})

    def read(batches):
        for batch in batches:
            for run, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(unpack(raw))
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows), pa.int64()), pa.array([t for t, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["run_id", "timestamp_ns", "data"])

    files = hours.groupBy("run_id", "hour").applyInPandas(write, "run_id bigint, content binary")
    return files.mapInArrow(read, "run_id bigint, timestamp_ns bigint, data binary").select("run_id", "timestamp_ns", F.hex("data").alias("data_hex"))


def q_native_runs(spark, folder):
    return _native(spark, folder, binary.run_bytes, binary.run_entries)


def q_native_segments(spark, folder):
    return _native(spark, folder, binary.segment_bytes, binary.segment_entries)


def q_entry_crc(spark, folder):
    """The checksum of every entry."""
    return reports.checksums(table(spark, folder, "run_entries"), ["entry_id"])


def q_corrupt_entries(spark, folder):
    """Entries whose data are no longer those their checksum was made of: in every later run the data were put into capitals."""
    rows = table(spark, folder, "run_entries").select("entry_id", "timestamp_ns", F.lower(F.hex("data")).cast("binary").alias("data"), "run_id")
    kept = reports.checksums(rows, ["entry_id"]).select("entry_id", "crc")
    later = F.col("run_id") > F.lit(rows.agg(F.expr("percentile_disc(0.5) within group (order by run_id)")).first()[0])
    read = rows.withColumn("data", F.when(later, F.upper(F.col("data").cast("string")).cast("binary")).otherwise(F.col("data")))
    return reports.corrupt(read.join(kept, "entry_id")).select("entry_id")


def q_crash_summary(spark, folder):
    """The verifier over all logs: what a recovery from the catalogued runs alone brings back, a log being a cycle."""
    entries = table(spark, folder, "run_entries")
    recovered = entries.join(table(spark, folder, "sstables").select("log_id", "run_id").distinct(), ["log_id", "run_id"], "left_semi")
    return reports.summarize(reports.verdicts(entries, recovered, ["log_id"], model.FlushMode.NORMAL))


def q_crash_verdicts(spark, folder):
    entries = table(spark, folder, "run_entries")
    recovered = entries.join(table(spark, folder, "sstables").select("log_id", "run_id").distinct(), ["log_id", "run_id"], "left_semi")
    return reports.verdicts(entries, recovered, ["log_id"], model.FlushMode.CAUTIOUS).select("log_id", "passed", "missing")


def q_manifest_runs(spark, folder):
    """The catalogue of a manifest that was written as text and read again: runs registered, and those without entries removed."""
    rows = table(spark, folder, "sstables").select("run_id", "min_timestamp_ns", "max_timestamp_ns", "entry_count").distinct().orderBy("max_timestamp_ns", "run_id").collect()  # a manifest is the driver's
    manifest = Manifest()
    for r in rows:
        manifest = manifest.register(Run(str(r.run_id), r.min_timestamp_ns, r.max_timestamp_ns, r.entry_count, 0))
    for r in rows:
        if not r.entry_count:
            manifest = manifest.remove(str(r.run_id))
    again = Manifest.loads(manifest.dumps())
    shown = spark.createDataFrame([tuple(asdict(x)[c.split()[0]] for c in RUN_SCHEMA.split(", ")) for x in again.runs], RUN_SCHEMA)
    return shown.select(F.col("path").cast("bigint").alias("run_id"), "min_timestamp_ns", "max_timestamp_ns", "entry_count", F.lit(again.checkpoint_timestamp_ns).alias("checkpoint_ns"))


def q_temporary_files(spark, folder):
    """Temporary manifests that torn saves left."""
    name = F.concat(F.lit("manifest-"), "log_id", F.lit("-"), "manifest_seq", F.when(F.col("state") == "torn", ".tmp").otherwise(""))
    return reports.temporary(table(spark, folder, "manifests").select(name.alias("name")).distinct())


def q_segment_names(spark, folder):
    """Names of numbered segments, in the order in which they sort as text: that of their numbers."""
    named = table(spark, folder, "manifests").select(F.col("manifest_seq").alias("number")).distinct().withColumn("name", model.segment_name("number"))
    return named.orderBy("name")


def q_parse_time(spark, folder):
    """Texts of times, as a user gives them, to nanoseconds."""
    texts = table(spark, folder, "manifests").where("saved_at is not null").select(F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("text")).distinct()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([timeparse.parse_time(x) for x in batch.column(0).to_pylist()], pa.int64())], names=["text", "ns"])

    return texts.mapInArrow(run, "text string, ns bigint")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        q_store_roundtrip, q_store_scan, q_store_get, q_snapshot_version, q_compact_store, q_store_stats, q_flushed_runs, q_export_lines, q_printed_lines, q_ingest_stream, q_read_lines, q_native_runs, q_native_segments,
        q_entry_crc, q_corrupt_entries, q_crash_summary, q_crash_verdicts, q_manifest_runs, q_temporary_files, q_segment_names, q_parse_time,
    )
    return {f.__name__: f for f in each}


_EVENTS = "e AS (SELECT epoch_us(ts) * 1000 AS timestamp_ns, encode(props) AS data FROM events), b AS (SELECT min(timestamp_ns) AS low, max(timestamp_ns) AS high FROM e)"
_CUT = f"(low + (high - low) * {{}} // {PARTS})"
_ALL = "SELECT timestamp_ns, hex(data) AS data_hex FROM"
_STAMP = "strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d %H:%M:%S') || ' UTC'"
# CRC-32, byte by byte with the polynomial's table.
_CRC = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crcs AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
turned AS (
  SELECT entry_id, timestamp_ns, hex(coalesce(data, ''::BLOB)) AS h FROM run_entries
), bytes AS (
  SELECT entry_id, timestamp_ns, [CAST(4294967295 AS BIGINT)] || [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, length(h) // 2)] AS l FROM turned
)
SELECT entry_id, timestamp_ns, xor(list_reduce(l, lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) AS crc FROM bytes, crcs
"""
_LOST = """
WITH known AS (SELECT DISTINCT log_id, run_id FROM sstables), recovered AS (SELECT * FROM run_entries SEMI JOIN known USING (log_id, run_id)),
lost AS (SELECT log_id, count(*) AS n FROM (SELECT DISTINCT log_id, timestamp_ns FROM run_entries) d ANTI JOIN recovered USING (log_id, timestamp_ns) GROUP BY 1),
verdicts AS (SELECT log_id, coalesce(n, 0) AS missing FROM (SELECT DISTINCT log_id FROM run_entries WHERE log_id IS NOT NULL) LEFT JOIN lost USING (log_id))
"""


def oracle_sql() -> dict[str, str]:
    flushes = f"""WITH RECURSIVE {_EVENTS.split(', b AS')[0]}, total AS (SELECT timestamp_ns, octet_length(data) + 8 AS size, CAST(sum(octet_length(data) + 8) OVER (ORDER BY timestamp_ns) AS BIGINT) AS c FROM e),
        cuts(segment, c) AS (SELECT 0, (SELECT min(c) FROM total WHERE c >= {4 * FLUSH_BYTES}) UNION ALL SELECT segment + 1, (SELECT min(t.c) FROM total t WHERE t.c >= cuts.c + {4 * FLUSH_BYTES}) FROM cuts WHERE cuts.c IS NOT NULL),
        placed AS (SELECT t.*, (SELECT count(*) FROM cuts WHERE cuts.c < t.c) AS segment FROM total t)
        SELECT min(timestamp_ns) AS min_timestamp_ns, max(timestamp_ns) AS max_timestamp_ns, count(*) AS entry_count, CAST(sum(size) AS BIGINT) AS bytes FROM placed GROUP BY segment"""
    return {
        "q_store_roundtrip": f"WITH {_EVENTS} {_ALL} e",
        "q_store_scan": f"WITH {_EVENTS} {_ALL} e, b WHERE timestamp_ns BETWEEN {_CUT.format(1)} AND {_CUT.format(2)}",
        "q_store_get": f"WITH {_EVENTS} {_ALL} e, b WHERE timestamp_ns = high ORDER BY data LIMIT 1",
        "q_snapshot_version": f"WITH {_EVENTS} {_ALL} e, b WHERE timestamp_ns <= {_CUT.format(2)}",
        "q_compact_store": f"WITH {_EVENTS} SELECT timestamp_ns, hex(CASE WHEN timestamp_ns <= {_CUT.format(2)} THEN min(data) ELSE encode('second ' || decode(min(data))) END) AS data_hex FROM e, b GROUP BY timestamp_ns, low, high",
        "q_store_stats": f"WITH {_EVENTS} SELECT CAST({PARTS} AS BIGINT) AS runs, count(*) AS entries, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, CAST(sum(octet_length(data) + 8) AS BIGINT) AS bytes, max(timestamp_ns) AS checkpoint_ns FROM e",
        "q_flushed_runs": flushes,
        "q_export_lines": f"""WITH {_EVENTS} SELECT '{{"timestamp":"' || {_STAMP} || '","data":"' || replace(replace(decode(data), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}}' AS line FROM e""",
        "q_printed_lines": f"WITH {_EVENTS} SELECT format('{{:016x}}', timestamp_ns) || ' ' || lower(hex(data)) AS line, (SELECT count(*) FROM e) > {FIRST} AS more FROM e ORDER BY timestamp_ns LIMIT {FIRST}",
        "q_ingest_stream": "SELECT props AS line FROM events",
        "q_read_lines": r"SELECT rtrim(unnest(string_split(text, chr(10))), chr(10) || chr(13)) AS line FROM documents WHERE text IS NOT NULL",
        "q_native_runs": "SELECT run_id, timestamp_ns, hex(data) AS data_hex FROM run_entries",
        "q_native_segments": "SELECT run_id, timestamp_ns, hex(data) AS data_hex FROM run_entries",
        "q_entry_crc": _CRC,
        "q_corrupt_entries": "SELECT entry_id FROM run_entries WHERE run_id > (SELECT quantile_disc(run_id, 0.5) FROM run_entries) AND regexp_matches(hex(data), '[A-F]')",
        "q_crash_summary": _LOST + "SELECT count(*) AS cycles, CAST(count(*) FILTER (missing <= 49) AS BIGINT) AS passed, CAST(count(*) FILTER (missing > 49) AS BIGINT) AS failed, max(missing) AS max_missing, CAST(sum(missing) AS BIGINT) AS total_missing FROM verdicts",
        "q_crash_verdicts": _LOST + "SELECT log_id, missing = 0 AS passed, missing FROM verdicts",
        "q_manifest_runs": "WITH runs AS (SELECT DISTINCT run_id, min_timestamp_ns, max_timestamp_ns, entry_count FROM sstables) SELECT *, (SELECT max(max_timestamp_ns) FROM runs) AS checkpoint_ns FROM runs WHERE entry_count > 0",
        "q_temporary_files": "SELECT DISTINCT 'manifest-' || log_id || '-' || manifest_seq || '.tmp' AS name FROM manifests WHERE state = 'torn'",
        "q_segment_names": "SELECT DISTINCT manifest_seq AS number, format('{:016x}', manifest_seq) || '.wal' AS name FROM manifests",
        "q_parse_time": "SELECT DISTINCT strftime(saved_at, '%Y-%m-%d %H:%M:%S.%f') AS text, epoch_us(saved_at) * 1000 AS ns FROM manifests WHERE saved_at IS NOT NULL",
    }
