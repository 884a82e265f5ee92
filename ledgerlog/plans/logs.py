"""The log store's own queries, each over its whole tables, with its equivalent in DuckDB's SQL.

Logs: ``events`` (timestamp from ts, data from props), ``documents`` (a millisecond per doc_id, data from text, null
texts being no entry), ``lineitem`` (many equal clocks) and the runs of ``run_entries``.  Binary columns are shown as
hexadecimal text.  Bytes that are no UTF-8 are rendered over all tables of raw entries; SQL has no counterpart, tests
hold the expressions against Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model, timeparse
from ..functions import render
from ..model import OutputFormat
from ..operators import compaction, reads, reports, sequence
from ..sources.lines import tagged
from .tables import table

RANGE = ("2024-01-10T06:00:00Z", "2024-01-20 12:00:00")
FIRST = 1000
FLUSH_BYTES = 4096
SMALL_LIMIT = 4096
FIRST_DOCUMENT_NS = 1_704_067_200_000_000_000
_HOUR = 3_600_000_000_000

def events_log(spark: SparkSession, folder: str) -> DataFrame:
    return model.from_timestamps(table(spark, folder, "events"), "ts", F.encode("props", "UTF-8"))


def documents_log(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").where("text is not null")
    return texts.select((F.col("doc_id") * 1_000_000 + FIRST_DOCUMENT_NS).alias("timestamp_ns"), F.encode("text", "UTF-8").alias("data"))


def _events_within(spark: SparkSession, folder: str, low: int | None, high: int | None) -> DataFrame:
    events = reads.micros_within(table(spark, folder, "events"), "ts", low, high)
    return reads.scan(model.from_timestamps(events, "ts", F.encode("props", "UTF-8")), low, high)


def _shown(log: DataFrame) -> DataFrame:
    return log.select("timestamp_ns", F.hex("data").alias("data_hex"))


def q_scan_all(spark, folder):
    return _shown(reads.scan_all(events_log(spark, folder)))


def q_time_range(spark, folder):
    return _shown(_events_within(spark, folder, *timeparse.parse_range(*RANGE)))


def q_range_from_only(spark, folder):
    return _shown(_events_within(spark, folder, *timeparse.parse_range(RANGE[0], None)))


def q_range_to_only(spark, folder):
    return _shown(_events_within(spark, folder, *timeparse.parse_range(None, RANGE[1])))


def q_to_second_rounding(spark, folder):
    """Per day: entries up to the last whole second of noon, which is widened, and up to noon itself."""
    log = events_log(spark, folder)
    noon = F.floor(F.col("timestamp_ns") / F.lit(24 * _HOUR)) * (24 * _HOUR) + 12 * _HOUR
    return log.groupBy(F.floor(F.col("timestamp_ns") / F.lit(24 * _HOUR)).alias("day")).agg(F.sum((F.col("timestamp_ns") <= noon + (timeparse.upper_bound(0))).cast("bigint")).alias("through"), F.sum((F.col("timestamp_ns") <= noon).cast("bigint")).alias("until"))


def q_limit_first_n(spark, folder):
    return _shown(reads.first_n(events_log(spark, folder), FIRST))


def q_get_hit(spark, folder):
    """The entry at the latest event's timestamp."""
    at = table(spark, folder, "events").agg(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', max(ts)) * 1000").alias("at")).first().at
    if at is None:
        return _shown(events_log(spark, folder))
    return _shown(reads.get(_events_within(spark, folder, at, at), at))


def _format(kind: OutputFormat, log: Callable[[SparkSession, str], DataFrame]):
    return lambda spark, folder: reads.render(log(spark, folder), kind, limit=0)


def _raw_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all tables whose data are bytes of any kind."""
    names = ("csv_entries", "txn_entries", "log_entries", "run_entries")
    each = [table(spark, folder, n).select(F.lit(n).alias("source"), "entry_id", "timestamp_ns", "data") for n in names]
    return reduce(DataFrame.unionByName, each)


def q_text_lossy_entries(spark, folder):
    return _raw_entries(spark, folder).select("source", "entry_id", "timestamp_ns", render.lossy_text().alias("line"))


def q_csv_invalid_utf8_entries(spark, folder):
    return _raw_entries(spark, folder).select("source", "entry_id", "timestamp_ns", render.csv_line().alias("line"))


def q_trim_tag(spark, folder):
    texts = table(spark, folder, "documents").where("text is not null")
    return texts.select("doc_id", F.hex(tagged("file:documents", "text")).alias("data_hex"))


def q_entry_size(spark, folder):
    return documents_log(spark, folder).select("timestamp_ns", model.entry_size().cast("bigint").alias("bytes"))


def q_oversize(spark, folder):
    return _shown(reads.oversize(documents_log(spark, folder), SMALL_LIMIT))


def q_merge_runs(spark, folder):
    """All runs of all logs, merged without dropping anything."""
    entries, known = table(spark, folder, "run_entries"), table(spark, folder, "sstables").select("log_id", "run_id").distinct()
    sides = [entries.join(known, ["log_id", "run_id"], how).select("log_id", "timestamp_ns", "data") for how in ("left_semi", "left_anti")]  # catalogued runs, and the others
    return reads.merge(sides).select("log_id", "timestamp_ns", F.hex("data").alias("data_hex"))


def q_compact_dedup(spark, folder):
    runs = table(spark, folder, "run_entries").select("log_id", "run_id", "timestamp_ns", "data")
    return compaction.compact(runs, keys=["log_id"]).select("log_id", "timestamp_ns", F.hex("data").alias("data_hex"))


def q_monotonic_ts(spark, folder):
    """Arrival order by key, clock from the ship date, of which many are equal and which goes back often; keys repeat."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) * 1000").alias("now_ns"))
    return sequence.monotonic(lines, "now_ns", ["l_orderkey", "l_linenumber", "now_ns"])


def q_flush_segments(spark, folder):
    return sequence.flush_segments(events_log(spark, folder), FLUSH_BYTES).select("timestamp_ns", "segment")


def q_segment_catalog(spark, folder):
    runs = table(spark, folder, "run_entries").select("run_id", "timestamp_ns", "data")
    return reports.run_catalog(runs).drop("crc")


def q_prune_runs(spark, folder):
    """The distinct runs that the hour after the median run's beginning has to open, in every log."""
    catalog = table(spark, folder, "sstables").select("log_id", "run_id", "path", "min_timestamp_ns", "max_timestamp_ns").distinct()
    low = catalog.agg(F.expr("percentile_disc(0.5) within group (order by min_timestamp_ns)").alias("low")).first().low or 0
    return reports.overlapping(catalog, int(low), int(low) + _HOUR)


def q_stats(spark, folder):
    return reports.stats(events_log(spark, folder))


def _checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """The highest committed checkpoint of each log."""
    return table(spark, folder, "manifests").where("state = 'committed'").groupBy("log_id").agg(F.max("checkpoint_timestamp_ns").alias("checkpoint_ns"))


def q_storage_stats(spark, folder):
    """Per log: runs, their end, and what lies behind its own committed checkpoint."""
    catalog = table(spark, folder, "sstables").dropDuplicates(["log_id", "run_id"])
    tail = reports.behind(table(spark, folder, "run_entries"), _checkpoints(spark, folder), ["log_id"])
    return reports.storage_stats(catalog, tail, ["log_id"])


def q_whole_bounds(spark, folder):
    return reports.whole_bounds(table(spark, folder, "sstables"))


def q_replay_tail(spark, folder):
    """Per log: entries behind its highest committed checkpoint."""
    return reports.replay_each(table(spark, folder, "run_entries"), _checkpoints(spark, folder), ["log_id"])


def q_durable_missing(spark, folder):
    """Timestamps of each log that a recovery from the catalogued runs alone would not bring back."""
    entries = table(spark, folder, "run_entries")
    return reports.missing(entries, entries.join(table(spark, folder, "sstables").select("log_id", "run_id").distinct(), ["log_id", "run_id"], "left_semi"), ["log_id"])


def q_orphans(spark, folder):
    """Names of runs that exist but stand in no catalogue."""
    runs = table(spark, folder, "run_entries").select("run_id", "timestamp_ns", "data")
    listing = reports.run_catalog(runs).select(F.col("path").alias("name"))
    return reports.orphans(listing, table(spark, folder, "sstables"))


def q_ingest_counters(spark, folder):
    return reports.ingest_counters(documents_log(spark, folder), SMALL_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        q_scan_all, q_time_range, q_range_from_only, q_range_to_only, q_to_second_rounding, q_limit_first_n, q_get_hit, q_text_lossy_entries, q_csv_invalid_utf8_entries, q_trim_tag, q_entry_size, q_oversize,
        q_merge_runs, q_compact_dedup, q_monotonic_ts, q_flush_segments, q_segment_catalog, q_prune_runs, q_stats, q_storage_stats, q_whole_bounds, q_replay_tail, q_durable_missing, q_orphans, q_ingest_counters,
    ]
    formats = {f"q_format_{k.value}{end}": _format(k, log) for k in OutputFormat for end, log in (("", events_log), ("_docs", documents_log))}
    return {f.__name__: f for f in plain} | formats


_EVENTS = "(SELECT epoch_us(ts) * 1000 AS timestamp_ns, encode(props) AS data FROM events)"
_DOCS = f"(SELECT doc_id * 1000000 + {FIRST_DOCUMENT_NS} AS timestamp_ns, encode(text) AS data FROM documents WHERE text IS NOT NULL)"
_STAMP = "strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%d %H:%M:%S') || ' UTC'"
_BYTES = (
    "array_to_string([CASE h WHEN '22' THEN '\\\"' WHEN '5C' THEN '\\\\' WHEN '0A' THEN '\\n' WHEN '0D' THEN '\\r' WHEN '09' THEN '\\t' "
    "ELSE CASE WHEN h >= '20' AND h <= '7E' THEN decode(unhex(h)) ELSE '\\u00' || lower(h) END END "
    "FOR h IN [substr(hex(data), 2 * i - 1, 2) FOR i IN range(1, length(hex(data)) // 2 + 1)]], '')"
)
_FORMATS = {
    OutputFormat.TEXT: f"{_STAMP} || ' ' || decode(data)",
    OutputFormat.JSON: f"""'{{"timestamp":"' || {_STAMP} || '","data":"' || {_BYTES} || '"}}'""",
    OutputFormat.CSV: f"""'"' || {_STAMP} || '","' || replace(decode(data), '"', '""') || '"'""",
    OutputFormat.HEX: "format('{:016x}', timestamp_ns) || ' ' || lower(hex(data))",
}


def _bounded(low: int | None, high: int | None) -> str:
    parts = [f"timestamp_ns >= {low}"] * (low is not None) + [f"timestamp_ns <= {high}"] * (high is not None)
    return f"SELECT timestamp_ns, hex(data) AS data_hex FROM {_EVENTS} WHERE {' AND '.join(parts)}"


def oracle_sql() -> dict[str, str]:
    day = 24 * _HOUR
    rank = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate)"
    name = lambda low, high: f"format('{{:016x}}', {low}) || '_' || format('{{:016x}}', {high}) || '.sst'"
    catalog = f"SELECT run_id, count(*) AS entry_count, min(timestamp_ns) AS min_timestamp_ns, max(timestamp_ns) AS max_timestamp_ns, {name('min(timestamp_ns)', 'max(timestamp_ns)')} AS path FROM run_entries GROUP BY run_id"
    out = {
        "q_scan_all": f"SELECT timestamp_ns, hex(data) AS data_hex FROM {_EVENTS}",
        "q_time_range": _bounded(*timeparse.parse_range(*RANGE)),
        "q_range_from_only": _bounded(*timeparse.parse_range(RANGE[0], None)),
        "q_range_to_only": _bounded(*timeparse.parse_range(None, RANGE[1])),
        "q_to_second_rounding": f"SELECT timestamp_ns // {day} AS day, CAST(sum(CASE WHEN timestamp_ns <= timestamp_ns // {day} * {day} + {12 * _HOUR} + 999999999 THEN 1 ELSE 0 END) AS BIGINT) AS through, CAST(sum(CASE WHEN timestamp_ns <= timestamp_ns // {day} * {day} + {12 * _HOUR} THEN 1 ELSE 0 END) AS BIGINT) AS until FROM {_EVENTS} GROUP BY 1",
        "q_limit_first_n": f"SELECT timestamp_ns, hex(data) AS data_hex FROM {_EVENTS} ORDER BY 1 LIMIT {FIRST}",
        "q_get_hit": f"SELECT timestamp_ns, hex(data) AS data_hex FROM {_EVENTS} WHERE timestamp_ns = (SELECT max(epoch_us(ts)) * 1000 FROM events) ORDER BY data LIMIT 1",
        "q_trim_tag": r"SELECT doc_id, hex(encode('[file:documents] ' || rtrim(text, chr(10) || chr(13)))) AS data_hex FROM documents WHERE text IS NOT NULL",
        "q_entry_size": f"SELECT timestamp_ns, CAST(octet_length(data) + 8 AS BIGINT) AS bytes FROM {_DOCS}",
        "q_oversize": f"SELECT timestamp_ns, hex(data) AS data_hex FROM {_DOCS} WHERE octet_length(data) > {SMALL_LIMIT}",
        "q_merge_runs": "SELECT log_id, timestamp_ns, hex(data) AS data_hex FROM run_entries",
        "q_compact_dedup": "SELECT log_id, timestamp_ns, hex(data) AS data_hex FROM (SELECT *, row_number() OVER (PARTITION BY log_id, timestamp_ns ORDER BY run_id, data) AS place FROM run_entries) WHERE place = 1",
        "q_monotonic_ts": f"SELECT l_orderkey, l_linenumber, now_ns, CAST(rn + max(now_ns - rn) OVER (ORDER BY rn) AS BIGINT) AS timestamp_ns FROM (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) * 1000 AS now_ns, {rank} AS rn FROM lineitem)",
        "q_flush_segments": f"""WITH RECURSIVE total AS (SELECT timestamp_ns, CAST(sum(octet_length(data) + 8) OVER (ORDER BY timestamp_ns) AS BIGINT) AS c FROM {_EVENTS}),
            cuts(segment, c) AS (SELECT 0, (SELECT min(c) FROM total WHERE c >= {FLUSH_BYTES}) UNION ALL SELECT segment + 1, (SELECT min(t.c) FROM total t WHERE t.c >= cuts.c + {FLUSH_BYTES}) FROM cuts WHERE cuts.c IS NOT NULL)
            SELECT t.timestamp_ns, CAST((SELECT count(*) FROM cuts WHERE cuts.c < t.c) AS BIGINT) AS segment FROM total t""",
        "q_segment_catalog": catalog,
        "q_prune_runs": f"SELECT DISTINCT log_id, run_id, path, min_timestamp_ns, max_timestamp_ns FROM sstables, (SELECT quantile_disc(min_timestamp_ns, 0.5) AS low FROM (SELECT DISTINCT log_id, run_id, path, min_timestamp_ns, max_timestamp_ns FROM sstables)) WHERE min_timestamp_ns <= low + {_HOUR} AND max_timestamp_ns >= low",
        "q_stats": f"SELECT count(*) AS entries, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM {_EVENTS}",
        "q_storage_stats": "WITH top AS (SELECT log_id, max(checkpoint_timestamp_ns) AS top FROM manifests WHERE state = 'committed' GROUP BY 1), tail AS (SELECT e.log_id, count(*) AS n, sum(octet_length(data) + 8) AS b FROM run_entries e LEFT JOIN top ON top.log_id = e.log_id WHERE e.timestamp_ns > coalesce(top, -1) GROUP BY 1), runs AS (SELECT log_id, count(DISTINCT run_id) AS runs, max(max_timestamp_ns) AS checkpoint_ns FROM sstables GROUP BY 1) SELECT coalesce(r.log_id, t.log_id) AS log_id, coalesce(runs, 0) AS runs, coalesce(checkpoint_ns, 0) AS checkpoint_ns, coalesce(n, 0) AS tail_entries, CAST(coalesce(b, 0) AS BIGINT) AS tail_bytes FROM runs r FULL JOIN tail t ON t.log_id = r.log_id",
        "q_whole_bounds": "SELECT min(min_timestamp_ns) AS min_timestamp_ns, max(max_timestamp_ns) AS max_timestamp_ns FROM sstables",
        "q_replay_tail": "SELECT e.log_id, count(*) AS entries, min(e.timestamp_ns) AS first_ns, max(e.timestamp_ns) AS last_ns FROM run_entries e LEFT JOIN (SELECT log_id, max(checkpoint_timestamp_ns) AS top FROM manifests WHERE state = 'committed' GROUP BY 1) t ON t.log_id = e.log_id WHERE e.timestamp_ns > coalesce(t.top, -1) GROUP BY 1",
        "q_durable_missing": "SELECT DISTINCT log_id, timestamp_ns FROM run_entries d WHERE NOT EXISTS (SELECT 1 FROM run_entries e JOIN sstables s ON s.log_id = e.log_id AND s.run_id = e.run_id WHERE e.log_id = d.log_id AND e.timestamp_ns = d.timestamp_ns)",
        "q_orphans": f"SELECT path AS name FROM ({catalog}) c WHERE NOT EXISTS (SELECT 1 FROM sstables s WHERE s.path = c.path)",
        "q_ingest_counters": f"SELECT CAST(count(*) FILTER (octet_length(data) <= {SMALL_LIMIT}) AS BIGINT) AS ingested, CAST(count(*) FILTER (octet_length(data) > {SMALL_LIMIT}) AS BIGINT) AS failed, CAST(coalesce(sum(octet_length(data)) FILTER (octet_length(data) <= {SMALL_LIMIT}), 0) AS BIGINT) AS bytes FROM {_DOCS}",
    }
    for kind, line in _FORMATS.items():
        for end, log in (("", _EVENTS), ("_docs", _DOCS)):
            out[f"q_format_{kind.value}{end}"] = f"SELECT timestamp_ns, {line} AS line FROM {log}"
    return out
