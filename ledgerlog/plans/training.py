"""Queries on the log store's entries that prepare training data: parsing, drift, rejects, repeats, increments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, incremental, logs, messages, rejects
from ..operators.lineage import checkpoint_dir, cut_lineage
from .tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return logs.records(table(spark, folder, "log_entries"))


def p1_layouts(spark: SparkSession, folder: str) -> DataFrame:
    return logs.layouts(table(spark, folder, "log_entries"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.top_level_changes(table(spark, folder, "txn_entries"), table(spark, folder, "feed_files"))


def p2_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "txn_entries"), table(spark, folder, "feed_files"))


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified(table(spark, folder, "txn_entries"), table(spark, folder, "feed_files"), typed=True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(table(spark, folder, "csv_entries"), rejects.table_fields(table(spark, folder, "txn_fields")))


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The typed rows, instants shown as microseconds since the epoch."""
    rows = rejects.loaded(table(spark, folder, "csv_entries"), rejects.table_fields(table(spark, folder, "txn_fields")))
    shown = {c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)") for c, kind in rows.dtypes if kind == "timestamp_ntz"}
    return rows.withColumns(shown)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return messages.surplus(table(spark, folder, "txn_entries"))


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    return messages.kept(table(spark, folder, "txn_entries"))


def p4_new(spark: SparkSession, folder: str) -> DataFrame:
    """Of the entries behind the median of arrival, what stays where all before it are stored."""
    entries = table(spark, folder, "txn_entries")
    fields = messages.identifier_fields(entries)
    identifier = messages.message_id(F.col("data"), fields)
    middle = entries.agg(F.expr("percentile_disc(0.5) within group (order by timestamp_ns)").alias("at")).first().at
    stored = entries.where(F.col("timestamp_ns") <= F.lit(middle)).select(identifier.alias("message_id"))
    return messages.deduplicate_new(stored, entries.where(F.col("timestamp_ns") > F.lit(middle)), identifier)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """What three runs of the incremental job commit, of which two lose their process; its folder is the shared one."""
    job = incremental.rerun(spark, f"{checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}", table(spark, folder, "run_entries"), table(spark, folder, "sstables"), table(spark, folder, "manifests"))
    result = cut_lineage(job.output())  # three numbers a row, so that the job's folder can go
    job.files.delete("")
    return result


def p5_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The same over all saves in one query, without a job's folder."""
    return incremental.processed(table(spark, folder, "run_entries"), table(spark, folder, "sstables"), table(spark, folder, "manifests"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_layouts, p2_found, p2_scripts, p2_table, p3_found, p3_loaded, p4_found, p4_kept, p4_new, p5_found, p5_replay)}


# Entries that are no JSON object (other JSON, plain text, bytes that are no UTF-8) have no identifier.
_MESSAGES = """
WITH texts AS (
  SELECT entry_id, timestamp_ns, try(decode(data)) AS t FROM txn_entries
), raw AS (
  SELECT entry_id, timestamp_ns, CASE WHEN starts_with(t, '[') AND instr(t, '] ') > 1 THEN substr(t, instr(t, '] ') + 2) ELSE t END AS payload FROM texts
), objects AS (
  SELECT entry_id, timestamp_ns, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS j FROM raw
), named AS (
  SELECT entry_id, timestamp_ns, j ->> '$.txn_id' AS a, j ->> '$.txnId' AS b, j ->> '$.txn_ref' AS c, j ->> '$.transaction_id' AS d, j ->> '$.message_id' AS e FROM objects
), keyed AS (
  SELECT entry_id, timestamp_ns, coalesce(CASE WHEN starts_with(a, 'TXN-') THEN a END, CASE WHEN starts_with(b, 'TXN-') THEN b END, CASE WHEN starts_with(c, 'TXN-') THEN c END,
    CASE WHEN starts_with(d, 'TXN-') THEN d END, CASE WHEN starts_with(e, 'TXN-') THEN e END) AS message_id FROM named
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY timestamp_ns NULLS LAST, entry_id) AS place, count(*) OVER (PARTITION BY message_id) AS n FROM keyed
)
"""

# Bytes become characters one by one (0 to 255), so that rows that are no UTF-8 can be split too; a delimiter goes
# before the row, so that every field begins with one.
_ROWS = """
WITH raw AS (
  SELECT entry_id, import_id, data, coalesce(nullif(delimiter, ''), ',') AS d, array_to_string([chr(CAST('0x' || substr(hex(data), 2 * i - 1, 2) AS INTEGER)) FOR i IN range(1, octet_length(data) + 1)], '') AS t FROM csv_entries
), payloads AS (
  SELECT entry_id, import_id, data, d, CASE WHEN starts_with(t, '[') AND instr(t, '] ') > 1 THEN substr(t, instr(t, '] ') + 2) ELSE t END AS p FROM raw
), records AS (
  SELECT entry_id, import_id, try(decode(data)) IS NULL AS broken, d, p, regexp_full_match(d || p, '(' || regexp_escape(d) || '("([^"]|"")*"|[^"\r\n' || regexp_escape(d) || ']*))+') AS formed,
    [CASE WHEN starts_with(f, d || '"') THEN replace(substr(f, 3, length(f) - 3), '""', '"') ELSE substr(f, 2) END FOR f IN regexp_extract_all(d || p, regexp_escape(d) || '("([^"]|"")*"|[^"\r\n' || regexp_escape(d) || ']*)')] AS f
  FROM payloads
), columns AS (
  SELECT pos, field, kind, required, string_split(allowed, '|') AS allowed FROM txn_fields
), names AS (
  SELECT list(field ORDER BY pos) AS names FROM columns
), wrong AS (
  SELECT r.entry_id, bool_or(CASE WHEN r.f[c.pos] = '' THEN c.required
      WHEN c.kind = 'integer' THEN NOT regexp_full_match(r.f[c.pos], '[0-9]+') OR TRY_CAST(r.f[c.pos] AS BIGINT) IS NULL
      WHEN c.kind = 'instant' THEN NOT regexp_full_match(r.f[c.pos], '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{3}Z') OR substr(r.f[c.pos], 12, 2) > '23' OR substr(r.f[c.pos], 18, 2) > '59' OR TRY_CAST(replace(substr(r.f[c.pos], 1, 23), 'T', ' ') AS TIMESTAMP) IS NULL
      WHEN c.kind = 'choice' THEN NOT list_contains(c.allowed, r.f[c.pos]) ELSE false END) AS bad
  FROM records r, columns c WHERE r.formed AND len(r.f) = (SELECT count(*) FROM columns) GROUP BY r.entry_id
), judged AS (
  SELECT r.entry_id, r.import_id, r.f, CASE WHEN NOT r.formed THEN 'quoting' WHEN len(r.f) <> (SELECT count(*) FROM columns) THEN 'column_count' WHEN r.broken THEN 'value' WHEN r.f = (SELECT names FROM names) THEN 'header' WHEN w.bad THEN 'value' ELSE 'loaded' END AS verdict
  FROM records r LEFT JOIN wrong w ON w.entry_id = r.entry_id
)
"""


def _loaded_sql() -> str:
    """The columns of a row; texts are put together again from their bytes."""
    kinds = {"timestamp": "epoch_us(CAST(replace(substr({0}, 1, 23), 'T', ' ') AS TIMESTAMP))"} | dict.fromkeys(["amount", "sender", "receiver"], "CAST(nullif({0}, '') AS BIGINT)")
    text = "CASE WHEN {0} <> '' THEN decode(unhex(array_to_string([format('{{:02x}}', ascii(substr({0}, i, 1))) FOR i IN range(1, length({0}) + 1)], ''))) END"
    names = ["txn_id", "terminal_id", "agent_id", "timestamp", "type", "amount", "currency", "method", "sender", "receiver", "status", "receipt", "note"]
    return _ROWS + "SELECT entry_id, import_id, " + ", ".join(f'{kinds.get(n, text).format(f"f[{i}]")} AS "{n}"' for i, n in enumerate(names, 1)) + " FROM judged WHERE verdict = 'loaded'"


_SAVES = """
WITH runs AS (
  SELECT log_id, run_id, min(manifest_seq) AS added FROM sstables WHERE log_id IS NOT NULL AND run_id IS NOT NULL AND manifest_seq IS NOT NULL GROUP BY ALL
), saves AS (
  SELECT log_id, manifest_seq AS seq, max(checkpoint_timestamp_ns) AS checkpoint FROM manifests WHERE state = 'committed' AND checkpoint_timestamp_ns IS NOT NULL GROUP BY ALL
), copies AS (
  SELECT e.log_id, e.timestamp_ns, e.data, r.added, min(e.entry_id) AS entry_id FROM run_entries e JOIN runs r ON e.log_id = r.log_id AND e.run_id = r.run_id GROUP BY ALL
), firsts AS (
  SELECT c.log_id, c.timestamp_ns, c.data, min(s.seq) AS seq FROM copies c JOIN saves s ON s.log_id = c.log_id AND s.seq >= c.added AND s.checkpoint >= c.timestamp_ns GROUP BY ALL
)
SELECT f.log_id, f.seq AS manifest_seq, min(c.entry_id) AS entry_id
FROM firsts f JOIN copies c ON c.log_id = f.log_id AND c.timestamp_ns = f.timestamp_ns AND c.data = f.data AND c.added <= f.seq
GROUP BY f.log_id, f.seq, f.timestamp_ns, f.data
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _ROWS + "SELECT entry_id, verdict AS reason FROM judged WHERE verdict NOT IN ('loaded', 'header')",
        "p3_loaded": _loaded_sql(),
        "p4_found": _MESSAGES + "SELECT message_id, entry_id FROM ranked WHERE message_id IS NOT NULL AND place > 1",
        "p4_kept": _MESSAGES + "SELECT message_id, entry_id, CASE WHEN message_id IS NULL THEN 1 ELSE n END AS n FROM ranked WHERE message_id IS NULL OR place = 1",
        "p4_new": _MESSAGES.replace("), ranked AS (", "), middle AS (SELECT quantile_disc(timestamp_ns, 0.5) AS mid FROM txn_entries), fresh AS (SELECT keyed.* FROM keyed, middle WHERE timestamp_ns > mid), ranked AS (").replace("AS n FROM keyed", "AS n FROM fresh")
        + "SELECT message_id, entry_id, CASE WHEN message_id IS NULL THEN 1 ELSE n END AS n FROM ranked WHERE message_id IS NULL OR (place = 1 AND message_id NOT IN (SELECT message_id FROM keyed, middle WHERE timestamp_ns <= mid AND message_id IS NOT NULL))",
        "p5_found": _SAVES,
        "p5_replay": _SAVES,
    }
