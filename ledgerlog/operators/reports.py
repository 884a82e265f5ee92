"""Statistics, catalogues of runs, and the verifier of acknowledged entries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FlushMode, entry_size, fits, hex16, sorted_run_name
from . import reads

#: Entries that a crash may lose: those since the last of the syncs that come with every fiftieth write.
MOST_LOST = {FlushMode.NORMAL: 49, FlushMode.CAUTIOUS: 0, FlushMode.EMERGENCY: 0}


def stats(log: DataFrame) -> DataFrame:
    """(entries, first_ns, last_ns) in one pass over the timestamps alone; an empty log has 0 and nulls."""
    return log.agg(F.count("*").alias("entries"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def storage_stats(catalog: DataFrame, tail: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, runs, checkpoint_ns, tail_entries, tail_bytes): catalogued runs, and what is not in any of them, of one log or of each."""
    runs = catalog.groupBy(*keys).agg(F.count("*").alias("runs"), F.coalesce(F.max("max_timestamp_ns"), F.lit(0)).alias("checkpoint_ns"))
    rest = tail.groupBy(*keys).agg(F.count("*").alias("tail_entries"), F.coalesce(F.sum(entry_size()), F.lit(0)).alias("tail_bytes"))
    if not keys:
        return runs.join(F.broadcast(rest))  # one row each
    return runs.join(rest, list(keys), "full").fillna(0, ["runs", "checkpoint_ns", "tail_entries", "tail_bytes"])


def behind(log: DataFrame, checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of each log behind its own checkpoint (``checkpoints``: keys… and checkpoint_ns); without one, all of them."""
    own = checkpoints.select(*keys, F.col("checkpoint_ns").alias("_checkpoint"))
    return log.join(own, list(keys), "left").where(F.col("timestamp_ns") > F.coalesce("_checkpoint", F.lit(-1))).drop("_checkpoint")


def entry_crc() -> Column:
    """CRC-32 of an entry: of its timestamp, least significant byte first as in the native files, and its data."""
    digits = hex16("timestamp_ns")
    turned = F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))
    return F.crc32(F.concat(F.unhex(turned), F.coalesce("data", F.lit(b""))))


def run_catalog(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run its count, bounds, checksum (xor of the entries' CRC-32, so that order does not matter) and file name."""
    by = runs.groupBy(run).agg(
        F.count("*").alias("entry_count"),
        F.min("timestamp_ns").alias("min_timestamp_ns"),
        F.max("timestamp_ns").alias("max_timestamp_ns"),
        F.bit_xor(F.crc32("data")).alias("crc"),
    )
    return by.withColumn("path", sorted_run_name("min_timestamp_ns", "max_timestamp_ns"))


def overlapping(catalog: DataFrame, low: int, high: int) -> DataFrame:
    """The runs a range (or, with equal bounds, a point read) has to open."""
    return catalog.where((F.col("min_timestamp_ns") <= high) & (F.col("max_timestamp_ns") >= low))


def whole_bounds(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.min("min_timestamp_ns").alias("min_timestamp_ns"), F.max("max_timestamp_ns").alias("max_timestamp_ns"))


def replay(log: DataFrame, checkpoint: int) -> DataFrame:
    """(entries, first_ns, last_ns) of what a restart replays."""
    return stats(reads.after_checkpoint(log, checkpoint))


def replay_each(log: DataFrame, checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, entries, first_ns, last_ns) of what a restart of each log replays; logs that replay nothing are missing."""
    return behind(log, checkpoints, keys).groupBy(*keys).agg(F.count("*").alias("entries"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def orphans(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files (``name``) that the catalogue's ``path`` does not have."""
    return listing.join(catalog.select(F.col("path").alias("name")).distinct(), "name", "left_anti")


def temporary(listing: DataFrame) -> DataFrame:
    """Leftovers of writers that died (``name``): all temporary files, also the manifest's own."""
    return listing.where(F.col("name").endswith(".tmp"))


def ingest_counters(log: DataFrame, limit: int) -> DataFrame:
    """(ingested, failed, bytes): what fits the entry limit is ingested, the rest failed."""
    ok = fits("data", limit)
    return log.agg(
        F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("ingested"),
        F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.octet_length("data").cast("bigint"))), F.lit(0)).alias("bytes"),
    )


def checksums(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, timestamp_ns, crc) per entry; the CRC-32 of its data."""
    return log.select(*keys, "timestamp_ns", F.crc32("data").alias("crc"))


def corrupt(log: DataFrame, crc: str = "crc") -> DataFrame:
    """Entries whose stored checksum is not that of their data."""
    return log.where(~F.col(crc).eqNullSafe(F.crc32("data")))


def missing(durable: DataFrame, recovered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, timestamp_ns): acknowledged timestamps that recovery did not bring back; ``keys`` name the log."""
    columns = [*keys, "timestamp_ns"]
    return durable.select(*columns).distinct().join(recovered.select(*columns).distinct(), columns, "left_anti")


def verdicts(durable: DataFrame, recovered: DataFrame, keys: Sequence[str], mode: FlushMode, previous: DataFrame | None = None) -> DataFrame:
    """(keys…, passed, missing, recovered): what ``verify`` says of each log, many at once.

    ``previous`` has keys… and previous_entries, which recovery must not fall below; logs without a row have 0.
    """
    lost = missing(durable, recovered, keys).groupBy(*keys).agg(F.count("*").alias("missing"))
    there = recovered.groupBy(*keys).agg(F.count("*").alias("recovered"))
    logs = durable.select(*keys).distinct().dropna()
    every = logs.join(lost, list(keys), "left").join(there, list(keys), "left")
    every = every.join(previous, list(keys), "left") if previous is not None else every.withColumn("previous_entries", F.lit(0))
    every = every.fillna(0, ["missing", "recovered", "previous_entries"])
    return every.select(*keys, ((F.col("recovered") >= F.col("previous_entries")) & (F.col("missing") <= MOST_LOST[mode])).alias("passed"), "missing", "recovered")


@dataclass(frozen=True)
class Verdict:
    passed: bool
    reason: str
    missing: int
    examples: tuple[int, ...]


def verify(durable: DataFrame, recovered: DataFrame, previous_entries: int, mode: FlushMode, shown: int = 10) -> Verdict:
    """Whether a recovery holds what the mode promises: counts all missing entries, shows the first few."""
    lost = missing(durable, recovered)
    number = lost.count()
    examples = tuple(r.timestamp_ns for r in lost.orderBy("timestamp_ns").limit(shown).collect())
    if recovered.count() < previous_entries:
        return Verdict(False, "entry count decreased", number, examples)
    if number > MOST_LOST[mode]:
        return Verdict(False, f"{number} acknowledged entries are missing", number, examples)
    return Verdict(True, "", number, examples)


def summarize(verdicts: DataFrame) -> DataFrame:
    """(cycles, passed, failed, max_missing, total_missing) of rows with passed and missing."""
    return verdicts.agg(
        F.count("*").alias("cycles"),
        F.coalesce(F.sum(F.col("passed").cast("bigint")), F.lit(0)).alias("passed"),
        F.coalesce(F.sum((~F.col("passed")).cast("bigint")), F.lit(0)).alias("failed"),
        F.coalesce(F.max("missing"), F.lit(0)).alias("max_missing"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing"),
    )
