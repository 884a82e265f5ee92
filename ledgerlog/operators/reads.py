"""Scans, ranges, point reads, limits and merges of logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import CSV_HEADER, line
from ..model import LONG_MAX, MAX_ENTRY_BYTES, OutputFormat, fits
from ..timeparse import check_range

DEFAULT_LIMIT = 1000


def scan_all(log: DataFrame) -> DataFrame:
    """All entries in order of timestamp."""
    return log.orderBy("timestamp_ns")


def within(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Entries with low <= timestamp_ns <= high, unordered; a bound that is None, or can't exclude anything, is left out.

    On stored logs the bounds reach the Parquet scan.
    """
    check_range(low, high)
    if low is not None and low > 0:
        log = log.where(F.col("timestamp_ns") >= low)
    if high is not None and high < LONG_MAX:
        log = log.where(F.col("timestamp_ns") <= high)
    return log


def micros_within(df: DataFrame, ts: str, low: int | None, high: int | None) -> DataFrame:
    """The same bounds on a TIMESTAMP_NTZ column from which timestamps are derived.

    A predicate on the derived nanoseconds would not be pushed to the scan; one on the stored column is.
    """
    check_range(low, high)
    at = lambda us: F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    if low is not None and low > 0:
        df = df.where(F.col(ts) >= at(-(-low // 1000)))
    if high is not None and high < LONG_MAX:
        df = df.where(F.col(ts) <= at(high // 1000))
    return df


def scan(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Entries of a range, both ends inclusive, in order."""
    return scan_all(within(log, low, high))


def first_n(log: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    """The first n entries in order; 0 means all.  n rows a task suffice: it plans as TakeOrderedAndProject."""
    if n < 0:
        raise ValueError("a limit can't be negative")
    return scan_all(log).limit(n) if n else scan_all(log)


def get(log: DataFrame, timestamp_ns: int, rank: Column | None = None) -> DataFrame:
    """The entry at a timestamp, or no row; of several the one with the lowest ``rank``, then the smallest data."""
    found = log.where(F.col("timestamp_ns") == timestamp_ns)
    return found.orderBy(*([rank] if rank is not None else []), "data").limit(1)


def after_checkpoint(log: DataFrame, checkpoint: int) -> DataFrame:
    """What a replay reads: entries strictly after the checkpoint."""
    return log.where(F.col("timestamp_ns") > checkpoint)


def storable(log: DataFrame, limit: int = MAX_ENTRY_BYTES) -> DataFrame:
    return log.where(fits("data", limit))


def oversize(log: DataFrame, limit: int = MAX_ENTRY_BYTES) -> DataFrame:
    return log.where(~fits("data", limit))


def merge(runs: Sequence[DataFrame]) -> DataFrame:
    """All entries of all runs, in order; nothing is dropped, also not where timestamps are equal."""
    if not runs:
        raise ValueError("no runs to merge")
    return scan_all(reduce(DataFrame.unionByName, runs))


def render(log: DataFrame, kind: OutputFormat, low: int | None = None, high: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(timestamp_ns, line): the query command; lines in order."""
    return first_n(within(log, low, high), limit).select("timestamp_ns", line(kind).alias("line"))


def lines(log: DataFrame, kind: OutputFormat, low: int | None = None, high: int | None = None, limit: int = DEFAULT_LIMIT) -> Iterator[str]:
    """Rendered lines, streamed to the driver partition by partition; CSV begins with its header."""
    if kind is OutputFormat.CSV:
        yield CSV_HEADER
    for row in render(log, kind, low, high, limit).select("line").toLocalIterator(prefetchPartitions=True):
        yield row.line


def truncated(log: DataFrame, limit: int) -> bool:
    """Whether a limit leaves entries out; looks at one more than the limit, not at all."""
    return bool(limit) and log.limit(limit + 1).count() > limit
