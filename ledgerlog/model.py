"""The data model: a log is a DataFrame of (timestamp_ns BIGINT, data BINARY), ordered by timestamp."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unsigned 64-bit nanoseconds are kept as signed ones, which end in the year 2262; TIMESTAMP would lose the nanoseconds.
SCHEMA = T.StructType([T.StructField("timestamp_ns", T.LongType(), False), T.StructField("data", T.BinaryType(), False)])

MAX_ENTRY_BYTES = 1 << 20
LONG_MAX = (1 << 63) - 1


class FlushMode(Enum):
    """How soon an append is durable.  Here a commit is a micro-batch; the mode sets how it is cut (see streaming)."""

    NORMAL = 0
    CAUTIOUS = 1
    EMERGENCY = 2

    @property
    def is_durable(self) -> bool:
        return self is not FlushMode.NORMAL

    @classmethod
    def parse(cls, text: str) -> FlushMode:
        try:
            return cls[text.strip().upper()]
        except KeyError:
            raise ValueError(f"unknown flush mode {text!r}: normal, cautious or emergency") from None


class OutputFormat(Enum):
    TEXT = "text"
    JSON = "json"
    CSV = "csv"
    HEX = "hex"

    @classmethod
    def parse(cls, text: str) -> OutputFormat:
        try:
            return cls(text.strip().lower())
        except ValueError:
            raise ValueError(f"unknown output format {text!r}: text, json, csv or hex") from None


def entry_size(data: str | Column = "data") -> Column:
    """Logical size of an entry: eight bytes for the timestamp, and its data."""
    return F.octet_length(data) + F.lit(8)


def fits(data: str | Column = "data", limit: int = MAX_ENTRY_BYTES) -> Column:
    """Whether an entry may be stored."""
    return F.octet_length(data) <= limit


def hex16(column: str | Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(column) if isinstance(column, str) else column)), 16, "0")


def sorted_run_name(low: str | Column, high: str | Column) -> Column:
    return F.concat(hex16(low), F.lit("_"), hex16(high), F.lit(".sst"))


def segment_name(number: str | Column) -> Column:
    return F.concat(hex16(number), F.lit(".wal"))


def from_timestamps(df: DataFrame, ts: str, data: Column) -> DataFrame:
    """A log from a TIMESTAMP_NTZ column, whatever the session's zone, and a binary expression."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return df.select((micros * F.lit(1000)).alias("timestamp_ns"), data.alias("data"))
