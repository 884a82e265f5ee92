"""Entries as text, JSON, CSV and hexadecimal lines: Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import OutputFormat, hex16

CSV_HEADER = "timestamp,data"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timestamp_text(timestamp_ns: str | Column = "timestamp_ns") -> Column:
    """`YYYY-MM-DD hh:mm:ss UTC`, the fraction cut off; independent of the session's zone."""
    column = _column(timestamp_ns)
    micros = F.call_function("div", column, F.lit(1000))
    instant = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.substring(instant.cast("string"), 1, 19), F.lit(" UTC"))


def lossy_text(data: str | Column = "data") -> Column:
    """The data as UTF-8, each maximal malformed part as U+FFFD."""
    return F.make_valid_utf8(_column(data).cast("string"))


def _byte_texts() -> list[str]:
    named = {0x22: '\\"', 0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}
    return [named.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\u{b:04x}") for b in range(256)]


def json_text(data: str | Column = "data") -> Column:
    """The bytes escaped for a JSON string: every byte below 0x20 or from 0x7F on as \\u00xx, also within a character.

    Rows of printable ASCII pass after one scan; of those that have only quotes, backslashes, line ends and tabs
    besides, `replace` makes the text; only the rest goes byte by byte.
    """
    column = _column(data)
    text = column.cast("string")
    plain = text.rlike(r"\A[\x20\x21\x23-\x5b\x5d-\x7e]*\z")
    simple = text.rlike(r"\A[\x20-\x7e\n\r\t]*\z")
    replaced = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        replaced = F.replace(replaced, F.lit(a), F.lit(b))
    table = F.array(*(F.lit(t) for t in _byte_texts()))
    latin = F.decode(column, "ISO-8859-1")
    each = F.array_join(F.transform(F.split(latin, ""), lambda c: F.element_at(table, F.ascii(c) + 1)), "")
    return F.when(plain, text).when(simple, replaced).otherwise(each)


def csv_text(data: str | Column = "data") -> Column:
    """Quotes doubled; data that is no UTF-8 as `[hex:…]`."""
    column = _column(data)
    text = column.cast("string")
    return F.when(F.is_valid_utf8(text), F.replace(text, F.lit('"'), F.lit('""'))).otherwise(F.concat(F.lit("[hex:"), F.lower(F.hex(column)), F.lit("]")))


def text_line(timestamp_ns: str | Column = "timestamp_ns", data: str | Column = "data") -> Column:
    return F.concat(timestamp_text(timestamp_ns), F.lit(" "), lossy_text(data))


def json_line(timestamp_ns: str | Column = "timestamp_ns", data: str | Column = "data") -> Column:
    return F.concat(F.lit('{"timestamp":"'), timestamp_text(timestamp_ns), F.lit('","data":"'), json_text(data), F.lit('"}'))


def csv_line(timestamp_ns: str | Column = "timestamp_ns", data: str | Column = "data") -> Column:
    return F.concat(F.lit('"'), timestamp_text(timestamp_ns), F.lit('","'), csv_text(data), F.lit('"'))


def hex_line(timestamp_ns: str | Column = "timestamp_ns", data: str | Column = "data") -> Column:
    return F.concat(hex16(timestamp_ns), F.lit(" "), F.lower(F.hex(_column(data))))


LINES: dict[OutputFormat, Callable[..., Column]] = {OutputFormat.TEXT: text_line, OutputFormat.JSON: json_line, OutputFormat.CSV: csv_line, OutputFormat.HEX: hex_line}


def line(kind: OutputFormat, timestamp_ns: str | Column = "timestamp_ns", data: str | Column = "data") -> Column:
    """One entry in the given format, without the line end."""
    return LINES[kind](timestamp_ns, data)
