"""The collector's tag and the payload behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_end(text: Column) -> Column:
    """Length of the leading `[tag] `, 0 where there is none."""
    at = F.locate("] ", text)
    return F.when(text.startswith("[") & (at > 1), at + 1).otherwise(F.lit(0))


def payload_text(data: Column) -> Column:
    """The payload of an entry as a string; bytes that are no UTF-8 are kept as they are."""
    text = data.cast("string")
    return F.substring(text, tag_end(text) + 1, F.lit(2**31 - 1))


def origin_tag(data: Column) -> Column:
    """The tag without its brackets; '' where there is none."""
    text = data.cast("string")
    return F.when(tag_end(text) > 0, F.substring(text, F.lit(2), tag_end(text) - 3)).otherwise(F.lit(""))


def split_tag(data: bytes) -> tuple[bytes, bytes]:
    """(tag without brackets, payload) in Python, by the same rule."""
    if data[:1] == b"[":
        at = data.find(b"] ")
        if at > 0:
            return data[1:at], data[at + 2 :]
    return b"", data
