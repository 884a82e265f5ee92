"""Lines of files and of standard input as entries, with the tag of where they came from."""

from __future__ import annotations

import sys
import time
import uuid
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only a line feed ends a line; a carriage return inside one is content.
LINE_END = "\n"


#: Where a line of a streamed file comes from: its file, and its block in it.
ARRIVAL = ("_file", "_block")


def arrival() -> list[Column]:
    return [F.col("_metadata.file_path").alias(ARRIVAL[0]), F.col("_metadata.file_block_start").alias(ARRIVAL[1])]


def trim_line_ends(line: str | Column) -> Column:
    """All trailing line feeds and carriage returns are cut off; works on strings with any bytes."""
    column = F.col(line) if isinstance(line, str) else line
    return F.rtrim(column.cast("string"), F.lit("\r\n"))


def trim_bytes(line: bytes) -> bytes:
    return line.rstrip(b"\r\n")


def tagged(tag: str | Column, line: str | Column) -> Column:
    """`[tag] ` before the trimmed line, as data."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.encode(F.concat(F.lit("["), name, F.lit("] ")), "UTF-8"), trim_line_ends(line).cast("binary"))


def file_tag() -> Column:
    """`file:` and the path of the row's file."""
    return F.concat(F.lit("file:"), F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^file:/*", "/"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(data) of all lines of text files; a last line without an end counts; bytes are kept as they are."""
    raw = spark.read.option("lineSep", LINE_END).text(path)
    return raw.select(tagged(file_tag(), "value").alias("data"))


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None, max_bytes: str | None = None, clean: str | None = None, archive: str | None = None) -> DataFrame:
    """(data, and the place of the line) of files that appear in a folder: closed or rolled files, each read once.

    ``max_files`` and ``max_bytes`` a trigger bound what a micro-batch takes, so nothing is dropped and no queue can
    overflow.  ``clean`` (archive or delete) clears files that are committed.
    """
    reader = spark.readStream.option("lineSep", LINE_END)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if clean:
        reader = reader.option("cleanSource", clean)
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    return reader.text(folder).select(tagged(file_tag(), "value").alias("data"), *arrival())


def spool_stdin(folder: str, source: BinaryIO | None = None, name: str = "stdin", most: int = 64 << 20) -> list[str]:
    """Lands standard input in files of a spool folder, cut after a line end; a file appears whole, by rename.

    Names hold the time and a token, so a later call adds files and replaces none.
    """
    source = source or sys.stdin.buffer
    Path(folder).mkdir(parents=True, exist_ok=True)
    made: list[str] = []
    while lines := source.readlines(most):
        target = Path(folder, f"{name}-{time.time_ns():020d}-{len(made):06d}-{uuid.uuid4().hex[:8]}.log")
        part = target.with_name(f".{target.name}.tmp")
        part.write_bytes(b"".join(lines))
        part.rename(target)
        made.append(str(target))
    return made


def read_stdin_spool(spark: SparkSession, folder: str) -> DataFrame:
    """(data) of landed standard input, under the tag `stdin`."""
    return spark.read.option("lineSep", LINE_END).text(folder).select(tagged("stdin", "value").alias("data"))
