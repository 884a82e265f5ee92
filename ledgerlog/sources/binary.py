"""The native files, read and written: write-ahead segments, sorted runs and the manifest, all little-endian.

    segment   records padded to 4096 bytes: u32 length, u32 crc(length); u64 timestamp, data; u32 crc(timestamp, data), u32 0, u64 mark
    run       u64 mark, u32 version, u32 count, u64 min, u64 max; per entry u64 timestamp, u32 length, data; u32 crc(entries), u32 0, u64 mark
    manifest  u64 mark, u32 version, u32 count, u64 checkpoint; per run u64 min, u64 max, u16 length, path; u32 crc(all before), u64 mark
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import MAX_ENTRY_BYTES

#: Marks and sizes of the formats (fixed values).
SEGMENT_MARK = 0x14057B7EF767814F
RUN_HEAD_MARK, RUN_END_MARK = 0x5851F42D4C957F2D, 0x27BB2EE687B0B0FD
MANIFEST_HEAD_MARK, MANIFEST_END_MARK = 0x2C6FE96EE78B6955, 0x369DEA0F31A53F85
VERSION = 1
SECTOR = 4096


class CorruptFile(ValueError):
    pass


def segment_entries(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Entries up to the first record that is not whole and sound; what follows it in the segment is not read."""
    at = 0
    while at + 8 <= len(raw):
        length, check = struct.unpack_from("<II", raw, at)
        size = -(-(8 + length) // SECTOR) * SECTOR
        if length < 24 or crc32(raw[at : at + 4]) != check or length - 24 > MAX_ENTRY_BYTES or at + size > len(raw):
            return
        body, end = raw[at + 8 : at + length - 8], at + 8 + length - 16
        found, _, mark = struct.unpack_from("<IIQ", raw, end)
        if mark != SEGMENT_MARK or crc32(body) != found:
            return
        yield struct.unpack_from("<Q", body)[0], body[8:]
        at += size


def run_entries(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Entries of a sorted run; CorruptFile where its marks, version, lengths or checksum are wrong."""
    if len(raw) < 48:
        raise CorruptFile("too short for a sorted run")
    mark, version, count, _, _ = struct.unpack_from("<QIIQQ", raw)
    if mark != RUN_HEAD_MARK or version != VERSION:
        raise CorruptFile("not a sorted run of this version")
    at = 32
    for _ in range(count):
        if at + 12 > len(raw):
            raise CorruptFile("the run ends within an entry")
        timestamp, length = struct.unpack_from("<QI", raw, at)
        if length > MAX_ENTRY_BYTES or at + 12 + length > len(raw):
            raise CorruptFile(f"an entry of {length} bytes")
        yield timestamp, raw[at + 12 : at + 12 + length]
        at += 12 + length
    if at + 16 > len(raw):
        raise CorruptFile("the run has no end")
    check, _, mark = struct.unpack_from("<IIQ", raw, at)
    if mark != RUN_END_MARK or check != crc32(raw[32:at]):
        raise CorruptFile("the run's checksum is wrong")


def segment_bytes(entries: Iterable[tuple[int, bytes]]) -> bytes:
    """A segment of these entries, in the order they come."""
    out = bytearray()
    for timestamp, data in entries:
        body = struct.pack("<Q", timestamp) + data
        length = struct.pack("<I", len(body) + 16)
        record = length + struct.pack("<I", crc32(length)) + body + struct.pack("<IIQ", crc32(body), 0, SEGMENT_MARK)
        out += record.ljust(-(-len(record) // SECTOR) * SECTOR, b"\0")
    return bytes(out)


def run_bytes(entries: Iterable[tuple[int, bytes]]) -> bytes:
    """A sorted run of these entries, which come in order."""
    entries = list(entries)
    body = b"".join(struct.pack("<QI", t, len(d)) + d for t, d in entries)
    low, high = (entries[0][0], entries[-1][0]) if entries else (0, 0)
    return struct.pack("<QIIQQ", RUN_HEAD_MARK, VERSION, len(entries), low, high) + body + struct.pack("<IIQ", crc32(body), 0, RUN_END_MARK)


@dataclass(frozen=True)
class NativeManifest:
    checkpoint_timestamp_ns: int
    runs: tuple[tuple[str, int, int], ...]  # path, min, max


def manifest(raw: bytes) -> NativeManifest:
    if len(raw) < 36:
        raise CorruptFile("too short for a manifest")
    mark, version, count, checkpoint = struct.unpack_from("<QIIQ", raw)
    if mark != MANIFEST_HEAD_MARK or version > VERSION:
        raise CorruptFile("not a manifest of this version")
    at, runs = 24, []
    for _ in range(count):
        if at + 18 > len(raw):
            raise CorruptFile("the manifest ends within a run")
        low, high, length = struct.unpack_from("<QQH", raw, at)
        try:
            path = raw[at + 18 : at + 18 + length].decode("utf-8")
        except UnicodeDecodeError:
            raise CorruptFile("a path is no UTF-8") from None
        runs.append((path, low, high))
        at += 18 + length
    if at + 12 > len(raw):
        raise CorruptFile("the manifest has no end")
    check, mark = struct.unpack_from("<IQ", raw, at)
    if mark != MANIFEST_END_MARK or check != crc32(raw[:at]):
        raise CorruptFile("the manifest's checksum is wrong")
    return NativeManifest(checkpoint, tuple(runs))


def _read(spark: SparkSession, path: str, pattern: str, entries) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(entries(raw))
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array([t for t, _ in part], pa.int64()), pa.array([d for _, d in part], pa.binary())], names=["path", "timestamp_ns", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, timestamp_ns bigint, data binary")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(path, timestamp_ns, data) of all write-ahead segments of a folder; a segment is read up to its first bad record."""
    return _read(spark, folder, "*.wal", segment_entries)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, timestamp_ns, data) of all sorted runs of a folder; a corrupt one fails the query."""
    return _read(spark, folder, "*.sst", run_entries)
