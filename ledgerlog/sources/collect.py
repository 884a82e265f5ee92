"""Collectors outside Spark: sockets, standard input and growing files land in a spool folder that a stream reads.

A socket can't be read again after a failure, so what it brings is first written to files; Spark takes it from there
exactly once.  Each spool line is one entry in base64, tag included, so inner line feeds and any bytes survive.
"""

from __future__ import annotations

import base64
import contextlib
import itertools
import os
import socket
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import BinaryIO, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import arrival, trim_bytes

#: A datagram is cut at this length.
DATAGRAM_BYTES = 8192
POLL_S = 0.1


class Spool:
    """Entries in files of bounded size and age, each of which appears whole, by rename.

    At most ``capacity`` entries and ``most_bytes`` wait; while they are written out, ``put`` blocks, and so it does while
    ``most_files`` files lie there that the stream has not cleared yet: producers slow down, nothing is dropped.
    """

    def __init__(self, folder: str, *, most_entries: int = 10_000, most_seconds: float = 1.0, capacity: int = 1024, most_bytes: int = 16 << 20, most_files: int = 10_000):
        if "://" in folder and not folder.startswith("file://"):
            raise ValueError(f"a spool is a folder of this machine, not {folder}")
        self.folder, self.most_entries, self.most_seconds, self.most_bytes, self.most_files = Path(folder.removeprefix("file://")), min(most_entries, capacity), most_seconds, most_bytes, most_files
        self.folder.mkdir(parents=True, exist_ok=True)
        self._bytes = 0
        self.closing = False
        self._lock = threading.Lock()
        self._waiting: list[bytes] = []
        self._since = time.monotonic()
        self._number = 0

    def put(self, tag: str, data: bytes) -> None:
        with self._lock:
            self._waiting.append(base64.b64encode(f"[{tag}] ".encode() + data))
            self._bytes += len(self._waiting[-1])
            if len(self._waiting) >= self.most_entries or self._bytes >= self.most_bytes:
                self._roll()
        self.tick()

    def tick(self) -> None:
        with self._lock:
            if self._waiting and time.monotonic() - self._since >= self.most_seconds:
                self._roll()

    def _full(self) -> bool:
        with os.scandir(self.folder) as there:
            return sum(1 for _ in itertools.islice(there, self.most_files)) >= self.most_files

    def _roll(self) -> None:
        while not self.closing and self._full():
            time.sleep(POLL_S)
        name = f"{time.time_ns():020d}-{self._number:06d}-{uuid.uuid4().hex[:8]}.spool"
        part = self.folder / f".{name}.tmp"
        with part.open("wb") as f:
            f.write(b"\n".join(self._waiting) + b"\n")
            f.flush()
            os.fsync(f.fileno())
        part.rename(self.folder / name)
        self._waiting.clear()
        self._bytes = 0
        self._number += 1
        self._since = time.monotonic()

    def close(self) -> None:
        """Writes what waits, however many files there are."""
        self.closing = True
        with self._lock:
            if self._waiting:
                self._roll()


class Source(Protocol):
    """What brings entries: runs until it has no more, or until ``stop`` is set."""

    def run(self, spool: Spool, stop: threading.Event) -> None: ...


class StdinSource:
    """Lines of standard input; the last one counts without an end too."""

    def __init__(self, stream: BinaryIO | None = None):
        self.stream = stream or sys.stdin.buffer

    def run(self, spool: Spool, stop: threading.Event) -> None:
        for line in self.stream:
            if stop.is_set():
                return
            spool.put("stdin", trim_bytes(line))


class TailSource:
    """Lines appended to a file from now on; the source ends with an error at a line that is no UTF-8.

    The file stays open: after a rotation what was still added to the old one is read first, then the new one from its
    start; a file that became shorter is read from its start.
    """

    def __init__(self, path: str, from_start: bool = False):
        self.path, self.from_start = os.path.realpath(path), from_start

    def run(self, spool: Spool, stop: threading.Event) -> None:
        tag, rest, file = f"file:{self.path}", b"", None

        def take(ended: bool) -> None:
            nonlocal rest
            while got := file.read(1 << 20):
                *lines, rest = (rest + got).split(b"\n")
                for line in lines:
                    line.decode("utf-8")
                    spool.put(tag, trim_bytes(line))
            if ended and rest:
                rest.decode("utf-8")
                spool.put(tag, trim_bytes(rest))
                rest = b""

        first = True
        try:
            while True:
                ending = stop.is_set()
                with contextlib.suppress(FileNotFoundError):
                    status = os.stat(self.path)
                    if file is not None and os.fstat(file.fileno()).st_ino != status.st_ino:
                        take(True)
                        file.close()
                        file = None
                    if file is None:
                        file = open(self.path, "rb")  # noqa: SIM115
                        if first and not self.from_start:
                            file.seek(0, os.SEEK_END)
                    elif status.st_size < file.tell():
                        file.seek(0)
                        rest = b""
                first = False
                if file is not None:
                    take(ending)
                spool.tick()
                if ending:
                    break
                stop.wait(POLL_S)
        finally:
            if file is not None:
                file.close()


class TcpSource:
    """Lines of any number of peers; a peer that sends bytes that are no UTF-8 is disconnected."""

    def __init__(self, host: str, port: int):
        family = socket.AF_INET6 if ":" in host else socket.AF_INET
        self.listener = socket.create_server((host, port), family=family)
        self.address = self.listener.getsockname()[:2]

    def _peer(self, connection: socket.socket, tag: str, spool: Spool, stop: threading.Event) -> None:
        rest = b""
        with connection:
            connection.settimeout(POLL_S)
            while not stop.is_set():
                try:
                    got = connection.recv(1 << 16)
                except TimeoutError:
                    continue  # what came of a line so far is kept
                except OSError:
                    break
                *lines, rest = (rest + got).split(b"\n")
                try:
                    for line in lines:
                        line.decode("utf-8")
                        spool.put(tag, trim_bytes(line))
                except UnicodeDecodeError:
                    return
                if not got:
                    break
        with contextlib.suppress(UnicodeDecodeError):
            if rest:
                rest.decode("utf-8")
                spool.put(tag, trim_bytes(rest))

    def run(self, spool: Spool, stop: threading.Event) -> None:
        peers: list[threading.Thread] = []
        with self.listener:
            self.listener.settimeout(POLL_S)
            while not stop.is_set():
                spool.tick()
                try:
                    connection, peer = self.listener.accept()
                except TimeoutError:
                    continue
                thread = threading.Thread(target=self._peer, args=(connection, f"tcp:{_shown(peer)}", spool, stop), daemon=True)
                thread.start()
                peers.append(thread)
        for p in peers:
            p.join()


class UdpSource:
    """One entry per datagram; its end is trimmed, line feeds inside stay."""

    def __init__(self, host: str, port: int):
        self.socket = socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((host, port))
        self.address = self.socket.getsockname()[:2]

    def run(self, spool: Spool, stop: threading.Event) -> None:
        with self.socket:
            self.socket.settimeout(POLL_S)
            while not stop.is_set():
                spool.tick()
                try:
                    data, peer = self.socket.recvfrom(DATAGRAM_BYTES)
                except TimeoutError:
                    continue
                spool.put(f"udp:{_shown(peer)}", trim_bytes(data))


def _shown(peer: tuple) -> str:
    return f"[{peer[0]}]:{peer[1]}" if ":" in peer[0] else f"{peer[0]}:{peer[1]}"


class Runner:
    """Several sources into one spool, a thread each; ends when all have."""

    def __init__(self, spool: Spool, sources: Iterable[Source]):
        self.spool, self.stop = spool, threading.Event()
        self.errors: list[BaseException] = []
        self.threads = [threading.Thread(target=self._guard(s), daemon=True) for s in sources]

    def _guard(self, source: Source) -> Callable[[], None]:
        def run() -> None:
            try:
                source.run(self.spool, self.stop)
            except Exception as e:
                self.errors.append(e)

        return run

    def start(self) -> Runner:
        for t in self.threads:
            t.start()
        return self

    def finish(self, stop: bool = False) -> None:
        """Waits for the sources (told to stop, if wanted), writes what waits, and raises what went wrong."""
        if stop:
            self.stop.set()
        for t in self.threads:
            t.join()
        self.spool.close()
        if self.errors:
            raise self.errors[0]


def read_spool(spark: SparkSession, folder: str) -> DataFrame:
    """(data) of landed spool files."""
    return spark.read.option("pathGlobFilter", "*.spool").text(folder).select(F.unbase64("value").alias("data"))


def stream_spool(spark: SparkSession, folder: str, max_files: int | None = None, clean: str | None = None) -> DataFrame:
    """(data, and the place of the line) of spool files as they land; ``max_files`` a trigger bound a micro-batch."""
    reader = spark.readStream.option("pathGlobFilter", "*.spool")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean:
        reader = reader.option("cleanSource", clean)
    return reader.text(folder).select(F.unbase64("value").alias("data"), *arrival())
