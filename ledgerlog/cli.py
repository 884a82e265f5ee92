"""Commands: ingest, query, export, stats."""

from __future__ import annotations

import argparse
import signal
import sys
import threading
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import config, timeparse
from .model import FlushMode, OutputFormat
from .operators import reads
from .sources.collect import Runner, Spool, StdinSource, TailSource, TcpSource, UdpSource, stream_spool
from .store import LogStore
from .streaming.ingest import Ingest


#: Spool files of a micro-batch.
FILES_A_BATCH = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlog", description="A timestamp-ordered log store on Spark")
    p.add_argument("-d", "--data-dir", help="folder of the log")
    p.add_argument("-c", "--config", help="TOML file of settings")
    commands = p.add_subparsers(dest="command", required=True)
    i = commands.add_parser("ingest", help="take log lines from sources")
    i.add_argument("--stdin", action="store_true", default=None, help="read lines from standard input")
    i.add_argument("--file", action="append", help="follow a file (may be repeated)")
    i.add_argument("--tcp", action="append", help="listen on a TCP address (may be repeated)")
    i.add_argument("--udp", action="append", help="listen on a UDP address (may be repeated)")
    i.add_argument("--flush-mode", choices=[m.name.lower() for m in FlushMode], help="how soon entries are committed")
    i.add_argument("--memtable-threshold-mib", type=int, help="size of a flush")
    either = i.add_mutually_exclusive_group()
    either.add_argument("--compaction-threshold", type=int, help="compact at so many runs")
    either.add_argument("--no-compaction", action="store_true", help="never compact")
    i.add_argument("--channel-capacity", type=int, help="entries that may wait before producers do")
    for name, form, what in (("query", "text", "return"), ("export", "json", "export")):
        q = commands.add_parser(name, help=f"{name} stored entries")
        q.add_argument("--from", dest="start", help="from this time: 1h, 30m, 2d, or YYYY-MM-DD HH:MM:SS")
        q.add_argument("--to", dest="end", help="until this time, inclusive")
        q.add_argument("-f", "--format", type=OutputFormat.parse, default=OutputFormat.parse(form), help="text, json, csv or hex")
        q.add_argument("-l", "--limit", type=int, default=reads.DEFAULT_LIMIT, help=f"most entries to {what}, 0 for all")
        if name == "export":
            q.add_argument("-o", "--output", required=True, help="file to write")
    commands.add_parser("stats", help="show what is stored")
    return p


def settings(args: argparse.Namespace) -> config.Config:
    given: dict = {"data_dir": args.data_dir}
    if args.command == "ingest":
        listed = lambda v: tuple(v) if v else None
        given |= {
            "memtable_flush_threshold": args.memtable_threshold_mib * config.MIB if args.memtable_threshold_mib is not None else None,
            "compaction_threshold": args.compaction_threshold,
            "compaction_enabled": False if args.no_compaction else None,
            "flush_mode": FlushMode.parse(args.flush_mode) if args.flush_mode else None,
            "channel_capacity": args.channel_capacity,
            "stdin": args.stdin,
            "files": listed(args.file),
            "tcp": listed(args.tcp),
            "udp": listed(args.udp),
        }
    return config.load(given, args.config)


def ingest(spark: SparkSession, c: config.Config, stop: threading.Event | None = None) -> dict[str, int]:
    """Runs until all sources have ended or ``stop`` is set, then takes all that has landed."""
    if not c.has_source:
        raise config.ConfigError("sources", "at least one is required: --stdin, --file, --tcp or --udp")
    store = LogStore(spark, f"{c.data_dir}/log", compaction_threshold=c.compaction_threshold, compaction_enabled=c.compaction_enabled, flush_threshold=c.memtable_flush_threshold)
    spool = Spool(f"{c.data_dir}/spool", capacity=c.channel_capacity, most_bytes=c.segment_size)
    sources = [*([StdinSource()] if c.stdin else []), *map(TailSource, c.files), *(TcpSource(*config.parse_address(a)) for a in c.tcp), *(UdpSource(*config.parse_address(a)) for a in c.udp)]
    # a micro-batch takes so many files at most, and files are deleted once their batch is committed
    job = Ingest(store, stream_spool(spark, f"{c.data_dir}/spool", max_files=FILES_A_BATCH, clean="delete"), f"{c.data_dir}/checkpoint", mode=c.flush_mode)
    runner = Runner(spool, sources).start()
    job.start()
    if stop is not None:
        while any(t.is_alive() for t in runner.threads) and not stop.wait(0.1):
            pass
    runner.finish(stop=stop is not None and stop.is_set())
    job.drain()
    return job.counters


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        c = settings(args)
        bounds = timeparse.parse_range(args.start, args.end) if args.command in ("query", "export") else None
        if args.command == "ingest" and not c.has_source:
            raise config.ConfigError("sources", "at least one is required: --stdin, --file, --tcp or --udp")
    except ValueError as e:
        print(f"ledgerlog: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("ledgerlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "ingest":
        stop = threading.Event()
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
        counts = ingest(spark, c, stop)
        print(f"{counts['ingested']} entries ({counts['bytes']} bytes), {counts['failed']} refused", file=sys.stderr)
        return 0
    store = LogStore(spark, f"{c.data_dir}/log")
    snapshot = store.snapshot()
    if args.command == "stats":
        for name, value in snapshot.stats().first().asDict().items():
            print(f"{name}: {value}")
        print(f"flush_mode: {c.flush_mode.name.lower()}")
        return 0
    low, high = bounds
    log = snapshot.log(low, high)
    if args.command == "export":
        print(f"{store.export(args.output, args.format, low, high, args.limit)} entries", file=sys.stderr)
    else:
        for text in reads.lines(log, args.format, low, high, args.limit):
            print(text)
    if reads.truncated(log, args.limit):
        print(f"(the first {args.limit}; there are more)", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
