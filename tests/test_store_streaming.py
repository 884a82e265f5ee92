import io
import json
import os
import signal
import socket
import struct
import subprocess
import sys
import threading
import time
from dataclasses import replace
from zlib import crc32

import pytest

from ledgerlog import cli, files
from ledgerlog.model import FlushMode, OutputFormat
from ledgerlog.operators import reads, reports
from ledgerlog.sources import binary, collect, generator, lines
from ledgerlog.store import CommitConflict, LogStore, Manifest, Run, StoreError
from ledgerlog.streaming.ingest import Ingest


def rows(df):
    return [(r.timestamp_ns, bytes(r.data)) for r in df.collect()]


def test_append_scan_get_stats(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path))
    assert rows(store.entries()) == [] and tuple(store.stats().first()) == (0, 0, None, None, 0, 0)
    store.append(log_of([(3, b"c"), (1, b"a"), (2, b"b")]))
    store.append(log_of([(5, b"e"), (4, b"d" * 3)]))
    assert rows(store.entries()) == [(1, b"a"), (2, b"b"), (3, b"c"), (4, b"ddd"), (5, b"e")]
    assert rows(store.scan(2, 4)) == [(2, b"b"), (3, b"c"), (4, b"ddd")]
    assert store.get(4) == b"ddd" and store.get(9) is None
    assert tuple(store.stats().first()) == (2, 5, 1, 5, 5 * 8 + 7, 5)
    store.view("stored", 1)
    assert spark.sql("SELECT count(*) FROM stored WHERE timestamp_ns >= 2").first()[0] == 2
    assert store.append(log_of([])).version == 2  # nothing to commit


def test_snapshot_survives_append_compaction_and_vacuum(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path), compaction_threshold=2)
    store.append(log_of([(1, b"a")]))
    before = store.snapshot()
    store.append(log_of([(2, b"b")]))
    store.compact()
    assert len(store.manifest().runs) == 1 and store.manifest().checkpoint_timestamp_ns == 2
    store.append(log_of([(3, b"c")]))
    assert rows(before.entries()) == [(1, b"a")] and rows(store.entries()) == [(1, b"a"), (2, b"b"), (3, b"c")]
    assert store.vacuum(older_than_s=3600) == []
    (tmp_path / "runs" / ".dead.tmp").mkdir()
    gone = store.vacuum(keep_versions=1, older_than_s=-1)
    assert "runs/.dead.tmp" in gone and len([g for g in gone if g.startswith("runs/0")]) == 2
    assert rows(store.entries()) == [(1, b"a"), (2, b"b"), (3, b"c")]


def test_compaction_waits_for_the_threshold_and_keeps_the_first(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path), compaction_threshold=3)
    store.append(log_of([(1, b"a"), (5, b"old")]))
    store.append(log_of([(5, b"new"), (6, b"f")]))
    assert len(store.compact().runs) == 2
    assert [t for t, _ in rows(store.entries())] == [1, 5, 5, 6] and store.get(5) == b"old"
    store.append(log_of([(7, b"g")]))
    assert len(store.compact().runs) == 1 and rows(store.entries()) == [(1, b"a"), (5, b"old"), (6, b"f"), (7, b"g")]


def test_oversize_entries_stay_out(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path), entry_limit=10)
    store.append(log_of([(1, b"x" * 10), (2, b"x" * 11)]))
    assert [t for t, _ in rows(store.entries())] == [1]


def test_manifest_rules(spark, log_of, tmp_path):
    run = lambda name, low, high: Run(name, low, high, 1, 1)
    m = Manifest()
    for i, (low, high) in enumerate([(1000, 100000), (100001, 200000), (200001, 300000)]):
        m = m.register(run(f"r{i}", low, high))
    assert m.checkpoint_timestamp_ns == 300000
    with pytest.raises(StoreError):
        m.register(run("r0", 1, 400000))
    with pytest.raises(StoreError):
        m.register(run("late", 1, 80000))
    assert m.remove("r0").remove("r1").checkpoint_timestamp_ns == 300000
    assert Manifest.loads(m.dumps()) == m
    with pytest.raises(StoreError):
        Manifest.loads(m.dumps().replace('"format": 1', '"format": 9'))
    store = LogStore(spark, str(tmp_path))
    with pytest.raises(StoreError):
        store._commit(Manifest().register(run("missing", 1, 2)))
    first = store.append(log_of([(1, b"")]))
    with pytest.raises(CommitConflict):
        store._commit(Manifest())
    assert store.manifest() == first


def test_writers_at_once_all_get_in(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.append(log_of([(1, b"first")]))
    logs = [log_of([(1000 + i, b"%d" % i)]) for i in range(6)]
    runs = [LogStore(spark, str(tmp_path))._write_run(x) for x in logs]
    base, wins = store.manifest(), []

    def commit(run):
        manifest = base
        while True:
            try:
                wins.append(store._commit(replace(manifest, runs=(*manifest.runs, run))).version)
                return
            except CommitConflict:
                time.sleep(0.01)
                manifest = store.manifest()

    threads = [threading.Thread(target=commit, args=(r,)) for r in runs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(wins) == [2, 3, 4, 5, 6, 7] and len(store.manifest().runs) == 7 and store.entries().count() == 7


def test_a_claim_that_was_left_behind(spark, log_of, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path))
    (tmp_path / "manifest" / f".v{1:020d}.claim").write_text("")
    with pytest.raises(CommitConflict):
        store._commit(Manifest())
    monkeypatch.setattr(files, "CLAIM_S", 0.0)
    assert store.append(log_of([(1, b"x")])).version == 1


def test_export_is_whole_or_nothing(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.append(log_of([(i * 10**9, b'say "%d"' % i) for i in range(5)]))
    out = tmp_path / "out.csv"
    assert store.export(str(out), OutputFormat.CSV, limit=3) == 3
    assert out.read_text().splitlines() == ["timestamp,data", *(f'"1970-01-01 00:00:0{i} UTC","say ""{i}"""' for i in range(3))]
    with pytest.raises(ValueError):
        store.export(str(tmp_path / "none"), OutputFormat.HEX, 5, 2)
    assert not (tmp_path / "none").exists() and not list(tmp_path.glob("*.tmp"))
    store.export_parts(str(tmp_path / "parts"), OutputFormat.HEX)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "parts").glob("part-*")) == 5


def test_file_lines_keep_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"one\r\ntwo\rhalf\n\n\xff\xfe\nlast")
    got = sorted(bytes(r.data).split(b"] ", 1)[1] for r in lines.read_lines(spark, str(tmp_path / "in")).collect())
    assert got == sorted([b"one", b"two\rhalf", b"", b"\xff\xfe", b"last"])
    tag = bytes(lines.read_lines(spark, str(tmp_path / "in")).first().data)
    assert tag.startswith(b"[file:/" + str(tmp_path / "in" / "a.log").lstrip("/").encode() + b"] ")
    made = lines.spool_stdin(str(tmp_path / "spool"), io.BytesIO(b"x\ny"), most=1)
    assert len(made) == 2 and sorted(bytes(r.data) for r in lines.read_stdin_spool(spark, str(tmp_path / "spool")).collect()) == [b"[stdin] x", b"[stdin] y"]


def test_collectors(spark, tmp_path):
    log = tmp_path / "app.log"
    log.write_text("old\n")
    tcp, udp = collect.TcpSource("127.0.0.1", 0), collect.UdpSource("127.0.0.1", 0)
    runner = collect.Runner(collect.Spool(str(tmp_path / "spool"), most_seconds=0.05), [tcp, udp, collect.TailSource(str(log)), collect.StdinSource(io.BytesIO(b"in\r\nput"))]).start()
    time.sleep(0.3)
    with log.open("a") as f:
        f.write("new\npart")
    with socket.create_connection(tcp.address) as s:
        s.sendall(b"first\nsec")
        time.sleep(0.3)  # longer than a poll: the partial line must survive
        s.sendall(b"ond\r\n")
    with socket.create_connection(tcp.address) as s:
        s.sendall(b"\xff\xfe\nnever\n")
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"two\nlines\r\n", udp.address)
        s.sendto(b"z" * 9000, udp.address)
    time.sleep(0.5)
    runner.finish(stop=True)
    got = [bytes(r.data) for r in collect.read_spool(spark, str(tmp_path / "spool")).collect()]
    by = lambda p: sorted(d.split(b"] ", 1)[1] for d in got if d.startswith(p))
    assert by(b"[stdin") == [b"in", b"put"] and by(b"[file:") == [b"new", b"part"]
    assert by(b"[tcp:127.0.0.1:") == [b"first", b"second"] and by(b"[udp:127.0.0.1:") == [b"two\nlines", b"z" * 8192]


def test_spool_holds_no_more_than_its_capacity(spark, tmp_path):
    spool = collect.Spool(str(tmp_path / "s"), most_seconds=3600, capacity=7)
    for i in range(20):
        spool.put("t", b"%d" % i)
        assert len(spool._waiting) < 7
    spool.close()
    assert len(list((tmp_path / "s").glob("*.spool"))) == 3 and collect.read_spool(spark, str(tmp_path / "s")).count() == 20


def test_stream_is_exactly_once_over_a_crash(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store, clock = LogStore(spark, str(tmp_path / "log"), compaction_threshold=3), iter(range(10**6, 10**9, 10))

    def job():
        return Ingest(store, lines.stream_lines(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "checkpoint"), clock=lambda: next(clock))

    (tmp_path / "in" / "a.log").write_text("a1\na2\n")
    job().drain()
    broken = job()
    append = store.append

    def fails(*args, **kwargs):
        append(*args, **kwargs)
        raise RuntimeError("killed after the commit of the log, before that of the stream")

    store.append = fails
    (tmp_path / "in" / "b.log").write_text("b1\nb2\nb3\n")
    with pytest.raises(Exception, match="killed"):
        broken.drain()
    store.append = append
    (tmp_path / "in" / "c.log").write_text("c1\n")
    again = job()
    again.drain()
    got = rows(store.entries())
    assert [d.split(b"] ")[1] for _, d in got] == [b"a1", b"a2", b"b1", b"b2", b"b3", b"c1"]
    assert [t for t, _ in got] == sorted({t for t, _ in got}) and again.counters["ingested"] == 1
    assert len(store.manifest().runs) == 1  # three runs were compacted
    durable = store.entries()
    assert reports.verify(durable, store.entries(), 6, FlushMode.CAUTIOUS).passed


JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from ledgerlog.sources.lines import stream_lines
from ledgerlog.store import LogStore
from ledgerlog.streaming.ingest import Ingest
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {base!r} + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
Ingest(LogStore(spark, {base!r} + "/log", compaction_threshold=3), stream_lines(spark, {base!r} + "/in", max_files=1), {base!r} + "/checkpoint").drain()
"""


def test_killed_ingestion_goes_on_where_it_was(spark, tmp_path):
    """A process that ingests is killed outright, more than once; afterwards every line is there once, in order."""
    (tmp_path / "in").mkdir()
    for i in range(8):
        (tmp_path / "in" / f"{i}.log").write_text("".join(f"{i}-{k}\n" for k in range(5)))
        os.utime(tmp_path / "in" / f"{i}.log", (1000 + i, 1000 + i))
    store = LogStore(spark, str(tmp_path / "log"))
    acknowledged = 0
    for goal in (1, 3):
        process = subprocess.Popen([sys.executable, "-c", JOB.format(root=os.environ["PYTHONPATH"].split(os.pathsep)[0], base=str(tmp_path))], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        until = time.time() + 60
        while process.poll() is None and dict(store.manifest().batches).get("ingest", -1) < goal and time.time() < until:
            time.sleep(0.05)
        os.killpg(process.pid, signal.SIGKILL)
        process.wait()
        durable = store.entries()
        verdict = reports.verify(durable, store.entries(), acknowledged, FlushMode.CAUTIOUS)
        assert verdict.passed
        acknowledged = durable.count()
        assert acknowledged >= 5 * (goal + 1)
    Ingest(store, lines.stream_lines(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "checkpoint")).drain()
    got = rows(store.entries())
    assert [d.split(b"] ")[1].decode() for _, d in got] == [f"{i}-{k}" for i in range(8) for k in range(5)]
    assert len({t for t, _ in got}) == len(got)


def test_escalation_commits_what_is_there(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = LogStore(spark, str(tmp_path / "log"), compaction_threshold=2)
    job = Ingest(store, lines.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"), name="escalated")
    job.start()
    (tmp_path / "in" / "a.log").write_text("a\n")
    job.escalate()
    assert len(rows(store.entries())) == 1 and job.mode is FlushMode.EMERGENCY
    (tmp_path / "in" / "b.log").write_text("b\n")
    job.stop()
    assert len(store.manifest().runs) == 2  # compaction is paused


def test_cli(spark, tmp_path, capsys, monkeypatch):
    data = str(tmp_path / "d")
    assert cli.main(["-d", data, "ingest"]) == 2 and cli.main(["-d", data, "query", "--from", "1h", "--to", "2h"]) == 2
    c = cli.settings(cli.parser().parse_args(["-d", data, "ingest", "--stdin"]))
    monkeypatch.setattr(collect.StdinSource, "__init__", lambda self, stream=None: setattr(self, "stream", io.BytesIO(b"hello\nworld\n")))
    assert cli.ingest(spark, c, threading.Event())["ingested"] == 2
    capsys.readouterr()
    assert cli.main(["-d", data, "query", "-f", "json", "-l", "1"]) == 0
    out = capsys.readouterr()
    assert json.loads(out.out)["data"] == "[stdin] hello" and "there are more" in out.err
    assert cli.main(["-d", data, "export", "-o", str(tmp_path / "o.hex"), "-f", "hex"]) == 0 and len((tmp_path / "o.hex").read_text().splitlines()) == 2
    assert cli.main(["-d", data, "stats"]) == 0 and "entries: 2" in capsys.readouterr().out


def test_generator(spark):
    a, b = (sorted(rows(generator.transactions(spark, 2000, seed=s))) for s in (1, 1))
    assert a == b and a != sorted(rows(generator.transactions(spark, 2000, seed=2)))
    made = [json.loads(d) for _, d in a]
    assert [m["txn_id"] for m in made[:2]] == ["TXN-00000001", "TXN-00000002"] and list(made[0])[:3] == ["txn_id", "terminal_id", "agent_id"]
    share = sum(m["type"] == "payment" for m in made) / len(made)
    assert 0.55 < share < 0.65 and all(generator.AMOUNTS[m["type"]][0] <= m["amount"] <= generator.AMOUNTS[m["type"]][1] for m in made)


def _segment(entries):
    out = b""
    for t, d in entries:
        length = struct.pack("<I", 8 + len(d) + 16)
        body = struct.pack("<Q", t) + d
        rec = length + struct.pack("<I", crc32(length)) + body + struct.pack("<IIQ", crc32(body), 0, binary.SEGMENT_MARK)
        out += rec + bytes(-len(rec) % 4096)
    return out


def _run(entries):
    body = b"".join(struct.pack("<QI", t, len(d)) + d for t, d in entries)
    return struct.pack("<QIIQQ", binary.RUN_HEAD_MARK, 1, len(entries), entries[0][0], entries[-1][0]) + body + struct.pack("<IIQ", crc32(body), 0, binary.RUN_END_MARK)


def test_native_files(spark, tmp_path):
    entries = [(1, b"a"), (2, b""), (3, b"z" * 5000)]
    good = _segment(entries)
    (tmp_path / "0000000000000000.wal").write_bytes(good + bytes(8192))
    damaged = bytearray(good)
    damaged[4096 + 10] ^= 1  # the second record
    (tmp_path / "0000000000000001.wal").write_bytes(damaged)
    (tmp_path / "x.sst").write_bytes(_run(entries))
    got = rows(binary.read_segments(spark, str(tmp_path)))
    assert sorted(got) == sorted([*entries, (1, b"a")])
    assert sorted(rows(binary.read_runs(spark, str(tmp_path)))) == entries
    raw = _run(entries)
    for bad in (raw[:-1], raw[:40], b"\0" * 60, raw[:50] + b"!" + raw[51:]):
        with pytest.raises(binary.CorruptFile):
            list(binary.run_entries(bad))
    head = struct.pack("<QIIQ", binary.MANIFEST_HEAD_MARK, 1, 1, 9) + struct.pack("<QQH", 1, 9, 5) + b"a.sst"
    whole = head + struct.pack("<IQ", crc32(head), binary.MANIFEST_END_MARK)
    assert binary.manifest(whole) == binary.NativeManifest(9, (("a.sst", 1, 9),))
    for bad in (whole[:-1], whole[:20], whole.replace(b"a.sst", b"b.sst"), whole.replace(b"a.sst", b"\xff.sst")):
        with pytest.raises(binary.CorruptFile):
            binary.manifest(bad)


def test_lines_are_streamed_in_order(log_of):
    log = log_of([(t * 10**9, b"x") for t in range(3)])
    assert list(reads.lines(log, OutputFormat.HEX))[0].endswith(" 78") and len(list(reads.lines(log, OutputFormat.CSV, limit=2))) == 3


def test_arrival_order_is_that_of_files_and_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("1", 3), ("2", 2000), ("3", 3)):
        (tmp_path / "in" / f"{name}.log").write_text("".join(f"{name}-{k}\n" for k in range(n)))
    store = LogStore(spark, str(tmp_path / "log"))
    Ingest(store, lines.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint")).drain()
    got = [bytes(r.data).split(b"] ")[1].decode() for r in store.entries().collect()]
    assert got == [f"{name}-{k}" for name, n in (("1", 3), ("2", 2000), ("3", 3)) for k in range(n)]


def test_a_second_landing_adds_files(spark, tmp_path):
    for text in (b"a\nb\n", b"c\n"):
        lines.spool_stdin(str(tmp_path), io.BytesIO(text))
    assert sorted(bytes(r.data) for r in lines.read_stdin_spool(spark, str(tmp_path)).collect()) == [b"[stdin] a", b"[stdin] b", b"[stdin] c"]


def test_a_large_batch_is_flushed_in_several_runs(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path), flush_threshold=100, compaction_enabled=False)
    log = [(t, b"x" * (t % 40)) for t in range(1, 60)]
    m = store.append(log_of(log), "s", 4)
    assert m.version == 1 and len(m.runs) > 5 and all(a.max_timestamp_ns < b.min_timestamp_ns for a, b in zip(m.runs, m.runs[1:])) and all(r.bytes >= 100 for r in m.runs[:-1])
    assert rows(store.entries()) == log and store.append(log_of([(99, b"y")]), "s", 4) == store.manifest() and m.checkpoint_timestamp_ns == 59
    assert len(store.append(log_of([(99, b"y")]), "s", 5).runs) == len(m.runs) + 1


def test_compaction_leaves_large_runs(spark, log_of, tmp_path, monkeypatch):
    from ledgerlog.operators import compaction

    monkeypatch.setattr(compaction, "TIER_BYTES", 64)
    store = LogStore(spark, str(tmp_path), compaction_threshold=3)
    store.append(log_of([(t, b"x" * 100) for t in range(1, 50)]))
    (large,) = store.manifest().runs
    for t in (100, 200, 300):
        store.append(log_of([(t, b"s"), (t + 1, b"t")]))
    m = store.compact()
    assert large in m.runs and len(m.runs) == 2 and store.compact() == m and len(rows(store.entries())) == 55
    overlapping = [Run("a", 1, 9, 1, 10**9), Run("b", 5, 6, 1, 1), Run("c", 20, 21, 1, 1), Run("d", 30, 31, 1, 1), Run("e", 50, 60, 1, 10**9)]
    assert [r.path for r in compaction.picked(overlapping, 3)] == ["a", "b", "c", "d"] and compaction.picked(overlapping[3:], 3) == ()


def test_compaction_refuses_a_run_that_was_changed(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path), compaction_threshold=2)
    for t in (1, 2):
        store.append(log_of([(t, b"good")]))
    run = store.manifest().runs[0]
    log_of([(1, b"evil")]).write.mode("overwrite").parquet(str(tmp_path / "runs" / run.path))
    with pytest.raises(StoreError, match="not what was committed"):
        store.compact()
    assert len(store.manifest().runs) == 2


def test_checksums_are_the_native_ones(spark, log_of):
    got = {r.timestamp_ns: r.crc for r in log_of([(5, b"a"), (2**62, b"")]).select("timestamp_ns", reports.entry_crc().alias("crc")).collect()}
    assert got == {5: crc32(struct.pack("<Q", 5) + b"a"), 2**62: crc32(struct.pack("<Q", 2**62))}
    kept = reports.checksums(log_of([(5, b"a"), (6, b"b")])).join(log_of([(5, b"a"), (6, b"c")]), "timestamp_ns")
    assert [r.timestamp_ns for r in reports.corrupt(kept).collect()] == [6]


def test_an_export_replaces_the_old_one(spark, log_of, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.append(log_of([(t, b"%d" % t) for t in range(1, 2001)]))
    out = tmp_path / "o.txt"
    out.write_text("old")
    assert store.export(str(out), OutputFormat.HEX, limit=0) == 2000 and len(out.read_text().splitlines()) == 2000
    assert [p.name for p in tmp_path.iterdir() if "tmp" in p.name] == []


def test_a_rotated_file_is_read_to_its_end(spark, tmp_path):
    log, stop = tmp_path / "a.log", threading.Event()
    log.write_text("before\n")
    spool = collect.Spool(str(tmp_path / "spool"), most_seconds=0.05)
    thread = threading.Thread(target=collect.TailSource(str(log)).run, args=(spool, stop))
    thread.start()
    time.sleep(0.4)
    with log.open("a") as f:  # written after the last look, and rotated at once
        f.write("one\ntwo")
        f.flush()
        log.rename(tmp_path / "a.log.1")
        log.write_text("three\n")
        time.sleep(0.5)
    stop.set()
    thread.join()
    spool.close()
    assert sorted(bytes(r.data).split(b"] ")[1] for r in collect.read_spool(spark, str(tmp_path / "spool")).collect()) == [b"one", b"three", b"two"]


def test_a_file_that_is_no_text_ends_its_source(tmp_path):
    (tmp_path / "b.log").write_bytes(b"fine\n\xff\xfe\n")
    runner = collect.Runner(collect.Spool(str(tmp_path / "spool")), [collect.TailSource(str(tmp_path / "b.log"), from_start=True)]).start()
    with pytest.raises(UnicodeDecodeError):
        runner.finish()


def test_a_full_spool_holds_producers_back(tmp_path):
    spool = collect.Spool(str(tmp_path), most_entries=1, most_files=2)
    done = []

    def produce():
        for i in range(4):
            spool.put("t", b"%d" % i)
            done.append(i)

    thread = threading.Thread(target=produce)
    thread.start()
    time.sleep(0.5)
    assert len(done) == 2 and len(list(tmp_path.glob("*.spool"))) == 2
    for p in tmp_path.glob("*.spool"):
        p.unlink()
    thread.join(5)
    assert len(done) == 4
    with pytest.raises(ValueError, match="folder of this machine"):
        collect.Spool("hdfs://there/spool")
