"""Messages delivered more than once, and only what is new: against plain Python, and odd inputs."""

import json
import pathlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlog.operators import incremental, messages

ENTRIES = "entry_id long, timestamp_ns long, data binary, file_id long, origin string, message_id string, n long, at string"


def entry(i, t, body, tag="tcp:1"):
    return (i, t, None if body is None else f"[{tag}] ".encode() + (body if isinstance(body, bytes) else json.dumps(body).encode()), 1, tag, "clash", 0, "clash")


@pytest.fixture(scope="module")
def sent(spark):
    rows = [
        entry(1, 10, {"txn_id": "TXN-1"}),
        entry(2, 5, {"message_id": "TXN-1", "note": "another name"}),
        entry(3, 5, {"txnId": "TXN-1"}),  # a tie in time
        entry(4, 1, {"txn_id": "TXN-2", "reversal_of": "TXN-1"}),
        entry(5, 1, {"txn_id": None, "reverses": "TXN-1"}),
        entry(6, 1, {"txn_id": ""}),
        entry(7, 1, {"txn_id": ""}),
        entry(8, 1, b"PING"),
        entry(9, 1, b"[]"),
        entry(10, 1, b"\xde\xad\xff"),
        entry(11, 1, None),
        entry(12, None, {"txn_id": "TXN-3"}),  # no time: last
        entry(13, 99, {"txn_id": "TXN-3"}),
        entry(14, 99, {"txn_id": "TXN-4"}),
        (15, 100, json.dumps({"txn_id": "TXN-4"}).encode(), None, None, None, None, None),  # no tag
        entry(16, 1, {"a": {"txn_id": "TXN-1"}}),  # another object's
        entry(17, 1, {"txn_id": 12}),
    ]
    return spark.createDataFrame(rows, ENTRIES)


def test_surplus(sent):
    got = sorted(tuple(r) for r in messages.surplus(sent).collect())
    assert got == [("TXN-1", 1), ("TXN-1", 3), ("TXN-3", 12), ("TXN-4", 15)]


def test_kept_and_deduplicated(sent):
    kept = messages.kept(sent).collect()
    assert sorted((r.message_id, r.entry_id, r.n) for r in kept if r.message_id) == [("TXN-1", 2, 3), ("TXN-2", 4, 1), ("TXN-3", 13, 2), ("TXN-4", 14, 2)]
    assert sorted(r.entry_id for r in kept if r.message_id is None) == [5, 6, 7, 8, 9, 10, 11, 16, 17]
    whole = messages.deduplicate(sent)
    assert whole.columns == sent.columns and sorted(r.entry_id for r in whole.collect()) == sorted(r.entry_id for r in kept)


def test_empty_and_only_nulls(spark, sent):
    for df in (sent.where("false"), sent.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in sent.schema))):
        assert messages.surplus(df).count() == 0
    assert messages.kept(sent.where("false")).count() == 0


def test_names_of_identifiers_are_found_in_the_values(spark, sent):
    assert messages.identifier_fields(sent) == ["txn_id", "message_id", "txnId"]
    rows = [entry(i, i, {"own.id`s": f"TXN-{i // 2}", "about": f"TXN-{i}", "Own": "x"}) for i in range(20)] + [entry(50 + i, i, {"OWN": f"TXN-{i}", "about": f"TXN-{i + 1}"}) for i in range(9)]
    df = spark.createDataFrame([*rows, entry(90, 90, {"Own": "TXN-0"})], ENTRIES)
    assert messages.identifier_fields(df)[:1] == ["about"] or messages.identifier_fields(df) == ["own.id`s", "OWN", "Own"]
    fields = ["own.id`s", "OWN", "Own"]
    got = {r.entry_id: r.m for r in df.select("entry_id", messages.message_id(F.col("data"), fields).alias("m")).collect()}
    assert got[3] == "TXN-1" and got[53] == "TXN-3" and got[90] == "TXN-0"
    assert messages.identifier_fields(df.where("false")) == [] and df.select(messages.message_id(F.col("data"), []).alias("m")).where("m is null").count() == df.count()


def test_a_sixth_name_loses_no_repeat(spark):
    df = spark.createDataFrame([entry(i, i, {["txn_id", "ref_no"][i % 2]: f"TXN-{i // 4}"} | ({"reversal_of": "TXN-7"} if i % 5 == 0 else {})) for i in range(40)], ENTRIES)
    assert messages.surplus(df).count() == 30


def test_new_against_stored(spark, sent):
    stored = spark.createDataFrame([("TXN-1",), (None,), ("TXN-1",)], "message_id string")
    got = {r.message_id: r.entry_id for r in messages.deduplicate_new(stored, sent.where("message_id is null or entry_id <> 0")).where("message_id is not null").collect()}
    assert got == {"TXN-2": 4, "TXN-3": 13, "TXN-4": 14}


@pytest.mark.parametrize("most", [0, 200_000])
def test_one_identifier_in_a_third_of_all_rows(spark, monkeypatch, most):
    monkeypatch.setattr(messages, "BROADCAST_IDENTIFIERS", most)
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), f'[t] {{"txn_id":"TXN-{0 if rng.random() < 0.34 else rng.randrange(2000)}"}}'.encode()) for i in range(3000)]
    by = defaultdict(list)
    for i, t, d in rows:
        by[json.loads(d[4:])["txn_id"]].append((t, i))
    expected = sorted((k, i) for k, v in by.items() for _, i in sorted(v)[1:])
    df = spark.createDataFrame(rows, "entry_id long, timestamp_ns long, data binary").repartition(5)
    assert sorted(tuple(r) for r in messages.surplus(df).collect()) == expected


def brute(entries, sstables, manifests):
    runs, saves, contents = {}, defaultdict(dict), defaultdict(list)
    for log, run, seq in sstables:
        if None not in (log, run, seq):
            runs[log, run] = min(seq, runs.get((log, run), seq))
    for log, seq, checkpoint, state in manifests:
        if state == "committed" and None not in (log, seq, checkpoint):
            saves[log][seq] = max(checkpoint, saves[log].get(seq, checkpoint))
    for e, log, run, t, d in entries:
        if (log, run) in runs and t is not None:
            contents[log, t, d].append((runs[log, run], e))
    out = []
    for (log, t, _), copies in contents.items():
        first = min(copies)[0]
        for seq, checkpoint in sorted(saves[log].items()):
            if seq >= first and checkpoint >= t:
                out.append((log, seq, min(e for a, e in copies if a <= seq)))
                break
    return sorted(out)


def history(seed, saves=400, logs=3, size=900):
    """Overlapping runs with repeats, late stretches, failed saves and checkpoints that fall back."""
    rng = random.Random(seed)
    sstables, manifests, entries, run = [], [], [], 0
    for log in range(logs):
        top = 0
        for seq in range(1, saves + 1):
            top += rng.randrange(0, 20)
            state = rng.choice(["committed", "committed", "failed", "torn", None])
            row = (log, seq, None if rng.random() < 0.05 else max(0, top - rng.choice([0, 0, 0, 500])), state)
            manifests += [row] * rng.choice([1, 1, 2])
            if rng.random() < 0.4:
                run += 1
                sstables += [(log, run, seq)] * rng.choice([1, 1, 2])
    known = [(log, run) for log, run, _ in sstables] + [(0, 10**6)]
    for i in range(size):
        log, r = rng.choice(known)
        entries.append((i, log, r, rng.randrange(0, saves * 12) // 5 * 5, b"%d" % rng.randrange(3)))
    entries += [(size + 1, None, 1, 5, b"x"), (size + 2, 0, None, 5, b"x"), (size + 3, *known[0], None, b"x"), (size + 4, *known[0], 5, None), (size + 5, *known[0], 5, None)]
    return entries, sstables, manifests


SCHEMAS = ("entry_id long, log_id long, run_id long, timestamp_ns long, data binary", "log_id long, run_id long, manifest_seq long", "log_id long, manifest_seq long, checkpoint_timestamp_ns long, state string")


def frames(spark, tables):
    return [spark.createDataFrame(t, s) for t, s in zip(tables, SCHEMAS)]


@pytest.mark.parametrize("block", [2, 128])
def test_processed_is_the_definition(spark, monkeypatch, block):
    monkeypatch.setattr(incremental, "BLOCK", block)  # small blocks make the search climb
    tables = history(block)
    got = sorted(tuple(r) for r in incremental.processed(*frames(spark, tables)).collect())
    assert got == brute(*tables) and len(got) > 100


def test_extra_columns_and_empty_tables(spark):
    tables = history(5, saves=20, logs=1, size=40)
    e, s, m = frames(spark, tables)
    extra = incremental.processed(e.withColumn("seq", F.lit(1)).withColumn("added", F.lit("x")).withColumn("b", F.lit(2)), s.withColumn("added", F.lit(0)).withColumn("data", F.lit(0)), m.withColumn("seq", F.lit(1)).withColumn("checkpoint", F.lit(1)))
    assert sorted(tuple(r) for r in extra.collect()) == brute(*tables)
    for i in range(3):
        some = [x.where("false") if i == j else x for j, x in enumerate((e, s, m))]
        assert incremental.processed(*some).count() == 0


def test_one_run_takes_all_saves(spark, tmp_path):
    tables = history(11, saves=200)
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))
    job.run(*frames(spark, tables))
    assert sorted(tuple(r) for r in job.output().collect()) == brute(*tables)
    empty = incremental.IncrementalJob(spark, str(tmp_path / "empty"))
    for _ in range(2):
        empty.run(*(f.where("false") for f in frames(spark, tables)))
    assert empty.output().count() == 0 and empty.commits() == [1, 2]


def test_runs_of_the_job_survive_failures(spark, tmp_path):
    entries, sstables, manifests = history(9, saves=30, logs=2, size=300)
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))

    def until(seq):
        return frames(spark, (entries, [s for s in sstables if s[2] <= seq], [m for m in manifests if m[1] <= seq]))

    def dies():
        raise RuntimeError("lost")

    assert job.output().count() == 0
    for seq in (7, 8, 15, 30):
        with pytest.raises(RuntimeError):
            job.run(*until(seq), before_commit=dies)
        job.run(*until(seq))
    job.run(*until(30))  # nothing is new
    got = sorted((r.log_id, r.manifest_seq, r.entry_id) for r in job.output().collect())
    assert got == brute(entries, sstables, manifests) and job.commits() == [1, 2, 3, 4, 5]


def test_a_run_opens_no_file_of_the_run_before(spark, tmp_path):
    tables = history(21, saves=60, logs=3, size=500)
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))
    steps = incremental.landed(job, *frames(spark, tables), 4)
    files = [{f.rsplit("/", 2)[1] for f in rows.inputFiles()} for rows, _ in steps]
    assert files == [{f"step={k}"} for k in range(4)]
    for (rows, saves), seen in zip(steps, [r[0].inputFiles() for r in steps]):
        job.run_arrived(rows, saves)
        for f in seen:  # nothing that was processed is needed again
            pathlib.Path(f.removeprefix("file://")).unlink()
    assert sorted(tuple(r) for r in job.output().collect()) == brute(*tables)


def test_lost_processes_neither_skip_nor_repeat(spark, tmp_path):
    tables = history(22, saves=60, logs=3, size=500)
    job = incremental.rerun(spark, str(tmp_path / "job"), *frames(spark, tables))
    assert sorted(tuple(r) for r in job.output().collect()) == brute(*tables) and job.commits() == [1, 2, 3]
    job.vacuum()
    assert sorted(tuple(r) for r in job.output().collect()) == brute(*tables)
    empty = incremental.rerun(spark, str(tmp_path / "empty"), *(f.where("false") for f in frames(spark, tables)))
    assert empty.output().count() == 0


def test_outputs_are_brought_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "OUTPUTS", 3)
    tables = history(23, saves=40, logs=2, size=300)
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))
    for rows, saves in incremental.landed(job, *frames(spark, tables), 7):
        job.run_arrived(rows, saves)
        assert len(job._latest()["outputs"]) < 3
    assert sorted(tuple(r) for r in job.output().collect()) == brute(*tables)


def test_two_runs_at_once_commit_once(spark, tmp_path):
    tables = history(24, saves=20, logs=1, size=60)
    job, other = (incremental.IncrementalJob(spark, str(tmp_path / "job")) for _ in range(2))
    with pytest.raises(RuntimeError):
        job.run(*frames(spark, tables), before_commit=lambda: other.run(*frames(spark, tables)))
    assert job.commits() == [1] and sorted(tuple(r) for r in job.output().collect()) == brute(*tables)


def test_stream_without_repeats(spark, tmp_path):
    from ledgerlog.streaming.ingest import deduplicated

    schema = "entry_id long, timestamp_ns long, data binary, arrived timestamp"
    for i, part in enumerate(([(1, "a", 10), (2, "b", 11), (3, "a", 12)], [(4, "a", 13), (5, "c", 14)], [(6, "b", 20), (7, None, 21)])):
        rows = [(e, t, json.dumps({"txn_id": f"TXN-{k}" if k else ""}).encode(), t) for e, k, t in part]
        spark.createDataFrame(rows, "entry_id long, timestamp_ns long, data binary, at long").withColumn("arrived", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    named = stream.withColumn("message_id", messages.message_id(F.col("data"), ["txn_id"])).where("message_id is not null")
    query = deduplicated(named).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = [r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["TXN-a", "TXN-b", "TXN-c"]
