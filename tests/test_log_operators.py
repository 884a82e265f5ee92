import random

import pytest
from pyspark.sql import functions as F

from ledgerlog.model import SCHEMA, FlushMode
from ledgerlog.operators import compaction, reads, reports, sequence


def rows(df):
    return [(r.timestamp_ns, bytes(r.data)) for r in df.collect()]


def test_scan_is_ordered_and_inclusive(log_of):
    log = log_of([(t, b"%d" % t) for t in (5, 1, 4, 2, 3)])
    assert [t for t, _ in rows(reads.scan_all(log))] == [1, 2, 3, 4, 5]
    assert [t for t, _ in rows(reads.scan(log, 2, 4))] == [2, 3, 4]
    assert [t for t, _ in rows(reads.scan(log, None, 2))] == [1, 2] and [t for t, _ in rows(reads.scan(log, 4))] == [4, 5]
    with pytest.raises(ValueError):
        reads.scan(log, 4, 2)


def test_limits(log_of):
    log = log_of([(t, b"") for t in range(10, 0, -1)])
    assert [t for t, _ in rows(reads.first_n(log, 3))] == [1, 2, 3] and reads.first_n(log, 0).count() == 10
    assert reads.truncated(log, 9) and not reads.truncated(log, 10) and not reads.truncated(log, 0)


def test_limit_plans_without_a_full_sort(log_of):
    assert "TakeOrderedAndProject" in reads.first_n(log_of([(1, b"")]), 5)._jdf.queryExecution().toString()


def test_get(log_of):
    log = log_of([(1, b"b"), (1, b"a"), (2, b"c")]).withColumn("rank", F.when(F.col("data") == b"b", 0).otherwise(1))
    assert rows(reads.get(log, 1, F.col("rank"))) == [(1, b"b")] and rows(reads.get(log, 1)) == [(1, b"a")] and rows(reads.get(log, 3)) == []


def test_merge_keeps_and_compaction_drops_equal_timestamps(log_of):
    a, b = log_of([(1, b"a"), (2, b"a")]), log_of([(2, b"b"), (3, b"b")])
    assert [t for t, _ in rows(reads.merge([a, b]))] == [1, 2, 2, 3]
    runs = a.withColumn("run_id", F.lit(1)).unionByName(b.withColumn("run_id", F.lit(2)))
    assert rows(compaction.compact(runs)) == [(1, b"a"), (2, b"a"), (3, b"b")]
    assert compaction.due(4) and not compaction.due(3)


def test_three_adjacent_runs(spark):
    data = [(t, bytes([t % 256]) * 10, run) for run, first in ((1, 1000), (2, 1005), (3, 1010)) for t in range(first, first + 5)]
    runs = spark.createDataFrame(data, "timestamp_ns long, data binary, run_id int")
    out = rows(compaction.compact(runs))
    assert [t for t, _ in out] == list(range(1000, 1015)) and all(d == bytes([t % 256]) * 10 for t, d in out)
    assert [tuple(r)[1:4] for r in reports.run_catalog(runs).orderBy("run_id").collect()] == [(5, 1000, 1004), (5, 1005, 1009), (5, 1010, 1014)]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_monotonic_is_the_sequential_rule(spark, parts):
    rng = random.Random(parts)
    clocks = [1000, 1000, 900, 1005, 1001, 1001] + [rng.randrange(0, 500) * 7 for _ in range(300)]
    expected, last = [], None
    for c in clocks:
        last = c if last is None else max(c, last + 1)
        expected.append(last)
    df = spark.createDataFrame(list(enumerate(clocks)), "n long, now long").repartition(parts)
    assert [r.timestamp_ns for r in sequence.monotonic(df, "now", ["n"]).orderBy("n").collect()] == expected
    after = [r.timestamp_ns for r in sequence.monotonic(df, "now", ["n"], last=10_000).orderBy("n").collect()]
    assert after == list(range(10_001, 10_001 + len(clocks)))
    assert sequence.monotonic(df.where("false"), "now", ["n"]).count() == 0


@pytest.mark.parametrize(("parts", "threshold", "largest"), [(1, 100, 60), (4, 100, 60), (13, 100, 60), (7, 5000, 60), (5, 9, 30), (6, 10**9, 60), (5, 64, 1)])
def test_flush_boundaries_reset(spark, log_of, parts, threshold, largest):
    rng = random.Random(parts)
    sizes = [rng.randrange(0, largest) for _ in range(700)]
    expected, held, number = [], 0, 0
    for s in sizes:
        expected.append(number)
        held += s + 8
        if held >= threshold:
            held, number = 0, number + 1
    log = log_of([(i, b"x" * s) for i, s in enumerate(sizes)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sequence.flush_segments(log.repartition(3), threshold).orderBy("timestamp_ns").collect()
        two = log.withColumn("w", F.lit("a")).unionByName(log.withColumn("w", F.lit("b")))
        folded = sequence.flush_segments(two, threshold, ["w"]).orderBy("timestamp_ns").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.segment for r in got] == expected
    for w in "ab":
        assert [r.segment for r in folded if r.w == w] == expected
    assert sequence.flush_segments(log.where("false"), threshold).count() == 0


def test_reports(spark, log_of):
    log = log_of([(10, b"abc"), (20, b""), (30, b"x" * 50)])
    assert tuple(reports.stats(log).first()) == (3, 10, 30) and tuple(reports.stats(log.where("false")).first()) == (0, None, None)
    assert tuple(reports.replay(log, 10).first()) == (2, 20, 30)
    assert tuple(reports.ingest_counters(log, 10).first()) == (2, 1, 3) and tuple(reports.ingest_counters(log.where("false"), 10).first()) == (0, 0, 0)
    catalog = spark.createDataFrame([("a", 1000, 100000), ("b", 100001, 200000), ("c", 200001, 300000)], "path string, min_timestamp_ns long, max_timestamp_ns long")
    assert tuple(reports.storage_stats(catalog, log).first()) == (3, 300000, 3, 24 + 53)
    assert [r.path for r in reports.overlapping(catalog, 100000, 100001).orderBy("path").collect()] == ["a", "b"]
    assert tuple(reports.whole_bounds(catalog).first()) == (1000, 300000)
    listing = spark.createDataFrame([("a",), ("z",), ("y.sst.tmp",), ("MANIFEST.tmp",)], "name string")
    assert sorted(r.name for r in reports.orphans(listing, catalog).collect()) == ["MANIFEST.tmp", "y.sst.tmp", "z"]
    assert reports.temporary(listing).count() == 2
    import zlib

    assert {r.timestamp_ns: r.crc for r in reports.checksums(log).collect()} == {10: zlib.crc32(b"abc"), 20: 0, 30: zlib.crc32(b"x" * 50)}


@pytest.mark.parametrize(
    ("recovered", "durable", "previous", "mode", "passed", "missing"),
    [
        ([10, 20, 30, 40, 50], [20, 30, 40], 3, "cautious", True, 0),
        ([10, 20, 30], [], 50, "cautious", False, 0),
        ([10, 20], [20, 30, 40], 50, "cautious", False, 2),
        ([10, 20, 30, 40, 50], [], 5, "cautious", True, 0),
        ([10, 20, 40, 50], [20, 30, 40], 2, "emergency", False, 1),
        (range(60), range(11, 60), 50, "normal", True, 0),
        (range(60), range(11, 109), 50, "normal", True, 49),
        (range(40), range(100), 30, "normal", False, 60),
        ([10, 20, 30, 40, 50, 60, 70], [20, 30], 5, "cautious", True, 0),
    ],
)
def test_verifier(spark, recovered, durable, previous, mode, passed, missing):
    df = lambda values: spark.createDataFrame([(v,) for v in values], "timestamp_ns long")
    v = reports.verify(df(durable), df(recovered), previous, FlushMode.parse(mode))
    assert (v.passed, v.missing) == (passed, missing) and len(v.examples) <= 10


def test_summary(spark):
    df = spark.createDataFrame([(True, 0), (False, 3), (True, 2)], "passed boolean, missing long")
    assert tuple(reports.summarize(df).first()) == (3, 2, 1, 3, 5)


def test_ranges_reach_the_scan(spark, log_of, tmp_path):
    log_of([(i, b"x") for i in range(100)]).write.parquet(str(tmp_path / "log"))
    stored = spark.read.schema(SCHEMA).parquet(str(tmp_path / "log"))
    plan = reads.scan(stored, 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp_ns,10)" in plan and "LessThanOrEqual(timestamp_ns,20)" in plan


def test_each_log_has_its_own_checkpoint(spark):
    log = spark.createDataFrame([(1, 5, b"a"), (1, 9, b"b"), (2, 5, b"c"), (3, 0, b"d"), (None, 1, b"e")], "log_id long, timestamp_ns long, data binary")
    checkpoints = spark.createDataFrame([(1, 5), (2, 9), (4, 1)], "log_id long, checkpoint_ns long")
    assert sorted(tuple(r) for r in reports.replay_each(log, checkpoints, ["log_id"]).where("log_id is not null").collect()) == [(1, 1, 9, 9), (3, 1, 0, 0)]
    catalog = spark.createDataFrame([(1, 7), (1, 8), (5, 3)], "log_id long, max_timestamp_ns long")
    got = reports.storage_stats(catalog, reports.behind(log, checkpoints, ["log_id"]).where("log_id is not null"), ["log_id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 8, 1, 9), (3, 0, 0, 1, 9), (5, 1, 3, 0, 0)]


def test_a_loss_in_one_log_is_no_other_logs(spark):
    durable = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "log_id long, timestamp_ns long")
    recovered = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "log_id long, timestamp_ns long")
    previous = spark.createDataFrame([(1, 3)], "log_id long, previous_entries long")
    assert [tuple(r) for r in reports.missing(durable, recovered, ["log_id"]).collect()] == [(2, 6)]
    got = {r.log_id: (r.passed, r.missing) for r in reports.verdicts(durable, recovered, ["log_id"], FlushMode.CAUTIOUS, previous).collect()}
    assert got == {1: (False, 0), 2: (False, 1)}
    assert {r.passed for r in reports.verdicts(durable, recovered, ["log_id"], FlushMode.NORMAL).collect()} == {True}


def test_steps_that_lead_to_one_end_are_one():
    import numpy as np

    rng = np.random.default_rng(2)
    total = np.cumsum(rng.integers(9, 300, 200_000))
    steps, left, flushes = sequence._exits(total, 1 << 20)
    assert len(steps) < 2000  # of some seven thousand entries that could be the first to flush
    for held in (0, 1, 77, 5000, (1 << 20) - 1, 600_000):
        cuts = sequence._chain(total, held, 1 << 20)
        k = int(np.searchsorted(steps, (1 << 20) - held))
        assert (left[k], flushes[k]) == (total[-1] - total[cuts[-1]], len(cuts))
    assert [len(x) for x in sequence._exits(np.zeros(0, np.int64), 10)] == [0, 0, 0]
