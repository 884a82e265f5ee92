"""Log lines: mined templates, times and levels, continuation lines over any cut, and odd inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlog.operators import log_times, logs
from ledgerlog.operators.log_templates import Parser, Template, classify, cluster, common, head, key_features, parse_pairs, structured, symbols

NOW = dt.datetime(2026, 1, 1, 0, 30, tzinfo=dt.UTC)
NS = int(NOW.timestamp()) * 10**9
SCHEMA = "entry_id long, timestamp_ns long, data binary, segment_path string, tag string, message string, level string, part long"


def us(*args):
    return int(dt.datetime(*args, tzinfo=dt.UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2025-12-30T01:04:41.344Z", us(2025, 12, 30, 1, 4, 41, 344000)),
        ("2025-12-30T06:34:41.5+05:30", us(2025, 12, 30, 1, 4, 41, 500000)),
        ("2025-12-29T21:34:41.509-0330", us(2025, 12, 30, 1, 4, 41, 509000)),
        ("2025-12-30 01:02:11,915", us(2025, 12, 30, 1, 2, 11, 915000)),
        ("2025/12/30 02:32:16", us(2025, 12, 30, 2, 32, 16)),
        ("30/12/2025 01:02:26.001", us(2025, 12, 30, 1, 2, 26, 1000)),
        ("Mon Dec 29 09:04:02.612658 2025", us(2025, 12, 29, 9, 4, 2, 612658)),
        ("Dec 30, 2025 1:04:41 AM", us(2025, 12, 30, 1, 4, 41)),
        ("Dec 30, 2025 12:00:00 AM", us(2025, 12, 30)),
        ("Dec 30, 2025 12:00:00 PM", us(2025, 12, 30, 12)),
        ("Dec 31 23:59:59", us(2025, 12, 31, 23, 59, 59)),
        ("Jan  1 00:05:05", us(2026, 1, 1, 0, 5, 5)),
        ("Feb 29 12:00:00", us(2024, 2, 29, 12)),
        ("I1231 23:59:59.000001", us(2025, 12, 31, 23, 59, 59, 1)),
        ("1767056466.777", 1767056466777000),
        ("1767056681086", 1767056681086000),
        ("2025-02-30T00:00:00Z", None),
        ("2025-12-30", None),
        ("12:00:00", None),
    ],
)
def test_times(text, expected):
    assert log_times.time_of(text, NS) == expected


def test_levels():
    assert [log_times.level_of(x) for x in ("warning", "CRIT", "Notice", "emerg", 30, "50", 35, True, "loud")] == ["WARN", "FATAL", "INFO", "FATAL", "INFO", "ERROR", "", "", ""]


def sub(a, b):
    return common(Template(a, [set() for _ in a], 1), Template(b, [set() for _ in b], 1))


def test_common_subsequence_is_longest():
    rng = random.Random(4)

    def longest(a, b):
        if not a or not b:
            return 0
        return 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(7))] for _ in range(2))
        t = sub(a, b)
        assert len(t.items) == longest(a, b) and len(t.gaps) == len(t.items)


def mined(lines):
    counts = {}
    for x in lines:
        counts[tuple(symbols(x))] = counts.get(tuple(symbols(x)), 0) + 1
    return cluster(Template(list(s), [set() for _ in s], n) for s, n in counts.items())


WORDS = ["ok", ".", "[5] slot released", "queue depth 7 > limit 3", 'said "x" | y', "a->b", "level=error seen", "数据段 9 已合并", "payload {1} ignored", "retrying (2 of 3)", "x: y"]


def test_optional_parts_become_gaps_and_messages_drop_out():
    lines = [f"<13>Dec 30 01:04:4{i % 10} box{i} {p}: {w}" for i, w in enumerate(WORDS) for p in ("posd[12]", "lane")]
    (t,) = mined(lines)
    assert head(t).items == ["PRI", "T_syslog", "SP", "WORD", "SP", "WORD", ":", "SP"] and head(t).gaps[6] == {"[", "NUM", "]"}
    p = Parser([t], {})
    h = p.parse("<11>Jan  1 00:05:05 box lane[7]: a: b", NS)
    assert (h.level, h.component, h.message, h.event_us) == ("ERROR", "lane", "a: b", us(2026, 1, 1, 0, 5, 5))
    assert p.parse("first cause: x", NS) is None and p.parse("Jan  1 00:05:05 box lane: a", NS) is None


def test_layouts_of_one_time_notation_stay_apart():
    lines = [f"2025-12-30T01:04:41Z INFO [till::queue] {w}" for w in WORDS] + [f"2025-12-30T01:04:41Z | net.peer | warn | {w}" for w in WORDS]
    p = Parser(mined(lines), {})
    assert [(h.level, h.component, h.message) for h in (p.parse(x, NS) for x in ("2025-12-30T01:04:41Z DEBUG [a-b]  two blanks", "2025-12-30T01:04:41Z | c | err | z"))] == [("DEBUG", "a-b", " two blanks"), ("ERROR", "c", "z")]
    assert p.parse("2025-12-30 is not a day", NS) is None and p.parse("2025-12-30T01:04:41Z what else", NS) is None


def test_pairs():
    assert parse_pairs('ts=1 msg="a \\"b\\" c\\nd" lane=5 note="a=b c"') == {"ts": "1", "msg": 'a "b" c\nd', "lane": "5", "note": "a=b c"}
    assert parse_pairs("level=error seen 60 times") is None and parse_pairs("") is None
    assert structured('{"a": [1') is None and structured("[1]") is None and structured("{") is None


def test_keys_are_classified_by_values():
    counts = {}
    for i in range(40):
        line = {"when": 1767056681086 + i, "sev": [10, 20, 30, 40][i % 4], "who": ["auth", "net.peer", "a-b"][i % 3], "said": WORDS[i % len(WORDS)], "pid": i, "ctx": {"level": "info"}}
        for k in key_features("json", line):
            counts[k] = counts.get(k, 0) + 1
    keys = classify(counts)
    assert (keys.time, keys.level, keys.component, keys.message) == (["when"], ["sev"], ["who"], ["said"])
    p = Parser([], {"json": keys})
    assert p.parse('{"said": "x\\ny", "when": 1767056681086}', NS).__dict__ == {"event_us": 1767056681086000, "level": "", "component": "", "message": "x\ny"}
    assert p.parse('{"said": "no time"}', NS) is None
    assert key_features("json", {"a": 1}) == []


def make(rows):
    return [(i, t, None if d is None else d if isinstance(d, bytes) else d.encode(), "clash", "clash", "clash", "clash", 0) for i, t, d in rows]


def story(seed, n=600, tags=3):
    """Interleaved streams; one tag has a third of all lines and more, one record nearly as many."""
    rng = random.Random(seed)
    rows, expected, current, order = [], {}, {}, []
    for i in range(n):
        tag = rng.choice(["hot"] * 3 + [f"t{k}" for k in range(tags)])
        order.append((i, 1000 + i // 2, tag))
    for i, t, tag in order:
        if rng.random() < (0.05 if tag == "hot" else 0.5):
            w = rng.choice(WORDS)
            rows.append((i, t, f"[{tag}] 2025-12-30T01:04:41.{i % 1000:03d}Z WARN [c{i}] {w}"))
            expected[i] = (us(2025, 12, 30, 1, 4, 41) + i % 1000 * 1000, "WARN", f"c{i}", w)
            current[tag] = i
        else:
            line = rng.choice(["\tat x.y(z:1)", "", "KeyError: 5", "2026-01-03 is no head", "{", "a=b c"])
            rows.append((i, t, f"[{tag}] {line}"))
            if tag in current:
                e = expected[current[tag]]
                expected[current[tag]] = (*e[:3], e[3] + "\n" + line)
    return rows, expected


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_records_over_any_cut(spark, partitions):
    rows, expected = story(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(make(rows), SCHEMA).repartition(5)
        got = {r.entry_id: tuple(r)[1:] for r in logs.records(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected


def test_odd_inputs(spark):
    heads = [(i, 1000 + i, f"[a] 2025-12-30T01:04:4{i % 10}Z INFO [x] {w}") for i, w in enumerate(WORDS)]
    rows = [*heads, heads[-1], (100, 2000, None), (101, 2001, "[a] "), (102, 2002, b"[a] \xff"), (103, None, "[a] early, without a head"), (104, 2003, "no tag at all"), (105, 2004, "2025-12-30T01:04:41Z ERROR [untagged] " + "long " * 50_000), (None, 2005, "[b] 2025-12-30T01:04:41Z ERROR [nobody] z"), (106, None, "[c] 2025-12-30T01:04:41Z INFO [y] no arrival")]
    df = spark.createDataFrame(make(rows), SCHEMA)
    got = logs.records(df).collect()
    assert sorted(str(r.entry_id) for r in got) == sorted([*map(str, range(len(WORDS))), str(len(WORDS) - 1), "105", "None", "106"])
    last = [r.message for r in got if r.entry_id == len(WORDS) - 1]
    assert sorted(last) == sorted([WORDS[-1], WORDS[-1] + "\n\n�"])
    (untagged,) = [r for r in got if r.entry_id == 105]
    assert untagged.component == "untagged" and len(untagged.message) == 250_000
    assert logs.records(df.where("false")).count() == 0
    assert logs.records(df.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))).count() == 0


def test_a_missing_year_without_arrival(spark):
    lines = [(i, None if i == 0 else NS, f"[s] <13>Dec 30 01:04:4{i % 10} box lane: {w}") for i, w in enumerate(WORDS)]
    got = {r.entry_id: r.event_us for r in logs.records(spark.createDataFrame(make(lines), SCHEMA)).collect()}
    assert got[0] is None and got[1] == us(2025, 12, 30, 1, 4, 41)


def test_report_names_the_layouts(spark):
    lines = [(i, NS + i, f"[s] <13>Dec 30 01:04:4{i % 10} box lane{'[7]' if i % 2 else ''}: {w}") for i, w in enumerate(WORDS * 2)]
    lines += [(100 + i, NS, '[s] {"when": 176705668108%d, "sev": "info", "said": "two words %d"}' % (i, i)) for i in range(9)]
    got = [tuple(r) for r in logs.layouts(spark.createDataFrame(make(lines), SCHEMA)).collect()]
    assert got == [("<priority><time:syslog> <word> <word>: ", "<number> [ ]", 2 * len(WORDS)), ("json time=when level=sev message=said", "", None)]
    assert logs.layouts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_of_rare_layouts_are_kept(spark):
    usual = [(i, NS + i, '[a] {"ts": 17670%08d, "level": "info", "logger": "l", "msg": "said it %d"}' % (i, i)) for i in range(6000)]
    rare = [(10_000 + i, NS + 1000 * i, '[a] {"when": 176705668108%d, "sev": "warn", "who": "pump", "said": "two words %d"}' % (i, i)) for i in range(5)]
    usual += [(20_000 + i, NS + i, '[b] ts=17670%08d level=info msg="said it %d"' % (i, i)) for i in range(6000)]
    rare += [(30_000 + i, NS + 1000 * i, '[b] when=176705668108%d sev=warn who=pump said="two words %d"' % (i, i)) for i in range(5)]
    got = {r.entry_id: tuple(r)[1:] for r in logs.records(spark.createDataFrame(make(usual + rare), SCHEMA)).collect()}
    assert len(got) == 12_010
    for first in (10_000, 30_000):
        assert [got[first + i] for i in range(5)] == [(1767056681080000 + 1000 * i, "WARN", "pump", f"two words {i}") for i in range(5)]


def test_long_heads_and_late_times():
    long = [f"[{'|'.join(f'p.q{k}:{k}' for k in range(12))}] 2025-12-30T01:04:4{i % 10}Z INFO app.main: {w}" for i, w in enumerate(WORDS)]
    late = [f"2025-12-30T01:04:4{i % 10}Z [{'|'.join(f'p.q{k}:{k}' for k in range(12))}] WARN app.main: {w}" for i, w in enumerate(WORDS)]
    led = [f"INFO app.main worker {i} 2025-12-30T01:04:4{i % 10}Z: {w}" for i, w in enumerate(WORDS)]
    for lines, level in ((long, "INFO"), (late, "WARN"), (led, "INFO")):
        p = Parser(mined(lines), {})
        got = [p.parse(x, NS) for x in lines]
        assert [(h.level, h.message) for h in got] == [(level, w) for w in WORDS]
        assert level == "INFO" and lines is led or {h.component for h in got} == {"app.main"}
    assert Parser(mined(led), {}).parse("it went wrong at 7 or so, 2025-12-30T01:04:41Z: who knows", NS) is None


def test_merging_in_rounds_is_merging(spark, monkeypatch):
    rows, _ = story(3, n=400)
    df = spark.createDataFrame(make(rows), SCHEMA).repartition(40)
    one = sorted(head(t).dumps() for t in logs.mine(df)[0])
    monkeypatch.setattr(logs, "MERGED", 8)
    assert sorted(head(t).dumps() for t in logs.mine(df)[0]) == one
