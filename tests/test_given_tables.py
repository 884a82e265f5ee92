"""The registered queries on the given tables: against DuckDB where there is SQL, log records against another parser."""

import datetime as dt
import json
import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not there")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return bytes(v) if isinstance(v, bytearray) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["timestamp_ns", "line"] and df.count() == 1000


MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
LEVEL = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
WORDS = {"WARNING": "WARN", "ERR": "ERROR", "NOTICE": "INFO", "INF": "INFO", "DBG": "DEBUG", "WRN": "WARN", "TRC": "TRACE", **dict.fromkeys("CRITICAL CRIT EMERG ALERT PANIC FTL".split(), "FATAL")}


def level(word):
    return WORDS.get(word.upper(), word.upper())


def micros(year, month, day, hour, minute, second, fraction="", zone="Z"):
    t = dt.datetime(*map(int, (year, month, day, hour, minute, second)), tzinfo=dt.UTC)
    sign, digits = (-1 if zone[0] == "-" else 1), zone[1:].replace(":", "").ljust(4, "0")
    return int(t.timestamp()) * 10**6 + int((fraction or "0").ljust(6, "0")[:6]) - sign * (int(digits[:2]) * 60 + int(digits[2:])) * 60 * 10**6


def iso(text):
    return micros(*re.fullmatch(r"(\d+)-(\d+)-(\d+)T(\d+):(\d+):(\d+)(?:\.(\d+))?(Z|[+-]\d\d:?\d\d)", text).groups())


def nearest(ns, *rest):
    year = dt.datetime.fromtimestamp(ns / 1e9, dt.UTC).year
    return min((micros(y, *rest) for y in (year - 1, year, year + 1)), key=lambda t: abs(t - ns // 1000))


#: One hand-written rule per layout, which the operator has to find by itself.
RULES = [
    (r"(\d{4}-\d\d-\d\dT\S+) +(\w+) +\[([^\]]*)\] (.*)", lambda m, ns: (iso(m[1]), level(m[2]), m[3], m[4])),
    (r"\[(\d{4}-\d\d-\d\dT\S+) +(\w+) +(\S+)\] (.*)", lambda m, ns: (iso(m[1]), level(m[2]), m[3], m[4])),
    (r"(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d),(\d+) - (\S+) - (\w+) - (.*)", lambda m, ns: (micros(*m.groups()[:7]), level(m[9]), m[8], m[10])),
    (r"([A-Z])(\d\d)(\d\d) (\d+):(\d+):(\d+)\.(\d+) +\d+ ([^:]+):\d+\] (.*)", lambda m, ns: (nearest(ns, *m.groups()[1:7]), LEVEL[m[1]], m[8], m[9])),
    (r"(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d)\.(\d+)\|(\w+)\|([^|]*)\|(.*)", lambda m, ns: (micros(m[3], m[2], m[1], *m.groups()[3:7]), level(m[8]), m[9], m[10])),
    (r"(\d{4})/(\d\d)/(\d\d) (\d\d):(\d\d):(\d\d) \(([^)]*)\) (.*)", lambda m, ns: (micros(*m.groups()[:6]), "", m[7], m[8])),
    (r"(\w{3}) (\d+), (\d{4}) (\d+):(\d+):(\d+) ([AP])M (\w+): (.*)", lambda m, ns: (micros(m[3], MONTHS[m[1]], m[2], int(m[4]) % 12 + 12 * (m[7] == "P"), m[5], m[6]), level(m[8]), "", m[9])),
    (r"\[\w{3} (\w{3}) +(\d+) (\d+):(\d+):(\d+)\.(\d+) (\d{4})\] \[(.*?):(\w+)\] (.*)", lambda m, ns: (micros(m[7], MONTHS[m[1]], *m.groups()[1:6]), level(m[9]), m[8], m[10])),
    (r"(\d{10})\.(\d+) \[(\w+)\] (\S+): (.*)", lambda m, ns: (int(m[1]) * 10**6 + int(m[2].ljust(6, "0")), level(m[3]), m[4], m[5])),
    (r"<(\d+)>(\w{3}) +(\d+) (\d+):(\d+):(\d+) \S+ ([^\[:]+)(?:\[\d+\])?: (.*)", lambda m, ns: (nearest(ns, MONTHS[m[2]], *m.groups()[2:6]), ["FATAL"] * 3 + ["ERROR", "WARN", "INFO", "INFO", "DEBUG"], m[7], m[8])),
]


def parse(text, ns):
    if text.startswith("{"):
        try:
            j = json.loads(text)
        except ValueError:
            return None
        if "time" in j:
            return (j["time"] * 1000 if isinstance(j["time"], int) else iso(j["time"]), [*LEVEL.values()][j["level"] // 10 - 1], j["name"], j["msg"])
        return (iso(j["@timestamp"]), level(j["severity"]), j["component"], j["message"]) if "@timestamp" in j else None
    if re.match(r"\w+=", text):
        kv = {k: json.loads(v) if v[:1] == '"' else v for k, v in re.findall(r'(\w+)=("(?:\\.|[^"\\])*"|\S*)', text)}
        return (iso(kv["ts"]), level(kv["level"]), kv.get("logger") or kv["component"], kv["msg"]) if "ts" in kv else None
    for pattern, make in RULES:
        if m := re.fullmatch(pattern, text, re.DOTALL):
            out = make(m, ns)
            return (out[0], out[1][int(m[1]) % 8], *out[2:]) if isinstance(out[1], list) else out
    return None


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_log_records(spark, folder):
    current, expected = {}, {}
    for e, ns, data in duckdb.execute(f"SELECT entry_id, timestamp_ns, data FROM '{folder}/log_entries.parquet' ORDER BY 2, 1").fetchall():
        tag, text = data[1:].split(b"] ", 1)
        if found := parse(text.decode(), ns):
            expected[e], current[tag] = [*found], e
        elif tag in current:
            expected[current[tag]][3] += "\n" + text.decode()
    got = {r.entry_id: list(r)[1:] for r in entry.queries()["p1_found"](spark, folder).collect()}
    assert got == expected


#: Names that the producers of the given tables use for one field each; the operator sees only values.
FIELDS = """txn_id txnId txn_ref transaction_id message_id|terminal_id terminalId device term|agent_id agentId operator clerk|timestamp ts event_time occurredAt|type kind operation txn_type
amount amt totalAmount value|currency ccy currencyCode|method channel instrument pay_method|sender payer src_account from_no|receiver payee dst_account to_no|status state result outcome
receipt slip receiptId receipt_no|note memo remark|labels tags marks|loyalty rewards is_member|offline was_queued|latency_ms elapsed rtt|geo_cell grid cellId|battery_pct batt batteryLevel
app_version appVer build|meta context attributes|fee commission charge|reversal_of reverses|settled_at clearedAt"""
FIELD = {n: i for i, g in enumerate(FIELDS.replace("\n", "|").split("|")) for n in g.split()}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_schema_changes(spark, folder):
    kind = lambda v: "boolean" if isinstance(v, bool) else {str: "string", int: "integer", float: "number", list: "array", dict: "object"}[type(v)]
    schemas = {}
    for file, data in duckdb.execute(f"SELECT file_id, data FROM '{folder}/txn_entries.parquet'").fetchall():
        try:
            value = json.loads(data.split(b"] ", 1)[1])
        except ValueError:
            continue
        if isinstance(value, dict):
            schemas.setdefault(file, {}).update({k: kind(v) for k, v in value.items() if v is not None})
    expected, before = set(), {}
    for feed, _, file in duckdb.execute(f"SELECT feed, file_seq, file_id FROM '{folder}/feed_files.parquet' ORDER BY 1, 2").fetchall():
        now = schemas.get(file, {})
        if feed in before:
            was = before[feed]
            gone, come = [k for k in was if k not in now], [k for k in now if k not in was]
            expected |= {(file, "retyped", k, k) for k in was if k in now and was[k] != now[k]}
            for a in list(gone):
                for b in come:
                    if FIELD.get(a, a) == FIELD.get(b, b) and was[a] == now[b]:
                        expected.add((file, "renamed", a, b))
                        gone.remove(a)
                        come.remove(b)
                        break
            expected |= {(file, "removed", a, "") for a in gone} | {(file, "added", "", b) for b in come}
        before[feed] = now
    got = [tuple(r) for r in entry.queries()["p2_found"](spark, folder).collect()]
    assert set(got) == expected and len(got) == len(expected)
