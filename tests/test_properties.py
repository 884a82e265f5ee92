"""Properties over generated inputs."""

import csv
import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlog import timeparse
from ledgerlog.operators import rejects
from ledgerlog.operators.log_templates import parse_pairs, symbols
from ledgerlog.operators.schema_tree import Node, script
from ledgerlog.sources.lines import trim_bytes

FIELD = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12)


@given(st.lists(FIELD, min_size=1, max_size=6), st.sampled_from([",", ";", "\t", "|"]), st.sampled_from([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]))
def test_written_records_are_read_back(fields, delimiter, quoting):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quoting=quoting, lineterminator="").writerow(fields)
    assert rejects.split_record(out.getvalue().encode(), delimiter.encode()) == [f.encode() for f in fields]


@given(st.binary(max_size=40))
def test_any_bytes_are_judged(data):
    reason, values = rejects.exact_check(data, b",", [rejects.Field("a", "text", False), rejects.Field("b", "integer", False)])
    assert reason in (None, "quoting", "column_count", "value") and (reason is None or values is None)


@given(st.integers(0, 10**9), st.sampled_from(sorted(timeparse.UNITS)))
def test_durations(n, unit):
    assert timeparse.parse_duration(f"{n}{unit}") == n * timeparse.UNITS[unit]


@given(st.integers(0, 253_402_300_799), st.integers(0, 999_999_999))
def test_instants_round_trip(second, nano):
    import datetime as dt

    text = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)).isoformat()
    assert timeparse.parse_instant(f"{text}.{nano:09d}Z") == second * 10**9 + nano


@given(st.binary(max_size=30))
def test_trimming_removes_only_ends(data):
    kept = trim_bytes(data)
    assert data.startswith(kept) and not data[len(kept) :].strip(b"\r\n") and kept[-1:] not in (b"\n", b"\r")


@given(st.text(max_size=60))
def test_any_text_has_symbols(text):
    assert len(symbols(text)) <= 40
    parse_pairs(text)


NAMES = st.dictionaries(st.sampled_from("abcdef"), st.sampled_from(["string", "integer", "array"]), max_size=6)


@settings(suppress_health_check=[HealthCheck.too_slow])
@given(NAMES, NAMES)
def test_scripts_turn_one_schema_into_the_other(a, b):
    tree = lambda fields: Node("", "object", {}, {k: Node(k, v) for k, v in fields.items()})
    cost, edits = script(tree(a), tree(b))
    made = dict(a)
    for e in edits:
        if e.op in ("removed", "renamed"):
            made.pop(e.old[0])
        if e.op in ("added", "renamed", "retyped"):
            made[e.new[0]] = b[e.new[0]]
    assert made == b and (cost == 0) == (a == b)
