"""Schemas that drift: scripts of nested schemas, rename detection, and the unified table."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlog.operators import drift
from ledgerlog.operators.schema_tree import Edit, Node, _assign, script, value_distance, value_features, with_moves


def node(fields, values=None):
    profile = lambda xs: dict(__import__("collections").Counter(f for x in xs for f in value_features(x)))
    root = Node("", "object")
    for name, kind in fields.items():
        if isinstance(kind, dict):
            child = node(kind)
            child.name = name
        else:
            child = Node(name, kind)
        child.profile = profile((values or {}).get(name, []))
        root.children[name] = child
    return root


def edits(a, b):
    return sorted((e.op, ".".join(e.old), ".".join(e.new)) for e in with_moves(script(a, b)[1], a, b))


def test_assignment_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(4, 7)
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = _assign(cost)
        assert len(set(got)) == n and abs(sum(cost[i][got[i]] for i in range(n)) - best) < 1e-9


def test_scripts_of_nested_schemas():
    a = node({"id": "string", "meta": {"lane": "integer", "os": "string"}, "old": "boolean", "x": "integer"})
    b = node({"id": "integer", "meta": {"os": "string", "x": "integer"}, "new": "array"})
    assert edits(a, b) == [("added", "", "new"), ("moved", "x", "meta.x"), ("removed", "meta.lane", ""), ("removed", "old", ""), ("retyped", "id", "id")]
    assert edits(a, a) == [] and script(a, a)[0] == 0
    assert edits(Node("", "object"), node({"x": "string"})) == [("added", "", "x")]


def test_rename_needs_the_same_kind_of_values():
    a = node({"code": "string", "n": "integer"}, {"code": ["AB-12", "CD-34"] * 10, "n": list(range(50))})
    assert edits(a, node({"ref": "string", "n": "integer"}, {"ref": ["EF-56", "GH-78"] * 10})) == [("renamed", "code", "ref")]
    assert edits(a, node({"ref": "string", "n": "integer"}, {"ref": ["some words here"] * 10})) == [("added", "", "ref"), ("removed", "code", "")]
    assert edits(a, node({"ref": "integer", "n": "integer"}, {"ref": [1] * 10})) == [("added", "", "ref"), ("removed", "code", "")]


def test_of_two_candidates_the_nearer_is_taken():
    a = node({"txn_id": "string"}, {"txn_id": [f"TXN-{i:04d}" for i in range(30)]})
    b = node({"message_id": "string", "reverses": "string", "cell": "string"}, {"message_id": [f"TXN-{i:04d}" for i in range(30, 60)], "reverses": ["TXN-0001"] * 3, "cell": ["abc"] * 30})
    assert ("renamed", "txn_id", "message_id") in edits(a, b)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ([f"T-{i:04d}" for i in range(20)], [f"T-{i:04d}" for i in range(50, 80)], True),
        (["payment", "deposit"] * 10, ["deposit", "payment", "payment"] * 5, True),
        (["payment", "deposit"] * 10, [f"g{a}{b}{c}xyz"[:7] for a, b, c in itertools.product("abc", "def", "ghi")], False),
        (["QZS"] * 20, ["red", "green"] * 10, False),
        (list(range(1000, 1200)), list(range(900, 1300, 7)), True),
        (list(range(1000, 1200)), [i % 100 for i in range(50)], False),
        ([True, False], [False], True),
        (["QZS"] * 40 + ["VNT"] * 3, ["retry"] * 4 + ["kiosk"] * 3 + ["bulk"] * 3 + ["a|b", "b|c", "c|a"] * 3, False),
        (["promo|bulk", "bulk", "night|promo|bulk"] * 4, ["night", "bulk|night", "promo|night"] * 4, True),
        ([["a", "b"], ["c"]] * 5, [["b"], ["c", "a"]] * 5, True),
        ([{"lane": 1, "os": "x"}], [{"lane": 2, "os": "y"}], True),
        ([{"lane": 1, "os": "x"}], [{"units": 2, "scale": 0}], False),
    ],
)
def test_values_of_one_kind(a, b, same):
    kind = drift.json_kind(a[0])
    x, y = node({"f": kind}, {"f": a}).children["f"], node({"f": kind}, {"f": b}).children["f"]
    assert (value_distance(x, y) <= 0.5) is same and abs(value_distance(x, y) - value_distance(y, x)) < 1e-9


ENTRIES = "entry_id long, timestamp_ns long, data binary, file_id long, feed string, n long, path string, kind string"
FILES = "file_id long, feed string, file_seq int, path string, previous long, span long"


def rows(payloads):
    out = []
    for i, (file, p) in enumerate(payloads):
        out.append((i, i, p if p is None or isinstance(p, bytes) else b"[tcp:x] " + json.dumps(p).encode(), file, "clash", 1, "clash", "clash"))
    return out


@pytest.fixture(scope="module")
def feed(spark):
    ids = [{"txn_id": f"TXN-{i:04d}", "amount": 100 + i, "note": None, "meta": {"lane": i}} for i in range(20)]
    second = [{"message_id": f"TXN-{i:04d}", "amount": 130 + i, "meta": {"lane": i, "os": "x"}} for i in range(20, 40)]
    third = [{"message_id": f"TXN-{i:04d}", "amount": str(i), "meta": {"lane": i, "os": "x"}, "late": True} for i in range(40, 60)]
    payloads = [(1, p) for p in ids] + [(2, p) for p in second] + [(3, p) for p in third] + [(1, p) for p in ids[:5]]
    payloads += [(2, b"[t] PING"), (2, b"[t] []"), (2, b"[t] \xff{"), (2, None), (2, b"[t] "), (2, b'[t] {"broken'), (None, {"x": 1}), (4, {"alone": 1}), (4, {}), (2, {}), (2, {"gone": None}), (99, {"no": "file"})]
    entries = spark.createDataFrame(rows(payloads), ENTRIES).repartition(3)
    files = spark.createDataFrame([(3, "f", 9, None, 0, 0), (1, "f", 1, None, 0, 0), (2, "f", 3000, None, 0, 0), (1, "f", 1, None, 0, 0), (4, "g", 1, None, 0, 0), (None, "f", 4, None, 0, 0), (7, None, 4, None, 0, 0), (8, "f", None, None, 0, 0), (5, "g", 2, None, 0, 0)], FILES)
    return entries, files.withColumn("file_seq", F.when(F.col("file_id") == 3, 5000).otherwise(F.col("file_seq")))


@pytest.mark.parametrize("most", [0, 100_000])
def test_changes(feed, monkeypatch, most):
    monkeypatch.setattr(drift, "_BROADCAST_FILES", most)
    got = sorted(tuple(r) for r in drift.top_level_changes(*feed).collect())
    assert got == [(2, "renamed", "txn_id", "message_id"), (3, "added", "", "late"), (3, "retyped", "amount", "amount"), (5, "removed", "alone", "")]
    deeper = {tuple(r)[:4] for r in drift.changes(*feed).where("depth > 1").collect()}
    assert deeper == {(2, "added", "", "meta.os")}


def test_preceding_crosses_spans_and_gaps(feed):
    assert {(r.file_id, r.previous) for r in drift.preceding(feed[1]).collect()} == {(1, None), (2, 1), (3, 2), (4, None), (5, 4)}


def test_unified_table(feed):
    table = drift.unified(*feed)  # an empty object is a row of nulls
    assert {"entry_id", "file_id", "f_amount", "f_message_id", "f_meta", "f_late"} <= set(table.columns) and "f_txn_id" not in table.columns
    got = table.where("file_id in (1, 2, 3)").collect()
    assert len(got) == 67 and sum(r.f_message_id is None for r in got) == 2 and all(r.f_message_id.startswith("TXN-") for r in got if r.f_message_id) and {r.f_late for r in got} == {None, "true"}
    assert table.where("file_id = 4").first().f_alone == "1"


def test_empty_tables(feed):
    entries, files = feed
    assert drift.changes(entries.where("false"), files).count() == 0 and drift.changes(entries, files.where("false")).count() == 0
    assert drift.unified(entries.where("false"), files).columns == ["entry_id", "file_id"]


def test_mixed_kinds_take_the_most_frequent(spark):
    entries = spark.createDataFrame(rows([(1, {"a": 1}), (1, {"a": "x"}), (1, {"a": "y"}), (1, {"b": 1.5}), (1, {"b": 2})]), ENTRIES)
    assert {r.path: r.kind for r in drift.file_fields(entries).collect()} == {"a": "string", "b": "integer"}


def test_canonical_names_keep_fields_that_stand_together_apart():
    uses = {"a": 5, "b": 9, "c": 1, "d": 1}
    got = drift.canonical_names([("a", "b", 3), ("b", "c", 1), ("c", "d", 1)], {("a", "c")}, uses)
    assert got == {"a": "b", "b": "b", "c": "c", "d": "c"}


def test_edits_are_values():
    assert Edit("added", (), ("x",)) == Edit("added", (), ("x",))


def test_moves_are_part_of_the_cost():
    a = node({"a": {"x": "string"}, "b": {"y": "integer"}})
    b = node({"a": {}, "b": {"y": "integer", "x": "string"}})
    for side in (a, b):
        side.children["a"].kind = side.children["b"].kind = "object"
    assert script(a, b) == (0.5, [Edit("moved", ("a", "x"), ("b", "x"))])


def test_what_lies_in_removed_fields_can_move():
    a, b = node({"meta": {"os": "string", "n": "integer"}}), node({"os": "string"})
    a.children["meta"].kind = "object"
    assert edits(a, b) == [("moved", "meta.os", "os"), ("removed", "meta", "")] and script(a, b)[0] == 2.5


def test_nested_renames_and_moves(spark):
    old = [{"id": i, "meta": {"os": f"V-{i:04d}", "deep": {"code": f"{i}/{i}/x"}}, "a": {"x": True}, "b": {"y": i}} for i in range(20)]
    new = [{"id": i, "meta": {"platform": f"V-{i:04d}", "deep": {"ref": f"{i}/{i}/x"}}, "a": {}, "b": {"y": i, "x": True}} for i in range(20, 40)]
    entries = spark.createDataFrame(rows([(1, p) for p in old] + [(2, p) for p in new]), ENTRIES)
    files = spark.createDataFrame([(1, "f", 1, None, 0, 0), (2, "f", 2, None, 0, 0)], FILES)
    assert sorted(tuple(r) for r in drift.changes(entries, files).collect()) == [(2, "moved", "a.x", "b.x", 2), (2, "renamed", "meta.deep.code", "meta.deep.ref", 3), (2, "renamed", "meta.os", "meta.platform", 2)]
    assert drift.top_level_changes(entries, files).count() == 0


def test_a_name_with_two_meanings_is_two_fields(spark):
    one = [(1, {"code": f"TXN-{i:04d}", "ok": True}) for i in range(20)] + [(2, {"ref": f"TXN-{i:04d}", "ok": True}) for i in range(20, 40)]
    two = [(3, {"code": f"TXN-{i:04d}", "ref": i}) for i in range(20)] + [(4, {"code": f"TXN-{i:04d}", "ref": i + 0.5}) for i in range(20, 40)]
    odd = [(None, {"code": "TXN-x"}), *((k, {"a-b": 1, "a.b": 2, "a_b": 3}) for k in (3, 4)), (3, {"wide": 1 << 70}), (4, {"wide": 1})]
    entries = spark.createDataFrame(rows(one + two + odd), ENTRIES)
    files = spark.createDataFrame([(1, "f", 1, None, 0, 0), (2, "f", 2, None, 0, 0), (3, "g", 1, None, 0, 0), (4, "g", 2, None, 0, 0)], FILES)
    for most in (0, 100_000):
        drift._BROADCAST_FILES, kept = most, drift._BROADCAST_FILES
        table = drift.unified(entries, files, typed=True)
        got = table.collect()
        drift._BROADCAST_FILES = kept
        kinds = dict(table.dtypes)
        assert len(got) == 85 and {kinds[c] for c in ("f_a_b", "f_a_b_2", "f_a_b_3")} == {"bigint"} and kinds["f_ok"] == "boolean" and kinds["f_wide"] == "string"
        ident = "f_code"
        assert {r[ident][:4] for r in got if r.file_id in (1, 2, 3, 4) and r[ident]} == {"TXN-"} and sum(r[ident] is not None for r in got) == 81
        (other,) = [c for c in table.columns if c.startswith("f_ref")]
        assert kinds[other] == "double" and sorted(r[other] for r in got if r[other] is not None)[:2] == [0.0, 1.0] and sum(r[other] is not None for r in got) == 40
        assert sorted(str(r.f_wide) for r in got if r.f_wide) == ["1", str(1 << 70)]
    assert {r.kind for r in drift.file_fields(entries).where("path = 'wide'").collect()} == {"integer"}
