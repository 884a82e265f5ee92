"""Schemas that drift between the files of a feed: every change reported, and all files read as one table."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .payload import split_tag
from .schema_tree import Node, script, value_features, with_moves

_SEP = "\x1f"
#: Consecutive files of a feed that one task orders.
_SPAN = 1024
#: Up to so many files (some 20 MB with their names) go to every task; beyond, entries meet their files in a shuffle.
_BROADCAST_FILES = 100_000


def parse_object(data: bytes | None) -> dict | None:
    """The payload's JSON object, or None: other JSON, broken JSON and bytes that are no UTF-8 are no message."""
    if data is None:
        return None
    payload = split_tag(data)[1]
    if not payload.lstrip()[:1] == b"{":
        return None
    try:
        value = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "integer", float: "number", list: "array", dict: "object"}[type(value)]


def _paths(value: dict, prefix: str = "") -> list[str]:
    """`kind path` of every non-null name, nested ones after their parent; a whole number beyond BIGINT is `large`."""
    out = []
    for name, x in value.items():
        if x is None:
            continue
        path = f"{prefix}{_SEP}{name}" if prefix else name
        out.append(f"{'large' if type(x) is int and not -(1 << 63) <= x < 1 << 63 else json_kind(x)} {path}")
        if isinstance(x, dict):
            out += _paths(x, path)
    return out


def file_fields(entries: DataFrame, every_kind: bool = False) -> DataFrame:
    """(file_id, path, kind, n): the schema of each file, with how many of its objects hold the field.

    A field of several kinds in one file has the most frequent, of equally frequent ones the first by name; with
    ``every_kind`` a row for each, and whole numbers beyond BIGINT are `large` ones.
    Objects are reduced to their set of paths and counted before the shuffle, so a hot file is as cheap as any.
    """

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse_object(data)
                if value is not None:
                    counts[(file, "\n".join(sorted(p.replace("\n", "\\n") for p in _paths(value))))] += 1
            files, sets = [k[0] for k in counts], [k[1] for k in counts]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(sets, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["file_id", "paths", "n"])

    sets = entries.where("file_id is not null").select(F.col("file_id").cast("bigint"), F.col("data").cast("binary")).mapInArrow(run, "file_id bigint, paths string, n bigint")
    sets = sets.groupBy("file_id", "paths").agg(F.sum("n").alias("n"))
    each = sets.select("file_id", "n", F.explode(F.split("paths", "\n")).alias("p")).where("p <> ''")  # an object can be empty
    kind = F.substring_index("p", " ", 1)
    kind = kind if every_kind else F.when(kind == "large", "integer").otherwise(kind)
    each = each.groupBy("file_id", kind.alias("kind"), F.expr("substring(p, locate(' ', p) + 1)").alias("path")).agg(F.sum("n").alias("n"))
    if every_kind:
        return each
    best = each.groupBy("file_id", "path").agg(F.max_by("kind", F.struct("n", F.expr("-ascii(kind)"))).alias("kind"), F.sum("n").alias("n"))
    return best


def file_schemas(entries: DataFrame) -> DataFrame:
    """(file_id, fields): fields is a map path → kind; files without any object are missing."""
    return file_fields(entries).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "kind"))).alias("fields"))


def preceding(files: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, previous): the file with the preceding file_seq of the feed.

    Files are ordered in spans of numbers, and spans by their last files, so a feed of any length is split.  Rows
    without feed, number or id are left out, repeated rows count once.
    """
    known = files.where("feed is not null and file_seq is not null and file_id is not null").groupBy("file_id").agg(F.min(F.struct("feed", "file_seq")).alias("at")).select("file_id", "at.*")
    span = known.withColumn("span", F.expr(f"file_seq div {_SPAN}"))
    inside = span.withColumn("previous", F.lag("file_id").over(Window.partitionBy("feed", "span").orderBy("file_seq", "file_id")))
    ends = span.groupBy("feed", "span").agg(F.max_by("file_id", F.struct("file_seq", "file_id")).alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.partitionBy("feed").orderBy("span"))).select("feed", "span", "before")
    return inside.join(before, ["feed", "span"]).select("feed", "file_seq", "file_id", F.coalesce("previous", "before").alias("previous"))


def _changed(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, previous, was, now) of the files whose schema is another than the preceding file's."""
    schemas = file_schemas(entries)
    order = preceding(files).where("previous is not null").select("file_id", "previous")
    empty = F.expr("map()").cast("map<string,string>")
    both = order.join(schemas.withColumnRenamed("fields", "now"), "file_id", "left").join(schemas.select(F.col("file_id").alias("previous"), F.col("fields").alias("was")), "previous", "left")
    both = both.withColumns({"was": F.coalesce("was", empty), "now": F.coalesce("now", empty)})
    as_set = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("\n"), e["value"])))
    return both.where(as_set("was") != as_set("now"))


def _value_at(value: object, path: list[str]) -> object:
    for name in path:
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


def _profiles(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, profile): profile is an array of (name, feature, n) of the ``wanted`` (file_id, names) fields.

    Names are full paths.
    """

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for file, names, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = parse_object(data)
                if value is None:
                    continue
                for name in names:
                    counts[(file, name, "of")] += 1
                    if (x := _value_at(value, name.split(_SEP))) is not None:
                        for feature in value_features(x):
                            counts[(file, name, feature)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.string()), pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["file_id", "name", "feature", "n"])

    wanted = cut_lineage(wanted)  # a row per file with a candidate; its size decides how it meets the entries
    side = F.broadcast(wanted) if wanted.count() <= _BROADCAST_FILES else wanted
    rows = entries.select(F.col("file_id").cast("bigint"), F.col("data").cast("binary")).join(side, "file_id").select("file_id", "names", "data")
    features = rows.mapInArrow(run, "file_id bigint, name string, feature string, n bigint").groupBy("file_id", "name", "feature").agg(F.sum("n").alias("n"))
    return features.groupBy("file_id").agg(F.collect_list(F.struct("name", "feature", "n")).alias("profile"))


def tree(fields: dict[str, str], profile: dict[str, dict[str, int]] | None = None) -> Node:
    """The schema tree of a map path → kind."""
    root = Node("", "object")
    for path in sorted(fields):
        *above, name = path.split(_SEP)
        node = root
        for step in above:
            node = node.children.setdefault(step, Node(step, "object"))
        known = node.children.get(name)
        node.children[name] = Node(name, fields[path], (profile or {}).get(path, {}), known.children if known else {})
    return root


def _scripts(changed: DataFrame, profiles: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                sides = []
                for fields, profile in ((row.was, row.old_profile), (row.now, row.new_profile)):
                    by: dict = defaultdict(dict)
                    for x in profile if profile is not None else []:
                        by[x["name"]][x["feature"]] = int(x["n"])
                    sides.append(tree(dict(fields), by))
                for e in with_moves(script(*sides)[1], *sides):
                    out.append((row.file_id, e.op, ".".join(e.old), ".".join(e.new), len(e.old or e.new)))
            yield pd.DataFrame(out, columns=["file_id", "change", "old_field", "new_field", "depth"])

    both = changed.join(profiles.withColumnRenamed("profile", "new_profile"), "file_id", "left").join(profiles.select(F.col("file_id").alias("previous"), F.col("profile").alias("old_profile")), "previous", "left")
    both = both.select("file_id", "was", "now", "old_profile", "new_profile")
    return both.mapInPandas(run, "file_id bigint, change string, old_field string, new_field string, depth int")


def changes(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, change, old_field, new_field, depth): the edit script from each file's schema to the next one's.

    ``entries`` has file_id and data (a JSON object each, or something else, which is passed over); ``files`` has
    file_id, feed and file_seq.  ``change`` is added, removed, renamed, retyped or moved, with '' for a missing
    side; depth 1 is a top-level field, names of deeper ones are joined by dots.  Null and repeated rows, empty
    files (an empty schema) and extra columns are allowed.  Values are profiled only in files where some field goes
    while another of its JSON kind comes, at any depth: elsewhere nothing can be a rename.
    """
    changed = cut_lineage(_changed(entries, files))  # one row per changed file; it is used three times
    # path, kind and parent; a nested field can be renamed below its own parent or one that is renamed or moved itself
    each = lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.regexp_replace(e["key"], f"{_SEP}?[^{_SEP}]*$", "").alias("above")))
    names = changed.withColumns({"a": each(F.col("was")), "b": each(F.col("now"))})
    missing = lambda x, y: F.filter(x, lambda e: ~F.exists(y, lambda o: o["key"] == e["key"]))
    names = names.withColumns({"gone": missing(F.col("a"), F.col("b")), "come": missing(F.col("b"), F.col("a"))})
    alike = lambda x, y: F.filter(x, lambda e: F.exists(y, lambda o: (o["value"] == e["value"]) & ((o["above"] == e["above"]) | ((o["above"] != "") & (e["above"] != "")))))
    keys = lambda c: F.transform(c, lambda e: e["key"])
    names = names.withColumns({"went": keys(alike(F.col("gone"), F.col("come"))), "came": keys(alike(F.col("come"), F.col("gone")))}).where("size(went) > 0")
    wanted = names.select("file_id", F.col("came").alias("names")).unionByName(names.select(F.col("previous").alias("file_id"), F.col("went").alias("names")))
    wanted = wanted.groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    return _scripts(changed, _profiles(entries, wanted))


def top_level_changes(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, change, old_field, new_field) of the top-level names; a field that moves in or out goes or comes."""
    every = changes(entries, files)
    moved = every.where("change = 'moved'")
    went = moved.where(~F.contains("old_field", F.lit("."))).select("file_id", F.lit("removed").alias("change"), "old_field", F.lit("").alias("new_field"))
    came = moved.where(~F.contains("new_field", F.lit("."))).select("file_id", F.lit("added").alias("change"), F.lit("").alias("old_field"), "new_field")
    return every.where("depth = 1 and change <> 'moved'").select("file_id", "change", "old_field", "new_field").unionByName(went).unionByName(came)


def canonical_names(renames: list[tuple[str, str, int]], together: set[tuple[str, str]], uses: dict[str, int]) -> dict[str, str]:
    """Classes of names that renames connect; each is called by its most used name.

    ``renames``: (old, new, how often); ``together``: pairs of names that stand in one file and so are two fields.
    """
    members = {n: {n} for n in uses}
    for old, new, _ in sorted(renames, key=lambda r: (-r[2], r[0], r[1])):
        a, b = members.setdefault(old, {old}), members.setdefault(new, {new})
        if a is b or any((x, y) in together or (y, x) in together for x in a for y in b):
            continue
        a |= b
        for x in b:
            members[x] = a
    best = {id(s): min(s, key=lambda n: (-uses.get(n, 0), n)) for s in members.values()}
    return {n: best[id(s)] for n, s in members.items()}


def field_classes(uses: dict[tuple[str, str], dict[str, int]], renames: dict[str, list[tuple[str, str, int]]], together: dict[str, set[tuple[str, str]]]) -> dict[tuple[str, str], tuple[str, str]]:
    """Of each (feed, name) the class, as the (feed, name) that it is used under most.

    ``uses``: how often the name holds a value of each kind.  Within a feed the names that its renames connect are one field.
    A name that two feeds use is one field too, unless that would put two names into one class that stand in one
    file of some feed: then it has two meanings, and stays two fields.
    """
    count = {node: sum(kinds.values()) for node, kinds in uses.items()}
    feeds = {feed for feed, _ in uses}
    apart = {(feed, frozenset(p)) for feed, pairs in together.items() for p in pairs}
    members: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for feed in sorted(feeds):
        own = {name: n for (f, name), n in count.items() if f == feed}
        for name, best in canonical_names(renames.get(feed, []), together.get(feed, set()), own).items():
            if (feed, name) in uses:
                members.setdefault((feed, best), set()).add((feed, name))
    whose = {node: group for group in members.values() for node in group}
    by_name: dict[str, list[tuple[str, str]]] = {}
    for node in sorted(count, key=lambda x: (-count[x], x)):
        by_name.setdefault(node[1], []).append(node)
    for nodes in by_name.values():
        for k, b in enumerate(nodes):
            for a in nodes[:k]:
                x, y = whose[a], whose[b]
                if x is y:
                    break
                if any(f == g and (f, frozenset((m, n))) in apart for f, m in x for g, n in y):
                    continue
                x |= y
                for node in y:
                    whose[node] = x
                break
    best = {id(group): min(group, key=lambda n: (-count[n], n)) for group in whose.values()}
    return {node: best[id(group)] for node, group in whose.items()}


def _column_type(kinds: set[str]) -> str:
    if kinds == {"boolean"}:
        return "boolean"
    if kinds == {"integer"}:
        return "bigint"
    return "double" if kinds and kinds <= {"integer", "number"} else "string"


_NOWHERE = -(1 << 63)


def unified(entries: DataFrame, files: DataFrame, typed: bool = False) -> DataFrame:
    """One table of all files: entry_id, file_id and one column per field, in order of name.

    Scripts are compiled into a projection for every feed: names connected by its renames become one column, called by
    its most used name, and so do names that feeds share, unless they mean two things (see ``field_classes``).  Columns
    are STRING; nested and retyped values are their JSON text, strings stand as they are; with ``typed`` a field
    that only ever held whole numbers is BIGINT, numbers DOUBLE, truth values BOOLEAN (one with a number beyond BIGINT stays
    STRING).  Null where an object lacks the field.  Every JSON object gives a row, also one without file.  Names become
    columns `f_…` with characters other than letters, digits and `_` replaced, numbered where two would be one, so they can't
    clash with the keys.  The names come to the driver (they are the schema).
    """
    placed = entries.select(F.col("entry_id").cast("bigint"), F.coalesce(F.col("file_id").cast("bigint"), F.lit(_NOWHERE)).alias("file_id"), F.col("data").cast("binary"))
    feeds = files.where("feed is not null and file_seq is not null and file_id is not null").groupBy("file_id").agg(F.min(F.struct("feed", "file_seq"))["feed"].alias("feed"))
    fields = file_fields(placed, every_kind=True).where(~F.contains("path", F.lit(_SEP)))
    fields = cut_lineage(fields.join(feeds, "file_id", "left").fillna("", ["feed"]))
    uses: dict[tuple[str, str], dict[str, int]] = {}
    for r in fields.groupBy("feed", "path", "kind").agg(F.sum("n").alias("n")).collect():
        uses.setdefault((r.feed, r.path), {})[r.kind] = r.n
    renames: dict[str, list] = {}
    renamed = top_level_changes(entries, files).where("change = 'renamed'").join(feeds, "file_id")
    for r in renamed.groupBy("feed", "old_field", "new_field").agg(F.count("*").alias("n")).collect():
        renames.setdefault(r.feed, []).append((r.old_field, r.new_field, r.n))
    named = sorted({x for some in renames.values() for r in some for x in r[:2]})
    together: dict[str, set] = {}
    if named:
        sets = fields.where(F.col("path").isin(named)).groupBy("feed", "file_id").agg(F.array_sort(F.collect_set("path")).alias("s"))
        for r in sets.select("feed", "s").distinct().collect():
            together.setdefault(r.feed, set()).update((x, y) for i, x in enumerate(r.s) for y in r.s[i + 1 :])
    classes = field_classes(uses, renames, together)
    column: dict[tuple[str, str], str] = {}
    for target in sorted(set(classes.values()), key=lambda x: (x[1], x[0])):
        plain = name = "f_" + "".join(c if c.isalnum() or c == "_" else "_" for c in target[1])
        number = 1
        while name.lower() in {c.lower() for c in column.values()}:
            number += 1
            name = f"{plain}_{number}"
        column[target] = name
    of = {node: column[target] for node, target in classes.items()}
    names = sorted(column.values())
    kinds: dict[str, set[str]] = {n: set() for n in names}
    for node, some in uses.items():
        kinds[of[node]] |= some.keys()
    types = {n: _column_type(kinds[n]) if typed else "string" for n in names}
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    by_name = {name: c for (_, name), c in of.items()}
    split = any(by_name[name] != c for (_, name), c in of.items())

    def shown(x: object, kind: str) -> object:
        if kind == "string":
            return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)
        return float(x) if kind == "double" else x

    def run(batches):
        for batch in batches:
            entry, file, out = [], [], []
            for e, f, data, feed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                value = parse_object(data)
                if value is not None:
                    entry.append(e)
                    file.append(None if f == _NOWHERE else f)
                    row = {}
                    for k, x in value.items():
                        if x is not None and (c := of[feed, k] if split else by_name[k]):
                            row[c] = shown(x, types[c])
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), pa.array(file, pa.int64()), *(pa.array([o.get(n) for o in out], arrow[types[n]]) for n in names)], names=["entry_id", "file_id", *names])

    if split:  # some name means two things: a row needs its feed
        side = F.broadcast(feeds) if feeds.count() <= _BROADCAST_FILES else feeds
        placed = placed.join(side, "file_id", "left").select("entry_id", "file_id", "data", F.coalesce("feed", F.lit("")).alias("feed"))
    else:
        placed = placed.withColumn("feed", F.lit(""))
    return placed.mapInArrow(run, "entry_id bigint, file_id bigint" + "".join(f", `{n}` {types[n]}" for n in names))
