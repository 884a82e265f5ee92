"""Log lines of many programs into records: time, level, component and message, with the lines that continue them."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .log_templates import Keys, Parser, Template, arranged, cluster, head, key_features, key_kind, structured, symbols, time_at
from .payload import origin_tag, split_tag


#: Templates that one task merges, and up to which the driver does.
MERGED = 1024


def _text_of(data: bytes | None) -> tuple[bytes, str]:
    tag, payload = split_tag(data or b"")
    return tag, payload.decode("utf-8", "replace")


def mine(entries: DataFrame) -> tuple[list[Template], dict[str, Keys]]:
    """Templates and classified keys of all entries.

    Every batch clusters its own lines and hands on a few templates; those of one anchor (the symbols up to the time)
    are merged in groups of bounded size, round by round, until few are left, which come to the driver and are merged
    there.  Keys of structured
    lines are classified where they are counted, however rare; only the names of those that a record needs come.
    """

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            keys: Counter = Counter()
            for data in batch.column(0).to_pylist():
                text = _text_of(data)[1]
                if found := structured(text):
                    for k, f in key_features(*found):
                        keys[(found[0], k, f)] += 1
                else:
                    seen[tuple(symbols(text))] += 1
            lines = (Template(list(s), [set() for _ in s], n) for s, n in seen.items() if time_at(list(s)) is not None)
            merged = cluster(lines)
            rows = [("template", t.anchor, t.dumps(), t.count) for t in merged] + [(form, k, f, n) for (form, k, f), n in keys.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], names=["form", "key", "value", "n"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        merged = cluster(Template.loads(r.value, int(r.n)) for r in frame.itertuples())
        return pd.DataFrame([(t.anchor, t.dumps(), t.count) for t in merged], columns=["key", "value", "n"])

    def kinds(batches):
        for batch in batches:
            names, each = batch.select(["form", "key"]), [dict(c) for c in batch.column("counts").to_pylist()]
            kind = pa.array([key_kind(c) for c in each], pa.string())
            out = pa.RecordBatch.from_arrays([*names.columns, kind, pa.array([c.get("n", 0) for c in each], pa.int64())], names=["form", "key", "kind", "n"])
            yield out.filter(kind.is_valid())

    partial = entries.select(F.col("data").cast("binary")).mapInArrow(run, "form string, key string, value string, n bigint").groupBy("form", "key", "value").agg(F.sum("n").alias("n"))
    partial = cut_lineage(partial)  # a few rows a batch, read twice
    templates, before = partial.where("form = 'template'").select("key", "value", "n"), None
    while (left := templates.count()) > MERGED and left != before:
        part = F.pmod(F.xxhash64("value"), F.lit(2 * left // MERGED))
        templates = cut_lineage(templates.groupBy("key", part).applyInPandas(merge, "key string, value string, n bigint"))
        before = left
    templates = cluster(Template.loads(r.value, r.n) for r in templates.collect())
    counts = partial.where("form <> 'template' and key <> ''").groupBy("form", "key").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("counts"))  # six at most
    by: dict[str, list] = {}
    for r in counts.mapInArrow(kinds, "form string, key string, kind string, n bigint").collect():
        by.setdefault(r.form, []).append((r.key, r.kind, r.n))
    return templates, {form: arranged(k) for form, k in by.items()}


def _pieces(entries: DataFrame, parser: Parser) -> DataFrame:
    """Records as far as one partition holds them, partitions being ranges of (tag, timestamp_ns, entry_id).

    Raw entries are cut into ranges and each is parsed once, in order, by the task that holds it.
    """

    def run(batches):
        part, number, begun = TaskContext.get().partitionId(), 0, False
        current: list | None = None  # tag, entry_id, event_us, level, component, texts
        out: list = []

        def close(last: bool) -> None:
            nonlocal number, current
            if current is not None:
                out.append((part, number, number == 0, last, begun, *current[:5], "\n".join(current[5])))
                number += 1
            current = None

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "number", "first", "last", "head", "tag", "entry_id", "event_us", "level", "component", "message"])

        for batch in batches:
            for entry, at, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tag, text = _text_of(data)
                if h := parser.parse(text, at):
                    close(False)
                    begun = True
                    current = [tag, entry, h.event_us, h.level, h.component, [h.message]]
                elif current is not None and current[0] == tag:
                    current[5].append(text)
                else:
                    close(False)
                    begun = False
                    current = [tag, None, None, None, None, [text]]
            if out:
                yield flush()
        close(True)
        if out:
            yield flush()

    picked = entries.select(F.col("entry_id").cast("bigint"), F.col("timestamp_ns").cast("bigint"), F.col("data").cast("binary"))
    order = [origin_tag(F.col("data")).cast("binary"), F.col("timestamp_ns"), F.col("entry_id")]
    ordered = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "part bigint, number bigint, first boolean, last boolean, head boolean, tag binary, entry_id bigint, event_us bigint, level string, component string, message string")


def records(entries: DataFrame, parser: Parser | None = None) -> DataFrame:
    """(entry_id, event_us, level, component, message): one row per log record.

    ``entries`` has entry_id, timestamp_ns and data.  A record starts at an entry whose payload begins with a head of
    some template; entries of its tag after it, by (timestamp_ns, entry_id), null timestamps first, belong to it until
    the tag's next head, each as a further line.  Lines before a tag's first head belong to no record.  Repeated rows
    are records each.  Null data is an empty line; bytes that are no UTF-8 come out as U+FFFD; a missing level or
    component is ''; event_us is null only where a year can't be completed because timestamp_ns is null.

    Ranges of the order are cut evenly whatever share of the rows a tag has.  A record that crosses a cut is put
    together from its pieces; only the first and last piece of each range take part in that.
    """
    parser = parser or Parser(*mine(entries))
    pieces = cut_lineage(_pieces(entries, parser))  # the cuts are sampled: they must not be drawn again
    # two rows per range at most
    edges = pieces.where("first or last").select("part", "number", "tag", "head", "first")
    order = Window.partitionBy("tag").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("head"), F.struct("part", "number")), ignorenulls=True).over(order)
    owners = edges.withColumn("owner", owner).where("not head and first and owner is not null").select("part", "number", "owner")
    carried = pieces.where("not head and first").join(owners, ["part", "number"]).groupBy("owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "message"))), lambda p: p["message"]), "\n").alias("rest"))
    carried = carried.select(F.col("owner.part").alias("part"), F.col("owner.number").alias("number"), "rest")
    heads = pieces.where("head")
    whole = heads.where("last").join(carried, ["part", "number"], "left").withColumn("message", F.when(F.col("rest").isNull(), F.col("message")).otherwise(F.concat(F.col("message"), F.lit("\n"), F.col("rest"))))
    columns = ["entry_id", "event_us", "level", "component", "message"]
    return heads.where("not last").select(*columns).unionByName(whole.select(*columns))


def layouts(entries: DataFrame) -> DataFrame:
    """(layout, optional, lines): the mined heads, a few rows; of structured lines, the keys of each kind.

    ``layout`` has a head's slots and constants in order, ``optional`` what some of its lines have in between;
    ``lines`` counts the entries the template was mined from (null for structured lines, whose keys vary).
    """
    templates, keys = mine(entries)
    shown = {"SP": " ", "PRI": "<priority>", "WORD": "<word>", "NUM": "<number>", "LEVEL": "<level>"}
    name = lambda s: f"<time:{s[2:]}>" if s.startswith("T_") else shown.get(s, s)
    rows = [("".join(map(name, h.items)), " ".join(sorted({name(g) for gap in h.gaps for g in gap})), h.count) for h in map(head, templates)]
    rows += [(f"{form} " + " ".join(f"{kind}={'|'.join(names)}" for kind, names in k.__dict__.items() if names), "", None) for form, k in keys.items()]
    return entries.sparkSession.createDataFrame(rows, "layout string, optional string, lines bigint")
