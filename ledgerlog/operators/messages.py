"""Messages that were delivered more than once: exactly one entry of each comes out.

Identifiers are counted first.  Those that occur once pass as they were counted and their entries are not looked at
again; only the entries of repeated ones are ranked, each group in as many parts as the root of its size, and then the
first of its parts, so that no task ever holds a whole group.  Both results make up the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .payload import payload_text

#: How an identifier begins.
IDENTIFIER_PREFIX = "TXN-"
#: Up to so many repeated identifiers, some 20 MB, are sent to every task.
BROADCAST_IDENTIFIERS = 200_000
#: A name is of an object's own identifier if less than this share of its objects have another such name besides.
ALONE = 0.5


def identifier_fields(entries: DataFrame, prefix: str = IDENTIFIER_PREFIX) -> list[str]:
    """The names under which objects hold their own identifier, most used first, found in the values.

    Producers call it differently, and other names hold references to another message's identifier.  Names that hold
    identifiers are taken by how often they do; one that mostly stands beside a name taken before, be that one empty, is
    a reference.  Counts of pairs of names come to the driver.
    """
    fields = F.from_json(payload_text(F.col("data")), "map<string,string>")
    held = F.map_keys(F.map_filter(fields, lambda _, v: v.startswith(prefix)))
    beside = F.map_keys(F.map_filter(fields, lambda _, v: v.isNull() | (v == "") | v.startswith(prefix)))
    each = entries.select(F.explode(held).alias("name"), beside.alias("beside")).select("name", F.explode(F.concat("beside", F.array(F.lit("")))).alias("other"))
    pairs = {(r.name, r.other): r.n for r in each.groupBy("name", "other").agg(F.count("*").alias("n")).collect()}
    total = {name: n for (name, other), n in pairs.items() if other == ""}
    own: list[str] = []
    for name in sorted(total, key=lambda x: (-total[x], x)):
        if sum(pairs.get((name, o), 0) for o in own) < ALONE * total[name]:
            own.append(name)
    return own


def message_id(data: Column, fields: Sequence[str], prefix: str = IDENTIFIER_PREFIX) -> Column:
    """The entry's own identifier, or null: payloads that are no JSON object, and empty or foreign values, have none."""
    if not fields:
        return F.lit(None).cast("string")
    if len({f.lower() for f in fields}) < len(fields):  # a struct can't tell them apart
        parsed = F.from_json(payload_text(data), "map<string,string>")
    else:
        parsed = F.from_json(payload_text(data), ", ".join(f"`{f.replace('`', '``')}` string" for f in fields), {"mode": "PERMISSIVE"})
    return F.coalesce(*(F.when(parsed[f].startswith(prefix), parsed[f]) for f in fields))


def _keys(entries: DataFrame, identifier: Column | None) -> DataFrame:
    of = message_id(F.col("data"), identifier_fields(entries)) if identifier is None else identifier
    return entries.select(of.alias("message_id"), F.struct(F.col("timestamp_ns").isNull().alias("late"), F.col("timestamp_ns").alias("ts"), F.col("entry_id").alias("entry")).alias("at"))


def _frequencies(keys: DataFrame) -> DataFrame:
    """Per identifier: how many entries, and one of them; counted on each side of the shuffle, so a hot one is cheap."""
    return keys.where("message_id is not null").groupBy("message_id").agg(F.count("*").alias("n"), F.min("at").alias("one"))


def _ranked(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """(message_id, n, at, place) of the entries of ``repeated`` identifiers; place is 1 for the first.

    Only the first of each part of a group is ranked among all of it; what follows another in its part has a place
    behind 1 anyway.
    """
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDENTIFIERS else repeated
    members = keys.where("message_id is not null").join(few, "message_id")
    members = members.withColumn("part", F.pmod(F.xxhash64("at"), F.ceil(F.sqrt("n"))))
    within = members.withColumn("place", F.rank().over(Window.partitionBy("message_id", "part").orderBy("at")))
    first = within.where("place = 1").withColumn("place", F.rank().over(Window.partitionBy("message_id").orderBy("at")))
    return within.where("place > 1").unionByName(first).drop("part")


def _repeated(keys: DataFrame) -> DataFrame:
    return cut_lineage(_frequencies(keys).where("n > 1").select("message_id", "n"))


def surplus(entries: DataFrame, identifier: Column | None = None) -> DataFrame:
    """(message_id, entry_id) of every entry that repeats a message an earlier entry brought.

    ``entries`` has entry_id, timestamp_ns and data; ``identifier`` is a string column expression, else the JSON
    payload's own identifier, under the names that ``identifier_fields`` finds.  The entry with the smallest
    (timestamp_ns, entry_id) stays; a null timestamp comes last.  Entries without identifier are never surplus.  Rows
    equal in identifier, timestamp and entry id are one entry.  If the repeated identifiers are few they go to every task and
    only their entries are moved; beyond BROADCAST_IDENTIFIERS the entries meet them in a shuffle, whose skewed
    partitions adaptive execution splits.
    """
    keys = _keys(entries, identifier)
    return _ranked(keys, _repeated(keys)).where("place > 1").select("message_id", F.col("at.entry").alias("entry_id"))


def kept(entries: DataFrame, identifier: Column | None = None) -> DataFrame:
    """(message_id, entry_id, n): the entry that stays for each message, and of how many it is one.

    Singletons pass as they are counted, of repeated groups the one that is ranked first, and entries without
    identifier all pass (message_id null, n 1).
    """
    keys = _keys(entries, identifier)
    single = _frequencies(keys).where("n = 1").select("message_id", F.col("one.entry").alias("entry_id"), "n")
    first = _ranked(keys, _repeated(keys)).where("place = 1").select("message_id", F.col("at.entry").alias("entry_id"), "n").distinct()
    without = keys.where("message_id is null").select("message_id", F.col("at.entry").alias("entry_id"), F.lit(1).cast("bigint").alias("n"))
    return single.unionByName(first).unionByName(without)


def deduplicate(entries: DataFrame, identifier: Column | None = None) -> DataFrame:
    """``entries``, whole rows, without the surplus ones."""
    return entries.join(surplus(entries, identifier).select("entry_id").distinct(), "entry_id", "left_anti").select(*entries.columns)


def deduplicate_new(stored_ids: DataFrame, new: DataFrame, identifier: Column | None = None) -> DataFrame:
    """(message_id, entry_id, n) of the messages in ``new`` whose identifiers are not in ``stored_ids``.message_id.

    The step of a stream: within the batch one entry of each comes out, against what is stored none that is there.
    """
    first = kept(new, identifier)
    known = stored_ids.select("message_id").where("message_id is not null").distinct()
    return first.join(known, "message_id", "left_anti").select("message_id", "entry_id", "n")
