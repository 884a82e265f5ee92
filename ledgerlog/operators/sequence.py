"""Strictly increasing timestamps, and the points at which a memtable is flushed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage


def monotonic(df: DataFrame, clock: str, order: Sequence[str], out: str = "timestamp_ns", last: int | None = None) -> DataFrame:
    """``df`` with ``out``: max(clock, previous + 1) over the rows in ``order``; ``last`` is the timestamp before them.

    In closed form it is rank + the greatest (clock - rank) so far, so it needs no sequential pass: the order is cut
    into ranges, each task numbers its range and keeps the running maximum, and one row per range carries counts and
    maxima over.  ``order`` should be total, else ties are numbered as they come; a null clock counts as 0.
    """
    names = ["_part", "_rank", "_high"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    columns = df.columns
    at = columns.index(clock)

    def number(batches):
        part, rank, high = TaskContext.get().partitionId(), 0, np.iinfo(np.int64).min
        for batch in batches:
            n = batch.num_rows
            ranks = np.arange(rank + 1, rank + n + 1)
            clocks = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            highs = np.maximum.accumulate(np.maximum(clocks - ranks, high)) if n else clocks
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(ranks), pa.array(highs)], names=[*columns, *names])
            if n:
                rank, high = rank + n, highs[-1]

    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema)
    numbered = cut_lineage(numbered)  # the ranges are sampled and must stay as they are
    ends = numbered.groupBy("_part").agg(F.max("_rank").alias("n"), F.max("_high").alias("top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ends = ends.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ends.withColumn("over", F.max(F.col("top") - F.col("offset")).over(before)).select("_part", "offset", "over")
    first = F.lit(last) if last is not None else F.lit(None).cast("bigint")
    joined = numbered.join(ends, "_part")
    value = F.col("offset") + F.col("_rank") + F.greatest(F.col("_high") - F.col("offset"), F.col("over"), first)
    return joined.select(*df.columns, value.alias(out))


def _chain(total: np.ndarray, held: int, threshold: int) -> np.ndarray:
    """The places, in running sizes, of the entries that reach the threshold, when ``held`` bytes come before."""
    cuts, base = [], -held
    while (end := int(np.searchsorted(total, base + threshold))) < len(total):
        cuts.append(end)
        base = int(total[end])
    return np.array(cuts, np.int64)


def _exits(total: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a range does with any number of bytes held before it, as a step function.

    (steps, held after, flushes): with h bytes held before, the first step that is at least threshold - h applies; if
    there is none, nothing is flushed.  Only entries within the first threshold bytes can be the first to flush, and
    chains that meet go on as one; neighbouring steps that lead to the same end are one step, so few are left of a range
    that flushes often, however many entries a memtable holds.
    """
    last = min(len(total), int(np.searchsorted(total, threshold)) + 1)
    at, flushes = np.arange(last), np.ones(last, np.int64)
    going = np.arange(last)
    while len(going):
        distinct, which = np.unique(at[going], return_inverse=True)
        ahead = np.searchsorted(total, total[distinct] + threshold)[which]
        on = ahead < len(total)
        going, ahead = going[on], ahead[on]
        at[going] = ahead
        flushes[going] += 1
    left = total[-1] - total[at] if len(total) else at
    ends = np.r_[(left[1:] != left[:-1]) | (flushes[1:] != flushes[:-1]), np.ones(min(1, last), bool)]
    return total[:last][ends], left[ends], flushes[ends]


def flush_segments(log: DataFrame, threshold: int, stream: Sequence[str] = ()) -> DataFrame:
    """``log`` with segment BIGINT: the number, from 0, of the memtable that holds the entry.

    Sizes (8 + length of data) add up until they reach ``threshold``; the entry that reaches it belongs to the
    segment, and the sum starts anew.  Null data counts 0 bytes; equal timestamps keep no particular order.

    Without ``stream`` the log is one writer's.  The rule is sequential, but all that a range of the log needs to
    know of those before is how many bytes they left in the memtable.  So every range, in parallel, works out for
    whatever may be left what it would leave in turn; one pass over these small step functions (one row per range)
    fixes what each range really meets, and the ranges are numbered in parallel.  With ``stream`` every writer has its
    own memtable and is folded by one task, batch by batch.
    """
    columns = log.columns
    sized = log.withColumn("_size", F.coalesce(F.octet_length("data").cast("bigint"), F.lit(0)) + 8)
    schema = T.StructType([*log.schema.fields, T.StructField("segment", T.LongType())])
    if stream:
        return _fold_streams(sized, list(stream), threshold, columns, schema)
    ranged = sized.repartitionByRange("timestamp_ns").sortWithinPartitions("timestamp_ns")
    ranged = cut_lineage(ranged)  # the ranges are sampled and must stay as they are
    at_size = len(columns)

    def describe(batches):
        sizes = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if sizes := [s for s in sizes if len(s)]:
            total = np.cumsum(np.concatenate(sizes))
            steps, left, flushes = _exits(total, threshold)
            same = lambda x: np.full(len(steps), int(x))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same(TaskContext.get().partitionId()), same(total[-1]), steps, left, flushes)], names=names)

    def follow(batches):
        held, number, waiting = 0, 0, []

        def met() -> pa.RecordBatch:
            """What the range meets whose steps have all come; then what it leaves over."""
            nonlocal held, number
            part, size, steps, left, flushes = (np.concatenate(x) for x in zip(*waiting))
            row = [[int(part[0])], [held], [number]]
            if size[0] < threshold - held:
                held += int(size[0])
            else:
                k = int(np.searchsorted(steps, threshold - held))
                held, number = int(left[k]), number + int(flushes[k])
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row], names=["part", "held", "number"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part = columns[0]
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if waiting and waiting[0][0][0] != part[i]:
                    yield met()
                waiting.append([c[i:j] for c in columns])
        if waiting:
            yield met()

    names = ["part", "bytes", "step", "left", "flushes"]
    functions = ranged.select("_size").mapInArrow(describe, ", ".join(f"{n} bigint" for n in names))
    # one row per range: its place and two numbers
    met = {r.part: (r.held, r.number) for r in functions.repartition(1).sortWithinPartitions("part", "step").mapInArrow(follow, "part bigint, held bigint, number bigint").collect()}

    def number(batches):
        held, base, done = *met.get(TaskContext.get().partitionId(), (0, 0)), 0
        for batch in batches:
            sizes = batch.column(at_size).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes)
            cuts = _chain(total, held, threshold)
            segment = base + done + np.searchsorted(cuts, np.arange(len(sizes)), "left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_size], pa.array(segment.astype(np.int64))], names=[*columns, "segment"])
            if len(sizes):
                held = int(total[-1] - total[cuts[-1]]) if len(cuts) else held + int(total[-1])
                done += len(cuts)

    return ranged.mapInArrow(number, schema)


def _fold_streams(sized: DataFrame, keys: list[str], threshold: int, columns: list[str], schema: T.StructType) -> DataFrame:
    places = [columns.index(k) for k in keys]

    def fold(batches):
        held, number, current = 0, 0, None
        for batch in batches:
            sizes = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            n = len(sizes)
            identity = list(zip(*(batch.column(i).to_pylist() for i in places)))
            cuts = [0, *(i for i in range(1, n) if identity[i] != identity[i - 1]), n]
            out = np.zeros(n, np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if identity[a] != current:
                    held, number, current = 0, 0, identity[a]
                total = np.cumsum(sizes[a:b])
                ends = _chain(total, held, threshold)
                out[a:b] = number + np.searchsorted(ends, np.arange(b - a), "left")
                number += len(ends)
                held = int(total[-1] - total[ends[-1]]) if len(ends) else held + int(total[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out)], names=[*columns, "segment"])

    return sized.repartition(*keys).sortWithinPartitions(*keys, "timestamp_ns").mapInArrow(fold, schema)
