"""Compaction: one sorted run without repeated timestamps out of many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of less than this are all of the lowest tier.
TIER_BYTES = 16 << 20


def due(run_count: int, threshold: int = 4) -> bool:
    """Compaction runs once there are as many runs as the threshold; it then takes all of them."""
    return run_count >= threshold


def picked(runs: Sequence, threshold: int = 4) -> tuple:
    """The runs to merge next, in their order, or none.  A run has bytes, min_timestamp_ns and max_timestamp_ns.

    Runs of like size make a tier, each four times as large as the one below.  The lowest tier that has ``threshold``
    runs is due, and takes along whatever overlaps it in time, so that of equal timestamps the earlier run's entry is known.
    """
    tier = lambda r: max(0, (max(1, r.bytes // TIER_BYTES).bit_length() - 1) // 2)
    by: dict[int, list] = {}
    for r in runs:
        by.setdefault(tier(r), []).append(r)
    chosen = next((by[t] for t in sorted(by) if due(len(by[t]), threshold)), [])
    if not chosen:
        return ()
    taken = {id(r) for r in chosen}
    spans = [(r.min_timestamp_ns, r.max_timestamp_ns) for r in chosen]
    taken |= {id(r) for r in runs if any(r.min_timestamp_ns <= high and r.max_timestamp_ns >= low for low, high in spans)}
    return tuple(r for r in runs if id(r) in taken)


def first_wins(runs: DataFrame, rank: str = "run_id", keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, timestamp_ns, data, rank): of each timestamp the entry of the run that ranks lowest, then the smallest data.

    ``keys`` name the log where several are in one table.  An aggregate with partial results before the shuffle, not
    a window: copies never meet in one task's buffer.
    """
    kept = F.min(F.struct(F.col(rank), F.col("data"))).alias("kept")
    return runs.groupBy(*keys, "timestamp_ns").agg(kept).select(*keys, "timestamp_ns", F.col("kept.data").alias("data"), F.col(f"kept.{rank}").alias(rank))


def compact(runs: DataFrame, rank: str = "run_id", keys: Sequence[str] = ()) -> DataFrame:
    """The compacted run of each log, strictly increasing in timestamp."""
    return first_wins(runs, rank, keys).select(*keys, "timestamp_ns", "data").orderBy(*keys, "timestamp_ns")
