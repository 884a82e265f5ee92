"""Generated point-of-sale transactions as JSON lines, reproducible from a seed and made in the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Choices and their weights, and the range of amounts of each type (fixed values).
TYPES = (("payment", 60), ("withdrawal", 20), ("deposit", 15), ("transfer", 5))
METHODS = (("mobile_money", 70), ("cash", 20), ("card", 10))
STATUSES = (("completed", 95), ("failed", 3), ("pending", 2))
AMOUNTS = {"withdrawal": (100, 150_000), "deposit": (100, 500_000), "transfer": (50, 100_000), "payment": (50, 50_000)}


def _draw(seed: int, salt: str, size: int | Column) -> Column:
    """A whole number in [0, size) from the row's number."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(size) if isinstance(size, int) else size)


def _choice(options: Sequence[tuple[str, int]], draw: Column) -> Column:
    out, total = None, 0
    for name, weight in options[:-1]:
        total += weight
        out = F.when(draw < total, name) if out is None else out.when(draw < total, name)
    return out.otherwise(options[-1][0])


def transactions(spark: SparkSession, n: int, *, seed: int = 1, start_ns: int = 1_769_688_000_000_000_000, step_ns: int = 1_000_000, terminals: int = 50, agents: int = 20, currency: str = "KES", partitions: int | None = None) -> DataFrame:
    """(timestamp_ns, data) of n transactions, in order."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    number = F.lpad((F.col("id") + 1).cast("string"), 8, "0")
    micros = F.floor((F.lit(start_ns) + F.col("id") * step_ns) / 1000)
    at = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")
    millis = F.lpad(F.pmod(F.floor(micros / 1000), F.lit(1000)).cast("string"), 3, "0")
    stamp = F.concat(F.substring(at, 1, 10), F.lit("T"), F.substring(at, 12, 8), F.lit("."), millis, F.lit("Z"))
    kind = _choice(TYPES, _draw(seed, "type", 100))
    low, size = (F.element_at(F.create_map(*(x for k, (a, b) in AMOUNTS.items() for x in (F.lit(k), F.lit(v(a, b))))), kind) for v in (lambda a, b: a, lambda a, b: b - a + 1))
    phone = lambda who: F.concat(F.lit("2547"), (_draw(seed, who, 90_000_000) + 10_000_000).cast("string"))
    padded = lambda salt, most, width: F.lpad((_draw(seed, salt, most) + 1).cast("string"), width, "0")
    parts = [
        ("txn_id", F.concat(F.lit("TXN-"), number)), ("terminal_id", F.concat(F.lit("T-"), padded("terminal", terminals, 4))), ("agent_id", F.concat(F.lit("A-"), padded("agent", agents, 3))), ("timestamp", stamp), ("type", kind),
        ("amount", low + _draw(seed, "amount", size)), ("currency", F.lit(currency)), ("method", _choice(METHODS, _draw(seed, "method", 100))), ("sender", phone("sender")), ("receiver", phone("receiver")),
        ("status", _choice(STATUSES, _draw(seed, "status", 100))), ("receipt", F.concat(F.lit("R-"), F.replace(F.substring(at, 1, 10), F.lit("-"), F.lit("")), F.lit("-"), number)),
    ]
    fields = [v.alias(k) for k, v in parts]
    return ids.select((F.lit(start_ns) + F.col("id") * step_ns).alias("timestamp_ns"), F.encode(F.to_json(F.struct(*fields)), "UTF-8").alias("data"))
