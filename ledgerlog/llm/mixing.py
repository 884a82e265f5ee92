"""Mixing of sources to target weights by Pareto order sampling.

Documents weigh differently, so their expected numbers of copies do: a source's rate times the weight, up to the cap on
repeats.  The rate is set so that the expected tokens are those the source is to have, also where many documents are at
the cap: tokens are summed by bucket of weight, and the bucket is looked for in which they are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .bpe import DEFAULT_VOCABULARY
from .tokenize import count_tokens

#: Equal slices of the order's range that are counted before the boundary slice is ranked.
SLICES = 1 << 16
#: A plan of so many sources at most goes to every task.
SOURCES = 10_000


def source_name(column: Column) -> Column:
    """Sources are the same apart from case and outer blanks; an empty one is none."""
    name = F.lower(F.trim(column))
    return F.when(name != "", name)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per source of ``targets``: tokens to take, and how often each document is taken on average.

    ``sizes`` has source, docs, tokens; ``targets`` has source, target_share, max_repeats.  Without
    ``total_tokens`` the corpus is the largest in which every source that has any tokens holds exactly its share
    (of the shares of the sources that are there) within its repeats.  With it, a source that can't reach its part
    gives what its repeats allow.  Rows of targets without a source, a positive share or repeats are ignored; of
    several for one source the shares add up and the smallest cap holds.
    """
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    both = wanted.join(sizes, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    whole = Window.partitionBy(F.lit("all"))  # one row per source of the targets
    there = F.col("tokens") > 0
    share = F.col("target_share") / F.sum(F.when(there, F.col("target_share"))).over(whole)
    both = both.withColumn("share_there", F.when(there, share).otherwise(F.lit(0.0)))
    room = F.when(there, F.col("max_repeats") * F.col("tokens") / F.col("share_there"))
    both = both.withColumn("corpus_tokens", F.lit(float(total_tokens)) if total_tokens is not None else F.min(room).over(whole))
    both = both.withColumn("take_tokens", F.least(F.col("corpus_tokens") * F.col("share_there"), F.col("max_repeats") * F.col("tokens").cast("double")))
    return both.withColumn("times", F.when(there, F.col("take_tokens") / F.col("tokens")).otherwise(F.lit(0.0)))


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the document's id alone: a second run, or another executor, draws the same."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def _small(rows: DataFrame) -> DataFrame:
    """For a join: goes to every task if its size, which is looked at, allows."""
    return F.broadcast(rows) if rows.count() <= SOURCES else rows


def _rates(counted: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, rate): expected copies are least(rate * weight, cap) and their tokens what the source is to take.

    With weights in buckets of 1/64 of a power of two, let the buckets from the heaviest down be at the cap: what the
    source takes beyond them, over the weighted tokens of the others, is the rate, as long as it does bring no further bucket to the
    cap and leaves none of these below it.  At most some thousands of rows a source, whatever the corpus is.
    """
    bucket = F.floor(F.log2("weight") * 64)
    sums = counted.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("tw"), F.max("weight").alias("top"))
    heavier = Window.partitionBy("source").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    sums = sums.withColumns({"capped": F.coalesce(F.sum("t").over(heavier), F.lit(0)), "rest": F.sum("tw").over(whole) - F.coalesce(F.sum("tw").over(heavier), F.lit(0.0))})
    both = sums.join(steps, "source")
    # with all heavier buckets at the cap, the rate that the others need; the first at which this bucket stays below it
    rate = (F.col("take_tokens") - F.col("max_repeats") * F.col("capped")) / F.col("rest")
    both = both.withColumn("rate", rate).withColumn("fits", F.col("rate") * F.col("top") <= F.col("max_repeats"))
    return both.groupBy("source").agg(F.coalesce(F.max_by("rate", F.when(F.col("fits"), F.col("bucket"))), F.max(F.col("max_repeats") / F.pow(F.lit(2.0), F.col("bucket") / 64))).alias("rate"))


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, weight: Column | str | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, source, tokens, copies): how often each document goes into the corpus; documents left out have no row.

    ``weight`` is a positive number per document (a column's name, or an expression on the documents; 1 if null): a document's
    expected number of copies is a rate of its source times that, at most ``max_repeats``.  Whole copies are
    certain; the fraction is the document's inclusion probability p.  Documents are ordered by u / (1 - u) over p / (1 - p), u being uniform by
    hash of the id, and taken from the front until the source has its tokens (Pareto order sampling, the sample
    size being fixed in tokens: it misses by less than one document).  No document exceeds ``max_repeats``.
    Documents without text, without tokens or of a source without target are not taken; of rows with one id each
    counts; a null id is an id like any other.

    The order is cut without sorting a source: tokens are summed by slice of the order's range, then only the
    slice at the boundary is ranked.
    """
    given = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    plain = documents.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.coalesce(given, F.lit(1.0)).alias("weight"))
    counted = count_tokens(plain, "text", vocabulary, ("doc", "source", "weight"))
    counted = counted.select("doc", source_name(F.col("source")).alias("source"), "tokens", "weight").where("source is not null and tokens > 0 and weight > 0 and weight < double('infinity')")
    counted = cut_lineage(counted)  # a few bytes a document, read several times
    sizes = counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    steps = plan(sizes, targets, total_tokens).where("times > 0").select("source", "max_repeats", "take_tokens")
    # The plan has a row per source of the targets, so it is a small side whatever the corpus is.
    steps = cut_lineage(steps)
    steps = _small(cut_lineage(steps.join(_rates(counted, steps), "source")))
    placed = counted.join(steps, "source")
    expected = F.least(F.col("rate") * F.col("weight"), F.col("max_repeats").cast("double"))
    expected = F.when(expected > F.col("max_repeats") - 1e-9, F.col("max_repeats").cast("double")).otherwise(expected)
    placed = placed.withColumns({"sure": F.floor(expected).cast("int"), "p": expected - F.floor(expected)})
    u = _uniform(F.col("doc"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # any rising function of the odds orders alike; this one lies in (0, 1)
    placed = placed.withColumn("place", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))
    placed = placed.withColumn("slice", F.least(F.floor(F.col("place") * SLICES), F.lit(SLICES - 1)).cast("int"))
    open_ = F.col("sure") < F.col("max_repeats")
    slices = placed.groupBy("source", "slice").agg(F.sum(F.when(open_, F.col("tokens")).otherwise(0)).alias("slice_tokens"), F.sum(F.col("tokens") * F.col("sure")).alias("sure_tokens"))
    run = Window.partitionBy("source").orderBy("slice")  # at most SLICES rows a source
    slices = slices.withColumns({"before": F.sum("slice_tokens").over(run) - F.col("slice_tokens"), "sure_all": F.sum("sure_tokens").over(Window.partitionBy("source"))})
    cuts = slices.join(steps.select("source", "take_tokens"), "source").withColumn("rest", F.col("take_tokens") - F.col("sure_all"))
    cuts = cuts.withColumn("crosses", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slice_tokens") >= F.col("rest")))
    # One row per source: the slice in which the tokens are reached, and what is still to take in it.
    cut = cuts.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("crosses"), F.col("slice"))), F.when(F.max("rest") > 0, F.lit(SLICES)).otherwise(F.lit(-1))).alias("cut"), F.max(F.when(F.col("crosses"), F.col("rest") - F.col("before"))).alias("left"))
    marked = placed.join(_small(cut_lineage(cut)), "source")
    front = marked.where("slice <> cut").withColumn("extra", (open_ & (F.col("slice") < F.col("cut"))).cast("int"))
    order = Window.partitionBy("source").orderBy("place", "doc", "tokens").rowsBetween(Window.unboundedPreceding, -1)  # one slice of a source
    edge = marked.where("slice = cut").withColumn("extra", (open_ & (F.coalesce(F.sum(F.when(open_, F.col("tokens")).otherwise(0)).over(order), F.lit(0)) + F.col("tokens") / 2 <= F.col("left"))).cast("int"))
    columns = [F.col("doc").alias(id_col), F.col("source").alias("source"), "tokens", (F.col("sure") + F.col("extra")).alias("copies")]
    return front.select(*columns).unionByName(edge.select(*columns)).where("copies > 0")


def corpus(documents: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, copy INT, source, tokens, text): a row for every copy that ``mixed`` takes, copies from 1 on.

    Each id is joined once and multiplied after the join, so repeats don't travel; null ids meet null ids.
    """
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    both = mixed.join(texts, F.col(id_col).eqNullSafe(F.col("_id")))
    return both.select(id_col, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "source", "tokens", "text")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, docs, copies, tokens, actual_share) of the mixed corpus, also of sources that got nothing."""
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share")).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(got, "source", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("docs", "copies", "tokens")})
    total = F.sum("tokens").over(Window.partitionBy(F.lit("all")))
    return both.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
