"""Only new or changed entries: what each save of a log processes, and a job that does so run by run."""

from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Folder

#: Saves of a block, and blocks of a group of blocks: arrays that are looked through have this length at most.
BLOCK = 128


def visible_runs(sstables: DataFrame) -> DataFrame:
    """(log_id, run_id, added): the save that made each run visible; of repeated rows the first save counts."""
    known = sstables.where("log_id is not null and run_id is not null and manifest_seq is not null")
    return known.groupBy("log_id", "run_id").agg(F.min("manifest_seq").alias("added"))


def committed_saves(manifests: DataFrame) -> DataFrame:
    """(log_id, seq, checkpoint) of the saves that succeeded; repeated rows count once, with the highest checkpoint."""
    good = manifests.where("state = 'committed' and log_id is not null and manifest_seq is not null and checkpoint_timestamp_ns is not null")
    return good.groupBy("log_id", F.col("manifest_seq").alias("seq")).agg(F.max("checkpoint_timestamp_ns").alias("checkpoint"))


def arrived(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(log_id, timestamp_ns, digest, added, entry_id) of the entries of visible runs.

    The digest (MD5, 16 bytes) stands for the data before anything is moved, so payloads stay where they are.  A null
    data is a content of its own.
    """
    digest = F.unhex(F.coalesce(F.md5("data"), F.lit("")))
    seen = entries.where("log_id is not null and timestamp_ns is not null").select("log_id", "run_id", "entry_id", "timestamp_ns", digest.alias("digest"))
    return seen.join(runs.select("log_id", "run_id", "added"), ["log_id", "run_id"]).select("log_id", "timestamp_ns", "digest", "added", "entry_id")


def contents(rows: DataFrame) -> DataFrame:
    """(log_id, timestamp_ns, digest, added, copies): one row per content of what has arrived.

    ``copies`` has, for each save that added copies of it, the smallest entry id: at most one element per save of
    the log, however many copies there are, because they are counted down before they are gathered.
    """
    each = rows.groupBy("log_id", "timestamp_ns", "digest", "added").agg(F.min("entry_id").alias("entry_id"))
    return each.groupBy("log_id", "timestamp_ns", "digest").agg(F.min("added").alias("added"), F.collect_list(F.struct("added", "entry_id")).alias("copies"))


def _first(array: str, test) -> Column:
    return F.try_element_at(F.filter(array, test), F.lit(1))


def assign(found: DataFrame, saves: DataFrame) -> DataFrame:
    """``found`` (log_id, timestamp_ns, added, …) with seq: the first save from ``added`` on whose checkpoint reaches it, or null.

    Saves lie in blocks of consecutive numbers with the highest checkpoint of each, and these in groups again, so
    the search takes a few equi-joins with short arrays instead of a range join.  Checkpoints need not rise.
    """
    block = saves.groupBy("log_id", F.expr(f"seq div {BLOCK}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("seq", "checkpoint"))).alias("members"), F.max("checkpoint").alias("top"))
    group = block.groupBy("log_id", F.expr(f"b div {BLOCK}").alias("g")).agg(F.sort_array(F.collect_list(F.struct("b", "top"))).alias("blocks"), F.max("top").alias("top"))
    whole = group.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("g", "top"))).alias("groups"))
    reaches = lambda x, field: x[field] >= F.col("timestamp_ns")
    own = block.select("log_id", "b", "members")
    step = found.withColumn("b", F.expr(f"added div {BLOCK}")).join(own, ["log_id", "b"], "left")
    step = step.withColumn("seq", _first("members", lambda x: (x["seq"] >= F.col("added")) & reaches(x, "checkpoint"))["seq"]).drop("members")
    step = step.withColumn("g", F.expr(f"b div {BLOCK}")).join(group.select("log_id", "g", "blocks"), ["log_id", "g"], "left")
    step = step.withColumn("nb", F.when(F.col("seq").isNull(), _first("blocks", lambda x: (x["b"] > F.col("b")) & reaches(x, "top"))["b"])).drop("blocks")
    step = step.join(whole, "log_id", "left")
    step = step.withColumn("ng", F.when(F.col("seq").isNull() & F.col("nb").isNull(), _first("groups", lambda x: (x["g"] > F.col("g")) & reaches(x, "top"))["g"])).drop("groups")
    step = step.join(group.select("log_id", F.col("g").alias("ng"), "blocks"), ["log_id", "ng"], "left")
    step = step.withColumn("nb", F.coalesce("nb", _first("blocks", lambda x: reaches(x, "top"))["b"])).drop("blocks")
    step = step.join(own.withColumnRenamed("b", "nb"), ["log_id", "nb"], "left")
    return step.withColumn("seq", F.coalesce("seq", _first("members", lambda x: reaches(x, "checkpoint"))["seq"])).drop("members", "b", "g", "nb", "ng")


def _smallest_visible() -> Column:
    return F.array_min(F.transform(F.filter("copies", lambda x: x["added"] <= F.col("seq")), lambda x: x["entry_id"]))


def processed(entries: DataFrame, sstables: DataFrame, manifests: DataFrame) -> DataFrame:
    """(log_id, manifest_seq, entry_id): what each committed save processes, over all saves.

    Entries of a log with equal timestamp and data are one content; it is processed once, by the first committed
    save at which a run with it is visible and whose checkpoint is not below its timestamp; its smallest entry id
    visible at that save stands for it.  Rows without log or timestamp, runs without a save and saves without a
    checkpoint take no part; a null data is a content of its own.  Data are compared by their MD5.
    """
    all_ = assign(contents(arrived(entries, visible_runs(sstables))).drop("digest"), committed_saves(manifests))
    return all_.where("seq is not null").select("log_id", F.col("seq").alias("manifest_seq"), _smallest_visible().alias("entry_id"))


_OUTPUT = "log_id bigint, manifest_seq bigint, entry_id bigint, timestamp_ns bigint, digest binary"
_BACKLOG = "log_id bigint, timestamp_ns bigint, added bigint, copies array<struct<added:bigint,entry_id:bigint>>, digest binary"
_WATERMARK = "log_id bigint, since bigint, mark bigint"
_PLACED = "log_id bigint, manifest_seq bigint, entry_id bigint, timestamp_ns bigint, added bigint, copies array<struct<added:bigint,entry_id:bigint>>, digest binary, done boolean"
_ARRIVED = "log_id bigint, timestamp_ns bigint, digest binary, added bigint, entry_id bigint"
#: Outputs of so many runs are brought together into one.
OUTPUTS = 8


class IncrementalJob:
    """Processes, run by run, what is new or changed since the last successful run.

    ``folder`` lies where all executors reach it.  A run fixes its upper limit (each log's last committed save) when
    it starts, takes the runs added after the watermark and the backlog that no checkpoint had reached, and writes the
    output, the new backlog and the new watermark under names of their own.  The commit is one small file,
    `commits/v<N>.json`, that names them all; only one writer can make it, whole.  A run that dies before it leaves
    nothing that a reader sees, and the next run does the same work again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Folder(spark, folder)
        self.files.make("commits", "data")

    def commits(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names("commits") if n.startswith("v") and n.endswith(".json"))

    def _latest(self) -> dict:
        done = self.commits()
        return json.loads(self.files.read_text(f"commits/v{done[-1]:020d}.json")) if done else {"number": 0, "outputs": [], "backlog": [], "watermark": []}

    def _read(self, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(self.files.uri, parts))

    def _write(self, rows: DataFrame, part: str, schema: str, *by: str) -> str:
        kinds = dict(f.split(" ", 1) for f in schema.split(", "))
        rows.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).write.partitionBy(*by).parquet(self.files.uri(part))
        return part

    def output(self) -> DataFrame:
        """(log_id, manifest_seq, entry_id) of all successful runs."""
        return self._read(_OUTPUT, self._latest()["outputs"]).select("log_id", "manifest_seq", "entry_id")

    def run(self, entries: DataFrame, sstables: DataFrame, manifests: DataFrame, before_commit=None) -> int:
        """One run over tables that hold at least what is new; the number of its commit."""
        return self.run_arrived(arrived(entries, visible_runs(sstables)), manifests, before_commit)

    def run_arrived(self, rows: DataFrame, manifests: DataFrame, before_commit=None) -> int:
        """One run; ``rows`` are those of ``arrived`` that have come since the last run, and may hold older ones.

        ``before_commit`` is called just before the commit (tests fail there).
        """
        latest = self._latest()
        saves = committed_saves(manifests)
        upper = saves.groupBy("log_id").agg(F.max("seq").alias("upper"))
        known = self._read(_WATERMARK, latest["watermark"]).select("log_id", F.col("mark").alias("old"))
        both = upper.join(known, "log_id", "full").select("log_id", F.coalesce("old", F.lit(0)).alias("since"), F.coalesce("upper", "old", F.lit(0)).alias("mark"))
        stage = f"data/{uuid.uuid4().hex}"
        try:
            watermark = [self._write(both.coalesce(1), f"{stage}/watermark", _WATERMARK)]
            limits = self._read(_WATERMARK, watermark)  # fixed from here on
            columns = [f.split(" ")[0] for f in _ARRIVED.split(", ")]
            taken = rows.join(limits, "log_id").where("added > since and added <= mark").select(*columns)
            if latest["backlog"]:
                taken = taken.unionByName(self._read(_BACKLOG, latest["backlog"]).select("log_id", "timestamp_ns", "digest", F.inline("copies")))
            found = contents(taken)
            if latest["outputs"]:
                span = taken.agg(F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high")).first()
                before = self._read(_OUTPUT, latest["outputs"]).select("log_id", "timestamp_ns", "digest")
                if span.low is not None:  # of the history only the stretch that these entries lie in is read
                    before = before.where(F.col("timestamp_ns").between(span.low, span.high))
                found = found.join(before, ["log_id", "timestamp_ns", "digest"], "left_anti")
            fresh = saves.join(limits, "log_id").where("seq > since and seq <= mark").select("log_id", "seq", "checkpoint")
            searched = found.join(limits, "log_id").withColumns({"first": F.col("added"), "added": F.greatest("added", F.col("since") + 1)}).drop("since", "mark")
            placed = assign(searched, fresh).withColumns({"done": F.col("seq").isNotNull(), "manifest_seq": F.col("seq"), "entry_id": _smallest_visible(), "added": F.col("first")})
            placed = placed.withColumn("copies", F.when(~F.col("done"), F.col("copies")))
            self._write(placed.sortWithinPartitions("done", "timestamp_ns"), f"{stage}/rows", _PLACED, "done")
            outputs, backlog = ([p] if self.files.exists(p) else [] for p in (f"{stage}/rows/done=true", f"{stage}/rows/done=false"))
            outputs = [*latest["outputs"], *outputs]
            if len(outputs) >= OUTPUTS:  # sorted by time, so that a stretch of it can be read
                outputs = [self._write(self._read(_OUTPUT, outputs).repartitionByRange("timestamp_ns").sortWithinPartitions("timestamp_ns"), f"{stage}/outputs", _OUTPUT)]
            commit = {"number": latest["number"] + 1, "outputs": outputs, "backlog": backlog, "watermark": watermark}
            if before_commit:
                before_commit()
            if not self.files.publish(f"commits/v{commit['number']:020d}.json", json.dumps(commit)):
                raise RuntimeError(f"another run made commit {commit['number']} first")
        except BaseException:
            if not self._names(stage):
                self.files.delete(stage)
            raise
        return commit["number"]

    def _names(self, stage: str) -> bool:
        """Whether the last commit names what lies in a stage: then the run was committed, whatever came after."""
        latest = self._latest()
        return any(p.startswith(f"{stage}/") for k in ("outputs", "backlog", "watermark") for p in latest[k])

    def vacuum(self) -> list[str]:
        """Deletes what the last commit does not name; no other run may be under way."""
        latest = self._latest()
        used = {p.split("/")[1] for k in ("outputs", "backlog", "watermark") for p in latest[k]}
        doomed = [n for n in self.files.names("data") if n not in used]
        for name in doomed:
            self.files.delete(f"data/{name}")
        return doomed


def landed(job: IncrementalJob, entries: DataFrame, sstables: DataFrame, manifests: DataFrame, steps: int) -> list[tuple[DataFrame, DataFrame]]:
    """(arrived rows, manifests) of so many runs of the job over a recorded history, in order.

    The recorded saves of each log are cut into ``steps`` of consecutive numbers.  What each run of the job finds new
    lies in a folder of its own, as it would have come in, so a run opens no file of the runs before it.
    """
    saves = committed_saves(manifests)
    last = saves.groupBy("log_id").agg(F.max("seq").alias("_last"))
    within = lambda k: F.expr(f"_last * {k + 1} div {steps}")
    reached = saves.join(last, "log_id")
    uppers = reached.groupBy("log_id").agg(*(F.coalesce(F.max(F.when(F.col("seq") <= within(k), F.col("seq"))), F.lit(0)).alias(f"upper{k}") for k in range(steps)))
    rows = arrived(entries, visible_runs(sstables)).join(uppers, "log_id")
    step = F.coalesce(*(F.when(F.col("added") <= F.col(f"upper{k}"), F.lit(k)) for k in range(steps)))
    part = f"data/landed-{uuid.uuid4().hex}"
    columns = [f.split(" ")[0] for f in _ARRIVED.split(", ")]
    rows.withColumn("step", step).where("step is not null").select(*columns, "step").write.partitionBy("step").parquet(job.files.uri(part))
    out = []
    for k in range(steps):
        there = job.files.exists(f"{part}/step={k}")
        known = manifests.join(last, "log_id").where(F.col("manifest_seq") <= within(k)).drop("_last")
        out.append((job._read(_ARRIVED, [f"{part}/step={k}"] if there else []), known))
    return out


class Crash(RuntimeError):
    """A failure that is put in."""


def _crash() -> None:
    raise Crash("the process is lost")


def rerun(spark: SparkSession, folder: str, entries: DataFrame, sstables: DataFrame, manifests: DataFrame, steps: int = 3) -> IncrementalJob:
    """The job after so many runs over a recorded history, in which processes are lost.

    The first run's process is lost when all is written but not committed, and the run is made again; that of the
    second is lost as soon as it has committed.  Every run is by a new process, which knows only the folder.
    """
    job = IncrementalJob(spark, folder)
    for k, (rows, saves) in enumerate(landed(job, entries, sstables, manifests, steps)):
        if k == 0:
            with contextlib.suppress(Crash):
                IncrementalJob(spark, folder).run_arrived(rows, saves, before_commit=_crash)
        with contextlib.suppress(Crash):
            IncrementalJob(spark, folder).run_arrived(rows, saves)
            if k == 1:
                _crash()
    return IncrementalJob(spark, folder)
