"""A projection's bookkeeping in a shared folder: offsets, results and management state.

Offsets and results are Parquet, a folder for each micro-batch or, later, for many of them. A log says which folders
count: a small file that names them all, written aside and renamed. That rename is the only moment at which a
micro-batch's results and its offset become visible, both or neither; folders that the log doesn't name are left from a
crash and are written over. Each time FAN folders of a level are there they are merged into one of the next, of offsets
only each entity's newest record and, with a retention, only what it keeps; so a read opens some FAN folders a level,
however many micro-batches there were. Merged folders are deleted at the merge after, as a reader may still be in them.

One runner writes to a projection's folder at a time. clear() and set_offset() begin a new epoch with a checkpoint of its
own; results stay, and numbers of micro-batches go on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET_SCHEMA = "slice int, pid string, seq_nr long, ts timestamp, consumed timestamp"
#: Folders of a level that are merged, and bytes of a merged file.
FAN, FILE_BYTES = 32, 128 << 20


@dataclass(frozen=True)
class ProjectionId:
    """Projections are told apart by name and key as a pair."""

    name: str
    key: str

    def __str__(self) -> str:
        return f"{self.name}-{self.key}"


def expand(name: str, keys: list[str]) -> list[ProjectionId]:
    return [ProjectionId(name, k) for k in keys]


@dataclass(frozen=True)
class Log:
    """What counts: folders of offsets and results with their levels, the last micro-batch, and the epoch with its first one and its start."""

    offsets: tuple[tuple[int, str], ...] = ()
    results: tuple[tuple[int, str], ...] = ()
    old: tuple[str, ...] = ()
    last: int = -1
    epoch: int = 0
    base: int = 0
    start: Mapping[str, int] = field(default_factory=dict)


def to_merge(folders: tuple[tuple[int, str], ...], fan: int = FAN) -> tuple[int, tuple[str, ...]] | None:
    """The lowest level with `fan` folders, and these."""
    for level in sorted({n for n, _ in folders}):
        own = tuple(name for n, name in folders if n == level)
        if len(own) >= fan:
            return level, own
    return None


class ProjectionStore:
    """Offsets, results and management rows of one projection below `root`."""

    def __init__(self, spark: SparkSession, root: str, projection: ProjectionId, fan: int = FAN, retention_s: float | None = None) -> None:
        self.spark, self.projection, self.fan, self.retention_s = spark, projection, fan, retention_s
        self.base = f"{root}/{projection.name}/{projection.key}"
        self.written: dict[int, list[str]] = {}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        return self._fs().exists(self._path(*parts))

    # The log.
    def _logs(self) -> list[str]:
        found = self._fs().globStatus(self._path("log", "*.json"))
        return sorted(f.getPath().getName() for f in found) if found else []

    def log(self) -> Log:
        """The newest state; the empty one before the first commit."""
        names = self._logs()
        if not names:
            return Log()
        stream = self._fs().open(self._path("log", names[-1]))
        try:
            raw = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        pairs = lambda k: tuple((n, f) for n, f in raw[k])
        return Log(pairs("offsets"), pairs("results"), tuple(raw["old"]), raw["last"], raw["epoch"], raw["base"], raw["start"])

    def _publish(self, log: Log) -> None:
        """Make a state the newest, by one rename; older ones but the last go."""
        names = self._logs()
        number = int(names[-1].partition(".")[0]) + 1 if names else 0
        aside, final = self._path("log", f"_{number:010d}"), self._path("log", f"{number:010d}.json")
        stream = self._fs().create(aside, True)
        stream.write(bytearray(json.dumps({"offsets": log.offsets, "results": log.results, "old": log.old, "last": log.last, "epoch": log.epoch, "base": log.base, "start": dict(log.start)}).encode()))
        stream.close()
        if not self._fs().rename(aside, final):
            raise RuntimeError(f"another runner writes to {self.base}")
        for name in names[:-1]:
            self._fs().delete(self._path("log", name), False)

    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint-{self.log().epoch}"

    def replays(self) -> str:
        return f"{self.base}/replays-{self.log().epoch}"

    def committed(self, batch_id: int) -> bool:
        log = self.log()
        return log.base + batch_id <= log.last

    def commit(self, batch_id: int, records: DataFrame) -> None:
        """The offset of a batch, of each entity the last record, and with it the results written for the batch. An empty batch counts too."""
        log = self.log()
        number = log.base + batch_id
        last = records.groupBy("pid").agg(F.max_by(F.struct("slice", "seq_nr", "ts"), F.struct("ts", "seq_nr")).alias("m"))
        rows = last.select("m.slice", "pid", "m.seq_nr", "m.ts", F.current_timestamp().alias("consumed"), F.lit(number).cast("int").alias("batch_id"))
        name = f"offsets/{log.epoch}-{number}"
        rows.write.mode("overwrite").parquet(f"{self.base}/{name}")
        results = tuple((0, r) for r in self.written.pop(batch_id, ()))
        self._publish(replace(log, offsets=(*log.offsets, (0, name)), results=(*log.results, *results), last=max(log.last, number)))
        self._compact()

    def write_result(self, batch_id: int, result: DataFrame, part: int = 0) -> None:
        """Results of a batch, or of a part of it; they count from its commit on, or from publish_results()."""
        log = self.log()
        name = f"results/{log.epoch}-{log.base + batch_id}-{part}"
        result.withColumn("batch_id", F.lit(log.base + batch_id).cast("int")).write.mode("overwrite").parquet(f"{self.base}/{name}")
        held = self.written.setdefault(batch_id, [])
        if name not in held:
            held.append(name)

    def publish_results(self, batch_id: int) -> None:
        """Let results count whose batch is committed already."""
        if names := self.written.pop(batch_id, None):
            log = self.log()
            self._publish(replace(log, results=(*log.results, *((0, n) for n in names))))
            self._compact()

    def forget_results(self, batch_id: int) -> None:
        """What was written for a batch doesn't count."""
        self.written.pop(batch_id, None)

    def _compact(self) -> None:
        """Merge levels that are full."""
        while found := [(kind, *m) for kind in ("offsets", "results") if (m := to_merge(getattr(self.log(), kind), self.fan))]:
            kind, level, names = found[0]
            log = self.log()
            name = f"{names[-1]}-{level + 1}"
            paths = [self._path(n) for n in names]
            rows = self.spark.read.parquet(*(f"{self.base}/{n}" for n in names))
            if kind == "offsets":
                rows = self._newest(rows)
            size = sum(self._fs().getContentSummary(p).getLength() for p in paths)
            rows.coalesce(max(1, size // FILE_BYTES)).write.mode("overwrite").parquet(f"{self.base}/{name}")
            held = [x for x in getattr(log, kind) if x[1] not in names]
            at = next((i for i, x in enumerate(held) if x[0] <= level), len(held))
            self._publish(replace(log, **{kind: (*held[:at], (level + 1, name), *held[at:])}, old=names))
            for n in log.old:
                self._fs().delete(self._path(n), True)

    def _newest(self, records: DataFrame) -> DataFrame:
        """Of each entity the newest record; with a retention, without those that are so much older than their slice's newest."""
        newest = records.groupBy("pid").agg(F.max_by(F.struct(*[c for c in records.columns if c != "pid"]), F.struct("ts", "seq_nr")).alias("m")).select("pid", "m.*").select(*records.columns)
        if self.retention_s is None:
            return newest
        limit = newest.groupBy("slice").agg((F.max(F.unix_micros("ts")) - round(self.retention_s * 1_000_000)).alias("__limit"))
        return newest.join(F.broadcast(limit), "slice").where(F.unix_micros("ts") >= F.col("__limit")).select(*records.columns)  # one row a slice

    def offsets(self) -> DataFrame:
        """All records that count and weren't merged away."""
        names = [n for _, n in self.log().offsets]
        if not names:
            return self.spark.createDataFrame([], f"{OFFSET_SCHEMA}, batch_id int")
        return self.spark.read.schema(f"{OFFSET_SCHEMA}, batch_id int").parquet(*(f"{self.base}/{n}" for n in names))

    def results(self) -> DataFrame | None:
        """Results that count, with the batch_id that gave them; None before the first."""
        names = [n for _, n in self.log().results]
        return self.spark.read.parquet(*(f"{self.base}/{n}" for n in names)) if names else None

    # Management.
    def _new_epoch(self, offsets: tuple[tuple[int, str], ...], start: Mapping[str, int]) -> None:
        log = self.log()
        self._publish(replace(log, offsets=offsets, epoch=log.epoch + 1, base=log.last + 1, start=start))
        for part in (f"checkpoint-{log.epoch}", f"replays-{log.epoch}"):
            self._fs().delete(self._path(part), True)
        for _, name in log.offsets:
            if name not in {n for _, n in offsets}:
                self._fs().delete(self._path(name), True)

    def clear(self) -> None:
        """Forget offsets and progress; the next run starts over. Results stay."""
        self._new_epoch((), {})

    def set_offset(self, offset: datetime | Mapping[int, datetime]) -> None:
        """Go on after a time, for all slices or each by its own: back or ahead. Newer records are deleted; results stay.

        Slices that aren't named keep what they have.
        """
        log, micros = self.log(), lambda t: round(t.timestamp() * 1_000_000)
        per_slice = offset if isinstance(offset, Mapping) else {}
        known = {r["slice"]: r["us"] for r in self.offsets().groupBy("slice").agg(F.max(F.unix_micros("ts")).alias("us")).collect()}  # one row a slice
        every = None if isinstance(offset, Mapping) else micros(offset)
        start = {str(s): us for s, us in known.items() if every is None} | {str(s): micros(t) for s, t in per_slice.items()}
        if every is not None:
            start = {"*": every}
        stops = {**{s: every for s in known if every is not None}, **{s: micros(t) for s, t in per_slice.items()}}
        limits = self.spark.createDataFrame([(s, us) for s, us in stops.items()], "slice int, __us long")
        kept = self.offsets().join(F.broadcast(limits), "slice", "left").where("__us IS NULL OR unix_micros(ts) < __us").drop("__us").select("slice", "pid", "seq_nr", "ts", "consumed", "batch_id")
        own = limits.select("slice", F.lit("").alias("pid"), F.lit(0).cast("long").alias("seq_nr"), F.timestamp_micros("__us").alias("ts"), F.current_timestamp().alias("consumed"), F.lit(log.last).cast("int").alias("batch_id"))
        name = f"offsets/{log.epoch + 1}-start"
        kept.unionByName(own).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/{name}")
        self._new_epoch(((0, name),), start)

    def after_start(self, events: DataFrame) -> DataFrame:
        """The events after the offset that set_offset() gave, if it did: of later times than their slice's."""
        start = self.log().start
        if not start:
            return events
        if "*" in start:
            return events.where(F.unix_micros("ts") > start["*"])
        limits = self.spark.createDataFrame([(int(s), us) for s, us in start.items()], "__slice int, __us long")  # one row a slice
        joined = events.join(F.broadcast(limits), F.col("slice") == F.col("__slice"), "left")
        return joined.where(F.col("__us").isNull() | (F.unix_micros("ts") > F.col("__us"))).drop("__slice", "__us")

    def set_paused(self, paused: bool) -> None:
        row = self.spark.createDataFrame([(self.projection.name, self.projection.key, paused, time.time_ns() // 1000)], "projection_name string, projection_key string, paused boolean, last_updated long")
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/management")

    def is_paused(self) -> bool:
        if not self._exists("management"):
            return False
        latest = self.spark.read.parquet(f"{self.base}/management").agg(F.max_by("paused", "last_updated")).first()[0]
        return bool(latest)
