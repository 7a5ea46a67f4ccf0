"""A consumer's filter that is exchanged while its stream runs.

Every update of the filter is a new version in a table: criteria as rows, so a filter may name any number of ids. A
micro-batch takes the newest version there is and notes which, so that it takes the same when it runs again. Ids that
a version includes anew, with a number of 1 or more, are read again from that number: all of them by one join, through
the cursors of streaming.cursors, beside the live events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import entity_id
from tidemark.operators import filters as L
from tidemark.streaming.cursors import PARALLELISM, ROWS_EACH, ReplayMerge

CRITERIA = "kind string, value string, seq_nr long"
_IDS = ("exclude_ids", "include_ids")


def marked(events: DataFrame, criteria: DataFrame, flag: str) -> DataFrame:
    """events with `flag`: whether they pass criteria (kind, value, seq_nr). Tags, topics and patterns are compiled, and are few; ids are joined, by whole id or without entity type."""
    few = criteria.where(~F.col("kind").isin(*_IDS)).limit(L.INLINE_IDS + 1).collect()
    if len(few) > L.INLINE_IDS:
        raise ValueError(f"more than {L.INLINE_IDS} tags, topics and patterns")
    rest = L.EventFilter.of(*L.from_rows(few)).values
    excluded = ~L.passes(L.EventFilter(rest | {k: {} for k in rest if k.startswith("include")}))
    included = L.passes(L.EventFilter(rest | {k: {} for k in rest if k.startswith("exclude")} | {"exclude_regex": {L.EXCLUDE_ALL: 0}}))
    named = criteria.where(F.col("kind").isin(*_IDS)).groupBy("value").agg(*(F.max(F.col("kind") == k).alias(f"__{k}") for k in _IDS))
    out = events.withColumn("__own", entity_id(F.col("pid")))
    for by in ("pid", "__own"):
        out = out.join(named.select(F.col("value").alias(f"__{by}_id"), *(F.col(f"__{k}").alias(f"__{by}_{k}") for k in _IDS)), F.col(by) == F.col(f"__{by}_id"), "left")
    has = lambda k: F.coalesce(F.col(f"__pid_{k}"), F.lit(False)) | F.coalesce(F.col(f"____own_{k}"), F.lit(False))
    return out.withColumn(flag, ~(excluded | has("exclude_ids")) | included | has("include_ids")).select(*events.columns, flag)


def replays_of(before: DataFrame, after: DataFrame, pids: DataFrame) -> DataFrame:
    """(pid, from_nr) of the ids that `after` includes anew, or from a higher number, with a number of 1 or more; ids without entity type stand for those of pids."""
    old = before.where("kind = 'include_ids'").groupBy("value").agg(F.max("seq_nr").alias("__old"))
    new = after.where("kind = 'include_ids'").groupBy("value").agg(F.max("seq_nr").alias("from_nr")).join(old, "value", "left")
    new = new.where((F.col("from_nr") >= 1) & (F.col("__old").isNull() | (F.col("from_nr") > F.col("__old")))).drop("__old")
    own = pids.select("pid").distinct().withColumn("__own", entity_id(F.col("pid")))
    whole = own.join(new, F.col("pid") == F.col("value")).select("pid", "from_nr")
    return whole.unionByName(own.join(new, F.col("__own") == F.col("value")).where("__own <> pid").select("pid", "from_nr")).groupBy("pid").agg(F.max("from_nr").alias("from_nr"))


class FilteredStream:
    """Filters and replays as a step of a stream's micro-batches; versions and cursors are stored below `folder`."""

    def __init__(self, spark: SparkSession, folder: str, journal: Callable[[SparkSession], DataFrame], parallelism: int = PARALLELISM, rows_each: int = ROWS_EACH) -> None:
        self.spark, self.folder, self.journal = spark, folder, journal
        self.flag = "__passes"
        self.merge = ReplayMerge(spark, f"{folder}/replays", journal, F.col(self.flag), parallelism, rows_each)

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{at}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> int:
        """The newest version; 0 is the filter that everything passes."""
        found = self._fs().globStatus(self._path("version-*/_SUCCESS")) or []
        return max((int(f.getPath().getParent().getName().partition("-")[2]) for f in found), default=0)

    def criteria(self, version: int) -> DataFrame:
        return self.spark.read.schema(CRITERIA).parquet(f"{self.folder}/version-{version}") if version else self.spark.createDataFrame([], CRITERIA)

    def update(self, criteria: DataFrame) -> int:
        """A new version: the newest with criteria, which may remove, merged into it."""
        now = self.newest()
        L.merge_frames(self.criteria(now), criteria.select("kind", "value", "seq_nr")).write.mode("overwrite").parquet(f"{self.folder}/version-{now + 1}")
        return now + 1

    def _applied(self, batch_id: int) -> int | None:
        found = self._fs().globStatus(self._path(f"applied-{batch_id}-*"))
        return int(found[0].getPath().getName().rpartition("-")[2]) if found else None

    def step(self, live: DataFrame, batch_id: int) -> DataFrame:
        """The live and replayed events of a micro-batch that pass, with `replayed`."""
        version, before = self._applied(batch_id), self._applied(batch_id - 1) or 0
        if version is None:
            version = self.newest()
            self._fs().create(self._path(f"applied-{batch_id}-{version}"), True).close()
        criteria = self.criteria(version)
        none = self.spark.createDataFrame([], "pid string, from_nr long, filter_after long, asked long")
        asks = none
        if version != before:
            asks = replays_of(self.criteria(before), criteria, self.journal(self.spark)).withColumn("filter_after", F.lit(0).cast("long")).withColumn("asked", F.lit(version).cast("long"))
        return self.merge.step(live, asks, batch_id, lambda rows: marked(rows, criteria, self.flag)).drop(self.flag)
