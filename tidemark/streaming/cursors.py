"""Replays that a consumer asks for, merged into its filtered live stream.

A request names an entity, the number to read from and `filter_after`: replayed events below that number pass whatever
the filter, those from it on are filtered like live ones, and 0 stands for no end. Requests become cursors. Of an entity the
newest request counts: one from another number replaces what is going on, one from the same number only changes its
filter_after. A stream (a range of slices) has at most `parallelism` cursors at work; the others wait in the order in
which they were asked for. Each micro-batch moves every working cursor on by at most `rows_each` numbers, by one join
of the cursors with the journal, so no replay, however long, holds the live events up; where a cursor stands is stored
with the micro-batch, and a micro-batch that runs again begins from the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import SLICES, slice_of
from tidemark.operators.validation import replay_or_filter

CURSOR_SCHEMA = "pid string, stream int, from_nr long, next_nr long, filter_after long, asked long, active boolean"
#: Cursors of a stream that work at once, numbers that each moves on in a micro-batch, and streams.
PARALLELISM, ROWS_EACH, STREAMS = 3, 1000, 32


def with_requests(cursors: DataFrame, requests: DataFrame, streams: int = STREAMS) -> DataFrame:
    """CURSOR_SCHEMA after requests (pid, from_nr, filter_after, asked); numbers below 1 ask for nothing."""
    valid = requests.where("from_nr >= 1")
    new = valid.groupBy("pid").agg(F.max_by(F.struct("from_nr", "filter_after", "asked"), "asked").alias("r"), F.min("from_nr").alias("__low"), F.max("from_nr").alias("__high"))
    both = cursors.join(new, "pid", "full")
    fresh, going = F.col("r").isNotNull(), F.col("from_nr").isNotNull()
    same = going & F.col("active") & (F.col("__low") == F.col("from_nr")) & (F.col("__high") == F.col("from_nr"))
    pick = lambda kept, own: F.when(fresh & ~F.coalesce(same, F.lit(False)), own).otherwise(kept)
    return both.select(
        "pid",
        F.coalesce("stream", F.floor(slice_of(F.col("pid")) * streams / SLICES).cast("int")).alias("stream"),
        pick(F.col("from_nr"), F.col("r.from_nr")).alias("from_nr"),
        pick(F.col("next_nr"), F.col("r.from_nr")).alias("next_nr"),
        F.coalesce("r.filter_after", "filter_after").alias("filter_after"),
        pick(F.col("asked"), F.col("r.asked")).alias("asked"),
        F.coalesce("active", F.lit(False)).alias("active"),
    )


def working(cursors: DataFrame, parallelism: int = PARALLELISM) -> DataFrame:
    """cursors with `active`: those at work stay so, and of the others the longest waiting fill each stream up."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("active"), "asked", "pid"))
    return cursors.withColumn("active", place <= parallelism)


def moved(cursors: DataFrame, journal: DataFrame, rows_each: int = ROWS_EACH) -> tuple[DataFrame, DataFrame]:
    """(the events that the working cursors reach, with filter_after; the cursors that go on): one join with the journal for each."""
    active = cursors.where("active")
    ahead = active.select("pid", "next_nr", "filter_after").join(journal, "pid").where(F.col("seq_nr") >= F.col("next_nr"))
    events = ahead.where(F.col("seq_nr") < F.col("next_nr") + rows_each).drop("next_nr")
    left = ahead.where(F.col("seq_nr") >= F.col("next_nr") + rows_each).groupBy("pid").agg(F.min("seq_nr").alias("__next"))
    on = active.join(left, "pid").withColumn("next_nr", F.col("__next")).drop("__next")
    return events, on.unionByName(cursors.where("NOT active"))


class ReplayMerge:
    """The merge as a step of a stream's micro-batches; cursors are stored below `folder`."""

    def __init__(self, spark: SparkSession, folder: str, journal: Callable[[SparkSession], DataFrame], passes: Column, parallelism: int = PARALLELISM, rows_each: int = ROWS_EACH) -> None:
        self.spark, self.folder, self.journal, self.passes = spark, folder, journal, passes
        self.parallelism, self.rows_each = parallelism, rows_each

    def _stored(self, batch_id: int) -> str:
        return f"{self.folder}/cursors-{batch_id}"

    def cursors(self, batch_id: int) -> DataFrame:
        """As they stand after a micro-batch; none before the first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._stored(batch_id))
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], CURSOR_SCHEMA)
        return self.spark.read.schema(CURSOR_SCHEMA).parquet(self._stored(batch_id))

    def step(self, live: DataFrame, requests: DataFrame, batch_id: int, mark: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The live and replayed events of a micro-batch that pass, with `replayed`; the journal has live's columns. mark may add columns that `passes` needs."""
        target = f"{self.folder}/started-{batch_id}"
        working(with_requests(self.cursors(batch_id - 1), requests), self.parallelism).write.mode("overwrite").parquet(target)
        now = self.spark.read.schema(CURSOR_SCHEMA).parquet(target)
        events, on = moved(now, self.journal(self.spark).select(*live.columns), self.rows_each)
        on.write.mode("overwrite").parquet(self._stored(batch_id))
        return replay_or_filter(mark(live), mark(events), self.passes)

    def finish(self, batch_id: int, mark: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """What all cursors have left, as the step after a live stream's last one, in the journal's columns with `replayed`.

        There is no live event then that a replay could hold up, and no request that could replace one, so all of them
        are read to their ends by one join, dealt by entity, however many there are. None goes on.
        """
        journal = self.journal(self.spark)
        left = self.cursors(batch_id - 1).select("pid", "next_nr", "filter_after").join(journal, "pid").where(F.col("seq_nr") >= F.col("next_nr")).drop("next_nr")
        self.spark.createDataFrame([], CURSOR_SCHEMA).write.mode("overwrite").parquet(self._stored(batch_id))
        return replay_or_filter(mark(journal.limit(0)), mark(left), self.passes)
