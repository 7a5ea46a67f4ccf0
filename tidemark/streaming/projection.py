"""Projections: a source, a handler and when its offset is stored.

    exactly_once   results are written, then the offset that makes them visible; a batch seen before is skipped
    at_least_once  the handler runs, then the offset is stored; after a failure in between it runs again
    at_most_once   the offset is stored, then the handler runs; after a failure in between it doesn't run again
    flow           a DataFrame transformation whose rows are written like results, filtered events included

With a journal the stream is validated strictly before the handler sees it: what is ahead of its predecessor waits, and
what is missing is read from the journal (streaming.replay). Without, the source's rows are taken as they are.

Under a strategy that skips, a micro-batch whose handler fails is halved until the envelopes or groups that fail are by
themselves; only these are skipped, and the results of the others are kept. That takes calls for each one that fails; a
handler of single envelopes (streaming.envelopes) is told apart in its tasks instead, in one pass.

Grouped forms give the handler consecutive groups of at most so many rows of each micro-batch. Parallel forms give it a
micro-batch's slices in parts beside one another, each under a number of its own; the offset is stored when all parts are done.
"""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.validation import ACCEPTED
from tidemark.streaming.envelopes import EachEnvelope, Skipped
from tidemark.streaming.metrics import Meter
from tidemark.streaming.recovery import Aborted, Recovery, Restart, fail, recover, supervise
from tidemark.streaming.replay import REQUEST, Replays, replaying_state, validate_replaying
from tidemark.streaming.store import ProjectionId, ProjectionStore
from tidemark.streaming.telemetry import Telemetry

Handler = Callable[[DataFrame, int], DataFrame | None] | EachEnvelope


class Delivery(Enum):
    EXACTLY_ONCE = "exactly_once"
    AT_LEAST_ONCE = "at_least_once"
    AT_MOST_ONCE = "at_most_once"


@dataclass(frozen=True)
class Projection:
    """Envelopes have pid, seq_nr, ts and slice, and may have `filtered`: such rows advance the offset only."""

    id: ProjectionId
    source: Callable[[SparkSession], DataFrame]
    handler: Handler
    delivery: Delivery = Delivery.AT_LEAST_ONCE
    flow: bool = False
    group_size: int | None = None
    parallel: int = 1
    recovery: Recovery = field(default_factory=fail)
    restart: Restart = field(default_factory=Restart)
    telemetry: Telemetry = field(default_factory=Telemetry)
    meter: Meter | None = None
    journal: Callable[[SparkSession], DataFrame] | None = None
    reset_after_s: float | None = None

    def __post_init__(self) -> None:
        if self.flow and self.delivery is not Delivery.AT_LEAST_ONCE:
            raise ValueError("a flow is delivered at least once")
        if self.delivery is Delivery.AT_MOST_ONCE and (self.group_size or self.recovery.retries):
            raise ValueError("at most once allows neither groups nor retries")
        if self.group_size is not None and self.group_size < 1:
            raise ValueError("a group has at least one row")
        if self.parallel < 1 or self.parallel > 1 and self.delivery is not Delivery.AT_LEAST_ONCE:
            raise ValueError("only at least once runs in parallel")
        if isinstance(self.handler, EachEnvelope) and (self.group_size or self.parallel > 1):
            raise ValueError("a handler of single envelopes has neither groups nor parts")

    def with_recovery(self, recovery: Recovery) -> Projection:
        return replace(self, recovery=recovery)

    def with_restart(self, restart: Restart) -> Projection:
        return replace(self, restart=restart)

    def process(self, store: ProjectionStore, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        if store.committed(batch_id):
            return
        self.telemetry.before(str(self.id), batch_id)
        visible = batch if self.flow or "filtered" not in batch.columns else batch.where(~F.col("filtered"))
        if self.delivery is Delivery.AT_MOST_ONCE:
            self._commit(store, batch, batch_id)
        self._handled(store, visible, batch_id)
        if self.delivery is Delivery.AT_MOST_ONCE:
            store.publish_results(batch_id)
        else:
            self._commit(store, batch, batch_id)
        self.telemetry.after(str(self.id), batch_id)

    def _commit(self, store: ProjectionStore, batch: DataFrame, batch_id: int) -> None:
        """Store the offset; a meter observes the rows that are read for it."""
        if self.meter is None:
            store.commit(batch_id, batch)
            return
        name = str(self.id)
        self.meter.begin(name, store.offsets)
        batch, seen = self.meter.observed(batch)
        store.commit(batch_id, batch)
        self.telemetry.measured(name, self.meter.committed(store.spark, name, batch_id, seen))

    def _handled(self, store: ProjectionStore, rows: DataFrame, batch_id: int) -> None:
        """The handler over a micro-batch under the recovery strategy; what it returns is computed and written here, so a failure shows here too."""
        store.forget_results(batch_id)
        told = lambda e, what: self.telemetry.error(str(self.id), e, what)

        def attempt(own: DataFrame, part: int) -> None:
            result = self._handle(own, batch_id)
            if result is not None:
                store.write_result(batch_id, result, part)

        if isinstance(self.handler, EachEnvelope):
            self._each(store, rows, batch_id, told)
            return
        if not self.recovery.skip:
            recover(lambda: attempt(rows, 0), self.recovery, told)
            return
        rows = self._grouped(rows)
        try:
            recover(lambda: attempt(rows, 0), replace(self.recovery, skip=False), lambda e, what: told(e, "split" if what == "fail" else what))
        except Aborted:
            raise
        except Exception:
            self._without_failing(rows, attempt, told)

    def _each(self, store: ProjectionStore, rows: DataFrame, batch_id: int, told: Callable[[BaseException, str], None]) -> None:
        """A handler of single envelopes: what its calls fail with is known only in the tasks; how many were skipped is told here."""
        result, seen = self.handler.results(rows, self.recovery)
        try:
            store.write_result(batch_id, result)
        except Exception as error:
            told(error, "fail")
            if f"{Aborted.__module__}.{Aborted.__name__}" in str(error):
                raise Aborted(str(error)) from error
            raise
        if found := seen.get["n"]:
            told(Skipped(f"{found} envelopes, one of them with {seen.get['failure']}"), "skip")

    def _without_failing(self, rows: DataFrame, attempt: Callable[[DataFrame, int], None], told: Callable[[BaseException, str], None]) -> None:
        """Halves of a micro-batch, and halves of those that fail, down to the envelopes or groups that fail by themselves: these are skipped.

        The halves are ranges of a hash of the envelope or group, so nothing of them is collected; results of good
        ones are kept. A failing one costs about twice as many calls as its micro-batch's size has binary digits.
        """
        unit = ("slice", "group_nr") if self.group_size else ("pid", "seq_nr")
        held = rows.withColumn("__unit", F.xxhash64(*unit)).persist()
        parts = itertools.count(1)

        def own(low: int, high: int) -> DataFrame:
            return held.where(F.col("__unit").between(low, high)).drop("__unit")

        try:
            low, high = held.agg(F.min("__unit"), F.max("__unit")).first()
            open_ranges = [(low, high)] if low is not None else []
            while open_ranges:
                low, high = open_ranges.pop()
                if low == high:
                    recover(lambda at=low: attempt(own(at, at), next(parts)), self.recovery, told)
                    continue
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = held.where(F.col("__unit").between(a, b)).agg(F.min("__unit"), F.max("__unit")).first()
                    if first is None:
                        continue
                    if first == last:
                        open_ranges.append((first, last))
                        continue
                    try:
                        attempt(own(first, last), next(parts))
                    except Aborted:
                        raise
                    except Exception as error:
                        told(error, "split")
                        open_ranges.append((first, last))
        finally:
            held.unpersist()

    def _grouped(self, rows: DataFrame) -> DataFrame:
        if not self.group_size or "group_nr" in rows.columns:
            return rows
        order = Window.partitionBy("slice").orderBy("ts", "pid", "seq_nr")
        return rows.withColumn("group_nr", F.floor((F.row_number().over(order) - 1) / self.group_size).cast("long"))

    def _handle(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        rows = self._grouped(rows)
        if self.parallel == 1:
            return self.handler(rows, batch_id)
        parts = [rows.where(F.col("slice") % self.parallel == n) for n in range(self.parallel)]
        with ThreadPoolExecutor(self.parallel) as pool:
            made = list(pool.map(lambda n: self.handler(parts[n], batch_id * self.parallel + n), range(self.parallel)))
        made = [m for m in made if m is not None]
        return reduce(DataFrame.unionByName, made) if made else None


def run_once(spark: SparkSession, root: str, projection: Projection, envelopes: DataFrame) -> ProjectionStore:
    """A projection over a table instead of its source, as one batch and without restarts: for tests of handlers. Gives its store."""
    store = ProjectionStore(spark, root, projection.id)
    projection.process(store, envelopes, 0)
    return store


class Runner:
    """Runs a projection as a streaming query and manages it."""

    def __init__(self, spark: SparkSession, root: str, projection: Projection) -> None:
        self.spark, self.projection = spark, projection
        self.store = ProjectionStore(spark, root, projection.id)
        self.query: StreamingQuery | None = None
        self.replays: Replays | None = None
        self._busy, self._stopping = threading.Lock(), False

    def start(self, interval: str | None = None, projection: Projection | None = None) -> StreamingQuery | None:
        """Start reading; without interval what is there now is read and the query ends. None while paused."""
        p, store = projection or self.projection, self.store
        if store.is_paused():
            return None
        p.telemetry.started(str(p.id))
        rows = store.after_start(p.source(self.spark))
        if p.journal is not None:
            self.replays = Replays(self.spark, store.replays(), p.journal, rows.drop("origin").schema)
            rows = validate_replaying(rows, self.replays, p.reset_after_s)
        writer = rows.writeStream.queryName(str(p.id)).option("checkpointLocation", store.checkpoint())
        writer = writer.foreachBatch(lambda batch, n: self._process(p, batch, n))
        self._stopping = False
        with replaying_state(self.spark) if p.journal is not None else nullcontext():
            self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        return self.query

    def _process(self, p: Projection, batch: DataFrame, batch_id: int) -> None:
        with self._busy:
            if self._stopping:
                raise InterruptedError("stopped")  # the batch stays unprocessed and comes first at the next start
            if p.journal is None:
                p.process(self.store, batch, batch_id)
                return
            batch = batch.persist()  # read for the answers and for the handler; state is worked on once
            try:
                self.replays.answer(batch.where(F.col("verdict") == REQUEST), batch_id)
                p.process(self.store, batch.where(F.col("verdict") == ACCEPTED).drop("verdict", "from_nr", "to_nr"), batch_id)
            finally:
                batch.unpersist()

    def run(self, sleep: Callable[[float], None] | None = None) -> None:
        """Read what there is, restarting by the projection's backoff, until it is done.

        A handler that is a class is made anew for each attempt; one with start() and stop() is told when an attempt begins and ends.
        """
        p = self.projection

        def once() -> None:
            handler = p.handler() if isinstance(p.handler, type) else p.handler
            getattr(handler, "start", lambda: None)()
            try:
                while True:
                    query = self.start(projection=replace(p, handler=handler))
                    if query is not None:
                        query.awaitTermination()
                    if query is None or p.journal is None or self.replays.answered == 0:
                        break  # an answer made while the query ran is read by the next one
            finally:
                getattr(handler, "stop", lambda: None)()

        keywords = {"sleep": sleep} if sleep else {}
        try:
            supervise(once, p.restart, lambda n, e: p.telemetry.restarted(str(p.id), n, e), **keywords)
        finally:
            p.telemetry.stopped(str(p.id))

    def stop(self) -> None:
        """Stop after the micro-batch in hand, if there is one."""
        if self.query is not None:
            query, self.query = self.query, None
            self._stopping = True
            with self._busy:
                query.stop()

    # Management.
    def offset(self) -> DataFrame:
        """The newest committed record of each slice."""
        best = self.store.offsets().groupBy("slice").agg(F.max(F.struct("ts", "pid", "seq_nr")).alias("m"))
        return best.select("slice", "m.*")

    def update_offset(self, offset: datetime | Mapping[int, datetime]) -> None:
        """Stop, and let the next run go on after a time, for all slices or each by its own: back or ahead."""
        self.stop()
        self.store.set_offset(offset)
        self._forget()

    def clear_offset(self) -> None:
        self.stop()
        self.store.clear()
        self._forget()

    def _forget(self) -> None:
        if self.projection.meter is not None:
            self.projection.meter.forget(str(self.projection.id))

    def pause(self) -> None:
        self.stop()
        self.store.set_paused(True)

    def resume(self) -> StreamingQuery | None:
        self.store.set_paused(False)
        return self.start()

    def is_paused(self) -> bool:
        return self.store.is_paused()


def rate_limited(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet as a stream; files_per_batch bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
