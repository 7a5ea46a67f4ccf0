"""What the engine itself measures of a running projection: rows, lag and backlog of each micro-batch, and its progress.

Rows and lags are observed metrics of the write that stores a micro-batch's offset: they cost no pass of their own, and a
micro-batch whose offset isn't stored, or that is skipped as seen before, isn't measured. Times and rates of
micro-batches come from the progress of the streaming query.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "projection string, batch long, n_rows long, n_filtered long, newest_us long, lag_sum_us long, lag_max_us long, offset_us long, backlog_us long"
PROGRESS_SCHEMA = "query string, batch long, n_rows long, took_ms long, rows_per_second double"


@dataclass(frozen=True)
class Measure:
    """One micro-batch: times in microseconds, null where there is no row, no clock or no source to measure by."""

    projection: str
    batch: int
    n_rows: int
    n_filtered: int
    newest_us: int | None
    lag_sum_us: int | None
    lag_max_us: int | None
    offset_us: int | None
    backlog_us: int | None


class Meter:
    """Measures micro-batches and keeps the newest `kept` of them.

    clock gives the time at which a row counts as consumed; source, if given, holds all events, against whose newest
    time the backlog is measured. One meter may serve several projections.
    """

    def __init__(self, clock: Callable[[], Column] = F.current_timestamp, source: Callable[[SparkSession], DataFrame] | None = None, kept: int = 10_000) -> None:
        self.clock, self.source, self.measures = clock, source, deque(maxlen=kept)
        self._newest: dict[str, int | None] = {}

    def observed(self, batch: DataFrame) -> tuple[DataFrame, Observation]:
        """batch, and what will be known of it once it has been read whole."""
        seen = Observation()
        us, lag = F.unix_micros("ts"), F.unix_micros(self.clock()) - F.unix_micros("ts")
        filtered = F.count_if(F.col("filtered")) if "filtered" in batch.columns else F.lit(0).cast("long")
        return batch.observe(seen, F.count(F.lit(1)).alias("n_rows"), filtered.alias("n_filtered"), F.max(us).alias("newest_us"), F.sum(lag).alias("lag_sum_us"), F.max(lag).alias("lag_max_us")), seen

    def begin(self, projection: str, offsets: Callable[[], DataFrame]) -> None:
        """Take up the newest offset stored before this meter's first micro-batch of a projection."""
        if projection not in self._newest:
            self._newest[projection] = offsets().agg(F.unix_micros(F.max("ts"))).first()[0]

    def forget(self, projection: str) -> None:
        """Its offset was set or cleared: take it up again."""
        self._newest.pop(projection, None)

    def committed(self, spark: SparkSession, projection: str, batch_id: int, seen: Observation) -> Measure:
        found = seen.get
        known = [t for t in (self._newest.get(projection), found["newest_us"]) if t is not None]
        offset = self._newest[projection] = max(known) if known else None
        latest = self.source(spark).agg(F.unix_micros(F.max("ts"))).first()[0] if self.source else None
        backlog = None if latest is None else latest - (offset or 0)
        measure = Measure(projection, batch_id, found["n_rows"], found["n_filtered"], found["newest_us"], found["lag_sum_us"], found["lag_max_us"], offset, backlog)
        self.measures.append(measure)
        return measure

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(m).values()) for m in list(self.measures)], SCHEMA)


class ProgressListener(StreamingQueryListener):
    """Starts, ends and failures of streaming queries, and of each micro-batch the rows read, the time taken and the rate.

    A micro-batch whose rows are read more than once counts them each time, as the engine does; Meter counts them once.
    """

    def __init__(self, kept: int = 10_000) -> None:
        self.progress, self.ended = deque(maxlen=kept), deque(maxlen=kept)
        self._names: dict[str, str] = {}
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        rate = p.processedRowsPerSecond
        self.progress.append((p.name or str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0), float(rate) if rate == rate else None))

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._changed:
            self.ended.append((self._names.pop(str(event.runId), str(event.id)), event.exception))
            self._changed.notify_all()

    def wait_for_end(self, query: str, timeout_s: float) -> bool:
        """Whether a query of this name has ended; its events come after it by a moment."""
        until = time.monotonic() + timeout_s
        with self._changed:
            while not any(name == query for name, _ in self.ended):
                if not self._changed.wait(max(until - time.monotonic(), 0)) and time.monotonic() >= until:
                    return False
        return True

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.progress), PROGRESS_SCHEMA)
