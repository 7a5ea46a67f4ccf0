"""The filter control plane: filters by stream, stored as rows so that every micro-batch can read the current ones."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import Criterion, EventFilter, criterion, filter_events, from_rows, merge
from tidemark.operators.transform import Transformation, transform_payload

SCHEMA = "stream_id string, kind string, value string, seq_nr long, version long"


class FilterRegistry:
    """Subscribe, update, read and replay, by stream id. Each change appends a version of the whole filter; the newest counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def _write(self, stream_id: str, filt: EventFilter) -> None:
        version = time.time_ns()
        rows = [(stream_id, c.kind, v, n, version) for c in filt.criteria() for v, n in c.values] or [(stream_id, None, None, None, version)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def subscribe(self, stream_id: str, initial: Iterable[Criterion] = ()) -> None:
        """Set the filter from which later updates go on."""
        self._write(stream_id, merge([], initial))

    def current(self, stream_id: str) -> EventFilter:
        """A filter is a set of settings, so it is small."""
        own = self._rows().where(F.col("stream_id") == stream_id)
        newest = own.agg(F.max("version")).first()[0]
        if newest is None:
            return EventFilter()
        return EventFilter.of(*from_rows(own.where((F.col("version") == newest) & F.col("kind").isNotNull()).collect()))

    def update(self, stream_id: str, criteria: Iterable[Criterion]) -> dict[str, int]:
        """Merge criteria in; gives the ids that are to be read again, and from where."""
        before = self.current(stream_id)
        after = merge(before.criteria(), criteria)
        self._write(stream_id, after)
        return after.replays(before)

    def apply(self, stream_id: str, events: DataFrame) -> DataFrame:
        """events of a micro-batch through the filter of this moment."""
        return filter_events(events, self.current(stream_id))


def to_json(criteria: Iterable[Criterion]) -> str:
    return json.dumps([{"kind": c.kind, "values": dict(c.values)} for c in criteria], sort_keys=True, ensure_ascii=False)


def from_json(text: str) -> list[Criterion]:
    return [criterion(c["kind"], c["values"]) for c in json.loads(text)]


def match_acks(in_flight: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is still in flight after acknowledgements by (pid, seq_nr), and acknowledgements of nothing, which are errors."""
    keys = ["pid", "seq_nr"]
    return in_flight.join(acks.select(*keys).distinct(), keys, "left_anti"), acks.join(in_flight.select(*keys).distinct(), keys, "left_anti")


#: Gets a stream's id and a request's metadata, and raises to refuse the request.
Interceptor = Callable[[str, Mapping[str, str]], None]


def intercepted(streams: Mapping[str, DataFrame], stream_id: str, metadata: Mapping[str, str], interceptors: Iterable[Interceptor] = ()) -> DataFrame:
    """The stream asked for, once every interceptor has let the request through; nothing is read before."""
    for check in interceptors:
        check(stream_id, metadata)
    if stream_id not in streams:
        raise KeyError(f"no stream {stream_id}")
    return streams[stream_id]


@dataclass(frozen=True)
class PushDestination:
    """Where producers push to: it accepts some streams, and tells a producer at its start which events to send."""

    accepted: frozenset[str]
    criteria: tuple[Criterion, ...] = ()
    transformation: Transformation | None = None
    interceptors: tuple[Interceptor, ...] = ()

    def start(self, stream_id: str, metadata: Mapping[str, str] | None = None) -> str:
        """The answer to a producer: its filter as JSON. Raises if the stream isn't accepted."""
        for check in self.interceptors:
            check(stream_id, metadata or {})
        if stream_id not in self.accepted:
            raise PermissionError(f"stream {stream_id} isn't accepted")
        return to_json(self.criteria)

    def ingest(self, events: DataFrame) -> DataFrame:
        """What it keeps of what was sent: each event once, transformed."""
        once = events.dropDuplicates(["pid", "seq_nr"])
        return transform_payload(once, self.transformation) if self.transformation else once


def push(events: DataFrame, answer: str) -> DataFrame:
    """What a producer sends after a destination's answer; the rest isn't sent at all."""
    return filter_events(events, merge([], from_json(answer)))
