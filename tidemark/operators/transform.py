"""Payload transformations, filtered events, origin and acknowledgement filters.

A transformation never drops rows: what it maps to nothing stays as a filtered event, so offsets still advance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import entity_type, slice_of


@dataclass
class Transformation:
    """Mappers by the value of a type column. A mapper gets the envelope's columns and gives a payload Column; null filters.

    An unknown type fails the query unless there is an or-else mapper (identity() has one that passes all).
    """

    mappers: dict[str, Callable[[], Column]] = field(default_factory=dict)
    or_else: Callable[[], Column] | None = None

    @classmethod
    def identity(cls) -> Transformation:
        return cls(or_else=lambda: F.col("payload"))

    def register(self, kind: str, mapper: Callable[[], Column]) -> Transformation:
        """A mapper of a type; of two for one type the later sees the earlier's payload."""
        earlier = self.mappers.get(kind)
        return Transformation(self.mappers | {kind: mapper if earlier is None else lambda: _after(earlier(), mapper())}, self.or_else)

    def register_or_else(self, mapper: Callable[[], Column]) -> Transformation:
        return Transformation(dict(self.mappers), mapper)

    def column(self, type_col: str = "event_type") -> Column:
        rest = self.or_else() if self.or_else else F.raise_error(F.concat(F.lit("no transformation for "), F.coalesce(F.col(type_col), F.lit("null"))))
        if not self.mappers:
            return rest
        out = None
        for kind, mapper in self.mappers.items():
            out = (F if out is None else out).when(F.col(type_col) == kind, mapper())
        return out.otherwise(rest)


def _after(first: Column, second: Column) -> Column:
    """second if first gave something."""
    return F.when(first.isNotNull(), second)


def transform_payload(events: DataFrame, t: Transformation, type_col: str = "event_type", payload: str = "payload") -> DataFrame:
    """events with the new payload and `filtered`, true where there is none; rows that were filtered before stay so."""
    done = events.withColumn("__new", t.column(type_col))
    was = F.col("filtered") if "filtered" in events.columns else F.lit(False)
    return done.withColumn("filtered", was | F.col("__new").isNull()).withColumn(payload, F.when(~F.col("filtered"), F.col("__new"))).drop("__new")


def for_handler(events: DataFrame, flow: bool = False) -> DataFrame:
    """What a handler sees: filtered events are skipped, but a flow gets them too."""
    return events if flow else events.where(~F.col("filtered"))


def map_tags(events: DataFrame, mapper: Callable[[Column], Column]) -> DataFrame:
    return events.withColumn("tags", mapper(F.col("tags")))


def map_ids(events: DataFrame, mapper: Callable[[Column], Column]) -> DataFrame:
    """New entity ids, with entity type and slice worked out afresh."""
    moved = events.withColumn("pid", mapper(F.col("pid")))
    return moved.withColumn("entity_type", entity_type(F.col("pid"))).withColumn("slice", slice_of(F.col("pid")))


def by_origin(events: DataFrame, choices: dict[str, Transformation], default: Transformation, origin: str = "origin", type_col: str = "event_type", payload: str = "payload") -> DataFrame:
    """A transformation for each producer."""
    column = default.column(type_col)
    for name, t in choices.items():
        column = F.when(F.col(origin) == name, t.column(type_col)).otherwise(column)
    return transform_payload(events, Transformation(or_else=lambda: column), type_col, payload)


def snapshots_as_events(snapshots: DataFrame, event: Column) -> DataFrame:
    return snapshots.withColumn("payload", event)


def transform_metadata(events: DataFrame, new: Column, metadata: str = "metadata") -> DataFrame:
    """New metadata where there is some, else the old."""
    return events.withColumn(metadata, F.coalesce(new, F.col(metadata)))


def excluded_origins(self_replica: str, consumer: str, others: Iterable[str], enabled: bool = True) -> set[str]:
    """Replicas whose events a consumer doesn't get: its own, and, if enabled, all that it reads itself; never the producer's own."""
    mine = {consumer} - {""}
    return (set(others) | mine) - {self_replica} if enabled else mine


@dataclass(frozen=True)
class ReplicationSettings:
    """A replica, those it reads, and whether events that others also send are left out."""

    self_replica: str
    others: tuple[str, ...]
    filter_origins: bool = True

    def excluded_by(self, producer: str) -> set[str]:
        """Origins that a producer leaves out for this replica."""
        return excluded_origins(producer, self.self_replica, [o for o in self.others if o != producer], self.filter_origins)


def mark_by_origin(events: DataFrame, excluded: set[str], origin: str = "origin_replica") -> DataFrame:
    """Events of excluded replicas become filtered events."""
    was = F.col("filtered") if "filtered" in events.columns else F.lit(False)
    hit = F.col(origin).isin(*excluded) if excluded else F.lit(False)
    return events.withColumn("filtered", was | F.coalesce(hit, F.lit(False)))


def mark_acknowledged(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events at or below the number acknowledged for their origin entity become filtered events. acks: (origin_pid, origin_seq_nr)."""
    top = acks.groupBy("origin_pid").agg(F.max("origin_seq_nr").alias("__acked"))
    was = F.col("filtered") if "filtered" in events.columns else F.lit(False)
    joined = events.join(top, "origin_pid", "left")
    return joined.withColumn("filtered", was | F.coalesce(F.col("origin_seq_nr") <= F.col("__acked"), F.lit(False))).drop("__acked")


def ack_cache(acks: DataFrame, by: str, limit: int = 1_000) -> DataFrame:
    """(by, origin_pid, origin_seq_nr): what a cache of acknowledgements (by, origin_pid, origin_seq_nr, at) holds of each stream: of at most so many entities the highest number, those longest without a higher one having been put out."""
    best = acks.groupBy(by, "origin_pid").agg(F.max("origin_seq_nr").alias("origin_seq_nr"), F.min_by("at", F.struct(-F.col("origin_seq_nr"), F.col("at"))).alias("at"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at"), "origin_pid"))
    return best.withColumn("__place", place).where(F.col("__place") <= limit).select(by, "origin_pid", "origin_seq_nr")


def with_replication_defaults(events: DataFrame, self_replica: str) -> DataFrame:
    """Missing replication metadata means: written here, with this number."""
    return events.withColumn("origin_replica", F.coalesce("origin_replica", F.lit(self_replica))).withColumn("origin_seq_nr", F.coalesce("origin_seq_nr", "seq_nr"))


def assigned_only(events: DataFrame, partitions: Iterable[int], partition: str = "partition") -> DataFrame:
    """Offset verification: rows of partitions that are still assigned."""
    return events.where(F.col(partition).isin(*partitions))


def publish(events: DataFrame, producer: Column, consumer: Column, t: Transformation) -> DataFrame:
    """What a producer sends: rows failing either filter are left out, the rest is transformed, nothing becomes a filtered event."""
    return transform_payload(events.where(producer & consumer), t)
