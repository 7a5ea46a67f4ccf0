"""Declarative event filters: criteria, their algebra, and their compilation to one predicate.

A filter is a list of Criteria. Exclusion decides first; an included envelope passes although it is excluded, and an
include without a matching exclude changes nothing. A criterion that removes takes values out of the one it names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions.scalars import TOPIC_PREFIX, entity_id, full_match, tags_match_topic

#: The seven kinds of criteria in the order in which filters list them; each has a remove_ form.
KINDS = ("exclude_tags", "include_tags", "include_topics", "exclude_regex", "include_regex", "exclude_ids", "include_ids")
EXCLUDE_ALL = ".*"
#: Sets of ids up to this size are compiled into the predicate; larger ones are joined.
INLINE_IDS = 1_000


@dataclass(frozen=True)
class Criterion:
    """kind is one of KINDS, or remove_ and one; values map to a sequence number, 0 but for include_ids."""

    kind: str
    values: tuple[tuple[str, int], ...]

    def __post_init__(self) -> None:
        if self.kind.removeprefix("remove_") not in KINDS:
            raise ValueError(f"unknown criterion {self.kind}")


def criterion(kind: str, values: Iterable[str] | dict[str, int]) -> Criterion:
    pairs = values.items() if isinstance(values, dict) else ((v, 0) for v in values)
    best: dict[str, int] = {}
    for v, n in pairs:
        best[v] = max(n, best.get(v, 0))
    return Criterion(kind, tuple(sorted(best.items())))


@dataclass
class EventFilter:
    """The state of a filter: for each kind the values, for include_ids with the sequence number to replay from."""

    values: dict[str, dict[str, int]] = field(default_factory=lambda: {k: {} for k in KINDS})

    @classmethod
    def of(cls, *criteria: Criterion) -> EventFilter:
        return merge([], criteria)

    def criteria(self) -> list[Criterion]:
        return [criterion(k, self.values[k]) for k in KINDS if self.values[k]]

    def apply_in_order(self, update: Iterable[Criterion]) -> EventFilter:
        """The replicated form: criteria take effect one after the other, so a later add outlives an earlier removal."""
        new = EventFilter({k: dict(v) for k, v in self.values.items()})
        for c in update:
            kind = c.kind.removeprefix("remove_")
            for v, n in c.values:
                if c.kind != kind:
                    new.values[kind].pop(v, None)
                else:
                    new.values[kind][v] = max(n, new.values[kind].get(v, 0))
        return new

    def replays(self, before: EventFilter) -> dict[str, int]:
        """Ids to read again and from where, when this filter follows `before`: newly included ids with a number of 1 or more."""
        old = before.values["include_ids"]
        return {v: n for v, n in self.values["include_ids"].items() if n >= 1 and n > old.get(v, 0)}


def merge(current: Iterable[Criterion], update: Iterable[Criterion]) -> EventFilter:
    """Union of both without all that either removes, whatever the order; ids keep their highest number."""
    both = [*current, *update]
    out = EventFilter()
    for kind in KINDS:
        gone = {v for c in both if c.kind == f"remove_{kind}" for v, _ in c.values}
        for c in both:
            if c.kind == kind:
                for v, n in c.values:
                    if v not in gone:
                        out.values[kind][v] = max(n, out.values[kind].get(v, 0))
    return out


def diff(a: Iterable[Criterion], b: Iterable[Criterion]) -> list[Criterion]:
    """Criteria that lead from filter a to filter b; an id counts as new if b's number is higher. Neither may remove."""
    a, b = list(a), list(b)
    if any(c.kind.startswith("remove_") for c in a + b):
        raise ValueError("merge removals first")
    x, y = merge([], a), merge([], b)
    out = []
    for kind in KINDS:
        new = {v: n for v, n in y.values[kind].items() if v not in x.values[kind] or n > x.values[kind][v]}
        gone = [v for v in x.values[kind] if v not in y.values[kind]]
        out += [criterion(kind, new)] if new else []
        out += [criterion(f"remove_{kind}", gone)] if gone else []
    return out


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _overlap(tags: Column, wanted: Iterable[str]) -> Column:
    wanted = list(wanted)
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)


def passes(filt: EventFilter, tags: Column | str = "tags", pid: Column | str = "pid", topic_prefix: str = TOPIC_PREFIX) -> Column:
    """The filter as one Column. Patterns match whole entity ids; ids may be given with or without entity type."""
    tags, pid = (F.col(c) if isinstance(c, str) else c for c in (tags, pid))
    own, v = entity_id(pid), filt.values
    named = lambda ids: (pid.isin(*ids) | own.isin(*ids)) if ids else F.lit(False)
    excluded = _overlap(tags, v["exclude_tags"]) | named(list(v["exclude_ids"])) | _any(full_match(own, r) for r in v["exclude_regex"])
    included = _overlap(tags, v["include_tags"]) | _any(tags_match_topic(tags, t, topic_prefix) for t in v["include_topics"]) | named(list(v["include_ids"])) | _any(full_match(own, r) for r in v["include_regex"])
    return ~excluded | included


def filter_events(events: DataFrame, filt: EventFilter, tags: str = "tags", pid: str = "pid") -> DataFrame:
    """events that pass. Large id sets are joined instead of listed; Spark picks the strategy by their size."""
    v = filt.values
    if max(len(v["exclude_ids"]), len(v["include_ids"])) <= INLINE_IDS:
        return events.where(passes(filt, tags, pid))
    spark = events.sparkSession
    small = EventFilter(v | {"exclude_ids": {}, "include_ids": {}})
    flagged = events.withColumn("__own", entity_id(F.col(pid)))
    # Ids come with or without entity type, so they are looked up by both; those without a separator can't be a whole id of a typed entity.
    for kind in ("exclude_ids", "include_ids"):
        for by, ids in (("__own", list(v[kind])), (pid, [i for i in v[kind] if "|" in i])):
            rows = spark.createDataFrame([(i, True) for i in ids], f"__id string, `__{kind}_{by}` boolean")
            flagged = flagged.join(rows, flagged[by] == rows["__id"], "left").drop("__id")
    has = lambda kind: F.col(f"__{kind}___own").isNotNull() | F.col(f"__{kind}_{pid}").isNotNull()
    excluded_else = ~passes(EventFilter(small.values | {"include_tags": {}, "include_topics": {}, "include_regex": {}}), tags, pid)
    included_else = passes(EventFilter(small.values | {"exclude_tags": {}, "exclude_regex": {EXCLUDE_ALL: 0}}), tags, pid)
    return flagged.where(~(excluded_else | has("exclude_ids")) | included_else | has("include_ids")).select(*events.columns)


CRITERIA_SCHEMA = StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("seq_nr", LongType())])


def criteria_frame(spark, criteria: Iterable[Criterion]) -> DataFrame:
    """Criteria as rows, the form in which filters are stored."""
    return spark.createDataFrame([(c.kind, v, n) for c in criteria for v, n in c.values], CRITERIA_SCHEMA)


def from_rows(rows: Iterable) -> list[Criterion]:
    by_kind: dict[str, dict[str, int]] = {}
    for r in rows:
        held = by_kind.setdefault(r["kind"], {})
        held[r["value"]] = max(r["seq_nr"] or 0, held.get(r["value"], 0))
    return [criterion(k, v) for k, v in by_kind.items()]


def merge_frames(current: DataFrame, update: DataFrame) -> DataFrame:
    """merge() over criteria rows, for filters too large for the driver: union, anti-join of removals, highest number."""
    both = current.unionByName(update)
    gone = both.where(F.col("kind").startswith("remove_")).select(F.substring("kind", len("remove_") + 1, 100).alias("kind"), "value").distinct()
    kept = both.where(~F.col("kind").startswith("remove_")).join(gone, ["kind", "value"], "left_anti")
    return kept.groupBy("kind", "value").agg(F.max("seq_nr").alias("seq_nr"))


def diff_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """diff() over criteria rows."""
    x = a.groupBy("kind", "value").agg(F.max("seq_nr").alias("a_nr"))
    y = b.groupBy("kind", "value").agg(F.max("seq_nr").alias("b_nr"))
    both = x.join(y, ["kind", "value"], "full")
    new = both.where("b_nr IS NOT NULL AND (a_nr IS NULL OR b_nr > a_nr)").select("kind", "value", F.col("b_nr").alias("seq_nr"))
    gone = both.where("b_nr IS NULL").select(F.concat(F.lit("remove_"), "kind").alias("kind"), "value", F.lit(0).cast("long").alias("seq_nr"))
    return new.unionByName(gone)


def latest_wins(changes: DataFrame) -> DataFrame:
    """The replicated filter store over rows (kind, value, seq_nr, updated_at): of adds and removals of a value the latest
    counts, of equally late ones the add; included ids keep the highest number among adds."""
    base = changes.withColumn("removed", F.col("kind").startswith("remove_")).withColumn("kind", F.regexp_replace("kind", "^remove_", ""))
    last = base.groupBy("kind", "value").agg(F.max_by("removed", F.struct("updated_at", ~F.col("removed"))).alias("removed"), F.max(F.when(~F.col("removed"), F.col("seq_nr"))).alias("seq_nr"))
    return last.where("NOT removed").select("kind", "value", "seq_nr")
