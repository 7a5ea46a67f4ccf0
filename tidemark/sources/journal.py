"""Scans over event journals, snapshots and state tables.

A journal has at least pid, seq_nr, ts, slice, entity_type and tags. Predicates are plain comparisons, so they reach
the Parquet scan; a journal written with write_journal() is partitioned by a bucket of slices and read by pruning.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.scalars import SLICES, slice_of

#: Slices are filed in so many directories of equal ranges.
SLICE_BUCKETS = 32


def with_envelope(df: DataFrame, entity_type: str, id_col: str, order: list[str], ts_col: str = "ts") -> DataFrame:
    """df with pid, entity_type, entity_id, seq_nr and slice, for tables that aren't journals yet."""
    from pyspark.sql import Window

    own = F.col(id_col).cast("string")
    pid = F.concat(F.lit(f"{entity_type}|"), own)
    nr = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)).cast("long")
    return df.select("*", pid.alias("pid"), F.lit(entity_type).alias("entity_type"), own.alias("entity_id"), nr.alias("seq_nr")).withColumn("slice", slice_of(F.col("pid")))


def write_journal(journal: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by ranges of slices, sorted so that statistics prune by time within each."""
    bucket = F.floor(F.col("slice") * SLICE_BUCKETS / SLICES).cast("int")
    journal.withColumn("slice_bucket", bucket).repartition("slice_bucket").sortWithinPartitions("slice_bucket", "ts").write.mode(mode).partitionBy("slice_bucket").parquet(path)


def read_journal(spark: SparkSession, path: str, min_slice: int = 0, max_slice: int = SLICES - 1) -> DataFrame:
    """A journal of write_journal; only the directories of the wanted slices are listed for reading."""
    low, high = min_slice * SLICE_BUCKETS // SLICES, max_slice * SLICE_BUCKETS // SLICES
    return spark.read.parquet(path).where(F.col("slice_bucket").between(low, high) & F.col("slice").between(min_slice, max_slice)).drop("slice_bucket")


def stream_journal(spark: SparkSession, path: str, schema: StructType, min_slice: int = 0, max_slice: int = SLICES - 1, files_per_batch: int | None = None) -> DataFrame:
    """A journal of write_journal as a stream that follows what is appended; of a range of slices, only its directories are read. schema: the journal's."""
    low, high = min_slice * SLICE_BUCKETS // SLICES, max_slice * SLICE_BUCKETS // SLICES
    reader = spark.readStream.schema(StructType([*schema.fields, StructField("slice_bucket", IntegerType())]))
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    return rows.where(F.col("slice_bucket").between(low, high) & F.col("slice").between(min_slice, max_slice)).drop("slice_bucket")


def _since(start: datetime | None, inclusive: bool = False) -> Column:
    ts = F.col("ts")
    return F.lit(True) if start is None else ts >= F.lit(start) if inclusive else ts > F.lit(start)


def events_by_tag(journal: DataFrame, tag: str, after: datetime | None = None) -> DataFrame:
    """Events that carry a tag, after an offset (exclusive)."""
    return journal.where(F.array_contains("tags", tag) & _since(after))


def events_by_slices(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int, start: datetime | None = None, adjust: Callable[[datetime | None], datetime | None] | None = None) -> DataFrame:
    """Events of an entity type in a range of slices, from an offset (inclusive: what was seen at it is dropped by validation).

    adjust may replace the stored offset before reading.
    """
    start = adjust(start) if adjust else start
    return journal.where((F.col("entity_type") == entity_type) & F.col("slice").between(min_slice, max_slice) & _since(start, inclusive=True))


def events_from_snapshots(journal: DataFrame, snapshots: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each entity its snapshot, made an event by transform, and the events after it; entities without snapshot in full."""
    marks = snapshots.select("pid", F.col("seq_nr").alias("__snap"))
    later = journal.join(marks, "pid", "left").where("__snap IS NULL OR seq_nr > __snap").drop("__snap")
    return transform(snapshots).unionByName(later.select(*journal.columns))


def events_by_id(journal: DataFrame, pid: str, from_nr: int = 1, to_nr: int = (1 << 63) - 1) -> DataFrame:
    return journal.where((F.col("pid") == pid) & F.col("seq_nr").between(from_nr, to_nr)).orderBy("seq_nr")


def load_envelopes(keys: DataFrame, journal: DataFrame) -> DataFrame:
    """Point lookups of (pid, seq_nr) as one join."""
    return keys.select("pid", "seq_nr").join(journal, ["pid", "seq_nr"])


def timestamps_of(keys: DataFrame, journal: DataFrame) -> DataFrame:
    """(pid, seq_nr, ts): null where the journal has no such event."""
    return keys.select("pid", "seq_nr").join(journal.select("pid", "seq_nr", "ts"), ["pid", "seq_nr"], "left")


def latest_event_timestamp(journal: DataFrame, entity_type: str, min_slice: int = 0, max_slice: int = SLICES - 1) -> DataFrame:
    return journal.where((F.col("entity_type") == entity_type) & F.col("slice").between(min_slice, max_slice)).agg(F.max("ts").alias("latest_ts"))


def slice_ranges(spark: SparkSession, ranges: int) -> DataFrame:
    """(range, min_slice, max_slice): equal contiguous ranges; ranges must divide the number of slices."""
    if SLICES % ranges:
        raise ValueError(f"{ranges} doesn't divide {SLICES}")
    size = SLICES // ranges
    return spark.range(ranges).select(F.col("id").cast("int").alias("range"), (F.col("id") * size).cast("int").alias("min_slice"), ((F.col("id") + 1) * size - 1).cast("int").alias("max_slice"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest revision of each object; deletions too. An aggregate, so it is combined before the shuffle."""
    rest = [c for c in changes.columns if c not in ("pid", "revision")]
    return changes.groupBy("pid").agg(F.max_by(F.struct("revision", *rest), "revision").alias("c")).select("pid", "c.*")


def changes_by_tag(changes: DataFrame, tag: str, after: datetime | None = None) -> DataFrame:
    return latest_changes(changes).where(F.array_contains("tags", tag) & _since(after))


def changes_by_slices(changes: DataFrame, entity_type: str, min_slice: int, max_slice: int, start: datetime | None = None) -> DataFrame:
    """Slices belong to ids, so the range is cut before the newest revision is looked for."""
    own = changes.where((F.col("entity_type") == entity_type) & F.col("slice").between(min_slice, max_slice))
    return latest_changes(own).where(_since(start, inclusive=True))


def get_object(changes: DataFrame, pid: str) -> DataFrame:
    """(pid, revision, value) of one object; value is null if it was deleted, no row if it never was."""
    return latest_changes(changes.where(F.col("pid") == pid)).select("pid", "revision", F.when(F.col("op") != "delete", F.col("value")).alias("value"))


def load_payloads(metadata: DataFrame, journal: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose payload wasn't sent get it from the journal by key."""
    full = journal.select("pid", "seq_nr", F.col(payload).alias("__full"))
    return metadata.join(full, ["pid", "seq_nr"], "left").withColumn(payload, F.coalesce(payload, "__full")).drop("__full")


def from_offset(events: DataFrame, last: int | None, offset: str = "offset") -> DataFrame:
    """A test source: rows after the last stored offset."""
    return events if last is None else events.where(F.col(offset) > last)


def paused(source: DataFrame, is_paused: bool) -> DataFrame:
    """Nothing while paused."""
    return source.where(F.lit(not is_paused))


def starting_offsets(partitions: list[tuple[str, int]], stored: dict[tuple[str, int], int]) -> str:
    """startingOffsets of a message-log reader: one past what is stored; with nothing stored, the beginning."""
    import json

    out: dict[str, dict[str, int]] = {}
    for topic, partition in partitions:
        out.setdefault(topic, {})[str(partition)] = stored[topic, partition] + 1 if (topic, partition) in stored else -2
    return json.dumps(out, sort_keys=True)


def message_log(spark: SparkSession, servers: str, topics: list[str], offsets: str | None = None) -> DataFrame:
    """A streaming message log; needs the log's connector on the classpath."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    return reader.option("startingOffsets", offsets or "earliest").load()


def log_records(rows: DataFrame, key: Column, *value: Column) -> DataFrame:
    """(key, value) as a message log's writer takes them; the value is JSON of the given columns."""
    return rows.select(key.alias("key"), F.to_json(F.struct(*value)).alias("value"))


def append_to_log(records: DataFrame, servers: str, topic: str) -> None:
    """Send (key, value) of a batch, as from a handler; needs the log's connector on the classpath."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
