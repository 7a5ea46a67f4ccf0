"""Offset algebra: what has been processed, where to start, what may be forgotten.

Records are rows (slice, pid, seq_nr, ts) with, where they are stored, projection_key and consumed. All operators are
aggregates, windows over slices or filters; none brings rows to the driver.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "slice", "pid", "seq_nr")


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def _us(c: str | Column) -> Column:
    return F.unix_micros(c)


def latest_timestamp(records: DataFrame) -> DataFrame:
    return records.agg(F.max("ts").alias("latest_ts"))


def latest_offset(records: DataFrame) -> DataFrame:
    """(ts, pid, seq_nr): the newest time and what was seen at it."""
    newest = records.agg(F.max("ts").alias("__ts"))  # one row
    return records.join(F.broadcast(newest), F.col("ts") == F.col("__ts")).groupBy("ts", "pid").agg(F.max("seq_nr").alias("seq_nr"))


def latest_offset_by_slice(records: DataFrame) -> DataFrame:
    """(slice, ts, pid, seq_nr): the same for each slice. At most as many newest times as slices, so they are broadcast."""
    newest = records.groupBy(F.col("slice").alias("__slice")).agg(F.max("ts").alias("__ts"))
    return records.join(F.broadcast(newest), (F.col("slice") == F.col("__slice")) & (F.col("ts") == F.col("__ts"))).groupBy("slice", "ts", "pid").agg(F.max("seq_nr").alias("seq_nr"))


def newest_per_slice(records: DataFrame, limit: int = 100) -> DataFrame:
    """The newest records of each slice; the limit is applied in each task before the shuffle."""
    order = Window.partitionBy("slice").orderBy(F.desc("ts"), F.desc("seq_nr"), "pid")
    return records.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def stored_seq_nr(pids: DataFrame, records: DataFrame) -> DataFrame:
    """(pid, seq_nr): the highest stored number, 0 for unknown ids."""
    best = records.groupBy("pid").agg(F.max("seq_nr").alias("seq_nr"))
    return pids.select("pid").join(best, "pid", "left").select("pid", F.coalesce("seq_nr", F.lit(0).cast("long")).alias("seq_nr"))


def top_record(records: DataFrame) -> DataFrame:
    """(pid, seq_nr, ts) of the highest number of each id."""
    return records.groupBy("pid").agg(F.max(F.struct("seq_nr", "ts")).alias("m")).select("pid", "m.seq_nr", "m.ts")


def ranked(records: DataFrame, by: str = "slice") -> DataFrame:
    """records with rank, their place in ORDER within a column's value; there are as many tasks as the column has values."""
    return records.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*ORDER)))


def newest_and_oldest(records: DataFrame, by: str) -> DataFrame:
    """(by, newest_pid, oldest_pid): entities of the newest and the oldest time."""
    return records.groupBy(by).agg(F.max_by("pid", "ts").alias("newest_pid"), F.min_by("pid", "ts").alias("oldest_pid"))


def latest_by_slice(records: DataFrame) -> DataFrame:
    """The newest record of each slice; at most as many rows as slices."""
    return records.groupBy("slice").agg(F.max(F.struct("ts", "pid", "seq_nr", "projection_key")).alias("m")).select("slice", "m.*")


def start_offset(records: DataFrame) -> DataFrame:
    """(ts, pid, seq_nr, projection_key): of the newest of each key the earliest, so that no key misses events."""
    by_key = latest_by_slice(records).groupBy("projection_key").agg(F.max(F.struct("ts", "pid", "seq_nr")).alias("m")).select("projection_key", "m.*")
    return by_key.agg(F.min(F.struct("ts", "pid", "seq_nr", "projection_key")).alias("m")).select("m.*")


def foreign_offsets(records: DataFrame, own_key: str) -> DataFrame:
    """Newest records of slices that another key wrote, earliest first."""
    return latest_by_slice(records).where(F.col("projection_key") != own_key).orderBy("ts", "slice")


def adopt(records: DataFrame, own_key: str, latest_seen: datetime) -> DataFrame:
    """records with the key of foreign slices' newest record exchanged for one's own, where it isn't newer than what was seen."""
    foreign = foreign_offsets(records, own_key).where(F.col("ts") <= F.lit(latest_seen)).select("slice", F.col("projection_key").alias("__key"), F.col("ts").alias("__ts"))
    joined = records.join(F.broadcast(foreign), "slice", "left")  # at most one row a slice
    taken = (F.col("projection_key") == F.col("__key")) & (F.col("ts") <= F.col("__ts"))
    return joined.withColumn("projection_key", F.when(taken, F.lit(own_key)).otherwise(F.col("projection_key"))).select(*records.columns)


def _newest(records: DataFrame) -> DataFrame:
    """records with the newest time of their slice as __newest: an aggregate of a row a slice, sent to where the records are."""
    top = records.groupBy(F.col("slice").alias("__slice")).agg(F.max("ts").alias("__newest"))
    return records.join(F.broadcast(top), F.col("slice").eqNullSafe(F.col("__slice"))).drop("__slice")


def without_old(records: DataFrame, delete_after_s: float, now: datetime, consumed_after_s: float) -> DataFrame:
    """Retention: a record goes if it is older than its slice's newest by delete_after and was consumed before now - consumed_after."""
    old = (_us("ts") < _us("__newest") - micros(delete_after_s)) & (_us("consumed") < _us(F.lit(now)) - micros(consumed_after_s))
    return _newest(records).where(~old).drop("__newest")


def without_newer(records: DataFrame, ts: datetime) -> DataFrame:
    """Setting an offset back: what is at it or after goes."""
    return records.where(F.col("ts") < F.lit(ts))


def cleared(records: DataFrame, name: str, min_slice: int, max_slice: int) -> DataFrame:
    return records.where(~((F.col("projection_name") == name) & F.col("slice").between(min_slice, max_slice)))


def evict(records: DataFrame, window_s: float, evictable: Column | None = None) -> DataFrame:
    """Records within the window before their slice's newest, that boundary included, and what may not be evicted."""
    out = _us("ts") < _us("__newest") - micros(window_s)
    if evictable is not None:
        out = out & evictable
    return _newest(records).where(~out).drop("__newest")


def save_batch(stored: DataFrame, batch: DataFrame, order: str = "arrival") -> DataFrame:
    """stored and, of a batch, the last row of each id in batch order, unless its number was stored already."""
    last = batch.groupBy("pid").agg(F.max_by(F.struct("slice", "seq_nr", "ts"), order).alias("m")).select("m.slice", "pid", "m.seq_nr", "m.ts")
    known = stored.groupBy("pid").agg(F.max("seq_nr").alias("__known"))
    new = last.join(known, "pid", "left").where("__known IS NULL OR seq_nr > __known").select("slice", "pid", "seq_nr", "ts")
    return stored.select("slice", "pid", "seq_nr", "ts").unionByName(new)


def add_records(state: DataFrame, records: DataFrame) -> DataFrame:
    """State after records: of each id the highest number."""
    both = state.select("pid", "slice", "seq_nr", "ts").unionByName(records.select("pid", "slice", "seq_nr", "ts"))
    return both.groupBy("pid").agg(F.max_by(F.struct("slice", "seq_nr", "ts"), "seq_nr").alias("m")).select("pid", "m.*")


def upsert(stored: DataFrame, update: DataFrame, keys: list[str], order: str = "last_updated") -> DataFrame:
    """Rows by key, the newest winning; of equally new ones the update's."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("__side", F.lit(0)).unionByName(update.withColumn("__side", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "__side")).alias("m"))
    return best.select(*keys, "m.*").select(*stored.columns)


def read_primitive(stored: DataFrame, name: str, key: str) -> DataFrame:
    """(projection_key, current_offset, manifest): all rows of the name if they are mergeable, else the exact key's."""
    own = stored.where(F.col("projection_name") == name)
    every = own.agg(F.coalesce(F.bool_and("mergeable"), F.lit(False)).alias("__merge"))
    return own.join(F.broadcast(every)).where(F.col("__merge") | (F.col("projection_key") == key)).select("projection_key", "current_offset", "manifest")


# Names by which offset types are stored.
MANIFESTS = {"string": "STR", "long": "LNG", "int": "INT", "sequence": "SEQ", "uuid": "TBU"}


def encode_offset(value: Column, kind: str, serializer: str | None = None) -> tuple[Column, Column]:
    """(text, manifest): primitive kinds as text, binary ones as base64 with the serialiser's name."""
    if kind in MANIFESTS:
        return value.cast("string"), F.lit(MANIFESTS[kind])
    return F.base64(value), F.lit(serializer)


def decode_offset(text: Column, manifest: Column) -> Column:
    """struct(text, number, bytes), of which the one that the manifest names is set."""
    number = manifest.isin(MANIFESTS["long"], MANIFESTS["int"], MANIFESTS["sequence"])
    plain = manifest.isin(MANIFESTS["string"], MANIFESTS["uuid"])
    return F.struct(F.when(plain, text).alias("text"), F.when(number, text.try_cast("long")).alias("number"), F.when(~number & ~plain, F.try_to_binary(text, F.lit("base64"))).alias("bytes"))


def consumer_lag(records: DataFrame) -> DataFrame:
    """Microseconds from an event's time to its consumption: (n, mean, max)."""
    lag = _us("consumed") - _us("ts")
    return records.agg(F.count("*").alias("n"), F.round(F.avg(lag), 3).alias("mean_lag"), F.max(lag).alias("max_lag"))


def backlog(events: DataFrame, records: DataFrame) -> DataFrame:
    """(source_ms, offset_ms, backlog_ms): newest event against newest stored offset; 0 where there is none."""
    ms = lambda df, name: df.agg(F.coalesce(F.unix_millis(F.max("ts")), F.lit(0).cast("long")).alias(name))
    joined = ms(events, "source_ms").crossJoin(ms(records, "offset_ms"))  # one row each
    return joined.withColumn("backlog_ms", F.col("source_ms") - F.col("offset_ms"))


def group_sizes(batches: DataFrame) -> DataFrame:
    """(n_groups, n_envelopes) of rows with group_size."""
    return batches.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("group_size"), F.lit(0)).cast("long").alias("n_envelopes"))


def unexpired(records: DataFrame, now: datetime, ttl_s: dict[str, float]) -> DataFrame:
    """Rows within the time to live of their projection; a name that ends in * stands for its beginning, the longest match counts."""
    limit = F.lit(None).cast("long")
    for name in sorted(ttl_s, key=lambda n: len(n.rstrip("*"))):
        hit = F.col("projection_name").startswith(name[:-1]) if name.endswith("*") else F.col("projection_name") == name
        limit = F.when(hit, F.lit(micros(ttl_s[name]))).otherwise(limit)
    return records.where(limit.isNull() | (_us("ts") + limit > _us(F.lit(now))))
