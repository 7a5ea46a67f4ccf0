"""Bookkeeping tables in the catalogue, a small SQL session for handlers, and an offset store in memory."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of bookkeeping tables.
TABLES = {
    "offset_store": "projection_name STRING, projection_key STRING, current_offset STRING, manifest STRING, mergeable BOOLEAN, last_updated BIGINT",
    "timestamp_offset_store": "projection_name STRING, projection_key STRING, slice INT, persistence_id STRING, seq_nr BIGINT, timestamp_offset TIMESTAMP, timestamp_consumed TIMESTAMP",
    "projection_management": "projection_name STRING, projection_key STRING, paused BOOLEAN, last_updated BIGINT",
}


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    """Create what doesn't exist; running it again changes nothing."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")


def drop_tables(spark: SparkSession, prefix: str = "") -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")


class Session:
    """What a handler may do with tables: select with named arguments, one row, and append."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def select(self, sql: str, **args) -> DataFrame:
        return self.spark.sql(sql, args=args)

    def select_one(self, sql: str, **args):
        return self.select(sql, **args).first()

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").insertInto(table)


class TableOffsetStore:
    """Offsets of one projection name in the catalogue's offset_store: a save appends, of each key the newest row counts, null clears.

    mergeable: whether offsets of several keys may be saved at once.
    """

    def __init__(self, spark: SparkSession, name: str, prefix: str = "", mergeable: bool = True) -> None:
        self.spark, self.name, self.table, self.mergeable = spark, name, f"{prefix}offset_store", mergeable

    def save(self, offsets: DataFrame) -> None:
        """offsets: (projection_key, current_offset, manifest)."""
        if not self.mergeable and len(offsets.limit(2).collect()) > 1:
            raise ValueError("this store keeps single offsets only")
        row = offsets.select(F.lit(self.name).alias("projection_name"), "projection_key", F.col("current_offset").cast("string"), "manifest", F.lit(self.mergeable).alias("mergeable"), F.lit(time.time_ns()).alias("last_updated"))
        row.write.mode("append").insertInto(self.table)

    def read(self) -> DataFrame:
        """(projection_key, current_offset, manifest) of each key that has one."""
        own = self.spark.table(self.table).where(F.col("projection_name") == self.name)
        newest = own.groupBy("projection_key").agg(F.max_by(F.struct("current_offset", "manifest"), "last_updated").alias("m"))
        return newest.select("projection_key", "m.*").where("current_offset IS NOT NULL")

    def clear(self) -> None:
        row = self.read().select("projection_key", F.lit(None).cast("string").alias("current_offset"), F.lit(None).cast("string").alias("manifest"), F.lit(self.mergeable).alias("mergeable"), F.lit(time.time_ns()).alias("last_updated"))
        # A table can't be read while it is appended to; keys of a projection are few.
        keys = self.spark.createDataFrame(row.collect(), row.schema)
        keys.select(F.lit(self.name).alias("projection_name"), *row.columns).write.mode("append").insertInto(self.table)


class MemoryOffsetStore:
    """Offsets of one projection in this process, for tests. Mergeable offsets are kept by key."""

    def __init__(self, mergeable: bool = True) -> None:
        self.offsets: dict[str, object] = {}
        self.mergeable, self.paused = mergeable, False

    def save(self, offset: object, key: str = "") -> None:
        if isinstance(offset, dict):
            if not self.mergeable:
                raise ValueError("this store keeps single offsets only")
            self.offsets |= offset
        else:
            self.offsets[key] = offset

    def read(self, key: str = "") -> object | None:
        return self.offsets.get(key)

    def clear(self) -> None:
        self.offsets.clear()
