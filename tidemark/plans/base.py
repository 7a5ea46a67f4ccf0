"""Envelopes, records and changes made from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import slice_of
from tidemark.session import importable
from tidemark.sources.journal import with_envelope

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of its result if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, with its times, which have no zone, as instants."""
    df = importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as envelopes of users: pid, seq_nr, slice, tags, payload."""
    env = with_envelope(table(spark, sf_dir, "events"), "user", "user_id", ["ts", "event_id"])
    topic = F.concat(F.lit("t:"), "event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"))
    return env.withColumn("tags", F.array("event_type", topic)).withColumnRenamed("props", "payload")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a stored offset record of four projection keys."""
    consumed = F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 1000 * 1000)
    key = F.concat(F.lit("k"), F.floor(F.col("slice") / 256).cast("string"))
    return journal(spark, sf_dir).select(F.lit("proj").alias("projection_name"), key.alias("projection_key"), "slice", "pid", "seq_nr", "ts", consumed.alias("consumed"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the event whose number is the highest multiple of ten, as a snapshot."""
    env = journal(spark, sf_dir).where("seq_nr % 10 = 0")
    best = env.groupBy("pid").agg(F.max_by(F.struct(*[c for c in env.columns if c != "pid"]), "seq_nr").alias("m")).select("pid", "m.*")
    return best.select(*env.columns)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as state changes of customers; every tenth order deletes."""
    env = with_envelope(table(spark, sf_dir, "orders"), "Customer", "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate")
    op = F.when(F.col("o_orderkey") % 10 == 0, "delete").otherwise("upsert")
    value = F.when(op != "delete", F.col("o_totalprice"))
    return env.select("pid", "entity_type", "slice", F.col("seq_nr").alias("revision"), F.col("o_orderdate").alias("ts"), op.alias("op"), value.alias("value"), F.array("o_orderstatus").alias("tags"))


ARRIVAL = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a stream with repeats and gaps."""
    pid = F.concat(F.lit("Order|"), F.col("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(pid.alias("pid"), F.col("l_linenumber").cast("long").alias("seq_nr"), F.col("l_shipdate").alias("ts"), slice_of(pid).alias("slice"), *ARRIVAL)


def us(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, times as microseconds named with _us."""
    kinds = dict(df.dtypes)
    return df.select(*(F.unix_micros(c).alias(f"{c}_us") if kinds[c] == "timestamp" else F.col(c) for c in columns))


def until(spark: SparkSession, sf_dir: str, part: int) -> int:
    """The microsecond that ends the first of so many equal parts of the events' time."""
    low, high = table(spark, sf_dir, "events").agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    return low + (high - low) // part


def sql_until(part: int) -> str:
    return f"(SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // {part} FROM events)"


def sql_hash(text: str) -> str:
    """The polynomial hash before its sign is taken, in SQL."""
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i::INT, 1))::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296)"


def sql_shard(h: str, n: int = 1024) -> str:
    return f"abs((CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % {n})::INT"


ENV = f"""e0 AS (SELECT event_id, ts, user_id, event_type, value, props AS payload, 'user|' || user_id AS pid, 'user' AS entity_type, user_id::VARCHAR AS entity_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_nr, {sql_hash("('user|' || user_id)")} AS h FROM events),
env AS (SELECT * EXCLUDE (h), {sql_shard("h")} AS slice, [event_type, 't:' || event_type || '/' || (event_id % 3)] AS tags FROM e0)"""
REC = ENV + """,
rec AS (SELECT 'proj' AS projection_name, 'k' || (slice // 256) AS projection_key, slice, pid, seq_nr, ts, make_timestamp(epoch_us(ts) + event_id % 1000 * 1000) AS consumed FROM env)"""
SNAP = ENV + """,
snap AS (SELECT * FROM env WHERE seq_nr % 10 = 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq_nr DESC) = 1)"""
CHG = f"""c0 AS (SELECT 'Customer|' || o_custkey AS pid, 'Customer' AS entity_type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision, o_orderdate AS ts,
    CASE WHEN o_orderkey % 10 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS value, [o_orderstatus] AS tags,
    {sql_hash("('Customer|' || o_custkey)")} AS h FROM orders),
chg AS (SELECT * EXCLUDE (h), {sql_shard("h")} AS slice FROM c0)"""
ARRIVAL_SQL = ", ".join(ARRIVAL)
DIRTY = f"""dirty AS (SELECT 'Order|' || l_orderkey AS pid, l_linenumber::BIGINT AS seq_nr, l_shipdate AS ts, l_partkey, l_suppkey, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {ARRIVAL_SQL}) AS rn FROM lineitem)"""
