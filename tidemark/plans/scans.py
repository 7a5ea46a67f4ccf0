"""Queries A: scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import slice_of
from tidemark.plans.base import CHG, ENV, SNAP, changes, journal, query, snapshots, sql_hash, sql_shard, table, us
from tidemark.session import cut
from tidemark.sources import journal as J

SINCE, SINCE_SQL = datetime(2024, 1, 5), "TIMESTAMP '2024-01-05'"
KEYS = ("pid", "seq_nr")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr, epoch_us(ts) AS ts_us FROM env WHERE list_contains(tags, 'purchase') AND ts > {SINCE_SQL}")
def op_A1_events_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return us(J.events_by_tag(journal(spark, d), "purchase", SINCE), "event_id", "pid", "seq_nr", "ts")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr, slice, epoch_us(ts) AS ts_us FROM env WHERE slice BETWEEN 0 AND 511 AND ts >= {SINCE_SQL}")
def op_A2_events_by_slices(spark: SparkSession, d: str) -> DataFrame:
    return us(J.events_by_slices(journal(spark, d), "user", 0, 511, SINCE), "event_id", "pid", "seq_nr", "slice", "ts")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr FROM env WHERE slice BETWEEN 512 AND 1023 AND ts >= {SINCE_SQL} - INTERVAL 1 DAY")
def op_A3_adjust_start_offset(spark: SparkSession, d: str) -> DataFrame:
    from datetime import timedelta

    return J.events_by_slices(journal(spark, d), "user", 512, 1023, SINCE, lambda s: s - timedelta(days=1)).select("event_id", "pid", "seq_nr")


@query(f"WITH {SNAP} SELECT event_id, pid, seq_nr, 'snapshot:' || event_type AS payload FROM snap UNION ALL SELECT e.event_id, e.pid, e.seq_nr, e.payload FROM env e LEFT JOIN snap s USING (pid) WHERE s.pid IS NULL OR e.seq_nr > s.seq_nr")
def op_A4_events_from_snapshots(spark: SparkSession, d: str) -> DataFrame:
    made = J.events_from_snapshots(journal(spark, d), snapshots(spark, d), lambda s: s.withColumn("payload", F.concat(F.lit("snapshot:"), "event_type")))
    return made.select("event_id", "pid", "seq_nr", "payload")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr, event_type FROM env WHERE pid = 'user|8' AND seq_nr BETWEEN 3 AND 12")
def op_A5_events_by_id(spark: SparkSession, d: str) -> DataFrame:
    return J.events_by_id(journal(spark, d), "user|8", 3, 12).select("event_id", "pid", "seq_nr", "event_type")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of every third event, moved on by two numbers, so that some don't exist."""
    return journal(spark, d).where("event_id % 3 = 0").select("pid", (F.col("seq_nr") + 2).alias("seq_nr"))


_KEYS_SQL = "keys AS (SELECT pid, seq_nr + 2 AS seq_nr FROM env WHERE event_id % 3 = 0)"


@query(f"WITH {ENV}, {_KEYS_SQL} SELECT pid, seq_nr, event_id, payload FROM keys JOIN env USING (pid, seq_nr)")
def op_A6_load_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return J.load_envelopes(_keys(spark, d), journal(spark, d)).select("pid", "seq_nr", "event_id", "payload")


@query(f"WITH {ENV}, {_KEYS_SQL} SELECT pid, seq_nr, epoch_us(env.ts) AS ts_us FROM keys LEFT JOIN env USING (pid, seq_nr)")
def op_A7_timestamps_of(spark: SparkSession, d: str) -> DataFrame:
    return us(J.timestamps_of(_keys(spark, d), journal(spark, d)), "pid", "seq_nr", "ts")


@query(f"WITH {ENV} SELECT epoch_us(max(ts)) AS latest_ts_us FROM env WHERE slice BETWEEN 256 AND 511")
def op_A8_latest_event_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return us(J.latest_event_timestamp(journal(spark, d), "user", 256, 511), "latest_ts")


@query(f"WITH p AS (SELECT c_name || '|' || c_custkey AS pid FROM customer UNION ALL SELECT 'Supplier|' || s_suppkey FROM supplier), q AS (SELECT pid, {sql_hash('pid')} AS h FROM p) SELECT pid, {sql_shard('h')} AS slice FROM q")
def op_A9_slice_for_id(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat_ws("|", "c_name", F.col("c_custkey").cast("string")).alias("pid"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("Supplier|"), F.col("s_suppkey").cast("string")).alias("pid"))
    return c.unionByName(s).select("pid", slice_of(F.col("pid")).alias("slice"))


@query('SELECT r::INT AS "range", (r * 64)::INT AS min_slice, (r * 64 + 63)::INT AS max_slice FROM range(16) t(r)')
def op_A10_slice_ranges(spark: SparkSession, d: str) -> DataFrame:
    return J.slice_ranges(spark, 16)


_LAST = "last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY pid ORDER BY revision DESC) = 1)"


@query(f"WITH {CHG}, {_LAST} SELECT pid, revision, op, value FROM last WHERE list_contains(tags, 'F')")
def op_A11_changes_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return J.changes_by_tag(changes(spark, d), "F").select("pid", "revision", "op", "value")


@query(f"WITH {CHG}, {_LAST} SELECT pid, revision, op, value, slice FROM last WHERE slice BETWEEN 100 AND 399 AND ts >= TIMESTAMP '1997-01-01'")
def op_A12_changes_by_slices(spark: SparkSession, d: str) -> DataFrame:
    return J.changes_by_slices(changes(spark, d), "Customer", 100, 399, datetime(1997, 1, 1)).select("pid", "revision", "op", "value", "slice")


@query(f"WITH {CHG}, {_LAST} SELECT pid, revision, CASE WHEN op <> 'delete' THEN value END AS value FROM last WHERE pid = 'Customer|7'")
def op_A13_get_object(spark: SparkSession, d: str) -> DataFrame:
    return J.get_object(changes(spark, d), "Customer|7")


@query("SELECT k AS topic_partition, o AS starting FROM (VALUES ('a-0', -2::BIGINT), ('a-1', 42), ('b-0', 8)) t(k, o)")
def op_A15_starting_offsets(spark: SparkSession, d: str) -> DataFrame:
    import json

    offsets = json.loads(J.starting_offsets([("a", 0), ("a", 1), ("b", 0)], {("a", 1): 41, ("b", 0): 7}))
    return spark.createDataFrame([(f"{t}-{p}", o) for t, ps in offsets.items() for p, o in ps.items()], "topic_partition string, starting long")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr, CASE WHEN event_id % 4 = 0 THEN payload ELSE payload END AS payload FROM env")
def op_A20_lazy_payload(spark: SparkSession, d: str) -> DataFrame:
    full = journal(spark, d)
    sent = full.withColumn("payload", F.when(F.col("event_id") % 4 != 0, F.col("payload")))
    return J.load_payloads(sent, full).select("event_id", "pid", "seq_nr", "payload")


@query("SELECT event_id FROM events WHERE false")
def op_A21_paused_source(spark: SparkSession, d: str) -> DataFrame:
    return J.paused(table(spark, d, "events"), True).select("event_id")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr FROM env WHERE event_id > 500")
def op_A23_test_source(spark: SparkSession, d: str) -> DataFrame:
    return J.from_offset(journal(spark, d), 500, "event_id").select("event_id", "pid", "seq_nr")


@query(f"WITH {ENV} SELECT event_id, pid, seq_nr, slice FROM env WHERE slice BETWEEN 896 AND 1023")
def op_A17_stored_journal(spark: SparkSession, d: str) -> DataFrame:
    """A journal written by slices and read by a consumer of one range: only its directories are listed."""
    import uuid

    from tidemark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/journal-{uuid.uuid4().hex}"
    J.write_journal(cut(journal(spark, d).select("event_id", "pid", "seq_nr", "slice", "ts")), path)
    return J.read_journal(spark, path, 896, 1023).select("event_id", "pid", "seq_nr", "slice")
