"""Queries G and I: grouping in time, and read models."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import handlers as H
from tidemark.operators import offsets as O
from tidemark.operators import validation as V
from tidemark.plans.base import ENV, REC, journal, query, records, table


@query(f"WITH {ENV} SELECT event_id, slice, (row_number() OVER (PARTITION BY slice ORDER BY event_id) - 1) // 20 AS group_nr FROM env")
def op_G1_grouped(spark: SparkSession, d: str) -> DataFrame:
    return H.grouped(journal(spark, d), 20, ["event_id"], "slice").select("event_id", "slice", "group_nr")


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 20 AS group_nr FROM events")
def op_G1c_grouped_overall(spark: SparkSession, d: str) -> DataFrame:
    """Groups of twenty over all events in the order of their times, whatever their entity."""
    return H.grouped(table(spark, d, "events").select("event_id", "ts"), 20, ["ts", "event_id"]).select("event_id", "group_nr")


@query(f"WITH {REC}, m AS (SELECT *, max(ts) OVER (PARTITION BY slice) AS t FROM rec) SELECT slice, count(*) AS kept FROM m WHERE epoch_us(ts) >= epoch_us(t) - 3600000000 GROUP BY slice")
def op_G2_window_eviction(spark: SparkSession, d: str) -> DataFrame:
    return O.evict(records(spark, d), 3600).groupBy("slice").agg(F.count("*").alias("kept"))


@query(f"WITH {ENV} SELECT pid, count(*) AS n FROM env GROUP BY pid")
def op_G3_backtracking(spark: SparkSession, d: str) -> DataFrame:
    """A second scan of recent events brings late ones and repeats; validation leaves each once."""
    j = journal(spark, d)
    first = j.where("event_id % 11 <> 0").select("pid", "seq_nr", "ts", F.lit(0).alias("scan"))
    both = first.unionByName(j.select("pid", "seq_nr", "ts", F.lit(1).alias("scan")))
    done = V.validate(both, ["scan", "seq_nr"], unknown_accepted=False)
    return done.where(F.col("verdict") == V.ACCEPTED).groupBy("pid").agg(F.count("*").alias("n"))


@query(f"WITH {ENV}, g AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq_nr) AS rn FROM env WHERE event_id % 11 <> 0) SELECT pid, count(*) FILTER (seq_nr <> rn) AS rejected FROM g GROUP BY pid")
def op_G4_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """What comes after a lost event is rejected until that event is read."""
    done = V.validate(journal(spark, d).where("event_id % 11 <> 0"), ["seq_nr"], unknown_accepted=False)
    return done.groupBy("pid").agg(F.count_if(F.col("verdict") == V.REJECTED).alias("rejected"))


@query(f"WITH {REC} SELECT slice, pid, seq_nr FROM rec WHERE epoch_us(ts) + 864000000000 > epoch_us(TIMESTAMP '2024-01-31')")
def op_G5_retention(spark: SparkSession, d: str) -> DataFrame:
    return O.unexpired(records(spark, d), datetime(2024, 1, 31), {"pro*": 10 * 86_400, "p*": 1, "other": 5}).select("slice", "pid", "seq_nr")


@query(f"WITH {ENV} SELECT event_id, CASE WHEN seq_nr > coalesce(max(seq_nr) OVER (PARTITION BY pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 'accepted' ELSE 'duplicate' END AS verdict FROM env WHERE event_id % 4 <> 1")
def op_G7_gaps_allowed(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_relaxed(journal(spark, d).where("event_id % 4 <> 1"), ["event_id"]).select("event_id", "verdict")


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def op_I1_word_count(spark: SparkSession, d: str) -> DataFrame:
    return H.word_count(table(spark, d, "documents"))


_CART = """cart AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'added' WHEN 2 THEN 'adjusted' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'removed' ELSE 'checked_out' END END AS event_type, l_partkey AS item_id, l_quantity::BIGINT AS quantity, (l_suppkey % 10)::BIGINT AS old_quantity FROM lineitem)"""


def _cart(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    kind = F.when(n.isin(0, 1), "added").when(n == 2, "adjusted").when(F.col("l_partkey") % 2 == 0, "removed").otherwise("checked_out")
    return table(spark, d, "lineitem").select(kind.alias("event_type"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_suppkey") % 10).alias("old_quantity"))


@query(f"WITH {_CART} SELECT item_id, sum(CASE event_type WHEN 'added' THEN quantity WHEN 'adjusted' THEN quantity - old_quantity ELSE -old_quantity END)::BIGINT AS count FROM cart WHERE event_type <> 'checked_out' GROUP BY item_id")
def op_I2_item_popularity(spark: SparkSession, d: str) -> DataFrame:
    return H.item_popularity(_cart(spark, d))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def op_I3_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.type_counts(table(spark, d, "events"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS concatenated FROM conversations GROUP BY conv_id")
def op_I4_concatenated(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("message", F.concat("role", F.lit(":"), F.char_length("text").cast("string")))
    return H.concatenated(c, "conv_id", "turn", "message")


@query(f"WITH {ENV} SELECT pid, seq_nr, epoch_us(ts) AS checked_out_us FROM env WHERE event_type = 'purchase'")
def op_I5_checkouts(spark: SparkSession, d: str) -> DataFrame:
    return H.checkouts(journal(spark, d)).select("pid", "seq_nr", F.unix_micros("checked_out_at").alias("checked_out_us"))


_POS = "pos AS (SELECT event_id, user_id AS id, CASE WHEN event_id % 13 <> 0 THEN 59 + (event_id % 50) / 1000.0::DOUBLE END AS latitude, 18 + (user_id % 40) / 1000.0::DOUBLE AS longitude FROM events)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("id"), F.when(e % 13 != 0, 59 + (e % 50) / F.lit(1000.0)).alias("latitude"), (18 + (F.col("user_id") % 40) / F.lit(1000.0)).alias("longitude"))


@query(f"WITH {_POS} SELECT floor(latitude * 100 + 0.5) / 100 AS lat, floor(longitude * 100 + 0.5) / 100 AS lon, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM pos WHERE latitude IS NOT NULL GROUP BY 1, 2")
def op_I6_coarse_locations(spark: SparkSession, d: str) -> DataFrame:
    return H.coarse_locations(_positions(spark, d)).select("lat", "lon", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {_POS}, c AS (SELECT event_id, id, floor(latitude * 100 + 0.5) / 100 AS lat, floor(longitude * 100 + 0.5) / 100 AS lon FROM pos WHERE latitude IS NOT NULL), g AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM c WINDOW w AS (PARTITION BY id ORDER BY event_id)) SELECT event_id, id, lat, lon FROM g WHERE plat IS NULL OR plat <> lat OR plon <> lon")
def op_I7_coarse_changes(spark: SparkSession, d: str) -> DataFrame:
    return H.coarse_changes(_positions(spark, d).where("latitude IS NOT NULL"), ["event_id"]).select("event_id", "id", "lat", "lon")


@query(f"WITH {ENV} SELECT pid, max(seq_nr) AS seq_nr, arg_max(value, seq_nr) AS value FROM env GROUP BY pid")
def op_I8_last_values(spark: SparkSession, d: str) -> DataFrame:
    return H.last_values(journal(spark, d))


@query("SELECT epoch_us(ts) // 3600000000 * 3600000000 AS window_start_us, count(*) AS n, round(count(*) / 3600, 6) AS per_second FROM events GROUP BY 1")
def op_I9_throughput(spark: SparkSession, d: str) -> DataFrame:
    return H.throughput(table(spark, d, "events"))


@query(f"WITH {ENV}, t AS (SELECT event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY pid ORDER BY seq_nr)::BIGINT AS total FROM env) SELECT event_id, total, CASE WHEN total >= 100 THEN 'large' WHEN total >= 10 THEN 'medium' ELSE 'small' END AS size_tag FROM t WHERE total >= 10")
def op_I10_size_tags(spark: SparkSession, d: str) -> DataFrame:
    return H.size_tags(journal(spark, d), F.floor("value").cast("long")).where("size_tag <> 'small'").select("event_id", "total", "size_tag")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'in_progress' ELSE 'waiting' END AS state FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber > 4)")
def op_I11_queue_state(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    of = lambda where: lines.where(where).select(F.col("l_orderkey").alias("id"))
    return H.queue_state(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), of("l_returnflag = 'A'"), of("l_linestatus = 'F' AND l_linenumber > 4"))


@query(f"WITH {ENV} SELECT event_id, pid, value FROM env WHERE event_type = 'signup'")
def op_I12_registered_only(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.transform import Transformation, for_handler, transform_payload

    t = Transformation().register("signup", lambda: F.col("payload")).register_or_else(lambda: F.lit(None).cast("string"))
    return for_handler(transform_payload(journal(spark, d), t)).select("event_id", "pid", "value")


_SHARED = "shared AS (SELECT 'Order|' || l_orderkey AS pid, l_partkey AS item, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::BIGINT AS delta, l_linestatus = 'F' AS closed, CASE l_suppkey % 3 WHEN 0 THEN 'DCA' WHEN 1 THEN 'DCB' ELSE 'DCC' END AS replica FROM lineitem)"


def _shared(spark: SparkSession, d: str) -> DataFrame:
    q, s = F.col("l_quantity").cast("long"), F.col("l_suppkey") % 3
    return table(spark, d, "lineitem").select(F.concat(F.lit("Order|"), F.col("l_orderkey").cast("string")).alias("pid"), F.col("l_partkey").alias("item"), F.when(F.col("l_returnflag") == "R", -q).otherwise(q).alias("delta"), (F.col("l_linestatus") == "F").alias("closed"), F.when(s == 0, "DCA").when(s == 1, "DCB").otherwise("DCC").alias("replica"))


@query(f"WITH {_SHARED} SELECT pid, item, sum(delta)::BIGINT AS quantity FROM shared GROUP BY pid, item")
def op_I13_replicated_cart(spark: SparkSession, d: str) -> DataFrame:
    return H.replicated_cart(_shared(spark, d))


@query(f"WITH {_SHARED} SELECT pid, array_to_string(list_sort(list(DISTINCT replica)), ',') AS replicas FROM shared WHERE closed GROUP BY pid")
def op_I13b_closed_by(spark: SparkSession, d: str) -> DataFrame:
    return H.closed_by(_shared(spark, d))
