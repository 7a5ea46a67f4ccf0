"""Queries F, H, J and K: offset algebra, order and top-k, sets, scalars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import filters as L
from tidemark.operators import handlers as H
from tidemark.operators import offsets as O
from tidemark.operators import orset
from tidemark.operators import validation as V
from tidemark.plans.base import ENV, REC, journal, query, records, sql_hash, sql_shard, table, us

SEEN, SEEN_SQL = datetime(2024, 1, 20), "TIMESTAMP '2024-01-20'"


@query(f"WITH {REC} SELECT epoch_us(max(ts)) AS latest_ts_us FROM rec")
def op_F1_latest_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return us(O.latest_timestamp(records(spark, d)), "latest_ts")


@query(f"WITH {REC} SELECT epoch_us(ts) AS ts_us, pid, max(seq_nr) AS seq_nr FROM rec WHERE ts = (SELECT max(ts) FROM rec) GROUP BY ts, pid")
def op_F2_latest_offset(spark: SparkSession, d: str) -> DataFrame:
    return us(O.latest_offset(records(spark, d)), "ts", "pid", "seq_nr")


@query(f"WITH {REC} SELECT slice, pid, seq_nr, epoch_us(ts) AS ts_us, rank FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY ts DESC, seq_nr DESC, pid)::INT AS rank FROM rec) WHERE rank <= 20")
def op_F3_newest_per_slice(spark: SparkSession, d: str) -> DataFrame:
    return us(O.newest_per_slice(records(spark, d), 20), "slice", "pid", "seq_nr", "ts", "rank")


@query(f"WITH {REC} SELECT pid, max(seq_nr) AS seq_nr, epoch_us(arg_max(ts, seq_nr)) AS ts_us FROM rec GROUP BY pid")
def op_F4_stored_record(spark: SparkSession, d: str) -> DataFrame:
    return us(O.top_record(records(spark, d)), "pid", "seq_nr", "ts")


@query(f"WITH {REC}, p AS (SELECT DISTINCT pid FROM env UNION SELECT 'user|none') SELECT pid, coalesce(max(seq_nr), 0) AS seq_nr FROM p LEFT JOIN rec USING (pid) GROUP BY pid")
def op_F5_stored_seq_nr(spark: SparkSession, d: str) -> DataFrame:
    pids = journal(spark, d).select("pid").distinct().unionByName(spark.createDataFrame([("user|none",)], "pid string"))
    return O.stored_seq_nr(pids, records(spark, d))


_BY_SLICE = "bs AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY slice ORDER BY ts DESC, pid DESC, seq_nr DESC) = 1)"


@query(f"WITH {REC}, {_BY_SLICE}, bk AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY projection_key ORDER BY ts DESC, pid DESC, seq_nr DESC) = 1) SELECT epoch_us(ts) AS ts_us, pid, seq_nr, projection_key FROM bk ORDER BY ts, pid LIMIT 1")
def op_F6_start_offset(spark: SparkSession, d: str) -> DataFrame:
    return us(O.start_offset(records(spark, d)), "ts", "pid", "seq_nr", "projection_key")


@query(f"WITH {REC}, {_BY_SLICE} SELECT slice, epoch_us(ts) AS ts_us, pid, seq_nr, projection_key FROM bs WHERE projection_key <> 'k1'")
def op_F7_foreign_offsets(spark: SparkSession, d: str) -> DataFrame:
    return us(O.foreign_offsets(records(spark, d), "k1"), "slice", "ts", "pid", "seq_nr", "projection_key")


@query(f"WITH {REC}, {_BY_SLICE}, f AS (SELECT slice, projection_key AS k, ts AS t FROM bs WHERE projection_key <> 'k1' AND ts <= {SEEN_SQL}) SELECT slice, pid, seq_nr, CASE WHEN projection_key = k AND ts <= t THEN 'k1' ELSE projection_key END AS projection_key FROM rec LEFT JOIN f USING (slice)")
def op_F8_adopt(spark: SparkSession, d: str) -> DataFrame:
    return O.adopt(records(spark, d), "k1", SEEN).select("slice", "pid", "seq_nr", "projection_key")


@query(f"WITH {REC}, m AS (SELECT *, max(ts) OVER (PARTITION BY slice) AS t FROM rec) SELECT slice, pid, seq_nr FROM m WHERE NOT (epoch_us(ts) < epoch_us(t) - 86400000000 AND epoch_us(consumed) < epoch_us(TIMESTAMP '2024-02-01') - 777600000000)")
def op_F9_delete_old(spark: SparkSession, d: str) -> DataFrame:
    return O.without_old(records(spark, d), 86_400, datetime(2024, 2, 1), 9 * 86_400).select("slice", "pid", "seq_nr")


@query(f"WITH {REC} SELECT slice, pid, seq_nr FROM rec WHERE ts < {SEEN_SQL}")
def op_F10_delete_newer(spark: SparkSession, d: str) -> DataFrame:
    return O.without_newer(records(spark, d), SEEN).select("slice", "pid", "seq_nr")


@query(f"WITH {REC} SELECT slice, pid, seq_nr FROM rec WHERE NOT (projection_name = 'proj' AND slice BETWEEN 0 AND 499)")
def op_F11_clear(spark: SparkSession, d: str) -> DataFrame:
    return O.cleared(records(spark, d), "proj", 0, 499).select("slice", "pid", "seq_nr")


@query(f"""WITH {REC}, b AS (SELECT * FROM env WHERE event_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY event_id DESC) = 1), k AS (SELECT pid, max(seq_nr) AS known FROM rec GROUP BY pid)
SELECT slice, pid, seq_nr, epoch_us(ts) AS ts_us FROM rec UNION ALL SELECT b.slice, b.pid, b.seq_nr, epoch_us(b.ts) FROM b LEFT JOIN k USING (pid) WHERE known IS NULL OR b.seq_nr > known""")
def op_F12_save_batch(spark: SparkSession, d: str) -> DataFrame:
    batch = journal(spark, d).where("event_id % 5 = 0").withColumn("arrival", F.col("event_id"))
    return us(O.save_batch(records(spark, d), batch), "slice", "pid", "seq_nr", "ts")


_PRIM = "prim AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'merge' ELSE 'plain' END AS projection_name, 'topic-' || (c_custkey % 40) AS projection_key, c_custkey::VARCHAR AS current_offset, 'LNG' AS manifest, c_custkey % 2 = 0 AS mergeable, c_custkey AS last_updated FROM customer)"


def _primitive(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(key % 2 == 0, "merge").otherwise("plain").alias("projection_name"), F.concat(F.lit("topic-"), (key % 40).cast("string")).alias("projection_key"), key.cast("string").alias("current_offset"), F.lit("LNG").alias("manifest"), (key % 2 == 0).alias("mergeable"), key.alias("last_updated")
    )


@query(f"WITH {_PRIM} SELECT projection_name, projection_key, current_offset, last_updated FROM prim QUALIFY row_number() OVER (PARTITION BY projection_name, projection_key ORDER BY last_updated DESC) = 1")
def op_F13_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = _primitive(spark, d)
    return O.upsert(p.where("last_updated < 700"), p.where("last_updated >= 700"), ["projection_name", "projection_key"]).select("projection_name", "projection_key", "current_offset", "last_updated")


@query(f"WITH {_PRIM}, u AS (SELECT * FROM prim QUALIFY row_number() OVER (PARTITION BY projection_name, projection_key ORDER BY last_updated DESC) = 1) SELECT 'merge' AS asked, projection_key, current_offset FROM u WHERE projection_name = 'merge' UNION ALL SELECT 'plain', projection_key, current_offset FROM u WHERE projection_name = 'plain' AND projection_key = 'topic-7'")
def op_F14_read_primitive(spark: SparkSession, d: str) -> DataFrame:
    p = _primitive(spark, d)
    stored = O.upsert(p.limit(0), p, ["projection_name", "projection_key"])
    read = lambda name: O.read_primitive(stored, name, "topic-7").select(F.lit(name).alias("asked"), "projection_key", "current_offset")
    return read("merge").unionByName(read("plain"))


@query("SELECT event_id, event_id::VARCHAR AS offset_text, event_type AS string_text, base64(event_type::BLOB) AS binary_text, event_id AS decoded_number, event_type AS decoded_binary FROM events")
def op_F15_offset_codec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    number, manifest = O.encode_offset(F.col("event_id"), "long")
    text, _ = O.encode_offset(F.col("event_type"), "string")
    binary, other = O.encode_offset(F.encode("event_type", "UTF-8"), "binary", "17:type")
    return e.select("event_id", number.alias("offset_text"), text.alias("string_text"), binary.alias("binary_text"), O.decode_offset(number, manifest)["number"].alias("decoded_number"), F.decode(O.decode_offset(binary, other)["bytes"], "UTF-8").alias("decoded_binary"))


@query(f"WITH {REC}, m AS (SELECT *, max(ts) OVER (PARTITION BY slice) AS t FROM rec) SELECT slice, epoch_us(ts) AS ts_us, pid, max(seq_nr) AS seq_nr FROM m WHERE ts = t GROUP BY slice, ts, pid")
def op_F16_latest_offset_by_slice(spark: SparkSession, d: str) -> DataFrame:
    return us(O.latest_offset_by_slice(records(spark, d)), "slice", "ts", "pid", "seq_nr")


@query(r"SELECT event_type || '-x-' || (event_id % 7) AS key, event_type || '-x' AS topic, (event_id % 7)::INT AS partition, count(*) AS n FROM events GROUP BY 1, 2, 3")
def op_F17_partition_keys(spark: SparkSession, d: str) -> DataFrame:
    key = S.topic_key(F.concat("event_type", F.lit("-x")), F.col("event_id") % 7)
    topic, partition = S.parse_topic_key(F.col("key"))
    return table(spark, d, "events").select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).select("key", topic.alias("topic"), partition.alias("partition"), "n")


@query(f"WITH {REC}, {_BY_SLICE} SELECT slice, epoch_us(ts) AS ts_us FROM bs ORDER BY ts DESC, slice DESC LIMIT 1")
def op_F18_latest_slice_offset(spark: SparkSession, d: str) -> DataFrame:
    return us(O.latest_by_slice(records(spark, d)).agg(F.max(F.struct("ts", "slice")).alias("m")).select("m.*"), "slice", "ts")


@query(f"WITH {REC} SELECT count(*) AS n, round(avg(epoch_us(consumed) - epoch_us(ts)), 3) AS mean_lag, max(epoch_us(consumed) - epoch_us(ts)) AS max_lag FROM rec")
def op_F19_consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    return O.consumer_lag(records(spark, d))


@query(f"WITH {REC} SELECT (SELECT epoch_us(max(ts)) // 1000 FROM env) AS source_ms, (SELECT epoch_us(max(ts)) // 1000 FROM rec WHERE ts < {SEEN_SQL}) AS offset_ms, (SELECT epoch_us(max(ts)) // 1000 FROM env) - (SELECT epoch_us(max(ts)) // 1000 FROM rec WHERE ts < {SEEN_SQL}) AS backlog_ms")
def op_F20_backlog(spark: SparkSession, d: str) -> DataFrame:
    return O.backlog(journal(spark, d), O.without_newer(records(spark, d), SEEN))


@query("SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_envelopes FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def op_F21_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return O.group_sizes(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("group_size")))


@query(f"WITH {REC} SELECT slice, pid, seq_nr FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY ts DESC, seq_nr DESC, pid) AS r FROM rec) WHERE r = 1")
def op_H1_top_per_slice(spark: SparkSession, d: str) -> DataFrame:
    return O.newest_per_slice(records(spark, d), 1).select("slice", "pid", "seq_nr")


@query(f"WITH {REC} SELECT pid, max(seq_nr) AS seq_nr FROM rec GROUP BY pid")
def op_H2_top_seq_nr(spark: SparkSession, d: str) -> DataFrame:
    return O.top_record(records(spark, d)).select("pid", "seq_nr")


@query(f"WITH {REC} SELECT pid, seq_nr, slice, rank FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY ts, slice, pid, seq_nr)::INT AS rank FROM rec)")
def op_H3_record_order(spark: SparkSession, d: str) -> DataFrame:
    return O.ranked(records(spark, d)).select("pid", "seq_nr", "slice", "rank")


@query(f"WITH {REC} SELECT projection_key, arg_max(pid, ts) AS newest_pid, arg_min(pid, ts) AS oldest_pid FROM rec GROUP BY projection_key")
def op_H4_max_min_by(spark: SparkSession, d: str) -> DataFrame:
    return O.newest_and_oldest(records(spark, d), "projection_key")


@query(f"WITH {REC}, {_BY_SLICE} SELECT slice, pid, seq_nr FROM bs WHERE projection_key <> 'k0' AND ts <= TIMESTAMP '2024-01-30 12:00:00'")
def op_H5_prefix(spark: SparkSession, d: str) -> DataFrame:
    return O.foreign_offsets(records(spark, d), "k0").where(F.col("ts") <= F.lit(datetime(2024, 1, 30, 12))).select("slice", "pid", "seq_nr")


@query("SELECT s_suppkey AS id, floor(abs(s_acctbal - 1000))::BIGINT AS distance FROM supplier ORDER BY floor(abs(s_acctbal - 1000)), s_suppkey LIMIT 1")
def op_H6_nearest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return H.nearest(s, F.floor(F.abs(F.col("s_acctbal") - 1000)).cast("long"))


@query(f"WITH {ENV} SELECT pid, seq_nr, age FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq_nr DESC)::INT AS age FROM env) WHERE age <= 25")
def op_H7_history(spark: SparkSession, d: str) -> DataFrame:
    return H.history(journal(spark, d), 25).select("pid", "seq_nr", "age")


@query("SELECT c_mktsegment AS value FROM customer WHERE c_nationkey < 10 UNION SELECT c_name FROM customer WHERE c_acctbal < 0 EXCEPT SELECT c_mktsegment FROM customer WHERE c_nationkey = 3 AND c_acctbal > 9000")
def op_J1_criteria_sets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    both = c.where("c_nationkey < 10").select(F.col("c_mktsegment").alias("value")).union(c.where("c_acctbal < 0").select("c_name")).distinct()
    return both.exceptAll(c.where("c_nationkey = 3 AND c_acctbal > 9000").select("c_mktsegment").distinct())


_LOG = "log AS (SELECT CASE WHEN event_type = 'error' THEN 'remove_' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN 'include_ids' ELSE 'exclude_ids' END AS kind, user_id::VARCHAR AS value, event_id AS seq_nr, event_id AS updated_at FROM events)"


def _filter_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.concat(F.when(F.col("event_type") == "error", "remove_").otherwise(""), F.when(F.col("event_id") % 2 == 0, "include_ids").otherwise("exclude_ids"))
    return table(spark, d, "events").select(kind.alias("kind"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("seq_nr"), F.col("event_id").alias("updated_at"))


@query(f"WITH {_LOG}, n AS (SELECT *, regexp_replace(kind, '^remove_', '') AS k, starts_with(kind, 'remove_') AS gone FROM log) SELECT k AS kind, value, max(seq_nr) FILTER (NOT gone) AS seq_nr FROM n GROUP BY k, value HAVING NOT arg_max(gone, updated_at)")
def op_J2_replicated_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_wins(_filter_log(spark, d))


@query("""WITH c AS (SELECT user_id::VARCHAR AS value, event_id AS seq_nr, 'r' || event_id % 3 AS replica, event_id AS counter, event_type = 'error' AS gone FROM events),
m AS (SELECT value, max(seq_nr) AS seq_nr FROM (SELECT *, max(CASE WHEN gone THEN counter END) OVER (PARTITION BY value, replica) AS last FROM c) WHERE NOT gone AND (last IS NULL OR counter > last) GROUP BY value)
SELECT 'include_ids' AS kind, value, seq_nr FROM m WHERE value::BIGINT % 10 <> 0 UNION ALL SELECT DISTINCT 'include_ids', user_id::VARCHAR, 7 FROM events WHERE user_id % 20 = 0""")
def op_J2b_or_set(spark: SparkSession, d: str) -> DataFrame:
    """Three replicas change a set of included ids by themselves and merge; one then removes ids while another adds some of them: these additions stay."""
    e = table(spark, d, "events")
    changes = e.select(F.lit("include_ids").alias("kind"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("seq_nr"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("replica"), F.col("event_id").alias("counter"), (F.col("event_type") == "error").alias("removed"))
    one, two, three = (orset.replica_state(changes.where(F.col("replica") == r)) for r in ("r0", "r1", "r2"))
    users = e.select(F.lit("include_ids").alias("kind"), F.col("user_id").cast("string").alias("value"), "user_id", F.lit(7).cast("long").alias("seq_nr")).distinct()
    all_three = orset.merged(orset.merged(one, two), three)
    return orset.merged(orset.removed(all_three, users.where("user_id % 10 = 0")), orset.added(three, users.where("user_id % 20 = 0"), "r2")).values()


@query(f"WITH {REC}, m AS (SELECT *, max(ts) OVER (PARTITION BY slice) AS t FROM rec) SELECT pid, seq_nr FROM m WHERE epoch_us(ts) >= epoch_us(t) - 432000000000 OR seq_nr % 2 = 1")
def op_J3_evict_union(spark: SparkSession, d: str) -> DataFrame:
    return O.evict(records(spark, d), 5 * 86_400, F.col("seq_nr") % 2 != 1).select("pid", "seq_nr")


@query(f"WITH {ENV} SELECT pid, seq_nr, event_id % 2 = 0 AS replayed FROM env WHERE event_id % 2 = 0 UNION ALL SELECT pid, seq_nr, false FROM env WHERE event_id % 2 = 1")
def op_J4_replay_union(spark: SparkSession, d: str) -> DataFrame:
    j, odd = journal(spark, d), F.col("event_id") % 2 == 1
    return V.replay_or_filter(j.where(odd), j.where(~odd).withColumn("filter_after", F.lit(0)), F.lit(True)).select("pid", "seq_nr", "replayed")


@query("SELECT c_custkey, c_mktsegment AS entity_type, c_name AS entity_id FROM customer")
def op_K1_id_parts(spark: SparkSession, d: str) -> DataFrame:
    pid = S.persistence_id(F.col("c_mktsegment"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.entity_type(pid).alias("entity_type"), S.entity_id(pid).alias("entity_id"))


@query("SELECT c_custkey, c_mktsegment || '|' || c_name AS pid FROM customer")
def op_K2_make_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.persistence_id(F.col("c_mktsegment"), F.col("c_name")).alias("pid"))


@query(f"WITH q AS (SELECT p_partkey, {sql_hash('p_name')} AS h FROM part) SELECT p_partkey, {sql_shard('h')} AS slice FROM q")
def op_K3_slice_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.slice_of(F.col("p_name")).alias("slice"))


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#0+[1-4][0-9]') AS hit FROM customer")
def op_K4_full_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.full_match(F.col("c_name"), "Customer#0+[1-4][0-9]").alias("hit"))


@query(f"WITH {ENV} SELECT event_id, starts_with(tags[2], 't:') AS is_topic, substr(tags[2], 3) AS topic FROM env")
def op_K5_prefix(spark: SparkSession, d: str) -> DataFrame:
    tag = F.col("tags")[1]
    return journal(spark, d).select("event_id", tag.startswith("t:").alias("is_topic"), tag.substr(F.lit(3), F.length(tag)).alias("topic"))


@query("SELECT event_id, len(string_split(event_type || '/' || (event_id % 3), '/')) AS levels, event_type || '/' || (event_id % 3) AS stripped FROM events")
def op_K6_split_strip(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit("//"))
    topic = S.strip_trailing_separators(raw)
    return table(spark, d, "events").select("event_id", F.size(F.split(topic, "/")).cast("long").alias("levels"), topic.alias("stripped"))


@query("SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, epoch_us(make_timestamp(epoch_us(ts))) AS back FROM events")
def op_K7_epochs(spark: SparkSession, d: str) -> DataFrame:
    us_ = S.to_micros(F.col("ts"))
    return table(spark, d, "events").select("event_id", us_.alias("us"), S.to_millis(F.col("ts")).alias("ms"), S.to_micros(S.from_micros(us_)).alias("back"))


@query("SELECT p_partkey, base64(p_name::BLOB) AS encoded, p_name AS decoded FROM part")
def op_K8_base64(spark: SparkSession, d: str) -> DataFrame:
    encoded = F.base64(F.encode("p_name", "UTF-8"))
    return table(spark, d, "part").select("p_partkey", encoded.alias("encoded"), F.decode(F.unbase64(encoded), "UTF-8").alias("decoded"))


_GEO = "geo AS (SELECT c_custkey AS id, ((c_custkey * 37) % 180 - 90) + (c_custkey % 7) / 10.0::DOUBLE AS lat, ((c_custkey * 91) % 360 - 180) + (c_custkey % 11) / 10.0::DOUBLE AS lon FROM customer)"


def _geo(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 37) % 180 - 90 + (k % 7) / F.lit(10.0)).alias("lat"), ((k * 91) % 360 - 180 + (k % 11) / F.lit(10.0)).alias("lon"))


@query(f"""WITH {_GEO}, a AS (SELECT id, sin(radians(lat - 59.3) / 2) AS x, sin(radians(lon - 18.1) / 2) AS y, cos(radians(lat)) * cos(radians(59.3)) AS c FROM geo), b AS (SELECT id, x * x + c * y * y AS v FROM a)
SELECT id, round(2 * atan2(sqrt(v), sqrt(1 - v)) * 6371000 / 10)::BIGINT AS tens_of_m FROM b""")
def op_K9_haversine(spark: SparkSession, d: str) -> DataFrame:
    """Rounded to ten metres, as the last digit may differ between mathematical libraries."""
    x, y = F.sin(F.radians(F.col("lat") - 59.3) / 2), F.sin(F.radians(F.col("lon") - 18.1) / 2)
    v = x * x + F.cos(F.radians("lat")) * F.cos(F.radians(F.lit(59.3))) * y * y
    return _geo(spark, d).select("id", F.round(2 * F.atan2(F.sqrt(v), F.sqrt(1 - v)) * S.EARTH_RADIUS_M / 10).cast("long").alias("tens_of_m"))


@query(f"WITH {_GEO} SELECT id, floor(lat * 100 + 0.5) / 100 AS lat, floor(lon * 100 + 0.5) / 100 AS lon FROM geo")
def op_K10_coarse(spark: SparkSession, d: str) -> DataFrame:
    return _geo(spark, d).select("id", S.coarse(F.col("lat")).alias("lat"), S.coarse(F.col("lon")).alias("lon"))


@query(f"WITH {ENV} SELECT pid, max(seq_nr) FILTER (event_type = 'click') AS last_click FROM env GROUP BY pid")
def op_K11_maps(spark: SparkSession, d: str) -> DataFrame:
    by_type = journal(spark, d).groupBy("pid", "event_type").agg(F.max("seq_nr").alias("n"))
    seen = by_type.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("seen"))
    return seen.select("pid", F.try_element_at("seen", F.lit("click")).alias("last_click"))


@query(f"WITH {ENV} SELECT event_id, list_has_any(tags, ['error', 't:click/1']) AS hit FROM env")
def op_K12_tags_overlap(spark: SparkSession, d: str) -> DataFrame:
    return journal(spark, d).select("event_id", F.arrays_overlap("tags", F.array(F.lit("error"), F.lit("t:click/1"))).alias("hit"))


@query("SELECT event_id, regexp_replace(md5('run-1:' || event_id), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS correlation_id FROM events")
def op_K13_correlation_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids by which a query and what it reads can be told in logs: from a run's seed and the key, so a task that runs again gives the same."""
    return table(spark, d, "events").select("event_id", S.correlation_id("run-1", F.col("event_id").cast("string")).alias("correlation_id"))


@query("SELECT 'carts' AS name, 'carts-' || k AS id FROM (VALUES ('a'), ('b'), ('c')) t(k)")
def op_K14_expand_ids(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.store import expand

    return spark.createDataFrame([(p.name, str(p)) for p in expand("carts", ["a", "b", "c"])], "name string, id string")


@query(f"WITH q AS (SELECT p_partkey, {sql_hash('p_name')} AS h FROM part) SELECT p_partkey, {sql_shard('h', 5)} AS partition FROM q")
def op_K15_key_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.key_partition(F.col("p_name")).alias("partition"))


@query("SELECT c_custkey, 'Cart|' || c_custkey || '|DCB' AS pid FROM customer")
def op_K16_replica_id(spark: SparkSession, d: str) -> DataFrame:
    pid = F.concat(F.lit("Cart|"), F.col("c_custkey").cast("string"), F.lit("|DCA"))
    return table(spark, d, "customer").select("c_custkey", S.with_replica(pid, "DCB").alias("pid"))
