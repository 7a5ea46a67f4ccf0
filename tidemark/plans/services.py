"""Queries A, B, L and N that run a service end to end: message logs, ingest, publishing, registries, replication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import filters as L
from tidemark.operators import handlers as H
from tidemark.operators import offsets as O
from tidemark.operators import registry as G
from tidemark.operators import transform as T
from tidemark.operators import validation as V
from tidemark.plans.base import ENV, REC, journal, query, records, table, us
from tidemark.plans.streams import _projection, _root
from tidemark.session import stored
from tidemark.sources import journal as J
from tidemark.sources.custom import MadeEventsSource
from tidemark.streaming import recovery as R
from tidemark.streaming import tables as B
from tidemark.streaming.projection import Delivery, Projection, Runner
from tidemark.streaming.store import ProjectionId

_LOG = "log AS (SELECT event_type AS topic, (user_id % 3)::INT AS partition, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1 AS \"offset\", event_id FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as a message log: topics by type, three partitions each."""
    part = (F.col("user_id") % 3).cast("int")
    nr = F.row_number().over(Window.partitionBy("event_type", part).orderBy("event_id")).cast("long") - 1
    return table(spark, d, "events").select(F.col("event_type").alias("topic"), part.alias("partition"), nr.alias("offset"), "event_id")


@query(f'WITH {_LOG} SELECT topic, partition, "offset", event_id FROM log WHERE topic IN (\'click\', \'view\') AND "offset" >= CASE WHEN topic = \'click\' AND partition = 1 THEN 42 WHEN topic = \'view\' AND partition = 0 THEN 8 ELSE 0 END')
def op_A14_message_log(spark: SparkSession, d: str) -> DataFrame:
    """Two topics from their stored offsets; partitions without one from the beginning."""
    import json

    topics = [(t, p) for t in ("click", "view") for p in range(3)]
    start = json.loads(J.starting_offsets(topics, {("click", 1): 41, ("view", 0): 7}))
    first = [(t, int(p), max(o, 0)) for t, ps in start.items() for p, o in ps.items()]
    from_ = spark.createDataFrame(first, "topic string, partition int, first long")  # one row a partition
    return _log(spark, d).join(F.broadcast(from_), ["topic", "partition"]).where(F.col("offset") >= F.col("first")).select("topic", "partition", "offset", "event_id")


@query(f'WITH {_LOG} SELECT topic, partition, min("offset") AS beginning, max("offset") + 1 AS "end" FROM log GROUP BY topic, partition')
def op_A16_partition_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("topic", "partition").agg(F.min("offset").alias("beginning"), (F.max("offset") + 1).alias("end"))


@query(f"WITH {ENV} SELECT p.pid, p.seq_nr, epoch_us(p.ts) AS ts_us, p.payload, n.n FROM env p JOIN (SELECT pid, count(*) AS n FROM env WHERE seq_nr BETWEEN 2 AND 9 GROUP BY pid) n USING (pid) WHERE p.seq_nr = 2")
def op_A18_remote_queries(spark: SparkSession, d: str) -> DataFrame:
    """Time, envelope and range of several ids at once, as a consumer asks a producer for them."""
    j = journal(spark, d)
    keys = j.where("seq_nr = 2").select("pid", "seq_nr")
    ranges = j.where("seq_nr BETWEEN 2 AND 9").groupBy("pid").agg(F.count("*").alias("n"))
    found = J.load_envelopes(keys, j.select("pid", "seq_nr", "payload")).join(J.timestamps_of(keys, j), ["pid", "seq_nr"]).join(ranges, "pid")
    return us(found, "pid", "seq_nr", "ts", "payload", "n")


@query(f"WITH {ENV} SELECT 'member|' || entity_id AS pid, seq_nr, CASE WHEN event_type <> 'error' THEN upper(payload) END AS payload, event_type = 'error' AS filtered FROM env WHERE event_id % 9 <> 0")
def op_A19_push_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A producer's events, some sent twice, transformed and written once into the consumer's journal."""
    j = journal(spark, d).where("event_id % 9 <> 0")
    sent = j.unionByName(j.where("event_id % 4 = 0"))
    t = T.Transformation().register("error", lambda: F.lit(None).cast("string")).register_or_else(lambda: F.upper(F.col("payload")))
    own = T.map_ids(T.transform_payload(sent, t), lambda p: F.regexp_replace(p, r"^user\|", "member|"))
    return own.dropDuplicates(["pid", "seq_nr"]).select("pid", "seq_nr", "payload", "filtered")


@query("SELECT 'made|' || (n % 7) AS pid, n // 7 + 1 AS seq_nr, n AS \"offset\", n * 1000 AS created_us FROM range(250, 20000) t(n)")
def op_A22_custom_source(spark: SparkSession, d: str) -> DataFrame:
    """A source of one's own, read from a stored offset."""
    spark.dataSource.register(MadeEventsSource)
    return spark.read.format("made_events").option("count", 20_000).option("entities", 7).option("start", 249).load().select("pid", "seq_nr", "offset", "created_us")


_BY_KEY = "bs AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY slice ORDER BY ts DESC, pid DESC, seq_nr DESC) = 1), bk AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY projection_key ORDER BY ts DESC, pid DESC, seq_nr DESC) = 1), s AS (SELECT * FROM bk ORDER BY ts, pid LIMIT 1)"


@query(f"WITH {REC}, {_BY_KEY} SELECT e.event_id, e.pid, e.seq_nr FROM env e, s WHERE e.ts >= s.ts AND NOT (e.pid = s.pid AND e.seq_nr <= s.seq_nr)")
def op_A24_resume_point(spark: SparkSession, d: str) -> DataFrame:
    """Where several instances resume: events from the start offset on, without what was seen at it."""
    start = O.start_offset(records(spark, d)).select(F.col("ts").alias("s_ts"), F.col("pid").alias("s_pid"), F.col("seq_nr").alias("s_nr"))  # one row
    j = journal(spark, d).crossJoin(F.broadcast(start)).where("ts >= s_ts AND NOT (pid = s_pid AND seq_nr <= s_nr)")
    return j.select("event_id", "pid", "seq_nr")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 7.5 GROUP BY event_type")
def op_B2_session_sql(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("tidemark_events")
    return B.Session(spark).select("SELECT event_type, count(*) AS n FROM tidemark_events WHERE value > :least GROUP BY event_type", least=7.5)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def op_B11_batched_writes(spark: SparkSession, d: str) -> DataFrame:
    """Items written in batches of 25, of which a store hands some back at first."""
    counts = [tuple(r) for r in table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).collect()]
    written, refused = [], {counts[0][0]} if counts else set()

    def write(items: list) -> list:
        left = [i for i in items if i[0] in refused]
        refused.clear()
        written.extend(i for i in items if i not in left)
        return left

    R.retry_unprocessed(write, counts, sleep=lambda s: None)
    return spark.createDataFrame(written, "event_type string, n long")


@query("SELECT * FROM (VALUES ('offset_store', 6::BIGINT), ('projection_management', 4), ('timestamp_offset_store', 7)) t(name, columns)")
def op_B14_create_tables(spark: SparkSession, d: str) -> DataFrame:
    prefix = f"t{uuid.uuid4().hex[:12]}_"
    B.create_tables(spark, prefix)
    B.create_tables(spark, prefix)
    found = [(name, len(spark.table(prefix + name).columns)) for name in B.TABLES]
    B.drop_tables(spark, prefix)
    return spark.createDataFrame(found, "name string, columns long")


@query(f"WITH {ENV} SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 4 <> 1 THEN payload END AS payload, NOT (event_type = 'click' AND event_id % 4 <> 1) AS filtered FROM env WHERE value > 1 AND event_type IN ('click', 'view')")
def op_B16_producer_service(spark: SparkSession, d: str) -> DataFrame:
    """The order on the producer's side: its own filter and the consumer's drop rows; origin and transformation give filtered events."""
    origin = F.when(F.col("event_id") % 4 == 1, "DCB").otherwise("DCA")
    consumer = L.passes(L.EventFilter.of(L.criterion("exclude_regex", [".*"]), L.criterion("include_topics", ["click/#", "view/+"])))
    t = T.Transformation().register("click", lambda: F.col("payload")).register_or_else(lambda: F.lit(None).cast("string"))
    marked = T.mark_by_origin(journal(spark, d).withColumn("origin_replica", origin), T.excluded_origins("DCA", "DCB", []))
    return T.publish(marked, F.col("value") > 1, consumer, t).select("event_id", "payload", "filtered")


@query("SELECT 'user|' || user_id AS key, '{\"id\":' || event_id || '}' AS value FROM events WHERE event_type = 'purchase'")
def op_B17_to_message_log(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values as a message log's writer takes them."""
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return J.log_records(e, F.concat(F.lit("user|"), F.col("user_id").cast("string")), F.col("event_id").alias("id"))


@query("SELECT * FROM (VALUES ('a', 3::BIGINT), ('b', 7)) t(key, \"offset\")")
def op_B18_memory_store(spark: SparkSession, d: str) -> DataFrame:
    store = B.MemoryOffsetStore()
    store.save({"a": 2, "b": 7})
    store.save(3, "a")
    return spark.createDataFrame([(k, store.read(k)) for k in ("a", "b")], "key string, offset long")


@query(f"WITH {ENV} SELECT pid, count(*) AS n, sum(CASE WHEN seq_nr > 1 THEN 1 ELSE 0 END)::BIGINT AS steps FROM env GROUP BY pid")
def op_D17_ordered_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys side by side, each in order: rows of a key follow one another with the next number."""
    steps = F.sum(F.col("follows").cast("long")).alias("steps")
    return H.in_order(journal(spark, d).select("pid", "seq_nr")).groupBy("pid").agg(F.count("*").alias("n"), steps)


@query(f'WITH {_LOG} SELECT topic || \'-\' || partition AS key, max("offset") AS "offset", count(*) AS n FROM log GROUP BY 1')
def op_D18_by_partition_key(spark: SparkSession, d: str) -> DataFrame:
    """A batch of several partitions: each partition's rows are handled together and give its own offset."""
    from tidemark.functions.scalars import topic_key

    return _log(spark, d).groupBy(topic_key(F.col("topic"), F.col("partition")).alias("key")).agg(F.max("offset").alias("offset"), F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('at_least_once', 'flow', true), ('at_least_once', 'group', true), ('at_least_once', 'retry', true), ('at_most_once', 'flow', false), ('at_most_once', 'group', false), ('at_most_once', 'retry', false), ('exactly_once', 'flow', false), ('exactly_once', 'group', true), ('exactly_once', 'retry', true)) t(delivery, with_, allowed)")
def op_E10_combinations(spark: SparkSession, d: str) -> DataFrame:
    more = {"flow": {"flow": True}, "group": {"group_size": 20}, "retry": {"recovery": R.retry_and_fail(2, 0)}}
    rows = []
    for delivery in Delivery:
        for name, extra in more.items():
            try:
                Projection(ProjectionId("x", "y"), lambda s: s.range(0), lambda rows, b: rows, delivery, **extra)
                rows.append((delivery.value, name, True))
            except ValueError:
                rows.append((delivery.value, name, False))
    return spark.createDataFrame(rows, "delivery string, with_ string, allowed boolean")


@query("SELECT * FROM (VALUES ('abort', 1::BIGINT), ('restart', 3)) t(how, runs)")
def op_L7_abort(spark: SparkSession, d: str) -> DataFrame:
    """An aborted projection isn't restarted, a failed one is."""

    def runs(error: type[Exception]) -> int:
        calls = []

        def run() -> None:
            calls.append(1)
            raise error

        try:
            R.supervise(run, R.Restart(0, 0, 0, 2), sleep=lambda s: None)
        except (R.Aborted, RuntimeError):
            pass
        return len(calls)

    return spark.createDataFrame([("abort", runs(R.Aborted)), ("restart", runs(RuntimeError))], "how string, runs long")


@query("SELECT count(*) AS n FROM events WHERE event_type <> 'error'")
def op_L16_run_until_done(spark: SparkSession, d: str) -> DataFrame:
    """A test kit's run: to the end of the input, then look at the results."""
    runner = Runner(spark, _root(spark), _projection(d, "kit", handler=lambda rows, b: rows.select("event_id")))
    runner.run(sleep=lambda s: None)
    return runner.store.results().agg(F.count("*").alias("n"))


_SITES = "w AS (SELECT event_id, 'Cart|' || user_id AS pid, CASE event_id % 3 WHEN 0 THEN 'DCA' WHEN 1 THEN 'DCB' ELSE 'DCC' END AS origin_replica, floor(value)::BIGINT AS delta FROM events)"


@query(f"WITH {_SITES} SELECT r.replica, w.pid, sum(delta)::BIGINT AS total, count(*) AS n FROM w, (VALUES ('DCA'), ('DCB'), ('DCC')) r(replica) GROUP BY r.replica, w.pid")
def op_L14_replication(spark: SparkSession, d: str) -> DataFrame:
    """Three replicas write and read one another; events are sent by any and taken from their origin, once; all come to the same state."""
    m = F.col("event_id") % 3
    written = table(spark, d, "events").select("event_id", F.concat(F.lit("Cart|"), F.col("user_id").cast("string")).alias("pid"), F.when(m == 0, "DCA").when(m == 1, "DCB").otherwise("DCC").alias("origin_replica"), F.floor("value").cast("long").alias("delta"))
    sites, out = ["DCA", "DCB", "DCC"], None
    for me in sites:
        settings = T.ReplicationSettings(me, tuple(s for s in sites if s != me))
        state = written.where(F.col("origin_replica") == me)
        for other in settings.others:
            # The other replica holds all events by now; what it didn't write comes from its origin or is one's own.
            sent = T.mark_by_origin(written, settings.excluded_by(other))
            state = state.unionByName(T.for_handler(sent).select(*written.columns))
        row = state.groupBy("pid").agg(F.sum("delta").alias("total"), F.count("*").alias("n")).select(F.lit(me).alias("replica"), "pid", "total", "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT * FROM (VALUES ('exclude_tags', 'é'), ('include_ids', 'x')) t(kind, value)")
def op_L17_filter_serialisation(spark: SparkSession, d: str) -> DataFrame:
    criteria = [L.criterion("exclude_tags", ["é"]), L.criterion("include_ids", {"x": 4})]
    back = G.from_json(G.to_json(criteria))
    assert back == criteria
    return L.criteria_frame(spark, back).select("kind", "value")


@query("SELECT * FROM (VALUES ('after_merge', 'exclude_tags', 'b', 0::BIGINT), ('after_merge', 'include_ids', 'x', 4), ('replay', 'include_ids', 'x', 4), ('subscribed', 'exclude_tags', 'a', 0), ('subscribed', 'exclude_tags', 'b', 0)) t(step, kind, value, seq_nr)")
def op_N1_filter_registry(spark: SparkSession, d: str) -> DataFrame:
    """Subscribe, read, update, and what the update asks to be read again."""
    registry = G.FilterRegistry(spark, f"{_root(spark)}/filters")
    registry.subscribe("s", [L.criterion("exclude_tags", ["a", "b"])])
    registry.subscribe("other", [L.criterion("exclude_tags", ["z"])])
    first = registry.current("s")
    replays = registry.update("s", [L.criterion("remove_exclude_tags", ["a"]), L.criterion("include_ids", {"x": 4})])
    step = lambda name, f: [(name, c.kind, v, n) for c in f.criteria() for v, n in c.values]
    rows = step("subscribed", first) + step("after_merge", registry.current("s")) + [("replay", "include_ids", v, n) for v, n in replays.items()]
    return spark.createDataFrame(rows, "step string, kind string, value string, seq_nr long")


@query(f"WITH {ENV} SELECT event_id FROM env WHERE pid = 'user|8' AND seq_nr >= 3 UNION ALL SELECT event_id FROM env WHERE pid = 'user|46' AND seq_nr >= 5 AND (event_type <> 'error' OR seq_nr < 9)")
def op_N3_replay_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests as rows: ids, from which number, and below which number the filter doesn't count."""
    asked = spark.createDataFrame([("user|8", 3, 1_000_000_000), ("user|46", 5, 9)], "pid string, from_nr long, filter_after long")
    passes = L.passes(L.EventFilter.of(L.criterion("exclude_tags", ["error"])))
    found = journal(spark, d).join(asked, "pid").where("seq_nr >= from_nr")
    return found.where((F.col("seq_nr") < F.col("filter_after")) | passes).select("event_id")


@query(f"WITH {ENV} SELECT event_id, seq_nr FROM env WHERE event_type <> 'click'")
def op_N9_acknowledged_pushes(spark: SparkSession, d: str) -> DataFrame:
    """What is in flight after acknowledgements; none of them is for something that wasn't sent."""
    sent = journal(spark, d)
    left, unknown = G.match_acks(sent, sent.where("event_type = 'click'"))
    assert not unknown.take(1)
    return left.select("event_id", "seq_nr")


@query("SELECT event_type AS projection_key, max(event_id)::VARCHAR AS current_offset, 'LNG' AS manifest FROM events WHERE event_type <> 'error' GROUP BY event_type")
def op_B6_table_offset_store(spark: SparkSession, d: str) -> DataFrame:
    """Create, save, save again, clear and read offsets in the catalogue; the last save after a clear counts."""
    prefix = f"t{uuid.uuid4().hex[:12]}_"
    B.create_tables(spark, prefix)
    store, other = B.TableOffsetStore(spark, "mine", prefix), B.TableOffsetStore(spark, "other", prefix)
    kept = table(spark, d, "events").groupBy(F.col("event_type").alias("projection_key")).agg(F.max("event_id").alias("last"), F.min("event_id").alias("first"))
    offsets = lambda c: kept.select("projection_key", F.col(c).alias("current_offset"), F.lit("LNG").alias("manifest"))
    other.save(offsets("first"))
    store.save(offsets("first"))
    store.clear()
    store.save(offsets("last").where("projection_key <> 'error'"))
    rows = store.read().collect()  # one row a key, read before the tables go
    assert other.read().count() == kept.count()
    B.drop_tables(spark, prefix)
    return spark.createDataFrame(rows, "projection_key string, current_offset string, manifest string")


@query("SELECT event_type AS projection_key, max(event_id)::VARCHAR AS current_offset, (SELECT count(DISTINCT event_type) FROM events) AS refused FROM events WHERE event_type = 'click' GROUP BY 1")
def op_B10_single_offsets(spark: SparkSession, d: str) -> DataFrame:
    """A store of single offsets takes one key's; offsets of several keys at once are refused, and what was stored stays."""
    prefix = f"t{uuid.uuid4().hex[:12]}_"
    B.create_tables(spark, prefix)
    store = B.TableOffsetStore(spark, "single", prefix, mergeable=False)
    keys = table(spark, d, "events").groupBy(F.col("event_type").alias("projection_key")).agg(F.max("event_id").cast("string").alias("current_offset")).withColumn("manifest", F.lit("LNG"))
    store.save(keys.where("projection_key = 'click'"))
    refused = 0
    try:
        store.save(keys)
    except ValueError:
        refused = keys.count()
    kept = stored(store.read().select("projection_key", "current_offset", F.lit(refused).cast("long").alias("refused")))
    B.drop_tables(spark, prefix)
    return kept


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def op_C26_interceptors(spark: SparkSession, d: str) -> DataFrame:
    """Every type is a stream of its own; an interceptor lets through requests with the right token only."""
    events = table(spark, d, "events").select("event_id", "event_type")
    types = ("click", "error", "purchase", "signup", "view")
    streams = {t: events.where(F.col("event_type") == t) for t in types}

    def token(stream_id: str, metadata) -> None:
        if metadata.get("token") != f"{stream_id}-token":
            raise PermissionError(stream_id)

    out = events.limit(0)
    for stream_id, metadata in [("click", {"token": "click-token"}), ("view", {}), ("error", {"token": "click-token"}), ("purchase", {"token": "purchase-token"})]:
        try:
            out = out.unionByName(G.intercepted(streams, stream_id, metadata, [token]))
        except PermissionError:
            pass
    return out


@query(f"WITH {ENV}, h AS (SELECT pid, max(seq_nr) AS done FROM env WHERE event_id % 3 = 0 GROUP BY pid), a AS (SELECT pid, max(seq_nr) AS top FROM env WHERE event_type <> 'error' GROUP BY pid), f AS (SELECT a.pid, a.top FROM a LEFT JOIN h USING (pid) WHERE done IS NULL OR done < top) SELECT env.pid, env.seq_nr, coalesce(env.seq_nr <= f.top, false) AS in_flight FROM env LEFT JOIN f USING (pid)")
def op_D9_in_flight(spark: SparkSession, d: str) -> DataFrame:
    """Events but errors are accepted, every third is stored; what an entity has in flight is above what is stored for it."""
    j = journal(spark, d).select("event_id", "event_type", "pid", "seq_nr")
    flying = V.in_flight(j.where("event_type <> 'error'"), j.where("event_id % 3 = 0"))
    return V.is_in_flight(j, flying).select("pid", "seq_nr", "in_flight")


@query("WITH t AS (SELECT DISTINCT event_type, epoch_us(ts) AS us FROM events), n AS (SELECT *, lead(us) OVER (PARTITION BY event_type ORDER BY us) AS next FROM t) SELECT event_type, unnest(range(us + 60000000, next, 60000000)) AS tick_us FROM n WHERE next - us > 60000000")
def op_G6_keep_alive(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of each type's stream for every minute without an event."""
    return H.keep_alive(table(spark, d, "events"), 60, "event_type")


@query(f"WITH {ENV} SELECT pid, seq_nr, CASE WHEN event_type <> 'view' THEN upper(payload) END AS payload, event_type = 'view' AS filtered FROM env WHERE event_type NOT IN ('error', 'click') OR pid IN ('user|8', 'user|46')")
def op_N6_push_destination(spark: SparkSession, d: str) -> DataFrame:
    """A destination tells the producer its filter at the start; the producer sends what passes, twice, and the destination keeps it once."""
    criteria = (L.criterion("exclude_tags", ["error", "click"]), L.criterion("include_ids", {"user|8": 0, "user|46": 0}))
    t = T.Transformation().register("view", lambda: F.lit(None).cast("string")).register_or_else(lambda: F.upper(F.col("payload")))
    destination = G.PushDestination(frozenset({"users"}), criteria, t)
    sent = G.push(journal(spark, d), destination.start("users"))
    return destination.ingest(sent.unionByName(sent)).select("pid", "seq_nr", "payload", "filtered")
