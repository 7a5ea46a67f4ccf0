"""Queries C, D and N: filters, transformations, sequence validation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import filters as L
from tidemark.operators import offsets as O
from tidemark.operators import transform as T
from tidemark.operators import validation as V
from tidemark.plans.base import ARRIVAL, CHG, DIRTY, ENV, REC, changes, dirty, journal, query, records, sql_until, table, until, us
from tidemark.streaming.filtering import marked, replays_of

EV = ("event_id", "pid", "seq_nr")


def _passing(where: str) -> str:
    return f"WITH {ENV} SELECT event_id, pid, seq_nr FROM env WHERE {where}"


def _filtered(spark: SparkSession, d: str, *criteria: L.Criterion) -> DataFrame:
    return L.filter_events(journal(spark, d), L.EventFilter.of(*criteria)).select(*EV)


@query(_passing("value > 5"))
def op_C1_producer_filter(spark: SparkSession, d: str) -> DataFrame:
    """A producer's own filter, with no filter of the consumer's and payloads as they are."""
    return T.publish(journal(spark, d), F.col("value") > 5, F.lit(True), T.Transformation.identity()).select(*EV)


@query(_passing("list_has_any(tags, ['t:click/0', 't:view/0', 't:error/0', 't:signup/0', 't:purchase/0'])"))
def op_C2_topic_producer_filter(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.scalars import tags_match_topic

    return journal(spark, d).where(tags_match_topic(F.col("tags"), "+/0")).select(*EV)


@query(_passing("NOT (list_contains(tags, 'error') OR pid IN ('user|3', 'user|5') OR regexp_full_match(entity_id, '1.*')) OR list_contains(tags, 't:click/1') OR pid = 'user|5' OR regexp_full_match(entity_id, '12.')"))
def op_C3_filter_matches(spark: SparkSession, d: str) -> DataFrame:
    c = L.criterion
    return _filtered(spark, d, c("exclude_tags", ["error"]), c("exclude_ids", ["user|3", "5"]), c("exclude_regex", ["1.*"]), c("include_tags", ["t:click/1"]), c("include_ids", {"user|5": 0}), c("include_regex", ["12."]))


@query(_passing("NOT list_has_any(tags, ['error', 'view'])"))
def op_C4_exclude_tags(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, L.criterion("exclude_tags", ["error", "view", "click"]), L.criterion("remove_exclude_tags", ["click"]))


@query(_passing("list_has_any(tags, ['error', 'view'])"))
def op_C5_include_tags(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, L.criterion("exclude_regex", [L.EXCLUDE_ALL]), L.criterion("include_tags", ["error", "view", "x"]), L.criterion("remove_include_tags", ["x"]))


@query(_passing("event_type IN ('click', 'view') AND (event_type = 'click' OR event_id % 3 = 2)"))
def op_C6_include_topics(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, L.criterion("exclude_regex", [L.EXCLUDE_ALL]), L.criterion("include_topics", ["click/#", "view/2", "error"]))


@query(_passing("NOT regexp_full_match(entity_id, '[0-4].*')"))
def op_C7_exclude_regex(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, L.criterion("exclude_regex", ["[0-4].*", "9.*"]), L.criterion("remove_exclude_regex", ["9.*"]))


@query(_passing("regexp_full_match(entity_id, '[0-4].')"))
def op_C8_include_regex(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, L.criterion("exclude_regex", [L.EXCLUDE_ALL]), L.criterion("include_regex", ["[0-4]."]))


@query(_passing("user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"))
def op_C9_exclude_ids_join(spark: SparkSession, d: str) -> DataFrame:
    """A set of ids too large to list, as a join that Spark may broadcast by its size."""
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return journal(spark, d).join(ids, "user_id", "left_anti").select(*EV)


@query(f"""WITH {ENV}, i AS (SELECT DISTINCT user_id, user_id % 4 AS from_nr FROM events WHERE user_id % 5 = 1) SELECT event_id, pid, seq_nr FROM env JOIN i USING (user_id) WHERE epoch_us(ts) > {sql_until(2)}
UNION ALL SELECT event_id, pid, seq_nr FROM env JOIN i USING (user_id) WHERE from_nr >= 1 AND seq_nr >= from_nr AND epoch_us(ts) <= {sql_until(2)}""")
def op_C10_include_ids_replay(spark: SparkSession, d: str) -> DataFrame:
    """Including ids with a number of 1 or more also reads their earlier events again, from that number: one join for any number of ids."""
    j, half = journal(spark, d), until(spark, d, 2)
    ids = table(spark, d, "events").where("user_id % 5 = 1").select("user_id").distinct()
    none = L.criteria_frame(spark, [L.criterion("exclude_regex", [L.EXCLUDE_ALL])])
    criteria = none.unionByName(ids.select(F.lit("include_ids").alias("kind"), F.col("user_id").cast("string").alias("value"), (F.col("user_id") % 4).alias("seq_nr")))
    late = F.unix_micros("ts") > half
    live = marked(j.where(late), criteria, "passes").where("passes").drop("passes")
    again = j.where(~late).join(replays_of(none, criteria, j), "pid").where(F.col("seq_nr") >= F.col("from_nr")).drop("from_nr")
    return live.unionByName(again).select(*EV)


@query("SELECT * FROM (VALUES ('exclude_ids', 'a', 0::BIGINT), ('exclude_ids', 'b', 0), ('exclude_ids', 'd', 0), ('include_ids', 'c', 2)) t(kind, value, seq_nr)")
def op_C11_add_remove_criteria(spark: SparkSession, d: str) -> DataFrame:
    c = L.criterion
    merged = L.merge([c("exclude_ids", ["a", "b", "c"]), c("include_ids", {"b": 1, "c": 2})], [c("exclude_ids", ["d"]), c("remove_include_ids", ["a", "b"]), c("remove_exclude_ids", ["c"])])
    return L.criteria_frame(spark, merged.criteria())


@query("SELECT event_id, event_type = 'click' AS plus, event_id % 3 = 1 AS one, event_type = 'error' AND event_id % 3 = 1 AS exact, true AS every, event_type = 'view' AS deep, false AS parent FROM events")
def op_C12_topic_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Topics end in a slash: wildcards don't see it, exact expressions do, and a level must follow where # stands."""
    from tidemark.functions.scalars import topic_matches

    topic = F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit("/"))
    cases = {"plus": "click/+", "one": "+/1", "exact": "error/1/", "every": "#", "deep": "view/#", "parent": "click/1/#"}
    return table(spark, d, "events").select("event_id", *(topic_matches(topic, e).alias(k) for k, e in cases.items()))


_CRIT = """a AS (SELECT 'include_ids' AS kind, user_id::VARCHAR AS value, event_id AS seq_nr FROM events WHERE event_id % 3 = 0),
b AS (SELECT CASE WHEN event_type = 'error' THEN 'remove_include_ids' ELSE 'include_ids' END AS kind, user_id::VARCHAR AS value, event_id AS seq_nr FROM events WHERE event_id % 41 = 1)"""


def _criteria(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    row = lambda kind: (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")
    a = e.where("event_id % 3 = 0").select(row("include_ids"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("seq_nr"))
    b = e.where("event_id % 41 = 1").select(row(F.when(F.col("event_type") == "error", "remove_include_ids").otherwise("include_ids")), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("seq_nr"))
    return a, b


@query(f"WITH {_CRIT}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT kind, value, max(seq_nr) AS seq_nr FROM u WHERE kind = 'include_ids' AND value NOT IN (SELECT value FROM u WHERE kind = 'remove_include_ids') GROUP BY kind, value")
def op_C13_merge_filters(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_frames(*_criteria(spark, d))


@query(f"""WITH {_CRIT}, x AS (SELECT value, max(seq_nr) AS n FROM a GROUP BY value), y AS (SELECT value, max(seq_nr) AS m FROM b WHERE kind = 'include_ids' GROUP BY value)
SELECT 'include_ids' AS kind, value, m AS seq_nr FROM y LEFT JOIN x USING (value) WHERE n IS NULL OR m > n UNION ALL SELECT 'remove_include_ids', value, 0 FROM x WHERE value NOT IN (SELECT value FROM y)""")
def op_C14_filter_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _criteria(spark, d)
    return L.diff_frames(a, b.where("kind = 'include_ids'"))


_REPLICA = "CASE event_id % 4 WHEN 0 THEN 'DCA' WHEN 1 THEN 'DCB' WHEN 2 THEN 'DCC' ELSE 'DCD' END"


def _replicated(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("event_id") % 4
    origin = F.when(r == 0, "DCA").when(r == 1, "DCB").when(r == 2, "DCC").otherwise("DCD")
    return journal(spark, d).withColumn("origin_replica", origin).withColumn("origin_pid", F.concat("pid", F.lit("|"), "origin_replica")).withColumn("origin_seq_nr", F.col("seq_nr"))


@query(f"WITH {ENV} SELECT event_id, {_REPLICA} IN ('DCB', 'DCC') AS filtered FROM env")
def op_C16_origin_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.mark_by_origin(_replicated(spark, d), T.excluded_origins("DCA", "DCB", ["DCA", "DCC"])).select("event_id", "filtered")


@query(f"WITH {ENV}, a AS (SELECT pid, {_REPLICA} AS o, max(seq_nr) AS acked FROM env WHERE epoch_us(ts) <= {sql_until(2)} GROUP BY 1, 2) SELECT event_id, coalesce(seq_nr <= acked, false) AS filtered FROM (SELECT *, {_REPLICA} AS o FROM env) LEFT JOIN a USING (pid, o)")
def op_C17_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    e = _replicated(spark, d)
    return T.mark_acknowledged(e, e.where(F.unix_micros("ts") <= until(spark, d, 2)).select("origin_pid", "origin_seq_nr")).select("event_id", "filtered")


@query(f"""WITH {ENV}, a AS (SELECT pid, slice // 256 AS stream, max(seq_nr) AS acked, max(event_id) AS t FROM env WHERE event_type <> 'error' GROUP BY 1, 2),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY stream ORDER BY t DESC, pid) <= 10) SELECT event_id, coalesce(seq_nr <= acked, false) AS filtered FROM env LEFT JOIN c USING (pid)""")
def op_C17b_ack_cache(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgements of all events but errors, in a cache of ten entities a stream: those acknowledged longest ago are forgotten, and their events pass. An entity's numbers and ids don't rise together, so the last to raise its number counts."""
    j = journal(spark, d).withColumn("stream", F.expr("slice div 256")).withColumn("origin_pid", F.col("pid")).withColumn("origin_seq_nr", F.col("seq_nr"))
    acks = j.where("event_type <> 'error'").withColumn("at", F.max("event_id").over(Window.partitionBy("pid").orderBy("seq_nr")))
    return T.mark_acknowledged(j, T.ack_cache(acks, "stream", 10)).select("event_id", "filtered")


@query("SELECT event_id, (event_id % 5)::INT AS partition FROM events WHERE event_id % 5 IN (0, 3)")
def op_C18_offset_verification(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("partition"))
    return T.assigned_only(e, [0, 3])


def _mapped() -> T.Transformation:
    upper = lambda: F.upper(F.col("payload"))
    t = T.Transformation().register("click", upper).register("click", lambda: F.concat(F.lit("c:"), "payload"))
    return t.register("view", lambda: F.when(F.col("value") > 10, F.col("payload"))).register_or_else(lambda: F.lit(None).cast("string"))


_MAP_SQL = "CASE WHEN event_type = 'click' THEN 'c:' || payload WHEN event_type = 'view' AND value > 10 THEN payload END"


@query(f"WITH {ENV} SELECT pid, max(seq_nr) AS last_seq_nr, count({_MAP_SQL}) AS handled FROM env GROUP BY pid")
def op_C19_filtered_skip(spark: SparkSession, d: str) -> DataFrame:
    """Filtered events don't reach the handler, but the offset passes them."""
    t = T.transform_payload(journal(spark, d), _mapped())
    handled = T.for_handler(t).groupBy("pid").agg(F.count("*").alias("handled"))
    return T.for_handler(t, flow=True).groupBy("pid").agg(F.max("seq_nr").alias("last_seq_nr")).join(handled, "pid", "left").select("pid", "last_seq_nr", F.coalesce("handled", F.lit(0).cast("long")).alias("handled"))


@query(f"WITH {ENV} SELECT event_id, {_MAP_SQL} AS payload, ({_MAP_SQL}) IS NULL AS filtered FROM env WHERE value > 1")
def op_C20_transformation(spark: SparkSession, d: str) -> DataFrame:
    return T.publish(journal(spark, d), F.col("value") > 1, F.lit(True), _mapped()).select("event_id", "payload", "filtered")


@query(f"WITH {ENV}, m AS (SELECT *, replace(pid, 'user|', 'member|x') AS npid FROM env) SELECT event_id, npid AS pid, 'member' AS entity_type, list_append(tags, 'moved') AS t, len(tags) + 1 AS n_tags FROM m".replace("list_append(tags, 'moved') AS t, ", ""))
def op_C21_map_tags_ids(spark: SparkSession, d: str) -> DataFrame:
    moved = T.map_ids(T.map_tags(journal(spark, d), lambda t: F.array_append(t, F.lit("moved"))), lambda p: F.regexp_replace(p, r"^user\|", "member|x"))
    return moved.select("event_id", "pid", "entity_type", F.size("tags").cast("long").alias("n_tags"))


@query(f"WITH {ENV} SELECT event_id, CASE WHEN {_REPLICA} = 'DCA' THEN upper(payload) WHEN {_REPLICA} = 'DCB' THEN NULL ELSE payload END AS payload, {_REPLICA} = 'DCB' AS filtered FROM env")
def op_C22_by_origin(spark: SparkSession, d: str) -> DataFrame:
    t = T.Transformation
    made = T.by_origin(_replicated(spark, d), {"DCA": t(or_else=lambda: F.upper(F.col("payload"))), "DCB": t(or_else=lambda: F.lit(None).cast("string"))}, t.identity(), origin="origin_replica")
    return made.select("event_id", "payload", "filtered")


@query(f"WITH {ENV} SELECT event_id, 'state:' || payload AS payload FROM env WHERE seq_nr % 10 = 0")
def op_C23_snapshot_events(spark: SparkSession, d: str) -> DataFrame:
    return T.snapshots_as_events(journal(spark, d).where("seq_nr % 10 = 0"), F.concat(F.lit("state:"), "payload")).select("event_id", "payload")


@query(f"WITH {ENV} SELECT event_id, CASE WHEN value > 10 THEN 'big' ELSE event_type END AS metadata FROM env")
def op_C24_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = journal(spark, d).withColumn("metadata", F.col("event_type"))
    return T.transform_metadata(e, F.when(F.col("value") > 10, "big")).select("event_id", "metadata")


@query(f"WITH {ENV} SELECT DISTINCT pid, slice BETWEEN 300 AND 600 AS handled FROM env")
def op_C25_slice_handled(spark: SparkSession, d: str) -> DataFrame:
    return journal(spark, d).select("pid", F.col("slice").between(300, 600).alias("handled")).distinct()


def _fold(first: str, ok: str, dup: str) -> str:
    """A strict fold in SQL over dirty; f is the state, s the row."""
    return f"""WITH RECURSIVE {DIRTY}, f AS (
SELECT pid, rn, seq_nr, l_partkey, l_suppkey, CASE WHEN {first} THEN seq_nr ELSE 0 END AS stored, CASE WHEN {first} THEN ts END AS st, CASE WHEN {first} THEN 'accepted' ELSE 'rejected' END AS verdict FROM dirty WHERE rn = 1
UNION ALL SELECT s.pid, s.rn, s.seq_nr, s.l_partkey, s.l_suppkey, CASE WHEN {ok} THEN s.seq_nr ELSE f.stored END, CASE WHEN {ok} THEN s.ts ELSE f.st END,
CASE WHEN {ok} THEN 'accepted' WHEN {dup} THEN 'duplicate' ELSE 'rejected' END FROM f JOIN dirty s ON s.pid = f.pid AND s.rn = f.rn + 1)
SELECT pid, seq_nr, l_partkey, l_suppkey, verdict FROM f"""


DV = ("pid", "seq_nr", "l_partkey", "l_suppkey", "verdict")
_RESET = "f.stored > 0 AND s.ts > f.st + INTERVAL 90 DAY"


@query(_fold("true", "(f.stored = 0 OR s.seq_nr = f.stored + 1)", "f.stored > 0 AND s.seq_nr <= f.stored"))
def op_D1_validate(spark: SparkSession, d: str) -> DataFrame:
    """An unknown id's first event is accepted whatever its number, as no earlier event is found."""
    return V.validate(dirty(spark, d).drop("slice"), ARRIVAL).select(*DV)


@query(_fold("true", "(f.stored = 0 OR s.seq_nr = f.stored + 1)", "f.stored > 0 AND s.seq_nr <= f.stored").replace("SELECT pid, seq_nr, l_partkey, l_suppkey, verdict FROM f", "SELECT pid, seq_nr, count(*) AS n FROM f WHERE verdict = 'duplicate' GROUP BY pid, seq_nr"))
def op_D2_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return V.validate(dirty(spark, d).drop("slice"), ARRIVAL).where(F.col("verdict") == V.DUPLICATE).groupBy("pid", "seq_nr").agg(F.count("*").alias("n"))


@query(_fold("seq_nr = 1", "(s.seq_nr = f.stored + 1)", "f.stored > 0 AND s.seq_nr <= f.stored"))
def op_D3_strict_next(spark: SparkSession, d: str) -> DataFrame:
    """Without looking for earlier events: an unknown id begins with number 1."""
    return V.validate(dirty(spark, d).drop("slice"), ARRIVAL, unknown_accepted=False).select(*DV)


@query(f"WITH {DIRTY} SELECT pid, seq_nr, l_partkey, l_suppkey, CASE WHEN seq_nr > coalesce(max(seq_nr) OVER (PARTITION BY pid ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 'accepted' ELSE 'duplicate' END AS verdict FROM dirty")
def op_D4_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_relaxed(dirty(spark, d), ARRIVAL).select(*DV)


@query(_fold("seq_nr = 1", f"(s.seq_nr = f.stored + 1 OR s.seq_nr = 1 AND {_RESET})", f"f.stored > 0 AND s.seq_nr <= f.stored AND NOT ({_RESET})"))
def op_D5_sequence_reset(spark: SparkSession, d: str) -> DataFrame:
    return V.validate(dirty(spark, d).drop("slice"), ARRIVAL, reset_after_s=90 * 86_400, unknown_accepted=False).select(*DV)


@query(f"""WITH {ENV}, firsts AS (SELECT * FROM env WHERE epoch_us(ts) > {sql_until(2)} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq_nr) = 1), r AS (SELECT slice, max(ts) AS m FROM env WHERE epoch_us(ts) <= {sql_until(3)} GROUP BY slice)
SELECT f.pid, f.seq_nr, CASE WHEN f.seq_nr = 1 OR p.ts IS NULL OR epoch_us(p.ts) < epoch_us(m) - 86400000000 THEN 'accepted' ELSE 'rejected' END AS verdict
FROM firsts f LEFT JOIN env p ON p.pid = f.pid AND p.seq_nr = f.seq_nr - 1 AND p.event_id % 7 <> 0 LEFT JOIN r ON r.slice = f.slice""")
def op_D6_event_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Unknown ids that begin above 1 are accepted if the event before is gone or older than the retention of their slice."""
    j = journal(spark, d)
    first = j.where(F.unix_micros("ts") > until(spark, d, 2)).groupBy("pid").agg(F.min_by(F.struct("seq_nr", "ts", "slice", "event_id"), "seq_nr").alias("m")).select("pid", "m.*")
    ready = V.with_previous(first, j.where("event_id % 7 <> 0"), 86_400, j.where(F.unix_micros("ts") <= until(spark, d, 3)))
    return V.validate(ready, ["seq_nr"]).select("pid", "seq_nr", "verdict")


@query(_fold("true", "(f.stored = 0 OR s.seq_nr = f.stored + 1)", "f.stored > 0 AND s.seq_nr <= f.stored").replace("SELECT pid, seq_nr, l_partkey, l_suppkey, verdict FROM f", "SELECT pid, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'duplicate') AS duplicates, count(*) FILTER (verdict = 'rejected') AS rejected FROM f GROUP BY pid"))
def op_D7_validate_all(spark: SparkSession, d: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return V.validate(dirty(spark, d).drop("slice"), ARRIVAL).groupBy("pid").agg(n(V.ACCEPTED).alias("accepted"), n(V.DUPLICATE).alias("duplicates"), n(V.REJECTED).alias("rejected"))


@query(f"WITH {REC}, s AS (SELECT pid, max(seq_nr) AS stored FROM rec WHERE ts < TIMESTAMP '2024-01-15' GROUP BY pid) SELECT event_id, stored, CASE WHEN stored IS NOT NULL AND seq_nr <= stored THEN 'duplicate' ELSE 'accepted' END AS verdict FROM env LEFT JOIN s USING (pid)")
def op_D8_load_on_demand(spark: SparkSession, d: str) -> DataFrame:
    stored = O.without_newer(records(spark, d), datetime(2024, 1, 15))
    return V.validate_relaxed(V.with_state(journal(spark, d), stored), ["seq_nr"]).select("event_id", "stored", "verdict")


@query(f"WITH {ENV} SELECT pid, max(seq_nr) AS seq_nr, epoch_us(arg_max(ts, seq_nr)) AS ts_us FROM env GROUP BY pid")
def op_D10_state_add(spark: SparkSession, d: str) -> DataFrame:
    j = journal(spark, d)
    return us(O.add_records(j.where("event_id % 2 = 0"), j.where("event_id % 2 = 1")), "pid", "seq_nr", "ts")


@query(f"WITH {REC}, m AS (SELECT *, max(ts) OVER (PARTITION BY slice) AS t FROM rec) SELECT slice, pid, seq_nr FROM m WHERE epoch_us(ts) >= epoch_us(t) - 300000000")
def op_D11_evict(spark: SparkSession, d: str) -> DataFrame:
    return O.evict(records(spark, d), 300).select("slice", "pid", "seq_nr")


@query(f"WITH {ENV}, g AS (SELECT * FROM env WHERE event_id % 23 <> 0), w AS (SELECT pid, max(seq_nr) AS last FROM g GROUP BY pid) SELECT pid, count(*) AS accepted, max(seq_nr) AS last_seq_nr FROM env JOIN w USING (pid) WHERE seq_nr <= last GROUP BY pid")
def op_D12_replay(spark: SparkSession, d: str) -> DataFrame:
    """A stream with lost events: what is rejected is read again from the journal, and then every entity is complete."""
    j = journal(spark, d)
    lossy = j.where("event_id % 23 <> 0")
    first = V.validate(lossy, ["seq_nr"], unknown_accepted=False)
    again, _ = V.replay(V.missing_ranges(first), j)
    ok = first.where(F.col("verdict") == V.ACCEPTED).select("pid", "seq_nr").unionByName(again.select("pid", "seq_nr"))
    return V.validate(ok.withColumn("ts", F.lit(None).cast("timestamp")), ["seq_nr"], unknown_accepted=False).where(F.col("verdict") == V.ACCEPTED).groupBy("pid").agg(F.count("*").alias("accepted"), F.max("seq_nr").alias("last_seq_nr"))


@query(f"WITH {ENV}, g AS (SELECT * FROM env WHERE event_id % 23 <> 0) SELECT g.pid, min(g.seq_nr) AS triggered_by FROM g LEFT JOIN g p ON p.pid = g.pid AND p.seq_nr = g.seq_nr - 1 WHERE g.seq_nr > 1 AND p.pid IS NULL GROUP BY g.pid")
def op_D13_trigger_replay(spark: SparkSession, d: str) -> DataFrame:
    """Of each entity the first number that was rejected, which asks for a replay."""
    done = V.validate(journal(spark, d).where("event_id % 23 <> 0"), ["seq_nr"], unknown_accepted=False)
    return done.where((F.col("verdict") == V.REJECTED) & (F.col("seq_nr") > 1)).groupBy("pid").agg(F.min("seq_nr").alias("triggered_by"))


#: A request of a replay: every error asks for its entity from ten numbers before, those of even ids without an end of what passes.
_ASKS = "SELECT pid, greatest(seq_nr - 10, 1) AS from_nr, CASE WHEN event_id % 2 = 0 THEN 0 ELSE seq_nr END AS filter_after, event_id AS asked FROM env WHERE event_type = 'error'"
#: The rule for replayed events of request r: below filter_after, of which 0 is the highest number, they pass; else the filter decides.
_FREE = "e.seq_nr < CASE WHEN r.filter_after = 0 THEN 9223372036854775807 ELSE r.filter_after END OR e.event_type <> 'error'"


def _asks(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select("pid", F.greatest(F.col("seq_nr") - 10, F.lit(1)).alias("from_nr"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("seq_nr")).cast("long").alias("filter_after"), F.col("event_id").alias("asked"))


@query(f"WITH {ENV}, r AS ({_ASKS}) SELECT e.event_id, r.asked FROM r JOIN env e ON e.pid = r.pid AND e.seq_nr >= r.from_nr AND e.seq_nr < r.from_nr + 20 WHERE {_FREE}")
def op_N4_filter_after(spark: SparkSession, d: str) -> DataFrame:
    """Every request's first twenty events: those before filter_after pass the filter by, the others don't; 0 is no limit."""
    j = journal(spark, d)
    again = _asks(j).join(j, "pid").where(F.col("seq_nr").between(F.col("from_nr"), F.col("from_nr") + 19))
    passes = L.passes(L.EventFilter.of(L.criterion("exclude_tags", ["error"])))
    return V.replay_or_filter(j.limit(0), again, passes).select("event_id", "asked")


@query(f"WITH {ENV}, g AS (SELECT * FROM env WHERE event_id % 23 <> 0), m AS (SELECT pid, min(seq_nr) AS lo, max(seq_nr) AS hi FROM g GROUP BY pid), s AS (SELECT pid, unnest(generate_series(lo, hi)) AS seq_nr FROM m) SELECT s.pid, s.seq_nr, g.pid IS NULL AS filler FROM s LEFT JOIN g ON g.pid = s.pid AND g.seq_nr = s.seq_nr")
def op_D19_fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    return V.fill_gaps(journal(spark, d).where("event_id % 23 <> 0"))


@query(f"WITH {CHG} SELECT pid, revision, 'accepted' AS verdict FROM chg WHERE revision % 3 <> 0")
def op_D4b_durable_state_gaps(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_relaxed(changes(spark, d).where("revision % 3 <> 0").withColumnRenamed("revision", "seq_nr"), ["seq_nr"]).select("pid", F.col("seq_nr").alias("revision"), "verdict")


@query(f"WITH {_CRIT}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT kind, value, max(seq_nr) AS seq_nr FROM u WHERE kind = 'include_ids' AND value NOT IN (SELECT value FROM u WHERE kind = 'remove_include_ids') GROUP BY kind, value")
def op_N7_local_filter_store(spark: SparkSession, d: str) -> DataFrame:
    a, b = _criteria(spark, d)
    return L.merge_frames(a.limit(0), a.unionByName(b))


@query("SELECT * FROM (VALUES ('exclude_tags', 'a', 0::BIGINT), ('include_ids', 'x', 4)) t(kind, value, seq_nr)")
def op_N8_filter_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Criteria in order: what was removed and added later stays."""
    c = L.criterion
    state = L.EventFilter().apply_in_order([c("exclude_tags", ["a", "b"]), c("include_ids", {"x": 4}), c("remove_exclude_tags", ["a", "b"]), c("exclude_tags", ["a"])])
    return L.criteria_frame(spark, state.criteria())


@query(f"WITH {ENV} SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'DCB' END, 'DCA') AS origin_replica, coalesce(CASE WHEN event_id % 3 = 0 THEN seq_nr + 100 END, seq_nr) AS origin_seq_nr FROM env")
def op_N10_replication_defaults(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("event_id") % 3 == 0
    e = journal(spark, d).withColumn("origin_replica", F.when(third, "DCB")).withColumn("origin_seq_nr", F.when(third, F.col("seq_nr") + 100))
    return T.with_replication_defaults(e, "DCA").select("event_id", "origin_replica", "origin_seq_nr")


@query(f"WITH {REC} SELECT epoch_us(ts) AS ts_us, slice, pid, max(seq_nr) AS seq_nr FROM (SELECT *, max(ts) OVER (PARTITION BY slice) AS t FROM rec WHERE NOT list_contains(CASE WHEN seq_nr % 5 = 0 THEN ['error'] ELSE [] END, 'error') OR pid = 'user|8') WHERE ts = t GROUP BY ts, slice, pid")
def op_F2_filtered_latest_offset(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: stored events through a filter, then the latest offset of each slice."""
    tagged = records(spark, d).withColumn("tags", F.when(F.col("seq_nr") % 5 == 0, F.array(F.lit("error"))).otherwise(F.array().cast("array<string>")))
    kept = L.filter_events(tagged, L.EventFilter.of(L.criterion("exclude_tags", ["error"]), L.criterion("include_ids", ["user|8"])))
    return us(O.latest_offset_by_slice(kept), "ts", "slice", "pid", "seq_nr")
