import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import criterion
from tidemark.operators.handlers import keep_alive
from tidemark.operators.registry import FilterRegistry, PushDestination, from_json, intercepted, push, to_json
from tidemark.operators.transform import Transformation, excluded_origins, transform_payload
from tidemark.operators.validation import in_flight, is_in_flight
from tidemark.sources.custom import MadeEventsSource
from tidemark.sources.journal import starting_offsets
from tidemark.streaming.tables import MemoryOffsetStore, Session, TableOffsetStore, create_tables, drop_tables


def test_registry(spark, tmp_path):
    registry = FilterRegistry(spark, str(tmp_path / "filters"))
    assert registry.current("s").criteria() == []
    registry.subscribe("s", [criterion("exclude_tags", "ab")])
    assert registry.update("s", [criterion("include_ids", {"x": 2, "y": 0})]) == {"x": 2}
    assert registry.update("s", [criterion("include_ids", {"x": 2})]) == {}
    assert registry.update("s", [criterion("remove_exclude_tags", "ab"), criterion("remove_include_ids", "xy")]) == {}
    assert registry.current("s").criteria() == []
    df = spark.createDataFrame([("p|1", ["a"])], "pid string, tags array<string>")
    assert registry.apply("s", df).count() == 1 and registry.apply("unknown", df).count() == 1


def test_criteria_as_json():
    criteria = [criterion("exclude_tags", ["é", '"']), criterion("include_ids", {"x": 4})]
    assert from_json(to_json(criteria)) == criteria


def test_custom_stream(spark, tmp_path):
    spark.dataSource.register(MadeEventsSource)
    stream = spark.readStream.format("made_events").option("count", 60).option("entities", 4).option("batch", 25).load()
    query = stream.writeStream.format("memory").queryName("made_test").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("made_test").agg(F.count("*"), F.countDistinct("offset")).first()[:] == (60, 60)


def test_tables_and_session(spark):
    create_tables(spark, "tt_")
    rows = spark.createDataFrame([("n", "k", "5", "LNG", False, 1)], spark.table("tt_offset_store").schema)
    session = Session(spark)
    session.append("tt_offset_store", rows)
    assert session.select_one("SELECT current_offset FROM tt_offset_store WHERE projection_name = :n", n="n")[0] == "5"
    drop_tables(spark, "tt_")


def test_memory_store_rejects_mergeable_offsets():
    with pytest.raises(ValueError):
        MemoryOffsetStore(mergeable=False).save({"a": 1})


def test_unknown_type_fails_without_or_else(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "event_type string, payload string")
    t = Transformation().register("a", lambda: F.upper(F.col("payload")))
    with pytest.raises(Exception, match="no transformation"):
        transform_payload(df, t).collect()
    assert {r["payload"] for r in transform_payload(df, Transformation.identity()).collect()} == {"x", "y"}


def test_excluded_origins():
    assert excluded_origins("A", "B", ["A", "C"]) == {"B", "C"}
    assert excluded_origins("A", "B", ["C"], enabled=False) == {"B"}
    assert excluded_origins("A", "", []) == set()


def test_starting_offsets():
    assert starting_offsets([("a", 0), ("a", 1)], {("a", 1): 4}) == '{"a": {"0": -2, "1": 5}}'


def test_table_store(spark):
    create_tables(spark, "ts_")
    try:
        rows = lambda *r: spark.createDataFrame(r, "projection_key string, current_offset string, manifest string")
        store = TableOffsetStore(spark, "n", "ts_")
        assert store.read().count() == 0
        store.clear()
        store.save(rows(("a", "1", "LNG"), ("b", "2", "LNG")))
        store.save(rows(("a", "3", "LNG")))
        assert {(r[0], r[1]) for r in store.read().collect()} == {("a", "3"), ("b", "2")}
        store.clear()
        assert store.read().count() == 0 and TableOffsetStore(spark, "m", "ts_").read().count() == 0
        with pytest.raises(ValueError):
            TableOffsetStore(spark, "s", "ts_", mergeable=False).save(rows(("a", "1", "LNG"), ("b", "2", "LNG")))
    finally:
        drop_tables(spark, "ts_")


def test_in_flight(spark):
    accepted = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("c", 5), (None, 1)], "pid string, seq_nr long")
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", 7)], "pid string, seq_nr long")
    flying = in_flight(accepted, stored)
    assert {tuple(r) for r in flying.collect()} == {("a", 3), (None, 1)}
    asked = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1)], "pid string, seq_nr long")
    assert {tuple(r) for r in is_in_flight(asked, flying).collect()} == {("a", 3, True), ("a", 4, False), ("b", 1, False)}
    assert in_flight(accepted, stored, limit=3).count() == 2
    with pytest.raises(Exception, match="too many envelopes in flight"):
        in_flight(accepted, stored, limit=2).collect()
    assert in_flight(accepted.limit(0), stored, limit=1).count() == 0


def test_keep_alive(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (0, 10), (0, 16), (1, 3)], "slice int, s long").select("slice", F.timestamp_seconds("s").alias("ts"))
    assert sorted(tuple(r) for r in keep_alive(df, 5).collect()) == [(0, 5_000_000), (0, 15_000_000)]


def test_push_destination(spark):
    def closed(stream_id, metadata):
        if metadata.get("token") != "t":
            raise PermissionError("no token")

    destination = PushDestination(frozenset({"s"}), (criterion("exclude_tags", ["x"]),), interceptors=(closed,))
    for stream_id, metadata in (("s", None), ("other", {"token": "t"})):
        with pytest.raises(PermissionError):
            destination.start(stream_id, metadata)
    events = spark.createDataFrame([("p|1", 1, ["x"]), ("p|1", 2, [])], "pid string, seq_nr long, tags array<string>")
    sent = push(events, destination.start("s", {"token": "t"}))
    assert [r["seq_nr"] for r in destination.ingest(sent.union(sent)).collect()] == [2]
    with pytest.raises(KeyError):
        intercepted({}, "s", {})
