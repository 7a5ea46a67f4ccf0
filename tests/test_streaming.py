import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import recovery as R
from tidemark.streaming.projection import Delivery, Projection, Runner, run_once
from tidemark.streaming.store import ProjectionId, ProjectionStore, expand
from tidemark.streaming.telemetry import Observer, ensemble

SCHEMA = "pid string, seq_nr long, slice int, ts timestamp, filtered boolean"


@pytest.fixture
def folder(tmp_path, spark):
    def add(lo, hi):
        spark.range(lo, hi).select(F.concat(F.lit("p|"), (F.col("id") % 3).cast("string")).alias("pid"), F.col("id").alias("seq_nr"), (F.col("id") % 3).cast("int").alias("slice"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 5 == 0).alias("filtered")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add(0, 10)
    return tmp_path, add


def projection(path, handler, **more):
    return Projection(**({"id": ProjectionId("n", "k"), "source": lambda s: s.readStream.schema(SCHEMA).parquet(str(path / "in")), "handler": handler, "restart": R.Restart(0, 0, 0, 2)} | more))


def test_restart_counts_each_event_once(spark, folder):
    path, add = folder
    p = projection(path, lambda rows, b: rows.select("seq_nr"), delivery=Delivery.EXACTLY_ONCE)
    Runner(spark, str(path / "store"), p).run()
    add(10, 25)
    runner = Runner(spark, str(path / "store"), p)
    runner.run()
    assert sorted(r[0] for r in runner.store.results().select("seq_nr").collect()) == [n for n in range(25) if n % 5]
    assert {(r["slice"], r["seq_nr"]) for r in runner.offset().collect()} == {(0, 24), (1, 22), (2, 23)}


@pytest.mark.parametrize("delivery,calls,seen", [(Delivery.AT_LEAST_ONCE, 2, 8), (Delivery.AT_MOST_ONCE, 1, None)])
def test_failure_in_the_handler(spark, folder, delivery, calls, seen):
    path, _ = folder
    made = []

    def handler(rows, batch):
        made.append(batch)
        if len(made) == 1:
            raise RuntimeError("once")
        return rows

    runner = Runner(spark, str(path / "store"), projection(path, handler, delivery=delivery))
    runner.run(sleep=lambda s: None)
    assert len(made) == calls
    results = runner.store.results()
    assert (results.count() if results is not None else None) == seen


def test_uncommitted_results_are_not_read(spark, tmp_path):
    store = ProjectionStore(spark, str(tmp_path), ProjectionId("a", "b"))
    store.write_result(0, spark.range(3))
    assert store.results() is None
    store.commit(0, spark.createDataFrame([], SCHEMA))
    assert store.results().count() == 3 and store.committed(0) and not store.committed(1)


def test_illegal_combinations(tmp_path):
    with pytest.raises(ValueError):
        projection(tmp_path, None, flow=True, delivery=Delivery.EXACTLY_ONCE)
    with pytest.raises(ValueError):
        projection(tmp_path, None, group_size=5, delivery=Delivery.AT_MOST_ONCE)
    with pytest.raises(ValueError):
        projection(tmp_path, None, recovery=R.retry_and_fail(1, 0), delivery=Delivery.AT_MOST_ONCE)


def test_pause_and_clear(spark, folder):
    path, _ = folder
    runner = Runner(spark, str(path / "store"), projection(path, lambda rows, b: rows))
    runner.pause()
    runner.run()
    assert runner.is_paused() and runner.offset().count() == 0
    runner.resume().awaitTermination()
    assert runner.offset().count() == 3
    runner.clear_offset()
    assert runner.offset().count() == 0


def test_observers_may_fail(spark, folder):
    class Bad(Observer):
        def before(self, projection, batch_id):
            raise RuntimeError("observer")

    path, _ = folder
    runner = Runner(spark, str(path / "store"), projection(path, lambda rows, b: rows, telemetry=ensemble([Bad()])))
    runner.run()
    assert runner.store.results().count() == 8


def test_supervision():
    tries, waits = [], []

    def run():
        tries.append(1)
        if len(tries) < 4:
            raise RuntimeError

    R.supervise(run, R.Restart(1, 3, 0), sleep=waits.append)
    assert waits == [1, 2, 3]
    with pytest.raises(RuntimeError):
        R.supervise(lambda: (_ for _ in ()).throw(RuntimeError()), R.Restart(max_restarts=0), sleep=waits.append)
    with pytest.raises(R.Aborted):
        R.supervise(lambda: (_ for _ in ()).throw(R.Aborted()), R.Restart(), sleep=waits.append)


def test_retry_unprocessed():
    written, fails = [], [True]

    def write(items):
        if fails.pop() if fails else False:
            written.extend(items[1:])
            return items[:1]
        written.extend(items)
        return []

    R.retry_unprocessed(write, list(range(30)), sleep=lambda s: None)
    assert sorted(written) == list(range(30))
    with pytest.raises(RuntimeError):
        R.retry_unprocessed(lambda items: items, [1], sleep=lambda s: None)


def test_ids():
    assert [str(i) for i in expand("n", ["a", "b"])] == ["n-a", "n-b"] and ProjectionId("a-b", "c") != ProjectionId("a", "b-c")


def test_handler_lifecycle(spark, folder):
    """A handler class is made anew after a failure, and each is started and stopped."""
    path, _ = folder
    log = []

    class Handler:
        def start(self):
            log.append("start")

        def stop(self):
            log.append("stop")

        def __call__(self, rows, batch):
            if log.count("start") == 1:
                raise RuntimeError("once")
            return rows

    runner = Runner(spark, str(path / "store"), projection(path, Handler))
    runner.run(sleep=lambda s: None)
    assert log == ["start", "stop", "start", "stop"] and runner.store.results().count() == 8


def test_stop_waits_for_the_batch_in_hand(spark, folder):
    path, _ = folder
    begun = threading.Event()

    def handler(rows, batch):
        begun.set()
        time.sleep(1)
        return rows

    runner = Runner(spark, str(path / "store"), projection(path, handler))
    runner.start(interval="1 second")
    assert begun.wait(60)
    runner.stop()
    assert runner.store.committed(0) and runner.store.results().count() == 8
    runner.stop()


def test_parallel_parts(spark, folder):
    """Each part of a batch has a number of its own; all are done before the offset is stored; a failing part fails the batch."""
    path, _ = folder
    seen = []

    def handler(rows, part):
        seen.append(part)
        if part == 1 and seen.count(1) == 1:
            raise RuntimeError("once")
        return rows.select("seq_nr")

    runner = Runner(spark, str(path / "store"), projection(path, handler, parallel=3))
    runner.run(sleep=lambda s: None)
    assert sorted(set(seen)) == [0, 1, 2] and seen.count(1) == 2
    assert sorted(r["seq_nr"] for r in runner.store.results().collect()) == [n for n in range(10) if n % 5]
    for more in ({"delivery": Delivery.EXACTLY_ONCE}, {"delivery": Delivery.AT_MOST_ONCE}):
        with pytest.raises(ValueError):
            projection(path, handler, parallel=2, **more)


def test_run_once(spark, tmp_path):
    rows = spark.createDataFrame([("p|1", 1, 0, None, False), ("p|1", 2, 0, None, True)], SCHEMA)
    store = run_once(spark, str(tmp_path / "store"), projection(tmp_path, lambda r, b: r.select("seq_nr")), rows)
    assert [r["seq_nr"] for r in store.results().collect()] == [1] and store.offsets().count() == 1


def commits(spark, store, numbers):
    for n in numbers:
        store.write_result(n, spark.range(n, n + 1))
        store.commit(n, spark.createDataFrame([(f"p|{n % 3}", n, n % 3, None, False)], SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq_nr") * 100)))


def test_the_log_is_compacted(spark, tmp_path):
    """Results and newest records stay the same, while few folders are left and merged ones go."""
    store = ProjectionStore(spark, str(tmp_path), ProjectionId("a", "b"), fan=3)
    commits(spark, store, range(20))
    log = store.log()
    assert len(log.offsets) <= 6 and len(log.results) <= 6 and log.last == 19
    assert sorted((r["id"], r["batch_id"]) for r in store.results().collect()) == [(n, n) for n in range(20)]
    newest = store.offsets().groupBy("pid").agg(F.max("seq_nr").alias("n")).collect()
    assert {(r["pid"], r["n"]) for r in newest} == {("p|0", 18), ("p|1", 19), ("p|2", 17)}
    on_disk = lambda kind: len([p for p in (tmp_path / "a" / "b" / kind).iterdir() if p.is_dir()])
    assert on_disk("offsets") <= 6 + 3 and on_disk("results") <= 6 + 3
    assert len(list((tmp_path / "a" / "b" / "log").glob("*.json"))) <= 2
    again = ProjectionStore(spark, str(tmp_path), ProjectionId("a", "b"))
    assert again.committed(19) and not again.committed(20) and again.results().count() == 20


def test_retention_in_the_store(spark, tmp_path):
    store = ProjectionStore(spark, str(tmp_path), ProjectionId("a", "b"), fan=4, retention_s=500)
    for n in range(4):
        rows = spark.createDataFrame([(f"p|{n}", n, 0, None, False)], SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq_nr") * 300))
        store.commit(n, rows)
    assert {r["pid"] for r in store.offsets().collect()} == {"p|2", "p|3"}


@pytest.mark.parametrize("count", [100, 10_000])
def test_folders_of_many_batches(count):
    """The folders that a read opens, by the rule that merges them: some FAN a level."""
    from tidemark.streaming.store import FAN, to_merge

    folders, most = (), 0
    for n in range(count):
        folders = (*folders, (0, str(n)))
        while found := to_merge(folders):
            level, names = found
            folders = (*(f for f in folders if f[1] not in names), (level + 1, f"{names[-1]}-{level + 1}"))
        most = max(most, len(folders))
    assert most < 3 * FAN


def test_a_crash_in_the_commit_shows_nothing(spark, tmp_path, monkeypatch):
    store = ProjectionStore(spark, str(tmp_path), ProjectionId("a", "b"))
    commits(spark, store, range(1))
    publish = ProjectionStore._publish
    monkeypatch.setattr(ProjectionStore, "_publish", lambda self, log: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        commits(spark, store, range(1, 2))
    monkeypatch.setattr(ProjectionStore, "_publish", publish)
    other = ProjectionStore(spark, str(tmp_path), ProjectionId("a", "b"))
    assert not other.committed(1) and other.results().count() == 1 and other.offsets().count() == 1
    commits(spark, other, range(1, 2))
    assert other.results().count() == 2


def test_offsets_set_by_slice_and_cleared(spark, folder):
    from datetime import UTC, datetime

    path, _ = folder
    runner = Runner(spark, str(path / "store"), projection(path, lambda rows, b: rows.select("seq_nr")))
    runner.run()
    at = lambda n: datetime.fromtimestamp(n, UTC)
    runner.update_offset({0: at(3), 1: at(100)})
    assert {(r["slice"], r["ts"].timestamp()) for r in runner.offset().collect()} == {(0, 3.0), (1, 100.0), (2, 8.0)}
    runner.run()
    got = sorted(r["seq_nr"] for r in runner.store.results().collect())
    assert got == sorted([n for n in range(10) if n % 5] + [6, 9])  # slice 0 after 3, nothing of 1 and 2
    runner.clear_offset()
    assert runner.offset().count() == 0 and runner.store.results().count() == 10
    runner.run()
    assert runner.store.results().count() == 18


@pytest.mark.parametrize("more,strategy,lost", [({}, R.skip(), {77}), ({}, R.retry_and_skip(2, 0), {77}), ({"group_size": 10}, R.skip(), set(range(70, 80)))])
def test_only_what_fails_is_skipped(spark, tmp_path, more, strategy, lost):
    """One envelope of 400 fails, or its group of ten: the calls are logarithmic in their number."""
    spark.range(400).select(F.lit("p|0").alias("pid"), F.col("id").alias("seq_nr"), F.lit(0).alias("slice"), F.timestamp_seconds("id").alias("ts"), F.lit(False).alias("filtered")).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []

    def handler(rows, batch):
        calls.append(batch)
        return rows.select(F.when(F.col("seq_nr") == 77, F.raise_error(F.lit("poison")).cast("long")).otherwise(F.col("seq_nr")).alias("seq_nr"))

    runner = Runner(spark, str(tmp_path / "store"), projection(tmp_path, handler, recovery=strategy, **more))
    runner.run()
    assert sorted(r["seq_nr"] for r in runner.store.results().collect()) == [n for n in range(400) if n not in lost]
    assert len(calls) <= 2 * 12 + 2 * (1 + strategy.retries)


def test_retries_lose_nothing(spark, folder):
    path, _ = folder
    calls = []

    def handler(rows, batch):
        calls.append(batch)
        bad = F.raise_error(F.lit("not yet")).cast("long") if len(calls) < 3 else F.col("seq_nr")
        return rows.select(bad.alias("seq_nr"))

    runner = Runner(spark, str(path / "store"), projection(path, handler, recovery=R.retry_and_skip(3, 0)))
    runner.run()
    assert len(calls) == 3 and runner.store.results().count() == 8


@pytest.mark.parametrize("more", [{"recovery": R.skip()}, {"recovery": R.retry_and_skip(2, 0), "delivery": Delivery.EXACTLY_ONCE}])
def test_single_envelopes_are_skipped_in_one_pass(spark, tmp_path, more):
    """However many fail: one job writes the results, and what is skipped is told once a micro-batch."""
    from tidemark.streaming.envelopes import EachEnvelope
    from tidemark.streaming.telemetry import Telemetry

    def call(envelope):
        if envelope["seq_nr"] % 2:
            raise ValueError(f"no {envelope['pid']}")
        return {"at": envelope["seq_nr"], "pid": envelope["pid"]} if envelope["seq_nr"] % 4 else None

    told = []

    class Telling(Telemetry):
        def error(self, projection, error, what):
            told.append((type(error).__name__, str(error), what))

    rows = spark.range(1, 2001).selectExpr("'p' AS pid", "id AS seq_nr", "1 AS slice", "timestamp_micros(id) AS ts", "false AS filtered")
    p = Projection(ProjectionId("each", "all"), lambda s: rows, EachEnvelope(call, "at long, pid string"), telemetry=Telling(), **more)
    store = run_once(spark, str(tmp_path), p, rows)
    assert sorted(r["at"] for r in store.results().collect()) == list(range(2, 2001, 4))
    assert told == [("Skipped", "1000 envelopes, one of them with ValueError: no p", "skip")]
    with pytest.raises(Exception, match="no p"):
        run_once(spark, f"{tmp_path}/fails", p.with_recovery(R.retry_and_fail(1, 0)), rows)
    with pytest.raises(ValueError):
        Projection(ProjectionId("each", "all"), lambda s: rows, p.handler, group_size=2)


def test_parts_are_micro_batches_whatever_their_size(spark, tmp_path, monkeypatch):
    """Parts of many and of few rows, and one of none, have as many files each, and each is one micro-batch."""
    from tidemark.plans import streams as S

    monkeypatch.setattr(S, "FILE_ROWS", 100)
    rows = spark.range(1000).selectExpr("id AS event_id", "CASE WHEN id < 997 THEN 0 ELSE 2 END AS part")
    batches = S._batches(rows, str(tmp_path / "in"), "part")
    seen = []
    stream = batches.stream(spark, rows.schema)
    stream.writeStream.foreachBatch(lambda b, n: seen.append((n, b.count(), b.selectExpr("max(part)").first()[0]))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert batches.each == 4 and [s for s in seen if s[1]] == [(0, 997, 0), (2, 3, 2)]


def test_hashes_of_short_and_long_strings(spark):
    from tidemark.functions.scalars import string_hash

    def expected(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) % (1 << 32)
        return h - (1 << 32) if h >= 1 << 31 else h

    texts = ["", "a", "user|1234567", "x" * 31, "z|" * 16, "z|" * 16 + "9", "~" * 200]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", string_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {**{t: expected(t) for t in texts}, None: None}


def test_stored_parts_hold_the_envelopes(spark, sf_dir):
    """A stream over stored parts reads slices, which it doesn't compute in every pass; parts of rows that enough tasks read aren't shuffled."""
    from tidemark.plans import streams as S

    for batches in (S._in_batches(spark, sf_dir), S._at_once(spark, sf_dir)):
        held = spark.read.parquet(batches.folder)
        want = S._as_table(spark, sf_dir).drop("user_id")
        assert held.columns == want.columns and held.count() == want.count() and held.exceptAll(want).isEmpty()
        plan = S._events(sf_dir, batches)(spark)._jdf.queryExecution().analyzed().toString()
        assert "ascii" not in plan


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_parts_of_rows_in_any_number_of_pieces(spark, tmp_path, monkeypatch, pieces):
    from tidemark.plans import streams as S

    monkeypatch.setattr(S, "FILE_ROWS", 100)
    rows = S.stored(spark.range(0, 3000, 1, pieces).selectExpr("id AS event_id"))
    batches = S._batches(rows, str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * batches.each
    seen = []
    query = batches.stream(spark, rows.schema).writeStream.foreachBatch(lambda b, n: seen.append((n, b.selectExpr("count(*)", "min(event_id % 3)", "max(event_id % 3)").first()[:])))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(n, (1000, n, n)) for n in range(3)]
