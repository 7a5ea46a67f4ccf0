"""Replay of rejected events within a running stream."""

from datetime import UTC, datetime, timedelta

import pytest

from tidemark.streaming import recovery as R
from tidemark.streaming.projection import Delivery, Projection, Runner, rate_limited
from tidemark.streaming.store import ProjectionId

SCHEMA = "pid string, seq_nr long, slice int, ts timestamp, event string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def event(pid, n, ms):
    return (pid, n, 1 if pid == "a" else 2, START + timedelta(milliseconds=ms), f"{pid}-{n}")


#: Two entities; the first lacks number 4, the second number 2.
GAPS = [event("a", 1, 0), event("a", 2, 1), event("b", 1, 2), event("b", 3, 4), event("a", 3, 5), event("a", 5, 7)]
#: What a later read of the same time gives, with repeats.
BACK = [event("a", 2, 1), event("b", 2, 3), event("b", 3, 4), event("a", 3, 5), event("a", 4, 6), event("a", 5, 7), event("b", 4, 8), event("a", 6, 9)]
WHOLE = sorted({*GAPS, *BACK})


def run(spark, root, batches, journal, reset_after_s=None, schema=SCHEMA, restarts=0):
    """Projects batches, one file a micro-batch; gives (batch_id, event) in order of batch, entity and number."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    p = Projection(
        ProjectionId("replay", "all"), lambda s: rate_limited(s, f"{root}/in", schema, 1), lambda rows, b: rows.select("pid", "seq_nr", "event"), Delivery.EXACTLY_ONCE,
        restart=R.Restart(0, 0, 0, restarts), journal=lambda s: s.createDataFrame(journal, SCHEMA), reset_after_s=reset_after_s,
    )
    runner = Runner(spark, f"{root}/store", p)
    runner.run()
    rows = runner.store.results()
    return [(r["batch_id"], r["event"]) for r in rows.orderBy("batch_id", "pid", "seq_nr").collect()] if rows is not None else []


def test_gaps_are_read_again(spark, tmp_path):
    got = run(spark, tmp_path, [GAPS], WHOLE)
    assert got == [(0, "a-1"), (0, "a-2"), (0, "a-3"), (0, "b-1"), (1, "a-4"), (1, "a-5"), (1, "b-2"), (1, "b-3")]


def test_later_reads_repeat_nothing(spark, tmp_path):
    got = run(spark, tmp_path, [GAPS, BACK], WHOLE)
    assert sorted(e for _, e in got) == sorted(e for *_, e in WHOLE)
    assert sorted(got) == got and [e for _, e in got if e[0] == "a"] == [f"a-{n}" for n in range(1, 7)]


def test_a_short_replay_fails_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="replay of a from 4 to 4 has 0 events"):
        run(spark, tmp_path, [GAPS], [e for e in WHOLE if e[4] != "a-4"])


def test_what_the_journal_no_longer_has_isnt_waited_for(spark, tmp_path):
    late = [event("c", n, n) for n in (7, 8, 10)]
    assert [e for _, e in run(spark, tmp_path / "gone", [late], [event("c", n, n) for n in range(7, 11)])] == ["c-7", "c-8", "c-9", "c-10"]
    # Earlier events that are there come first; of some only, the replay is short.
    assert [e for _, e in run(spark, tmp_path / "there", [late], [event("c", n, n) for n in range(1, 11)])] == [f"c-{n}" for n in range(1, 11)]
    with pytest.raises(Exception, match="replay of c from 1 to 6 has 2 events"):
        run(spark, tmp_path / "some", [late], [event("c", n, n) for n in range(5, 11)])


def test_numbers_that_begin_anew(spark, tmp_path):
    hour = 3_600_000
    again = [event("a", 1, hour), event("a", 2, hour + 1)]
    got = run(spark, tmp_path, [[event("a", 1, 0), event("a", 2, 1), event("a", 3, 2)], again], again, reset_after_s=600)
    assert got == [(0, "a-1"), (0, "a-2"), (0, "a-3"), (1, "a-1"), (1, "a-2")]


def test_published_events_dont_ask(spark, tmp_path):
    schema = f"{SCHEMA}, origin string"
    rows = [(*event("a", 1, 0), None), (*event("a", 3, 2), "pubsub")]
    assert run(spark, tmp_path, [rows], WHOLE, schema=schema) == [(0, "a-1")]


def test_a_crash_after_the_answer(spark, tmp_path, monkeypatch):
    """The micro-batch that asked runs again: its answer is there once, and each event counts once."""
    from tidemark.streaming.store import ProjectionStore

    commit, failed = ProjectionStore.commit, []

    def once(self, batch_id, rows):
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("crash")
        commit(self, batch_id, rows)

    monkeypatch.setattr(ProjectionStore, "commit", once)
    got = run(spark, tmp_path, [GAPS], WHOLE, restarts=1)
    assert sorted(e for _, e in got) == ["a-1", "a-2", "a-3", "a-4", "a-5", "b-1", "b-2", "b-3"] and failed == [0]


# Replays beside a filtered live stream.
JOURNAL = [(f"{p}|1", n, "error" if n % 3 == 0 else "ok") for p in "abcdefgh" for n in range(1, 26)]
ROWS = "pid string, seq_nr long, event_type string"
ASK = "pid string, from_nr long, filter_after long, asked long"


@pytest.fixture
def merge(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming.cursors import ReplayMerge

    m = ReplayMerge(spark, str(tmp_path), lambda s: s.createDataFrame(JOURNAL, ROWS), F.col("event_type") != "error", parallelism=3, rows_each=10)

    def step(n, live=(), asks=(), m=m):
        rows = m.step(spark.createDataFrame(list(live), ROWS), spark.createDataFrame(list(asks), ASK), n)
        return sorted((r["pid"][0], r["seq_nr"], r["replayed"]) for r in rows.collect())

    step.cursors, step.finish = m.cursors, m.finish
    return step


def test_filter_after_of_replays_and_filtered_live_rows(merge):
    got = merge(0, [("a|1", 2, "error"), ("a|1", 30, "ok")], [("a|1", 1, 5, 1), ("b|1", 20, 0, 2), ("c|1", 0, 0, 3)])
    assert got == sorted([("a", 30, False), *(("a", n, True) for n in range(1, 11) if n < 5 or n % 3), *(("b", n, True) for n in range(20, 26))])


def test_a_newer_request_replaces_an_older(merge):
    merge(0, asks=[("a|1", 1, 0, 1)])
    # Another number: what was left of the old replay isn't read; the same number goes on with another filter_after.
    assert merge(1, asks=[("a|1", 22, 0, 2)]) == [("a", n, True) for n in range(22, 26)]
    assert merge(2) == [] and merge.cursors(2).count() == 0
    merge(3, asks=[("b|1", 1, 0, 3), ("c|1", 5, 0, 4), ("c|1", 24, 0, 5)])
    got = merge(4, asks=[("b|1", 1, 1, 6)])
    assert got == [("b", n, True) for n in range(11, 21) if n % 3]
    assert merge(5, asks=[("b|1", 2, 0, 7), ("b|1", 1, 0, 8)]) == [("b", n, True) for n in range(1, 11)]


def test_three_at_a_time_in_order(spark, merge, monkeypatch):
    from tidemark.streaming import cursors as C

    one_stream = C.with_requests
    monkeypatch.setattr(C, "with_requests", lambda c, r: one_stream(c, r, streams=1))
    seen, n = [], 0
    asks = [(f"{p}|1", 1, 0, k) for k, p in enumerate("hgfedcba")]
    while n == 0 or merge.cursors(n - 1).count():
        rows = merge(n, asks=asks if n == 0 else ())
        seen.append(sorted({p for p, _, _ in rows}, reverse=True))
        assert len(rows) <= 30
        n += 1
    assert seen == [list("hgf")] * 3 + [list("edc")] * 3 + [list("ba")] * 3


def test_what_is_left_when_the_live_stream_ends_is_one_step(spark, merge, monkeypatch):
    """All cursors end at once, those that wait for their turn too; each by its own filter_after and from where it stood."""
    from tidemark.streaming import cursors as C

    one_stream = C.with_requests
    monkeypatch.setattr(C, "with_requests", lambda c, r: one_stream(c, r, streams=1))
    asks = [(f"{p}|1", 3, 0 if p < "e" else 9, k) for k, p in enumerate("abcdefgh")]
    first = merge(0, asks=asks)
    assert first == [(p, n, True) for p in "abc" for n in range(3, 13)]
    rest = sorted((r["pid"][0], r["seq_nr"], r["replayed"]) for r in merge.finish(1).collect())
    assert rest == sorted([*((p, n, True) for p in "abc" for n in range(13, 26)), *(("d", n, True) for n in range(3, 26)), *((p, n, True) for p in "efgh" for n in range(3, 26) if n < 9 or n % 3)])
    assert merge.cursors(1).count() == 0


def test_a_micro_batch_that_runs_again(merge):
    merge(0, asks=[("a|1", 1, 0, 1)])
    assert merge(1) == merge(1) == [("a", n, True) for n in range(11, 21)]


# A filter that is exchanged while the stream runs.
def test_versions_of_a_filter(spark, tmp_path):
    from tidemark.streaming.filtering import CRITERIA, FilteredStream

    journal = [(f"user|{p}", n, ["error"] if n % 3 == 0 else []) for p in "abc" for n in range(1, 8)]
    schema = "pid string, seq_nr long, tags array<string>"
    stream = FilteredStream(spark, str(tmp_path), lambda s: s.createDataFrame(journal, schema), rows_each=4)
    live = spark.createDataFrame(journal[-3:] + [("user|a", 9, ["error"])], schema)
    frame = lambda *rows: spark.createDataFrame(list(rows), CRITERIA)

    def step(n, rows=live):
        return sorted((r["pid"][-1], r["seq_nr"], r["replayed"]) for r in stream.step(rows, n).collect())

    everything = [("a", 9, False), ("c", 5, False), ("c", 6, False), ("c", 7, False)]
    assert step(0) == everything
    assert stream.update(frame(("exclude_tags", "error", 0), ("include_ids", "a", 2), ("include_ids", "user|b", 0))) == 1
    # By entity id; number 2 asks for a replay, in two steps; number 0 for none.
    assert step(1) == sorted([*[e for e in everything if e[1] != 6], *(("a", n, True) for n in range(2, 6))])
    stream.update(frame(("remove_include_ids", "a", 0), ("include_ids", "user|c", 7), ("exclude_ids", "c", 0)))
    # Run again, a micro-batch takes the version it took first.
    assert step(1) == sorted([*[e for e in everything if e[1] != 6], *(("a", n, True) for n in range(2, 6))])
    # The replay that goes on isn't stopped by the removal; the live filter is the new one.
    assert step(2) == [("a", 6, True), ("a", 7, True), ("c", 5, False), ("c", 6, False), ("c", 7, False), ("c", 7, True)]
    assert step(3, live.limit(0)) == []
    with pytest.raises(ValueError, match="more than"):
        stream.update(frame(*(("exclude_tags", f"t{n}", 0) for n in range(1_001))))
        step(4)


# Pushes with acknowledgement.
def test_acknowledgements_of_what_was_never_sent(spark, tmp_path):
    from tidemark.streaming.projection import rate_limited
    from tidemark.streaming.pushes import ACK_SCHEMA, acknowledgements, pushed
    from tidemark.streaming.replay import replaying_state

    spark.createDataFrame([("a", 1), ("a", 2)], ACK_SCHEMA).write.parquet(str(tmp_path / "in"))
    sent = []

    def deliver(batch, n):
        rows = batch.collect()
        sent.extend((r["what"], r["seq_nr"], r["passed"]) for r in rows)
        if n == 0:  # out of order, repeated
            spark.createDataFrame([("a", 2), ("a", 2)], ACK_SCHEMA).write.parquet(str(tmp_path / "acks" / "0"))
        if n and ("offset", None, 2) not in sent and not (tmp_path / "acks" / "1").exists():
            spark.createDataFrame([("a", 1)], ACK_SCHEMA).write.parquet(str(tmp_path / "acks" / "1"))
        if ("offset", None, 2) in sent and not (tmp_path / "acks" / "2").exists():
            spark.createDataFrame([("a", 3)], ACK_SCHEMA).write.parquet(str(tmp_path / "acks" / "2"))

    stream = pushed(rate_limited(spark, str(tmp_path / "in"), ACK_SCHEMA), acknowledgements(spark, str(tmp_path / "acks")), patience_s=600)
    with replaying_state(spark):
        query = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()
    with pytest.raises(Exception, match="acknowledgement of a 3, which wasn't sent"):
        query.awaitTermination(120)
    query.stop()
    # Number 2 alone doesn't move the offset; with number 1 both are passed.
    assert sent == [("send", 1, None), ("send", 2, None), ("offset", None, 2)]


# An entity's events in few values of its state.
class State(dict):
    """A map state that counts its calls."""

    calls = 0

    def _called(self, result):
        self.calls += 1
        return result

    def containsKey(self, key):  # noqa: N802
        return self._called(key in self)

    def getValue(self, key):  # noqa: N802
        return self._called(self[key])

    def updateValue(self, key, value):  # noqa: N802
        self._called(self.__setitem__(key, value))

    def removeKey(self, key):  # noqa: N802
        self._called(self.pop(key))

    def keys(self):
        return iter(self._called(list(super().keys())))


def test_blocks_of_events():
    from tidemark.streaming import blocks as B

    # Few events take no call of the map state at all.
    state, few = State(), B.Blocks(State(), 0, None)
    few.put(2, ("b", 2))
    few.put(9, ("c", 9))
    kept = B.Blocks(state, 2, few.save())
    assert kept.least() == 2 and kept.pop(2) == ("b", 2) and kept.get(3) is None and [n for n, _ in kept.items()] == [9]
    assert kept.pop(9) and kept.save() is None and state.calls == 0
    # Many take few: more blocks than are in memory at once, each written once or twice.
    count = B.SIZE * (B.OPEN + 8)
    held = B.Blocks(state, 0, None)
    for n in range(count, 0, -1):
        held.put(n, (f"e{n}", n))
    assert held.save() is None and len(state) == count // B.SIZE + 1 and state.calls <= 4 * len(state)
    again = B.Blocks(state, count, None)
    assert again.least() == 1 and [again.pop(n) for n in range(1, count)] == [(f"e{n}", n) for n in range(1, count)]
    assert again.pop(5) is None and again.get(count) == (f"e{count}", count) and again.least() == count
    again.save()
    assert list(state) == [(count // B.SIZE,)] and [nr for nr, _ in B.Blocks(state, 1, None).items()] == [count]
    cleared = B.Blocks(state, 1, None)
    cleared.put(7, ("x", 7))
    cleared.clear()
    assert cleared.save() is None and not state and cleared.least() is None


def test_entities_of_a_bucket(spark, tmp_path, monkeypatch):
    """Many entities share a bucket, whose waiting events aren't all in memory at once, and some fill several blocks: each ends whole, and one call is made for a bucket."""
    from tidemark.streaming import replay

    class State(dict):
        exists, containsKey, getValue, updateValue, removeKey = dict.__len__, dict.__contains__, dict.get, dict.__setitem__, dict.__delitem__  # noqa: N815

    class Handle:
        def getMapState(self, *of):  # noqa: N802
            return State()

    from pyspark.sql import Row

    monkeypatch.setattr(replay, "IN_MEMORY", 40)
    work = replay.Waiting(["pid", "seq_nr", "__us"], None, None)
    work.init(Handle())
    item = Row("pid", "seq_nr", "__us", "__origin", "__bucket")
    size = {"a": 1500, "b": 30, "c": 30}
    rows = [item(p, n, n, None, 1) for n in range(1500, 1, -1) for p in size if n <= size[p]]
    asked = [tuple(r)[-2:] for r in work.handleInputRows((1,), iter(rows), None) if r.verdict == replay.REQUEST]
    assert asked == [(1, 1)] * 3
    last = [item("c", 1, 1, "replay", 1), item("a", 2, 2, None, 1), *(item(p, None, None, "end:1:1:1", 1) for p in "ac"), item("a", 1, 1, "replay", 1)]
    got = [(r.pid, r.seq_nr, r.verdict) for r in work.handleInputRows((1,), iter(last), None)]
    for p in "ac":
        assert [n for q, n, v in got if q == p and v == replay.ACCEPTED] == list(range(1, size[p] + 1))
    assert [g for g in got if g[2] != replay.ACCEPTED] == [("a", 2, replay.DUPLICATE)] and not work.waiting and work.seen[("b",)][4] == 29
    with pytest.raises(replay.RejectedEnvelope, match="replay of b from 1 to 1 has 1 events"):
        list(work.handleInputRows((1,), iter([item("b", None, None, "end:1:1:1", 1)]), None))
