"""Strict validation of a running stream that reads again what it misses.

An event whose predecessor hasn't come waits in its entity's state, and the stream asks for the missing numbers. The
micro-batch that asks is also the one that reads them from the journal, with one join for all entities, into a folder
that is a second input of the same stream: so they come back with the next micro-batch, are accepted in order, and what
waited follows them. An answer that lacks an event fails the query, unless the entity is unknown and the journal has none
of the earlier ones: then these are gone, and the entity begins where it can. State is a few numbers and times for each
entity, and the events that wait; entities are dealt to BUCKETS. The order of rows within a micro-batch doesn't matter.

Verdicts: accepted; duplicate; rejected (from "pubsub", ahead of its predecessor: it comes again by the journal); and
rows of "request" with from_nr and to_nr, of which only the ids are set.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.operators.validation import ACCEPTED, DUPLICATE, REJECTED
from tidemark.session import importable
from tidemark.streaming.blocks import OPEN, SIZE, STATE_KEY, STATE_VALUE, Blocks

REQUEST = "request"
#: Buckets of entities by a hash of their ids, and waiting events of a bucket that are in memory at once.
BUCKETS, IN_MEMORY = 4096, 1 << 17
#: Beside an event's own columns: where it came from, and of the end of an answer its range and how many events it has.
ANSWER = [StructField("origin", StringType()), StructField("from_nr", LongType()), StructField("to_nr", LongType()), StructField("found", LongType())]
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RejectedEnvelope(Exception):
    """The journal lacks an event that a stream needs before it can go on."""


class OwnBlocks:
    """One entity's part of a map state by entity and block; `places` are the blocks that it has there."""

    def __init__(self, state, pid: str, places: set[int]) -> None:
        self.state, self.pid, self.places = state, pid, places

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return key[0] in self.places

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        return self.state.getValue((self.pid, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.places.add(key[0])
        self.state.updateValue((self.pid, *key), value)

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.places.discard(key[0])
        self.state.removeKey((self.pid, *key))

    def keys(self) -> Iterator[tuple]:
        return iter([(at,) for at in sorted(self.places)])

    def clear(self) -> None:
        for at in list(self.places):
            self.removeKey((at,))


class Known:
    """One entity: what was accepted last, up to where was asked and when that is overdue, and the events that wait, by number."""

    __slots__ = ("seq", "us", "asked", "due", "held", "own", "waiting", "changed")

    def __init__(self, state, pid: str, value: tuple | None) -> None:
        self.seq, self.us, self.asked, self.due, self.held, few, places = value or (0, None, 0, 0, 0, None, None)
        self.own = OwnBlocks(state, pid, set(pickle.loads(bytes(places))) if places is not None else set())
        self.waiting, self.changed = Blocks(self.own, self.held, few), False

    def value(self) -> tuple:
        few = self.waiting.save()
        return self.seq, self.us, self.asked, self.due, self.held, few, pickle.dumps(self.own.places) if self.own.places else None

    def follow(self) -> Iterator[tuple]:
        """What waited for the last accepted event."""
        while self.held and (found := self.waiting.pop(self.seq + 1)):
            event, time = found
            self.seq, self.us, self.held, self.changed = self.seq + 1, time, self.held - 1, True
            yield event, ACCEPTED

    def take(self, event: tuple, n: int, time: int | None, origin: str | None, reset_us: int | None) -> Iterator[tuple]:
        """An event's verdict, unless it waits, and those of events that waited for it."""
        reset = reset_us is not None and self.us is not None and time > self.us + reset_us
        if self.seq and n <= self.seq and not reset:
            yield event, DUPLICATE
            return
        if self.seq and n <= self.seq:  # numbers began anew
            self.waiting.clear()
            self.seq, self.asked, self.held, self.changed = 0, 0, 0, True
        if n == self.seq + 1:
            self.seq, self.us, self.changed = n, time, True
            yield event, ACCEPTED
            yield from self.follow()
        elif origin == "pubsub":
            yield event, REJECTED
        elif self.held and self.waiting.get(n):
            yield event, DUPLICATE
        else:
            self.waiting.put(n, (event, time))
            self.held, self.changed = self.held + 1, True

    def answered(self, pid: str, begin: int, end: int, found: int) -> Iterator[tuple]:
        """An answer is whole."""
        if self.seq < end and self.held:
            if self.seq or found or begin != 1:
                raise RejectedEnvelope(f"replay of {pid} from {begin} to {end} has {found} events")
            self.seq, self.changed = self.waiting.least() - 1, True
            yield from self.follow()


class Waiting(StatefulProcessor):
    """The entities of a bucket. A call of the engine costs far more than the work on an entity's few events, so a bucket's are one call; each entity is a value of its state, read and written once a micro-batch."""

    def __init__(self, columns: list[str], reset_us: int | None, patience_ms: int | None) -> None:
        self.columns, self.reset_us, self.patience_ms = columns, reset_us, patience_ms
        self.row = Row(*columns, "verdict", "from_nr", "to_nr")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "pid string", "seq long, us long, asked long, due long, held long, few binary, places binary")
        self.waiting = handle.getMapState("waiting", f"pid string, {STATE_KEY}", STATE_VALUE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known: dict[str, Known] = {}
        ends: dict[str, list[tuple]] = {}  # of all entities of this call
        new, many, places = not self.seen.exists(), 0, None

        def entity(pid: str) -> Known:
            nonlocal many
            if pid not in known:
                known[pid] = Known(self.waiting, pid, None if new else self.seen.getValue((pid,)))
                many += min(known[pid].held, OPEN * SIZE)
            return known[pid]

        for r in rows:
            if places is None:
                at = {c: i for i, c in enumerate(r.__fields__)}
                places = [at[c] for c in self.columns]
                p, n, us, origin = at["pid"], at["seq_nr"], at["__us"], at["__origin"]
            values = tuple(r)
            pid = values[p]
            told = ends.setdefault(pid, [])
            if values[origin] is not None and values[origin].startswith("end:"):
                told.append(tuple(int(part) for part in values[origin].split(":")[1:]))
                continue
            held = entity(pid)
            before = held.held
            for event, verdict in held.take(tuple(values[i] for i in places), values[n], values[us], values[origin], self.reset_us):
                yield self.row(*event, verdict, None, None)
            many += max(held.held - before, 0)
            if many > IN_MEMORY:
                for name in list(known):
                    self._save(name, known.pop(name))
                new, many = False, 0
        for pid, told in ends.items():
            held = entity(pid)
            for answer in told:
                for event, verdict in held.answered(pid, *answer):
                    yield self.row(*event, verdict, None, None)
            low = held.waiting.least() if held.held else 0
            if held.held and low - 1 > held.asked:
                held.asked, held.changed = low - 1, True
                yield self._request(pid, held.seq + 1, held.asked)
                if self.patience_ms is not None:
                    held.due = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
                    self.handle.registerTimer(held.due)
            self._save(pid, known.pop(pid))

    def _save(self, pid: str, held: Known) -> None:
        if held.changed:
            self.seen.updateValue((pid,), held.value())

    def _request(self, pid: str, begin: int, end: int) -> Row:
        return self.row(*(pid if c == "pid" else None for c in self.columns), REQUEST, begin, end)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Answers are overdue: ask again."""
        now = timerValues.getCurrentProcessingTimeInMs()
        overdue = [(k[0], tuple(v)) for k, v in self.seen.iterator() if v[4] and v[0] < v[2] and v[3] <= now]
        for pid, (seq, us, asked, _, *more) in overdue:
            yield self._request(pid, seq + 1, asked)
            self.seen.updateValue((pid,), (seq, us, asked, now + self.patience_ms, *more))
        if overdue:
            self.handle.registerTimer(now + self.patience_ms)

    def close(self) -> None: ...


class Replays:
    """Answers to a stream's requests: events of a journal, in a folder that the stream reads too."""

    def __init__(self, spark: SparkSession, folder: str, journal: Callable[[SparkSession], DataFrame], schema: StructType) -> None:
        self.spark, self.folder, self.journal = spark, folder, journal
        self.schema = StructType([*schema.fields, *ANSWER])
        self.answered = 0
        self._fs().mkdirs(self._path(folder))

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.folder)

    def answer(self, requests: DataFrame, batch_id: int) -> None:
        """Read what a micro-batch asks for; a micro-batch that runs again has its answer already."""
        target = f"{self.folder}/answer-{batch_id}"
        if self._fs().exists(self._path(f"{target}/_SUCCESS")) or requests.isEmpty():
            return
        ranges = requests.groupBy("pid").agg(F.min("from_nr").alias("from_nr"), F.max("to_nr").alias("to_nr"))
        own = self.schema.names[: -len(ANSWER)]
        found = ranges.join(self.journal(self.spark).select(*own), "pid").where(F.col("seq_nr").between(F.col("from_nr"), F.col("to_nr")))
        counts = found.groupBy("pid").agg(F.count_distinct("seq_nr").alias("found"))
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name in own and f.name != "pid"]
        ends = ranges.join(counts, "pid", "left").select("pid", "from_nr", "to_nr", F.coalesce("found", F.lit(0).cast("long")).alias("found"), F.lit("end").alias("origin"), *nothing)
        events = found.drop("from_nr", "to_nr").withColumn("origin", F.lit("replay"))
        rows = events.unionByName(ends, allowMissingColumns=True).select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        rows.write.mode("overwrite").parquet(target)
        self.answered += 1


def validate_replaying(events: DataFrame, replays: Replays, reset_after_s: float | None = None, patience_s: float | None = None) -> DataFrame:
    """A stream of events (pid, seq_nr, ts, perhaps origin, more) as `verdict`, from_nr, to_nr beside their columns; run it within replaying_state().

    With patience_s a request that has no answer after so long is made again, by a timer of its entity.
    """
    importable(events.sparkSession)
    columns = [c for c in events.columns if c != "origin"]
    extra = {f.name: F.lit(None).cast(f.dataType) for f in ANSWER}
    live = events.select(*columns, *((F.col("origin") if n == "origin" and "origin" in events.columns else c).alias(n) for n, c in extra.items()))
    # A value of a row takes longer to cross than all work on its event: times go as numbers, and an answer's end is its origin.
    origin = F.when(F.col("origin") == "end", F.concat_ws(":", "origin", "from_nr", "to_nr", "found")).otherwise(F.col("origin"))
    own = [F.unix_micros("ts").alias("__us") if c == "ts" else F.col(c) for c in columns]
    both = live.unionByName(replays.stream()).select(*own, origin.alias("__origin"), F.pmod(F.xxhash64("pid"), F.lit(BUCKETS)).cast("int").alias("__bucket"))
    out = StructType([*both.drop("__origin", "__bucket").schema.fields, StructField("verdict", StringType()), StructField("from_nr", LongType()), StructField("to_nr", LongType())])
    as_int = lambda s, unit: None if s is None else round(s * unit)
    work = Waiting(["__us" if c == "ts" else c for c in columns], as_int(reset_after_s, 1_000_000), as_int(patience_s, 1000))
    judged = both.groupBy("__bucket").transformWithState(work, out, "append", "none" if patience_s is None else "processingTime")
    return judged.select(*(F.timestamp_micros("__us").alias(c) if c == "ts" else c for c in columns), "verdict", "from_nr", "to_nr")


@contextmanager
def replaying_state(spark: SparkSession) -> Iterator[None]:
    """The state store that such streams need, for queries that start within."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)
