"""Pushing events to a consumer that acknowledges them.

What was sent and isn't acknowledged yet is in flight, in the state of its entity. Acknowledgements come back as a second
input of the stream; one for a number that was never sent fails the query, one that comes again (for what was sent
twice) changes nothing. A timer sends again what stays in flight too long. The offset of an entity passes a number only
when it and all before it are acknowledged.

Rows of the stream: "send" with `attempt`, to be delivered, and "offset" with the number that is passed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.session import importable
from tidemark.streaming.blocks import STATE_KEY, STATE_VALUE, Blocks

SEND, OFFSET = "send", "offset"
ACK_SCHEMA = "pid string, seq_nr long"


class UnknownAcknowledgement(Exception):
    """A consumer acknowledged what wasn't sent."""


class InFlight(StatefulProcessor):
    """One entity: the highest number sent, the offset told last, and what is in flight, by number with its attempts."""

    def __init__(self, columns: list[str], patience_ms: int, limit: int) -> None:
        self.columns, self.patience_ms, self.limit = columns, patience_ms, limit
        self.row = Row(*columns, "what", "attempt", "passed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "highest long, passed long, n long, few binary")
        self.flying = handle.getMapState("flying", STATE_KEY, STATE_VALUE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        highest, passed, n, few = self.sent.get() or (0, 0, 0, None)
        due, acks, new = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms, [], {}
        for r in rows:
            if r["__ack"]:
                acks.append(r["seq_nr"])
            elif r["seq_nr"] > highest:  # micro-batches come in an entity's order; what comes again is sent already
                new[r["seq_nr"]] = tuple(r[c] for c in self.columns)
                if n + len(new) > self.limit:
                    raise RuntimeError(f"more than {self.limit} events of {key[0]} in flight")
        flying = Blocks(self.flying, n, few)
        for nr, event in sorted(new.items(), key=lambda item: item[0]):
            flying.put(nr, (event, 1, due))
            highest, n = nr, n + 1
            yield self.row(*event, SEND, 1, None)
        for nr in acks:
            if nr > highest:
                raise UnknownAcknowledgement(f"acknowledgement of {key[0]} {nr}, which wasn't sent")
            if flying.pop(nr):
                n -= 1
        if new:
            self.handle.registerTimer(due)
        done = highest if n == 0 else flying.least() - 1 if acks else passed
        few = flying.save()
        if done > passed:
            passed = done
            yield self.row(*(key[0] if c == "pid" else None for c in self.columns), OFFSET, None, passed)
        self.sent.update((highest, passed, n, few))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Send again what is overdue."""
        highest, passed, n, few = self.sent.get()
        now, flying, again = timerValues.getCurrentProcessingTimeInMs(), Blocks(self.flying, n, few), False
        for nr, (event, attempt, due) in flying.items():
            if due <= now:
                flying.put(nr, (event, attempt + 1, now + self.patience_ms))
                again = True
                yield self.row(*event, SEND, attempt + 1, None)
        if again:
            self.sent.update((highest, passed, n, flying.save()))
            self.handle.registerTimer(now + self.patience_ms)

    def close(self) -> None: ...


def acknowledgements(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of acknowledgements that a consumer files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(ACK_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)


def pushed(events: DataFrame, acks: DataFrame, patience_s: float = 5.0, limit: int = 10_000) -> DataFrame:
    """The stream of sends and offsets of events (pid, seq_nr, more) and acks (pid, seq_nr); run it within replay.replaying_state(), by an interval.

    The query fails if an entity has more than `limit` events in flight: its consumer doesn't keep up.
    """
    importable(events.sparkSession)
    both = events.withColumn("__ack", F.lit(False)).unionByName(acks.select("pid", "seq_nr", F.lit(True).alias("__ack")), allowMissingColumns=True)
    out = StructType([*(StructField(f.name, f.dataType) for f in events.schema), StructField("what", StringType()), StructField("attempt", LongType()), StructField("passed", LongType())])
    return both.groupBy("pid").transformWithState(InFlight(events.columns, round(patience_s * 1000), limit), out, "append", "processingTime")
