"""Custom sources as Python data sources: a reader by offset, what an envelope's offset is, and when it was made."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "pid string, seq_nr long, slice int, offset long, created_us long"


def envelope(n: int, entities: int) -> tuple[str, int, int, int, int]:
    """Event n of a source that deals events to entities in turn."""
    return f"made|{n % entities}", n // entities + 1, n % entities, n, n * 1000


class MadeEventsSource(DataSource):
    """Deterministic envelopes, as a batch or a stream. Options: count, entities, batch (rows a micro-batch), start (last stored offset)."""

    @classmethod
    def name(cls) -> str:
        return "made_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MadeEventsReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return MadeEventsStream(self.options)


class MadeEventsReader(DataSourceReader):
    """One partition a range of offsets."""

    RANGE = 10_000

    def __init__(self, options: dict[str, str]) -> None:
        self.count, self.entities, self.start = int(options.get("count", 100)), int(options.get("entities", 4)), int(options.get("start", -1)) + 1

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(self.start, self.count, self.RANGE)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(partition.value, min(partition.value + self.RANGE, self.count)):
            yield envelope(n, self.entities)


class MadeEventsStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.count, self.entities, self.batch = int(options.get("count", 100)), int(options.get("entities", 4)), int(options.get("batch", 25))
        self.start = int(options.get("start", -1)) + 1

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["next"] + self.batch, self.count)
        return iter([envelope(n, self.entities) for n in range(start["next"], end)]), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([envelope(n, self.entities) for n in range(start["next"], end["next"])])
