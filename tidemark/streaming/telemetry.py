"""Status and telemetry hooks; what an observer raises never reaches the projection."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from tidemark.streaming.metrics import Measure


class Observer:
    """Callbacks in the order of a projection's life; override what is of interest."""

    def started(self, projection: str) -> None: ...
    def before(self, projection: str, batch_id: int) -> None: ...
    def after(self, projection: str, batch_id: int) -> None: ...
    def measured(self, projection: str, measure: Measure) -> None: ...
    def error(self, projection: str, error: BaseException, action: str) -> None: ...
    def restarted(self, projection: str, count: int, error: BaseException) -> None: ...
    def stopped(self, projection: str) -> None: ...


@dataclass
class Telemetry:
    """All observers as one."""

    observers: list[Observer] = field(default_factory=list)

    def _tell(self, hook: str, *args) -> None:
        for o in self.observers:
            with contextlib.suppress(Exception):
                getattr(o, hook)(*args)

    def started(self, projection: str) -> None:
        self._tell("started", projection)

    def before(self, projection: str, batch_id: int) -> None:
        self._tell("before", projection, batch_id)

    def after(self, projection: str, batch_id: int) -> None:
        self._tell("after", projection, batch_id)

    def measured(self, projection: str, measure: Measure) -> None:
        self._tell("measured", projection, measure)

    def error(self, projection: str, error: BaseException, action: str) -> None:
        self._tell("error", projection, error, action)

    def restarted(self, projection: str, count: int, error: BaseException) -> None:
        self._tell("restarted", projection, count, error)

    def stopped(self, projection: str) -> None:
        self._tell("stopped", projection)


class Recorder(Observer):
    """Keeps what it was told, for tests and reports."""

    def __init__(self) -> None:
        self.events: list[tuple] = []

    def __getattribute__(self, name: str):
        if name in ("started", "before", "after", "measured", "error", "restarted", "stopped"):
            return lambda *args: self.events.append((name, *args))
        return super().__getattribute__(name)

    def count(self, name: str) -> int:
        return sum(e[0] == name for e in self.events)


def ensemble(observers: Iterable[Observer]) -> Telemetry:
    return Telemetry(list(observers))
