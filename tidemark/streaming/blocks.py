"""An entity's events by number, many of them a value of its state: a call of the state costs far more than the work on one event.

Few events are one value beside what else is known of the entity, which is read and written once a micro-batch anyhow; more
of them go to a map state by blocks of numbers.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

#: Numbers of a value, also events that count as few, and values of an entity that are in memory at once.
SIZE, OPEN = 512, 32
STATE_KEY, STATE_VALUE = "block long", "events binary"


class Blocks:
    """Items by number, `held` of them as yet. few: what save() gave, which must follow the last change."""

    def __init__(self, state, held: int, few: bytes | None) -> None:
        self.state, self.empty = state, not held or few is not None  # empty: the map state holds none
        self.few: dict[int, Any] | None = (pickle.loads(bytes(few)) if few is not None else {}) if self.empty else None
        self.open: OrderedDict[int, dict[int, Any]] = OrderedDict()
        self.changed: set[int] = set()

    def _block(self, at: int) -> dict[int, Any]:
        if at in self.open:
            self.open.move_to_end(at)
            return self.open[at]
        if len(self.open) >= OPEN:
            self._close(next(iter(self.open)))
        held = {}
        if not self.empty and self.state.containsKey((at,)):
            held = pickle.loads(bytes(self.state.getValue((at,))[0]))
        self.open[at] = held
        return held

    def _close(self, at: int) -> None:
        held = self.open.pop(at)
        if at not in self.changed:
            return
        self.changed.discard(at)
        if held:
            self.state.updateValue((at,), (pickle.dumps(held),))
            self.empty = False
        elif not self.empty and self.state.containsKey((at,)):
            self.state.removeKey((at,))

    def get(self, nr: int) -> Any | None:
        return self._own(nr).get(nr)

    def _own(self, nr: int) -> dict[int, Any]:
        return self._block(nr // SIZE) if self.few is None else self.few

    def put(self, nr: int, item: Any) -> None:
        self._own(nr)[nr] = item
        if self.few is None:
            self.changed.add(nr // SIZE)
        elif len(self.few) > SIZE:
            many, self.few = self.few, None
            for n in sorted(many):
                self.put(n, many[n])

    def pop(self, nr: int) -> Any | None:
        item = self._own(nr).pop(nr, None)
        if item is not None and self.few is None:
            self.changed.add(nr // SIZE)
        return item

    def save(self) -> bytes | None:
        if self.few is not None:
            return pickle.dumps(self.few) if self.few else None
        for at in list(self.open):
            self._close(at)
        return None

    def clear(self) -> None:
        self.open.clear()
        self.changed.clear()
        if not self.empty:
            self.state.clear()
        self.empty, self.few = True, {}

    def _places(self) -> list[int]:
        """Blocks that hold something, in order."""
        stored = set() if self.empty else {k[0] for k in self.state.keys()}
        return sorted({at for at in stored | set(self.open) if at not in self.open or self.open[at]})

    def least(self) -> int | None:
        if self.few is not None:
            return min(self.few, default=None)
        places = self._places()
        return min(self._block(places[0])) if places else None

    def items(self) -> Iterator[tuple[int, Any]]:
        """All by number; what has been given may be put anew while this goes on."""
        if self.few is not None:
            yield from sorted(self.few.items(), key=lambda item: item[0])
            return
        for at in self._places():
            yield from sorted(self._block(at).items(), key=lambda item: item[0])
