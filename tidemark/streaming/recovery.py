"""What happens when a handler fails, and how a projection restarts."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Recovery:
    """Retries with a delay, then give up by failing or by skipping."""

    retries: int = 0
    delay_s: float = 0.0
    skip: bool = False


def fail() -> Recovery:
    return Recovery()


def skip() -> Recovery:
    return Recovery(skip=True)


def retry_and_fail(retries: int, delay_s: float) -> Recovery:
    """Below one retry this is fail()."""
    return Recovery(retries, delay_s) if retries >= 1 else fail()


def retry_and_skip(retries: int, delay_s: float) -> Recovery:
    """Below one retry this is fail(), not skip()."""
    return Recovery(retries, delay_s, skip=True) if retries >= 1 else fail()


class Aborted(Exception):
    """Stops a projection for good: it isn't retried, skipped or restarted."""


def recover(call: Callable[[], Any], strategy: Recovery, on_error: Callable[[BaseException, str], None] = lambda e, what: None, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, Any]:
    """(done, result) of call under a strategy; (False, None) if it was skipped. on_error gets each error and what follows it."""
    attempt = 0
    while True:
        try:
            return True, call()
        except Aborted:
            raise
        except Exception as error:
            attempt += 1
            if attempt <= strategy.retries:
                on_error(error, "retry")
                sleep(strategy.delay_s)
            elif strategy.skip:
                on_error(error, "skip")
                return False, None
            else:
                on_error(error, "fail")
                raise


@dataclass(frozen=True)
class Restart:
    """Backoff from low to high seconds, doubled each time and spread by up to `random_factor`; max_restarts -1 means no bound, 0 none at all."""

    low_s: float = 3.0
    high_s: float = 30.0
    random_factor: float = 0.2
    max_restarts: int = -1

    def delay(self, restarts: int, rand: Callable[[], float] = random.random) -> float:
        return min(self.high_s, self.low_s * 2 ** min(restarts, 60)) * (1 + rand() * self.random_factor)


def supervise(run: Callable[[], Any], restart: Restart, on_restart: Callable[[int, BaseException], None] = lambda n, e: None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """run() until it ends, started again with backoff when it fails, from what it stored last."""
    count = 0
    while True:
        try:
            return run()
        except Aborted:
            raise
        except Exception as error:
            if 0 <= restart.max_restarts <= count:
                raise
            on_restart(count + 1, error)
            sleep(restart.delay(count))
            count += 1


def retry_unprocessed(write: Callable[[list], list], items: list, limit: int = 25, retries: int = 3, delay_s: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> None:
    """Writes items in batches of at most `limit`; what a write hands back is tried again, with doubling delays."""
    for at in range(0, len(items), limit):
        left, tries = items[at : at + limit], 0
        while left := write(left):
            if tries == retries:
                raise RuntimeError(f"{len(left)} items left after {retries} retries")
            sleep(delay_s * 2**tries)
            tries += 1
