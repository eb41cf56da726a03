"""Stopping and pacing runs: a registry of cancelled runs, retries with backoff, and a bound on calls at once."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class CancelRegistry:
    """Run id to reason; an entry is forgotten ttl seconds after it was made. Cancelling twice keeps the first reason.

    With a session, the run's Spark jobs (its job group) are cancelled too.
    """

    def __init__(self, ttl: float = 20 * 60, clock: Callable[[], float] = time.monotonic, spark=None) -> None:
        self._ttl, self._clock, self._spark = ttl, clock, spark
        self._runs: dict[str, tuple[str, float]] = {}
        self._lock = threading.Lock()

    def _prune(self) -> None:
        now = self._clock()
        self._runs = {k: v for k, v in self._runs.items() if now - v[1] < self._ttl}

    def cancel(self, run_id: str, reason: str = "") -> None:
        if not run_id:
            raise ValueError("a run id is required")
        with self._lock:
            self._prune()
            self._runs.setdefault(run_id, (reason, self._clock()))
        if self._spark is not None:
            self._spark.sparkContext.cancelJobGroup(run_id)

    def reason(self, run_id: str) -> str | None:
        """The reason of a cancelled run, else None."""
        with self._lock:
            self._prune()
            return self._runs[run_id][0] if run_id in self._runs else None

    def clear(self, run_id: str) -> None:
        with self._lock:
            self._runs.pop(run_id, None)


class Busy(RuntimeError):
    """A call to be tried again; after names the seconds that the other side asks for."""

    def __init__(self, message: str = "", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def backoff(tries: int, first: float = 1.0, factor: float = 2.0, most: float = 30.0, after: float | None = None) -> float:
    """Seconds before the next try, after so many that failed; what the other side asks for counts if it is longer."""
    return max(after or 0.0, min(most, first * factor ** max(0, tries - 1)))


class Paced:
    """A call of which at most `at_once` run together and that is tried again while it raises Busy."""

    def __init__(self, call: Callable, at_once: int = 1, most_tries: int = 4, sleep: Callable[[float], None] = time.sleep, **pace: float) -> None:
        self._call, self._tries, self._sleep, self._pace = call, most_tries, sleep, pace
        self._gate = threading.BoundedSemaphore(at_once)

    def __call__(self, *args, **kwargs):
        for n in range(1, self._tries + 1):
            try:
                with self._gate:
                    return self._call(*args, **kwargs)
            except Busy as e:
                if n == self._tries:
                    raise
                self._sleep(backoff(n, after=e.after, **self._pace))
        raise AssertionError
