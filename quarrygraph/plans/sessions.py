"""Which data set is served: switching with a log, benchmarks of new uploads, a memory of failed probes.

All of it runs on the driver; loading and measuring are callables that start Spark jobs.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..sources.catalog import BUILT_IN, Catalog

#: Seconds for which a failed probe is believed.
PROBE_SECONDS = 15.0


@dataclass
class Run:
    """A switch in the background: its log grows until ``done``."""

    session: str
    log: list[str] = field(default_factory=list)
    done: bool = False
    ok: bool = False
    error: str | None = None
    thread: threading.Thread | None = None

    def wait(self, seconds: float | None = None) -> bool:
        self.thread.join(seconds)
        return self.done


class Sessions:
    """``load(session, say)`` stores a session's graph and calls ``say`` with lines of its log.

    ``measure(session)`` benchmarks an upload and ``measured(session)`` tells whether results exist:
    each upload is measured once, after it was loaded, in a thread of its own.
    """

    def __init__(self, catalog: Catalog, load: Callable[[str, Callable[[str], None]], None], measure: Callable[[str], None] | None = None, measured: Callable[[str], bool] | None = None):
        self.catalog, self.load, self.measure, self.measured = catalog, load, measure, measured
        self._one = threading.Lock()
        self._state = threading.Lock()
        self._measuring: dict[str, threading.Thread] = {}

    def _known(self, session: str) -> str:
        row = self.catalog.sessions().filter(F.col("id") == session).first()
        if row is None:
            raise ValueError(f"no session {session!r}")
        return row["kind"]

    def _loaded(self, session: str) -> bool:
        return self.catalog.loaded() is not None and self.catalog.current() == session

    def switch(self, session: str, force: bool = False, say: Callable[[str], None] = lambda line: None) -> str:
        """``already_loaded`` or ``loaded``; one switch runs at a time, and a failed one leaves the mark."""
        kind = self._known(session)
        if not force and self._loaded(session):
            self._benchmark(session, kind)
            return "already_loaded"
        with self._one:
            # another caller may have loaded it in the meantime
            if not force and self._loaded(session):
                return "already_loaded"
            self.load(session, say)
            markers = {s: m for m, s in BUILT_IN.items()}
            self.catalog.stamp(markers.get(session, session))
        self._benchmark(session, kind)
        return "loaded"

    def start(self, session: str, force: bool = False) -> Run:
        """The same in the background; an unknown session is an error at once."""
        self._known(session)
        run = Run(session)

        def work() -> None:
            try:
                run.log.append(self.switch(session, force, run.log.append))
                run.ok = True
            except Exception as e:  # the caller asks the handle, not this thread
                run.error = f"{type(e).__name__}: {e}"
            finally:
                run.done = True

        run.thread = threading.Thread(target=work, daemon=True, name=f"switch {session}")
        run.thread.start()
        return run

    def measuring(self, session: str) -> bool:
        with self._state:
            return session in self._measuring

    def wait(self) -> None:
        """Until no benchmark runs."""
        with self._state:
            running = list(self._measuring.values())
        for thread in running:
            thread.join()

    def _benchmark(self, session: str, kind: str) -> None:
        if kind != "custom" or self.measure is None:
            return

        def work() -> None:
            try:
                self.measure(session)
            finally:
                with self._state:
                    self._measuring.pop(session, None)

        with self._state:
            if session in self._measuring or (self.measured and self.measured(session)):
                return
            thread = self._measuring[session] = threading.Thread(target=work, daemon=True, name=f"benchmark {session}")
            thread.start()


class Probe:
    """Whether a server answers; a failure is remembered for ``seconds``, a success is asked for again."""

    def __init__(self, ask: Callable[[str], bool], seconds: float = PROBE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.ask, self.seconds, self.clock = ask, seconds, clock
        self._failed: dict[str, float] = {}

    def __call__(self, address: str) -> bool:
        now = self.clock()
        if now - self._failed.get(address, -float("inf")) < self.seconds:
            return False
        try:
            ok = bool(self.ask(address))
        except Exception:  # whatever a client raises, the server doesn't answer
            ok = False
        if ok:
            self._failed.pop(address, None)
        else:
            self._failed[address] = now
        return ok
