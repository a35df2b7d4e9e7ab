"""What a host page and the engine say to each other: changes are told once, requests are answered by their number.

State changes made close together are told as one.  A request runs under a job tag; an aborted one is interrupted and a
late answer dropped; an error is an answer.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from veduta.operators.engine import Engine, LazyView

#: Seconds in which changes are gathered.
WAIT = 0.12


class Session:
    """An engine under a state (filters, quick, sort, group, selected) that listeners follow."""

    def __init__(self, engine: Engine, state: dict | None = None, wait: float = WAIT, workers: int = 4):
        self.engine, self.state, self.wait = engine, dict(state or {}), wait
        self._told, self._listeners = dict(self.state), {"view": [], "selected": []}
        self._timer, self._lock = None, threading.RLock()
        self._pool, self._running, self._name = ThreadPoolExecutor(workers), {}, uuid.uuid4().hex

    # changes
    def observe(self, what: str, listener: Callable[[dict], None]) -> Callable[[], None]:
        """Calls ``listener`` once for each real change of the view or of the selection; the answer ends that."""
        self._listeners[what].append(listener)
        return lambda: self._listeners[what].remove(listener)

    def on_view(self, listener: Callable[[LazyView], None]) -> Callable[[], None]:
        """Calls ``listener`` with the view now and after each change."""
        listener(self.view)
        return self.observe("view", lambda _: listener(self.view))

    @property
    def view(self) -> LazyView:
        return self.engine.view(self.state)

    def change(self, **state) -> None:
        """Puts in parts of the state; listeners hear of it once no more has come for ``wait`` seconds."""
        with self._lock:
            self.state |= state
            if self._timer:
                self._timer.cancel()
            if self.wait:
                self._timer = threading.Timer(self.wait, self.flush)
                self._timer.daemon = True
                self._timer.start()
        if not self.wait:
            self.flush()

    def replace(self, engine: Engine) -> None:
        """Other data: the state is pruned to its columns, and the view has changed."""
        with self._lock:
            self.engine, self.state = engine, engine.view(self.state).state
            self._told.pop("version", None)
            self._told["replaced"] = object()
        self.flush()

    def flush(self) -> None:
        """Tells listeners what has changed since they were last told."""
        with self._lock:
            if self._timer:
                self._timer.cancel()
                self._timer = None
            now, before = dict(self.state), self._told
            self._told = now
        differs = {k for k in now.keys() | before.keys() if now.get(k) != before.get(k)}
        if "selected" in differs:
            for listener in list(self._listeners["selected"]):
                listener(now)
        if differs - {"selected"}:
            for listener in list(self._listeners["view"]):
                listener(now)

    # requests
    def request(self, number: int, call: Callable[[Engine], object], answer: Callable[[dict], None]) -> None:
        """Runs ``call`` on the engine aside; ``answer`` gets {id, ok, result} or {id, ok, reason} unless it was aborted."""
        tag = f"request-{self._name}-{number}"
        spark = self.engine.source.sparkSession

        def run() -> None:
            spark.addTag(tag)
            try:
                said = {"id": number, "ok": True, "result": call(self.engine)}
            except Exception as e:  # noqa: BLE001  an error is an answer
                said = {"id": number, "ok": False, "reason": str(e) or type(e).__name__}
            finally:
                spark.removeTag(tag)
            with self._lock:
                wanted = self._running.pop(number, None) == tag
            if wanted:
                answer(said)

        with self._lock:
            self._running[number] = tag
        self._pool.submit(run)

    def abort(self, number: int) -> bool:
        """Interrupts a request; whether it was still running."""
        with self._lock:
            tag = self._running.pop(number, None)
        if tag:
            self.engine.source.sparkSession.interruptTag(tag)
        return tag is not None

    def close(self) -> None:
        for number in list(self._running):
            self.abort(number)
        if self._timer:
            self._timer.cancel()
        self._pool.shutdown(wait=False)


class Expansion:
    """Which groups are open: those below ``levels`` start closed, once, when they first arrive (-1: all start open)."""

    def __init__(self, levels: int = 0):
        self.levels, self.seen, self.closed = levels, set(), set()

    def arrived(self, paths: list[tuple]) -> list[tuple]:
        """The groups, given by their path of keys, that are to be collapsed now."""
        new = [p for p in dict.fromkeys(map(tuple, paths)) if p not in self.seen]
        self.seen.update(new)
        out = [p for p in new if self.levels >= 0 and len(p) > self.levels]
        self.closed.update(out)
        return out

    def toggle(self, path: tuple, opened: bool) -> None:
        """What the reader opens or closes stays so when the group arrives again."""
        self.seen.add(tuple(path))
        (self.closed.discard if opened else self.closed.add)(tuple(path))
