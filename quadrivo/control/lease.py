"""The right to change a warehouse, which one process at a time has.

A term is a file beside the tables, on the same file system, so it holds for processes on any machine: who made it, and until when. Its holder writes it anew while
it works; a term that has run out, as that of a killed process does, is followed by the next one, whose file can be made once only.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from ..sources.warehouse import Warehouse

#: Seconds for which a term lasts unless it is renewed, and the part of them after which it is.
SECONDS, RENEWED = 30.0, 1 / 3


class Held(RuntimeError):
    """Another process has the lease."""


class Lease:
    """A context in which this process has the warehouse; entering raises Held where another one has it. lost says that a term ran out before it could be renewed."""

    def __init__(self, warehouse: Warehouse, seconds: float = SECONDS, now: Callable[[], float] = time.time):
        self.files, self.seconds, self.now = warehouse.files("lease"), seconds, now
        self.name, self.term, self.lost = uuid.uuid4().hex, None, False
        self._ended = threading.Event()

    def _newest(self) -> tuple[int, str, float]:
        """Number, holder and end of the newest term."""
        if not (terms := self.files.names()):
            return 0, "", 0.0
        holder, _, until = (self.files.read(terms[-1]) or "\t0").partition("\t")
        return int(terms[-1]), holder, float(until or 0)

    def taken(self) -> bool:
        """Whether some process has the lease now."""
        return self._newest()[2] > self.now()

    def __enter__(self) -> Lease:
        number, _, until = self._newest()
        if until > self.now() or not self.files.create(f"{number + 1:012d}", self._text()):
            raise Held
        self.term = number + 1
        for old in self.files.names():
            if int(old) < self.term:
                self.files.remove(old)
        threading.Thread(target=self._keep, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._ended.set()
        if not self.lost:
            self.files.replace(f"{self.term:012d}", f"{self.name}\t0")

    def _text(self) -> str:
        return f"{self.name}\t{self.now() + self.seconds}"

    def renew(self) -> None:
        number, holder, _ = self._newest()
        self.lost = self.lost or (number, holder) != (self.term, self.name)
        if not self.lost:
            self.files.replace(f"{self.term:012d}", self._text())

    def _keep(self) -> None:
        while not self._ended.wait(self.seconds * RENEWED) and not self.lost:
            self.renew()
