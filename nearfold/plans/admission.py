"""Admission without a queue: a call gets a permit at once or is refused."""

from __future__ import annotations

import os
import threading
from contextlib import contextmanager

from ..errors import Busy


class AdmissionGate:
    def __init__(self, capacity: int | None = None):
        self.capacity = 2 * (os.cpu_count() or 1) if capacity is None else capacity
        self._lock, self._taken = threading.Lock(), 0

    @property
    def in_flight(self) -> int:
        return self._taken

    @contextmanager
    def permit(self):
        with self._lock:
            if self._taken >= self.capacity:
                raise Busy()
            self._taken += 1
        try:
            yield
        finally:
            with self._lock:
                self._taken -= 1


#: Shared by all searches of this driver.
GATE = AdmissionGate()
