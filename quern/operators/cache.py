"""Small dimensions that are read again when they are old: channel names, folder parents."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quern.scratch import dropped, written


@dataclass
class Cached:
    """A table made by ``load`` and written once; after ``ttl_s`` seconds it is made anew. If that fails, the old one stays."""

    load: Callable[[], DataFrame]
    ttl_s: float
    clock: Callable[[], float] = time.monotonic
    _table: DataFrame | None = field(default=None, init=False)
    _at: float = field(default=0.0, init=False)

    def get(self) -> DataFrame:
        now = self.clock()
        if self._table is None or now - self._at >= self.ttl_s:
            try:
                fresh = written(self.load(), "dimension")
            except Exception:
                if self._table is None:
                    raise
                return self._table
            old, self._table, self._at = self._table, fresh, now
            if old is not None:
                dropped(old)
        return self._table
