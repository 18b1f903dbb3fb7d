"""Searches side by side with one deadline: each in a thread of its own whose jobs have a tag; what fails or is late is told
apart by branch and leaves the others alone."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    """``state``: ``ok``, ``timeout``, or the name of what a branch raised, which is then in ``error``."""

    value: Any = None
    state: str = "ok"
    error: BaseException | None = None


def together(spark: SparkSession, branches: Mapping[str, Callable[[], Any]], seconds: float, awaited: tuple[str, ...] = ()) -> dict[str, Outcome]:
    """What each branch returns, or why it doesn't. Branches must do their own work before they return: a DataFrame that isn't
    computed yet is computed later, without a deadline.

    Jobs of branches that are late are cancelled by their tag. ``awaited`` branches have no deadline. A branch that hangs outside Spark keeps its thread, which doesn't keep the program.
    """
    found: dict[str, Outcome] = {}
    tags = {name: f"branch-{uuid.uuid4().hex}" for name in branches}

    def run(name: str, work: Callable[[], Any]) -> None:
        spark.sparkContext.addJobTag(tags[name])
        try:
            out = Outcome(work())
        except BaseException as e:  # whatever a branch raises is its own outcome
            out = Outcome(None, type(e).__name__, e)
        finally:
            spark.sparkContext.removeJobTag(tags[name])
        found.setdefault(name, out)

    threads = {name: InheritableThread(target=run, args=(name, work), daemon=True) for name, work in branches.items()}
    end = time.monotonic() + seconds
    for t in threads.values():
        t.start()
    for name, t in threads.items():
        if name not in awaited:
            t.join(max(0.0, end - time.monotonic()))
    for name, t in threads.items():
        if name not in awaited and t.is_alive() and found.setdefault(name, Outcome(None, "timeout")).state == "timeout":
            spark.sparkContext.cancelJobsWithTag(tags[name])
    for name in awaited:
        threads[name].join()
    return dict(found)


def relevance(spark: SparkSession, searches: Mapping[str, Callable[[], DataFrame]], seconds: float) -> tuple[float, dict[str, str]]:
    """The best ``score`` of the searches that answered in time, 0 if none has a row, and each one's state. All of them have
    failed if no state is ``ok``."""
    best = {name: (lambda search=search: search().agg(F.max("score")).first()[0]) for name, search in searches.items()}
    found = together(spark, best, seconds)
    scores = [float(o.value) for o in found.values() if o.state == "ok" and o.value is not None]
    return max(scores, default=0.0), {name: o.state for name, o in found.items()}
