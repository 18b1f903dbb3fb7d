"""Searches with one deadline: what hangs is cancelled, what fails is told apart, and the rest is there in time."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import deadline, location
from quern.scratch import _SCOPES, scope, written


def hanging(spark):
    """A DataFrame whose job takes a minute."""

    def wait(frames):
        for frame in frames:
            time.sleep(60)
            yield frame

    return spark.range(0, 4, 1, 4).mapInPandas(wait, "id long")


def no_jobs(spark, within=20):
    end = time.monotonic() + within
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < end:
        time.sleep(0.2)
    return list(spark.sparkContext.statusTracker().getActiveJobsIds()) == []


def test_branches(spark):
    def fails():
        raise LookupError("x")

    start = time.monotonic()
    got = deadline.together(spark, {"a": lambda: spark.range(5).count(), "b": fails, "c": lambda: hanging(spark).count(), "d": lambda: time.sleep(40)}, 8)
    assert time.monotonic() - start < 30
    assert {k: o.state for k, o in got.items()} == {"a": "ok", "b": "LookupError", "c": "timeout", "d": "timeout"} and got["a"].value == 5
    assert no_jobs(spark)
    # a branch that is awaited has no deadline, and the tags of others don't stop it
    got = deadline.together(spark, {"slow": lambda: (time.sleep(2), spark.range(3).count())[1], "late": lambda: hanging(spark).count()}, 0.5, awaited=("slow",))
    assert (got["slow"].value, got["late"].state) == (3, "timeout") and no_jobs(spark)


def test_relevance(spark):
    rows = lambda *s: lambda: spark.createDataFrame([(float(x),) for x in s], "score double")

    def fails():
        raise ConnectionError

    best, states = deadline.relevance(spark, {"drive": rows(0.2, 0.7), "slack": fails}, 60)
    assert best == 0.7 and states == {"drive": "ok", "slack": "ConnectionError"}
    assert deadline.relevance(spark, {"drive": rows(), "slack": rows(-0.5)}, 60)[0] == -0.5
    assert deadline.relevance(spark, {"drive": fails}, 60) == (0.0, {"drive": "ConnectionError"})


def test_a_live_source_that_hangs(spark, data):
    from quern.plans.base import files

    question, f = "src4 파일 어디에 있어?", files(spark, data)
    want = [r.file_id for r in location.locate(spark, question, f).files.orderBy("rank").collect()]
    listing = hanging(spark).select(F.col("id").cast("string").alias("file_id"), F.lit("n").alias("name"), F.lit("p").alias("path"), F.lit("m").alias("modified"), F.lit(False).alias("trashed"), F.lit(True).alias("inside_root"), F.col("id").alias("pos"))
    start = time.monotonic()
    found = location.locate_hybrid(spark, question, f, lambda: listing, seconds=2)
    assert found.live == "timeout" and time.monotonic() - start < 40 and no_jobs(spark)
    assert [r.file_id for r in found.files.orderBy("rank").collect()] == want

    def breaks():
        raise PermissionError

    assert location.locate_hybrid(spark, question, f, breaks, seconds=60).live == "PermissionError"
    many = spark.range(500).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("file_id"), F.lit("n").alias("name"), F.lit("p").alias("path"), F.lit("m").alias("modified"), F.lit(False).alias("trashed"), F.lit(True).alias("inside_root"), F.col("id").alias("pos"))
    found = location.locate_hybrid(spark, question, f, lambda: many, seconds=120)
    assert found.live == "ok" and found.files.count() == 5


def test_scopes_of_threads(spark):
    """A block's tables are its thread's own: one that ends elsewhere takes none of them."""
    made, inside, over = [], threading.Event(), threading.Event()

    def other():
        with scope() as keep:
            inside.wait(60)
            made.append(keep(written(spark.range(3), "other")))
        over.set()

    t = threading.Thread(target=other)
    t.start()
    with scope():
        written(spark.range(2), "mine")
        inside.set()
        assert over.wait(120) and len(_SCOPES.get()) == 1
    t.join()
    assert made[0].count() == 3 and _SCOPES.get() == ()
    with pytest.raises(Exception), scope():  # noqa: B017, PT011
        raise ValueError
    assert _SCOPES.get() == ()
