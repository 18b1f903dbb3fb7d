"""The incremental jobs as Structured Streaming: a keyed manifest, message de-duplication, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.manifest import save_keyed

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def distinct_messages(messages: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """Each message once, however often it is delivered within the delay; state older than that is dropped. Replies to old
    threads are kept, since their own time counts and not their thread's."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, at: str, length: str, by: list[str], slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums for tumbling or sliding windows; late rows count within the delay."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, gap: str, user: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))


def keyed_sink(spark: SparkSession, path: str, keys: list[str], newest: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each batch; running a batch again changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        save_keyed(batch.sparkSession, path, batch, keys, F.col(newest))

    return run


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, then stop."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_steps(steps: list[tuple[str, bool, Callable[[], str]]], check_only: bool = False) -> list[tuple[str, str, str]]:
    """``(name, status, detail)`` of each step in order. ``steps``: name, whether it changes anything, and what to run.

    A failed step doesn't stop the later ones; in check mode those that change something are skipped.
    """
    out = []
    for name, changes, run in steps:
        if check_only and changes:
            out.append((name, "skipped", ""))
            continue
        try:
            out.append((name, "ok", str(run())[:2000]))
        except Exception as e:  # the report holds it, and later steps still run
            out.append((name, "failed", f"{type(e).__name__}: {e}"[:2000]))
    return out


def exit_code(report: list[tuple[str, str, str]]) -> int:
    return int(any(status == "failed" for _, status, _ in report))
