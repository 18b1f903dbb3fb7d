"""Chat sync: takes what is new in a folder of chat exports and keeps messages and a summary of every thread.

The source is a file stream that ends when everything there has been read; its checkpoint knows which files were. Below
``output`` are three Parquet tables:

``messages`` by channel, day of the thread and micro-batch: new messages as they are shown (system events and blank ones left
out, secrets masked, with the link of their thread). A batch writes only partitions of its own number, so running it again
after a failure replaces what it wrote and touches nothing else.

``threads`` by channel and day: a row for each thread with its counts, first and last message. It follows from ``messages``
alone: a batch makes the partitions anew in which it has messages, with dynamic partition overwrite. A late reply belongs to
its thread's day, however old that is. A batch that failed half-way makes the same partitions again.

``pieces`` by channel and day, made anew with the same partitions: threads cut into pieces for a search, with the link of their
thread and, if ``embed`` is set, a vector by the registered provider. They are the store that chat retrieval searches.

A message is known by channel, thread and time; one that is delivered again counts once, as it was last delivered. Messages
without channel, thread or time, or with a time that is no number, are counted as unusable and left out.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, mapped, told
from quern.functions import text as X
from quern.operators import providers, threads

DEFAULT = Path(__file__).with_suffix(".json")
MESSAGES = "channel_name string, thread_ts string, ts string, user_name string, text string, link string, channel_id string, day date, batch long"
THREADS = (
    "channel_name string, thread_ts string, link string, n_messages long, n_users long, n_chars long, first_ts string, last_ts string, "
    "opening string, latest string, channel_id string, day date"
)
PIECES = "channel_name string, thread_ts string, idx long, text string, link string, vector array<float>, channel_id string, day date"
TABLES = {"messages": MESSAGES, "threads": THREADS, "pieces": PIECES}
#: Partitions of one batch up to which their list goes to all tasks by broadcast.
MOST_BROADCAST = 100_000
SECONDS_A_DAY = 86_400


def day_of(ts: Column) -> Column:
    """The UTC day of a time stamp in seconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts.try_cast("double") / SECONDS_A_DAY).cast("int"))


def usable() -> Column:
    return F.col("channel_id").isNotNull() & F.col("thread_ts").try_cast("double").isNotNull() & F.col("ts").try_cast("double").isNotNull()


def shown(raw: DataFrame) -> DataFrame:
    """Usable messages as ``messages`` keeps them, without its ``batch``."""
    said = raw.where(usable() & (F.trim(F.coalesce("text", F.lit(""))) != "") & threads.meaningful(F.col("text")))
    return said.select(
        "channel_name", "thread_ts", "ts", "user_name", X.redact(F.col("text")).alias("text"), X.permalink(F.col("channel_id"), F.col("thread_ts")).alias("link"),
        "channel_id", day_of(F.col("thread_ts")).alias("day"),
    )


KEY = ("channel_id", "day", "thread_ts")


def latest(messages: DataFrame) -> DataFrame:
    """Each message once, as it was last delivered."""
    last = F.max(F.struct("batch", "text", "user_name", "channel_name", "link")).alias("m")
    return messages.groupBy(*KEY, "ts").agg(last).select(*KEY, "ts", "m.*")


def summaries(messages: DataFrame, excerpt: int) -> DataFrame:
    """A row for each thread. Repeated messages and threads are folded by aggregates of fixed size, on both sides of the
    shuffle, so a thread that has most of the messages is no large row or group."""
    key, once = KEY, latest(messages)
    order = F.struct(F.col("ts").cast("double"), F.col("ts"))
    out = once.groupBy(*key).agg(
        F.max("channel_name").alias("channel_name"), F.max("link").alias("link"), F.count(F.lit(1)).alias("n_messages"), F.count_distinct("user_name").alias("n_users"),
        F.sum(F.length("text")).cast("long").alias("n_chars"), F.min_by("ts", order).alias("first_ts"), F.max_by("ts", order).alias("last_ts"),
        F.min_by(F.left("text", F.lit(excerpt)), order).alias("opening"), F.max_by(F.left("text", F.lit(excerpt)), order).alias("latest"),
    )
    return out.select(*[c.split()[0] for c in THREADS.split(", ")])


def pieces(messages: DataFrame, embed: bool) -> DataFrame:
    """The pieces of each thread, under the name that its channel has now."""
    told = latest(messages)
    name = told.groupBy(*KEY).agg(F.max("channel_name").alias("channel_name"))
    cut = threads.thread_chunks(told.drop("channel_name").join(name, list(KEY)).withColumn("idx", F.lit(0)))
    linked = cut.withColumns({"link": X.permalink(F.col("channel_id"), F.col("thread_ts")), "day": day_of(F.col("thread_ts"))})
    vector = providers.embed(F.col("text")) if embed else F.lit(None).cast("array<float>")
    return linked.withColumn("vector", vector).select(*[c.split()[0] for c in PIECES.split(", ")])


def saved(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of. The hint gives files of a reasonable size and splits large partitions."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """``messages``, ``threads`` or ``pieces`` of an output folder."""
    return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}")


def load(batch: DataFrame, number: int, output: str, excerpt: int, embed: bool = False) -> dict:
    """One micro-batch: its messages, and the threads of the partitions they fall into."""
    spark, seen = batch.sparkSession, Observation()
    counted = batch.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(~usable()).alias("unusable"))
    saved(shown(counted).withColumn("batch", F.lit(number).cast("long")), f"{output}/messages", ["channel_id", "day", "batch"])
    kept = table(spark, output, "messages")
    new = kept.where(F.col("batch") == number)
    touched = new.select("channel_id", "day").distinct()
    n = touched.count()
    here = kept.join(F.broadcast(touched) if n <= MOST_BROADCAST else touched, ["channel_id", "day"], "left_semi")
    saved(summaries(here, excerpt), f"{output}/threads", ["channel_id", "day"])
    saved(pieces(here, embed), f"{output}/pieces", ["channel_id", "day"])
    return told("chat_sync", batch=number, **seen.get, written=new.count(), partitions=n)


def sync(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict) -> list[dict]:
    """Reads the chat exports that are new since the last run into messages and threads."""
    done: list[dict] = []
    for name, schema in TABLES.items():  # so that all can be read if there is nothing yet
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{output}/{name}")
    reader = spark.readStream.format(settings["format"]).schema(settings["schema"]).option("maxFilesPerTrigger", settings["files_per_batch"])
    stream = mapped(reader.load(source), settings["columns"])
    write = stream.writeStream.foreachBatch(lambda batch, number: done.append(load(batch, number, output, settings["excerpt"], settings["embed"])))
    write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    told("chat_sync", source=source, output=output, batches=len(done), read=sum(x["read"] for x in done), written=sum(x["written"] for x in done))
    return done


if __name__ == "__main__":
    main("chat_sync", DEFAULT, ("source", "output", "checkpoint"), sync)
