"""A chat service as a Spark source: batches and streams of its messages, joined with users, and written back per channel.

:class:`ChatPages` reads a service through a client: a class with ``channels()``, ``history(channel, oldest, latest, cursor)``
and ``replies(channel, ts, cursor)``, the last two of which give one page, ``(messages, next cursor)``; the option ``client``
names it as ``module:class``, and it is made with the options. The default one, :class:`FolderClient`, has pages in files.
One partition reads one channel; replies are fetched only of messages that have some.

A stream's offset is the time up to which each channel was read. A batch has the messages between two offsets, so after a
stop it goes on where it was, and a batch that is run again reads the same messages. Calls that are refused for their rate
or that fail on the way are tried ``ATTEMPTS`` times, after the wait that the service asks for, ``LONGEST_WAIT`` seconds at most.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "channel_id string, channel_name string, ts string, thread_ts string, user_id string, text string, reply_count int"
#: Calls in all, and seconds that a wait has at most, and where the service names none.
ATTEMPTS, LONGEST_WAIT, DEFAULT_WAIT = 6, 120.0, 5.0


class RateLimited(Exception):
    """A call that was refused for now. ``wait``: seconds, or None if the service doesn't say."""

    def __init__(self, wait: float | None = None):
        super().__init__(f"rate limited for {wait} s")
        self.wait = wait


def patiently(call: Callable, *args, sleep: Callable[[float], None] = time.sleep):
    """The result of a call that may be refused or fail on the way; its last error if it never succeeds."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call(*args)
        except RateLimited as e:
            wait, why = DEFAULT_WAIT if e.wait is None else e.wait, e
        except (ConnectionError, TimeoutError) as e:
            wait, why = float(2 ** (attempt - 1)), e
        if attempt == ATTEMPTS:
            raise why
        sleep(min(wait, LONGEST_WAIT))


def moment(ts: str | None) -> tuple[int, str]:
    """A message's time, in order; none comes first."""
    seconds, _, fraction = (ts or "0").partition(".")
    return int(seconds) if seconds.isdigit() else 0, fraction.ljust(6, "0")


class FolderClient:
    """Pages in files ``<path>/<channel>/*.json``, each line of which is a page ``{"messages": [...]}`` (or a whole file that
    is one), and replies in ``<path>/<channel>/replies/<ts>.json``. A channel's folder may be called ``channel_id=<channel>``."""

    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://")

    def channels(self) -> list[str]:
        return sorted(c for c in os.listdir(self.folder) if os.path.isdir(os.path.join(self.folder, c)) and not c.startswith(("_", ".")))

    def history(self, channel: str, oldest: str, latest: str | None, cursor: str) -> tuple[list[dict], str]:
        at = os.path.join(self.folder, channel)
        names = sorted(x for x in os.listdir(at) if x.endswith(".json") and x > cursor)
        if not names:
            return [], ""
        found = [m for page in self._pages(os.path.join(at, names[0])) for m in page]
        inside = [m for m in found if moment(oldest) < moment(m["ts"]) and (latest is None or moment(m["ts"]) <= moment(latest))]
        return inside, names[0] if len(names) > 1 else ""

    def replies(self, channel: str, ts: str, cursor: str) -> tuple[list[dict], str]:
        at = os.path.join(self.folder, channel, "replies", f"{ts}.json")
        return ([m for page in self._pages(at) for m in page], "") if os.path.exists(at) else ([], "")

    @staticmethod
    def _pages(path: str) -> Iterator[list[dict]]:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            yield json.loads(text).get("messages", [])
        except json.JSONDecodeError:  # several pages, a line each
            yield from (json.loads(line).get("messages", []) for line in text.splitlines() if line.strip())


def _client(options):
    module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def _all_pages(page: Callable, *args) -> Iterator[dict]:
    """The messages of all pages of a call."""
    cursor = ""
    while True:
        found, cursor = patiently(page, *args, cursor)
        yield from found
        if not cursor:
            return


@dataclass
class ChannelPartition(InputPartition):
    channel: str
    oldest: str
    latest: str | None = None


def _read(client, partition: ChannelPartition) -> Iterator[tuple]:
    """The messages of a channel between two times, each with its replies."""
    c = partition.channel
    for m in _all_pages(client.history, c, partition.oldest, partition.latest):
        yield _row(c, m)
        if m.get("reply_count", 0):
            yield from (_row(c, r) for r in _all_pages(client.replies, c, m["ts"]) if r["ts"] != m["ts"])


def _row(channel: str, m: dict) -> tuple:
    name = channel.removeprefix("channel_id=")
    return (name, m.get("channel_name", name), m["ts"], m.get("thread_ts") or m["ts"], m.get("user"), m.get("text", ""), int(m.get("reply_count", 0) or 0))


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [ChannelPartition(c, self.options.get("oldest", "0")) for c in patiently(_client(self.options).channels)]

    def read(self, partition: ChannelPartition) -> Iterator[tuple]:
        yield from _read(_client(self.options), partition)


class PageStream(DataSourceStreamReader):
    """Offsets are ``{channel: time}``; a channel that appears later begins at ``oldest``."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        client, out = _client(self.options), {}
        for c in patiently(client.channels):
            newest = max((m["ts"] for m in _all_pages(client.history, c, self.options.get("oldest", "0"), None)), key=moment, default=None)
            if newest is not None:
                out[c] = newest
        return out

    def partitions(self, start: dict, end: dict):
        first = self.options.get("oldest", "0")
        return [ChannelPartition(c, start.get(c, first), upto) for c, upto in sorted(end.items()) if moment(start.get(c, first)) < moment(upto)]

    def read(self, partition: ChannelPartition) -> Iterator[tuple]:
        yield from _read(_client(self.options), partition)


class ChatPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def collect(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with their users' names (display, real, id), those without text left out, ordered as text."""
    u = users.select(F.col("user_id").alias("__u"), F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("display_name", "real_name", "user_id")]).alias("user_name"))
    j = messages.join(u, F.col("user_id") == F.col("__u"), "left").drop("__u")
    j = j.withColumn("user_name", F.coalesce("user_name", "user_id")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return j.orderBy("channel_name", "thread_ts", "ts")


def read_jsonl(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """JSON lines; lines that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(messages: DataFrame, path: str) -> None:
    """A folder of JSON lines for each channel; Spark's commit protocol makes the whole visible at once."""
    messages.write.mode("overwrite").partitionBy("channel_id").json(path)
