"""Chat as a vector store: pieces of threads and whole threads as parents, searched, collapsed and narrowed to channels.

A search reads keys and vectors; texts are fetched for the rows that it found. Every list is cut to its top k before it meets
another one, so what a registered model reads is bounded by the lists' lengths and not by the chat's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import dates, fixed, intent
from quern.functions import text as X
from quern.operators import fusion, providers, threads, vector

THREAD = ("channel_id", "thread_ts")
#: Parents of a search, threads that a period looks at, characters of a parent that a piece carries.
PARENTS, SCANNED, PARENT_CONTEXT = 20, 5000, 900
#: Threads that a question about the latest ones looks at, at least, and for each asked row.
LATEST_LEAST, LATEST_EACH = 30, 5


@dataclass(frozen=True)
class Chat:
    """``pieces``: ``channel_id, channel_name, thread_ts, idx, text, vector``; ``parents``: the same without ``idx``, or None."""

    pieces: DataFrame
    parents: DataFrame | None = None


def pieces_index(messages: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """The pieces of all threads with their vectors; a thread's context, if it has one, is embedded in front of the text."""
    cut = threads.thread_chunks(messages)
    told = threads.with_context(cut, contexts) if contexts is not None else cut.withColumn("embed_text", F.col("text"))
    return told.select("channel_id", "channel_name", "thread_ts", "idx", "text", providers.embed(F.col("embed_text")).alias("vector"))


def parents_index(messages: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """A row for each thread, of its first characters, with its vector."""
    whole = threads.assemble(messages)
    text = F.concat(F.lit("채널: #"), F.coalesce("channel_name", F.lit("")), F.lit("\n스레드 전체 대화:\n"), "body")
    whole = whole.select("channel_id", "channel_name", "thread_ts", text.alias("text"))
    told = F.col("text")
    if contexts is not None:
        whole = whole.join(contexts.select(*THREAD, "context"), list(THREAD), "left")
        told = F.coalesce(F.concat(F.lit("[Slack 스레드 전체 맥락]\n"), "context", F.lit("\n\n"), "text"), "text")
    return whole.select("channel_id", "channel_name", "thread_ts", "text", providers.embed(told).alias("vector"))


def _hit(df: DataFrame, kind: str) -> DataFrame:
    """Rows of the store as candidates."""
    file_id = F.concat(F.lit("slack:" if kind == "slack" else "slack-thread:"), F.concat_ws(":", *THREAD))
    idx = F.col("idx").cast("long") if kind == "slack" else F.lit(0).cast("long")
    return df.select(
        file_id.alias("file_id"), idx.alias("idx"), "pos", "text", F.col("channel_name").alias("root"), F.lit(kind).alias("kind"), *THREAD, "channel_name",
        F.lit(None).cast("string").alias("parent_context"),
    )


def _top(store: DataFrame, query: Sequence[float], k: int, keys: tuple[str, ...]) -> DataFrame:
    """The k nearest rows of a store with ``pos``, ties by key; vectors are read with keys alone, texts for k rows."""
    top = vector.top_k(vector.scored(store.select(*keys, "vector"), query), k, *keys)
    top = fusion.with_rank(top, "pos", F.col("score").desc(), *[F.col(c) for c in keys]).drop("score")
    return store.drop("vector").join(F.broadcast(top), list(keys))  # k rows


def dense(c: Chat, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest pieces."""
    return _hit(_top(c.pieces, query, k, (*THREAD, "idx")), "slack")


def parent_hits(c: Chat, query: Sequence[float], k: int = PARENTS) -> DataFrame:
    """The k nearest parents."""
    return _hit(_top(c.parents, query, k, THREAD), "slack_parent")


def latest(c: Chat, limit: int) -> DataFrame:
    """The first pieces of the newest threads, by the number that a thread's time is, another counting as 0. Only keys are
    aggregated and sorted; texts are fetched for ``limit`` threads."""
    there = (F.coalesce("channel_id", F.lit("")) != "") & (F.coalesce("thread_ts", F.lit("")) != "")
    heads = c.pieces.where(there).groupBy(*THREAD).agg(F.min("idx").alias("idx"))
    order = (F.coalesce(F.col("thread_ts").try_cast("double"), F.lit(0.0)).desc(), F.col("channel_id"), F.col("thread_ts"))
    top = fusion.with_rank(heads.orderBy(*order).limit(limit), "pos", *order)
    return _hit(c.pieces.drop("vector").join(F.broadcast(top), [*THREAD, "idx"]), "slack")  # limit rows


def in_period(hits: DataFrame, period: tuple[str, str]) -> DataFrame:
    """Rows whose thread began in ``[start, end)``."""
    of = {"source": F.col("kind"), "thread_ts": F.col("thread_ts"), "mod_time": F.lit(None).cast("string")}
    return hits.where(dates.in_period(of, F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")))


def collapse(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Pieces with the beginning of their thread where its parent was found, then the parents of which no piece was."""
    p = parents.select(*[F.col(c).alias(f"__{c}") for c in THREAD], F.left("text", F.lit(PARENT_CONTEXT)).alias("__context"))
    same = [F.col(c) == F.col(f"__{c}") for c in THREAD]
    with_parent = children.join(F.broadcast(p), same, "left").withColumn("parent_context", F.col("__context")).drop(*p.columns)  # some rows
    alone = parents.join(children.select(*THREAD).distinct(), list(THREAD), "left_anti")
    return with_parent.unionByName(alone)


def shown(hits: DataFrame) -> DataFrame:
    """Without notices of people coming and going; secrets masked, with the link of the thread."""
    kept = hits.where(threads.meaningful(F.col("text")))
    return kept.withColumns({
        "text": X.redact(F.col("text")), "parent_context": X.redact(F.col("parent_context")), "file_url": X.permalink(F.col("channel_id"), F.col("thread_ts")),
    })


def candidates(c: Chat, query: Sequence[float], k: int, period: tuple[str, str] | None = None) -> DataFrame:
    """What a question finds in chat: the k nearest pieces, those of the newest threads that lie in its period, and parents.

    ``pos`` orders them: pieces by distance, then by time, then parents.
    """
    lists = [dense(c, query, k)]
    if period:
        lists.append(in_period(latest(c, SCANNED), period))
    found = fusion.merge_candidates(lists) if len(lists) > 1 else lists[0].withColumn("branch", F.lit(0))
    found = found.withColumn("pos", F.col("branch") * 100_000 + F.col("pos")).drop("branch")
    if c.parents is not None:
        found = collapse(found, parent_hits(c, query).withColumn("pos", F.lit(200_000) + F.col("pos")))
    return shown(found)


def once_per_thread(hits: DataFrame, k: int, recent_first: bool = False) -> DataFrame:
    """The first row of each thread by ``rank``, k at most, ranked anew. ``recent_first``: the newest threads come first."""
    order = [F.col("rank")]
    if recent_first:
        order = [F.coalesce(F.col("thread_ts").try_cast("double"), F.lit(0.0)).desc(), F.col("rank")]
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*THREAD).orderBy(*order))).where(F.col("__n") == 1).drop("__n")
    top = first.orderBy(*order).limit(k)
    return fusion.with_rank(top, "__new", *order).drop("rank").withColumnRenamed("__new", "rank")


@dataclass(frozen=True)
class Asked:
    """What a question says about its sources. ``channels``: names it means; ``notes``: what the answer should tell."""

    sources: frozenset[str]
    channels: tuple[str, ...]
    notes: tuple[str, ...]
    recent: bool
    only_latest: bool

    @property
    def chat_only(self) -> bool:
        return self.sources == {"slack"}


def asked(question: str, pieces: DataFrame | None, channel_names: Callable[[], DataFrame] | None = None) -> Asked:
    """Reads a question: sources, channels, recency. ``channel_names`` lists the channels (``name``), by default those of the
    pieces; if that fails, the question goes on without a channel."""
    q = SparkSession.active().createDataFrame([(0, question)], "id int, q string")
    if channel_names is None and pieces is not None:
        channel_names = lambda: pieces.where(F.coalesce("channel_name", F.lit("")) != "").select(F.col("channel_name").alias("name")).distinct()
    said = q.select(
        intent.sources(F.col("q")).alias("sources"), F.col("q").rlike(fixed.RECENCY).alias("recent"), intent.generic_recency(F.col("q")).alias("generic"),
        threads.names_a_channel(F.col("q")).alias("named"),
    ).first()
    found = threads.resolve_or_none(q, channel_names).first() if channel_names is not None else None
    names, confidence = (tuple(found["names"]), found["confidence"]) if found else ((), "")
    sources = set(said["sources"]) | ({"slack"} if names or said["named"] else set())
    notes = []
    if confidence == "inferred":
        notes.append(fixed.NOTE_CHANNEL_INFERRED.format(names[0]))
    elif not names and said["named"]:
        notes.append(fixed.NOTE_CHANNEL_UNKNOWN)
    return Asked(frozenset(sources), names, tuple(notes), bool(said["recent"]), bool(said["recent"] and said["generic"]) and sources == {"slack"})


def narrowed(hits: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the channels and rows that aren't chat; all rows if that leaves none."""
    return fusion.keep_or_all(hits, ~F.col("kind").isin("slack", "slack_parent") | F.col("channel_name").isin(list(names)))


def latest_answer(c: Chat, names: Sequence[str], top_k: int) -> DataFrame:
    """The newest threads, of the channels if some are named: ``rank`` by time and ``score`` 0. No vector is read."""
    found = shown(latest(c, max(top_k * LATEST_EACH, LATEST_LEAST)))
    if names:
        found = found.where(F.col("channel_name").isin(list(names)))
    ranked = found.withColumns({"rank": F.col("pos"), "score": F.lit(0.0)})
    return once_per_thread(ranked, top_k, recent_first=True)
