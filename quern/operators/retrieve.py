"""Hybrid retrieval as one plan: dense, lexical and chat candidates, merge, filters, rerank, top k, neighbours, balance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import dates, fixed
from quern.functions import text as X
from quern.operators import catalog, fusion, providers, threads, vector
from quern.operators import chat as chats


@dataclass(frozen=True)
class Stores:
    """``points``: ``file_id, idx, root, vector``; ``chunks``: ``file_id, idx, text, root``; ``files``: the manifest;
    ``messages``: chat pieces without vectors, or None; ``synopses``: ``file_id, root, synopsis, vector``, or None; ``chat``:
    chat pieces and parents with vectors, or None. Where ``chat`` is there, ``messages`` isn't asked."""

    points: DataFrame
    chunks: DataFrame
    files: DataFrame
    messages: DataFrame | None = None
    synopses: DataFrame | None = None
    chat: chats.Chat | None = None

    @property
    def has_chat(self) -> bool:
        return self.chat is not None or self.messages is not None


def dense_candidates(s: Stores, query: list[float], k: int, roots: list[str] | None) -> DataFrame:
    """The k nearest chunks; texts are fetched for those k rows alone."""
    p = s.points.where(F.col("root").isin(roots)) if roots else s.points
    top = vector.top_k(vector.scored(p, query), k, "file_id", "idx").select("file_id", "idx", "score")
    top = fusion.with_rank(top, "pos", F.col("score").desc(), F.col("file_id"), F.col("idx")).drop("score")
    return s.chunks.join(F.broadcast(top), ["file_id", "idx"]).select("file_id", "idx", "pos", "text", "root", F.lit("drive").alias("kind"))


def name_candidates(s: Stores, query: list[float], terms: list[str], roots: list[str] | None) -> DataFrame:
    found = catalog.lexical_candidates(s.files, s.chunks, s.points, query, terms, allowed=roots or ())
    found = fusion.with_rank(found, "pos", F.col("name_score").desc(), F.col("seq"), F.col("score").desc(), F.col("idx"))
    return found.select("file_id", "idx", "pos", "text", "root", F.lit("drive").alias("kind"))


def synopsis_candidates(s: Stores, query: list[float], roots: list[str] | None) -> DataFrame:
    found = catalog.synopsis_candidates(s.synopses, s.chunks, s.points, query, roots)
    found = fusion.with_rank(found, "pos", F.col("file_score").desc(), F.col("file_id"), F.col("score").desc(), F.col("idx"))
    return found.select("file_id", "idx", "pos", "text", "root", F.lit("drive").alias("kind"), "synopsis")


def chat_candidates(s: Stores, question: str, k: int) -> DataFrame:
    """The k pieces of chat that share most words with the question, without system events and secrets, with their links. A
    registered reranker reads these k alone, later."""
    m = s.messages.where(threads.meaningful(F.col("text"))).withColumn("score", providers.overlap(question, F.col("text")))
    top = m.orderBy(F.col("score").desc(), F.col("ts").desc(), "channel_id", "idx").limit(k)
    top = fusion.with_rank(top, "pos", F.col("score").desc(), F.col("ts").desc(), F.col("channel_id"), F.col("idx"))
    return top.select(
        F.concat(F.lit("slack:"), "channel_id", F.lit(":"), "thread_ts").alias("file_id"), F.col("idx").cast("long").alias("idx"), "pos", X.redact(F.col("text")).alias("text"),
        F.col("channel_name").alias("root"), F.lit("slack").alias("kind"), "thread_ts", X.permalink(F.col("channel_id"), F.col("thread_ts")).alias("file_url"),
    )


def retrieve(
    s: Stores, question: str, query: list[float], terms: list[str] = (), roots: list[str] | None = None, period: tuple[str, str] | None = None,
    candidates: int = fixed.CANDIDATES, top_k: int = fixed.TOP_K, chat: bool = False, expand: int = 1, sources: Sequence[str] = (), recent: bool = False, channels: Sequence[str] = (),
) -> DataFrame:
    """``file_id, idx, rank, score, is_neighbour`` (and ``kind`` with chat) of the answer's chunks.

    ``sources``: only ``drive`` or only ``slack``, if the question names one alone; an error if chat alone is asked for and
    there is none. ``recent`` orders the top rows by time rather than by score. ``channels`` narrows chat to these, if any row is
    in them. Of chat with vectors an answer from chat alone has one row for each thread, the newest first if ``recent``.
    """
    only = set(sources) if len(set(sources)) == 1 else set()
    if only == {"slack"} and not s.has_chat:
        raise LookupError("chat is not available")
    lists = []
    if only != {"slack"}:
        lists.append(dense_candidates(s, query, candidates, roots))
        if terms:
            lists.append(name_candidates(s, query, list(terms), roots))
        if s.synopses is not None:
            lists.append(synopsis_candidates(s, query, roots))
    if (chat or only == {"slack"}) and only != {"drive"} and s.has_chat:
        lists.append(chats.candidates(s.chat, query, candidates, period) if s.chat is not None else chat_candidates(s, question, candidates))
    merged = fusion.merge_candidates(lists, notes=("synopsis",))
    if period:
        stamps = s.files.select("file_id", "mod_time", "name", "path")
        merged = merged.join(stamps, "file_id", "left")
        hit: dict[str, Column] = {"source": F.col("kind"), "thread_ts": F.col("thread_ts") if "thread_ts" in merged.columns else F.lit(None).cast("string"), **{k: F.col(k) for k in ("name", "path", "root", "mod_time")}}
        merged = merged.where(dates.in_period(hit, F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")))
    if channels:
        merged = chats.narrowed(merged, channels)
    place = F.col("branch") * 1_000_000 + F.col("pos")
    said = {c: F.col(c) for c in ("channel_name", "synopsis", "parent_context", "text") if c in merged.columns}
    ranked = providers.rerank(merged.withColumn("place", place), question, order="place", text=providers.rerank_text(said))
    if only == {"slack"} and s.chat is not None:
        ranked = ranked if recent else ranked.where(F.col("rank") <= top_k)
        return chats.once_per_thread(ranked, top_k, recent).select("file_id", "idx", "rank", "score", "kind", "text", "file_url")
    if recent:
        when = s.files.select(F.col("file_id").alias("__of"), F.coalesce("mod_time", F.lit("")).alias("__when"))
        when = ranked.join(when, F.col("file_id") == F.col("__of"), "left").withColumn("__when", F.coalesce("__when", F.lit("")))
        ranked = fusion.by_recency(when, "__when").drop("__of", "__when")
    if chat and not only:
        ranked = fusion.balance_sources(ranked, top_k)
        return ranked.select("file_id", "idx", "rank", "score", "kind")
    top = ranked.where(F.col("rank") <= top_k).select("file_id", "idx", "rank", "score")
    if only == {"slack"}:
        return top.withColumn("is_neighbour", F.lit(0))
    return fusion.expand_neighbours(top, s.chunks, top=expand)


@dataclass(frozen=True)
class Answer:
    hits: DataFrame
    notes: list[str]


def answer(s: Stores, question: str, query: list[float], channel_names: Callable[[], DataFrame] | None = None, **how) -> Answer:
    """:func:`retrieve` for what the question itself says of its sources and channels, with notes on how it was read.

    A question for the latest chat alone takes the newest threads without a search. Chat is asked unless only the drive is
    named. A channel without any row is given up, which is a note.
    """
    said = chats.asked(question, s.chat.pieces if s.chat is not None else None, channel_names)
    notes = list(said.notes)
    if said.only_latest and s.chat is not None:
        return Answer(chats.latest_answer(s.chat, said.channels, how.get("top_k", fixed.TOP_K)), notes)
    with_chat = s.has_chat and said.sources != {"drive"}
    if said.channels and said.chat_only and s.chat is not None:
        found = chats.candidates(s.chat, query, how.get("candidates", fixed.CANDIDATES), how.get("period"))
        if found.where(F.col("channel_name").isin(list(said.channels))).isEmpty():
            notes.append(fixed.NOTE_CHANNEL_EMPTY.format(min(said.channels)))
    hits = retrieve(s, question, query, chat=with_chat, sources=sorted(said.sources), channels=said.channels, recent=said.recent and said.chat_only, **how)
    return Answer(hits, notes)


def chunk_index(chunks: DataFrame) -> DataFrame:
    """The vector table of chunks: stable ids, hashes and embeddings by the provider, in Arrow batches."""
    return chunks.select(
        X.uuid5(F.concat_ws(":", "file_id", F.col("idx").cast("string"))).alias("point_id"), "file_id", "idx", "root", F.sha2("text", 256).alias("content_hash"), providers.embed(F.col("text")).alias("vector")
    )
