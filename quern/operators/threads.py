"""Chat threads: assembly, recency, de-duplication, parents, channels, turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.session import prepared


def assemble(messages: DataFrame, most: int = 7000) -> DataFrame:
    """One row per thread: its messages ``user: text`` by time, ``most`` characters of them; messages without text are left
    out. Only lines that begin within these characters are gathered, so a thread of any length is a row of bounded size."""
    said = messages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.concat(F.coalesce("user_name", F.lit("")), F.lit(": "), "text")
    thread = ("channel_id", "channel_name", "thread_ts")
    before = Window.partitionBy(*thread).orderBy("ts", "idx", "line").rowsBetween(Window.unboundedPreceding, -1)
    told = said.select(*thread, "ts", "idx", F.left(line, F.lit(most)).alias("line"), F.length(line).alias("n"))
    told = told.withColumn("from", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    first = F.when(F.col("from") < most, F.struct("ts", "idx", "line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["line"]), "\n")
    return told.groupBy(*thread).agg(F.left(joined, F.lit(most)).alias("body"), F.count(F.lit(1)).alias("n_messages"), F.max("ts").alias("last_ts"))


def with_context(pieces: DataFrame, contexts: DataFrame) -> DataFrame:
    """Pieces with their thread's context, if it has one, and ``embed_text``: the context in front of the text."""
    c = contexts.select("channel_id", "thread_ts", F.col("context"))
    told = F.concat(F.lit("[Slack 대화 맥락]\n"), "context", F.lit("\n\n"), "text")
    return pieces.join(c, ["channel_id", "thread_ts"], "left").withColumn("embed_text", F.coalesce(told, "text"))


def names_a_channel(q: Column) -> Column:
    """Whether a question names a channel outright (``#name``), which makes it one about chat alone."""
    return q.rlike(r"#\S+")


def resolve_or_none(queries: DataFrame, channels: Callable[[], DataFrame]) -> DataFrame:
    """:func:`resolve_channels`, or no channel for every question if the channels can't be listed."""
    try:
        known = channels()
        known.limit(1).count()
    except Exception:  # whatever the listing raises: questions go on without a channel
        return queries.select("id", F.array().cast("array<string>").alias("names"), F.lit("").alias("confidence"))
    return resolve_channels(queries, known)


def thread_key(channel_id: Column, thread_ts: Column) -> Column:
    return F.concat_ws(":", channel_id, thread_ts)


def latest(messages: DataFrame, limit: int) -> DataFrame:
    """The newest threads by their number's value, each by its first piece."""
    first = messages.groupBy("channel_id", "thread_ts").agg(F.min_by(F.struct("text", "user_name"), "idx").alias("first"))
    return first.orderBy(F.col("thread_ts").try_cast("double").desc(), "channel_id").limit(limit).select("channel_id", "thread_ts", "first.*")


def first_per_thread(hits: DataFrame, k: int) -> DataFrame:
    """The best-ranked hit of each thread, k at most."""
    by = Window.partitionBy("channel_id", "thread_ts").orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(by)).where(F.col("__n") == 1).drop("__n").orderBy("rank").limit(k)


def collapse_parents(children: DataFrame, parents: DataFrame, context: int = 900) -> DataFrame:
    """Children with up to 900 characters of their parent, then parents without a child."""
    p = parents.select("channel_id", "thread_ts", F.left("body", F.lit(context)).alias("parent_context"))
    with_parent = children.join(p, ["channel_id", "thread_ts"], "left").withColumn("kind", F.lit("child"))
    alone = parents.join(children.select("channel_id", "thread_ts").distinct(), ["channel_id", "thread_ts"], "left_anti")
    alone = alone.select("channel_id", "thread_ts", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("parent_context"), F.lit("parent").alias("kind"))
    return with_parent.select("channel_id", "thread_ts", "idx", "parent_context", "kind").unionByName(alone)


def meaningful(text: Column) -> Column:
    """Not a notice that someone joined, left or was added."""
    return ~F.coalesce(text, F.lit("")).rlike(fixed.SYSTEM_EVENT)


def last_turns(conversations: DataFrame, n: int = 6) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return conversations.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def routing_queries(conversations: DataFrame) -> DataFrame:
    """Each user turn as it should be routed: behind the user's turn before it if it begins like a follow-up."""
    users = conversations.where(F.col("role") == "user").withColumn("q", F.trim(F.coalesce("text", F.lit(""))))
    before = F.lag("q").over(Window.partitionBy("conv_id").orderBy("turn"))
    return users.withColumn("before", before).select("conv_id", "turn", F.when(F.col("before").isNotNull() & F.col("q").rlike(fixed.FOLLOW_UP), F.concat_ws("\n", "before", "q")).otherwise(F.col("q")).alias("routed"))


def resolve_channels(queries: DataFrame, channels: DataFrame) -> DataFrame:
    """``id, names, confidence``: channels a query names outright, else the one channel that a fragment of it can mean.

    Needs a word for chat. Names stand outright as ``#name``, ``name채널`` or ``채널name`` without separators. Otherwise runs
    of words, longest first and then leftmost, are tried as a beginning or end of a name or the beginning of one of its
    parts; the first run that fits exactly one channel is taken. ``channels``: ``name``; a workspace has some thousands.
    """
    known = channels.select("name", X.squeezed(F.col("name")).alias("n")).where(F.col("n") != "").distinct()
    known = F.broadcast(known) if known.count() <= 100_000 else known
    cue = queries.where(F.coalesce("q", F.lit("")).rlike(fixed.CHANNEL_CUE)).withColumn("s", X.squeezed(F.col("q")))
    named = F.col("s").contains(F.concat(F.lit("#"), "n")) | F.col("s").contains(F.concat("n", F.lit("채널"))) | F.col("s").contains(F.concat(F.lit("채널"), "n"))
    confirmed = cue.join(known, named).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    words = F.filter(F.split("q", r"[\s,./?!·]+"), lambda w: w != "")
    runs = cue.withColumn("w", words).select(
        "id", "w", F.explode(F.flatten(F.transform(F.sequence(F.size("w"), F.lit(1), F.lit(-1)), lambda size: F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda at: F.struct(size.alias("size"), at.alias("at")))))).alias("run")
    )
    pieces = runs.select("id", "run.size", "run.at", X.squeezed(F.array_join(F.slice("w", F.col("run.at") + 1, F.col("run.size")), "")).alias("piece"))
    pieces = pieces.where((F.length("piece") >= 2) & ~F.col("piece").isin(*fixed.CHANNEL_GENERIC))
    part = F.exists(F.split("name", r"[\s_-]+"), lambda x: (x != "") & X.squeezed(x).startswith(F.col("piece")))
    fits = F.col("n").startswith(F.col("piece")) | F.col("n").endswith(F.col("piece")) | part
    single = pieces.join(known, fits).groupBy("id", "size", "at").agg(F.count(F.lit(1)).alias("n_fit"), F.min("name").alias("name")).where(F.col("n_fit") == 1)
    inferred = single.groupBy("id").agg(F.min_by("name", F.struct(-F.col("size"), F.col("at"))).alias("guess"))
    out = queries.select("id").join(confirmed, "id", "left").join(inferred, "id", "left")
    return out.select(
        "id", F.coalesce("names", F.when(F.col("guess").isNotNull(), F.array("guess")), F.array().cast("array<string>")).alias("names"),
        F.when(F.col("names").isNotNull(), "confirmed").when(F.col("guess").isNotNull(), "inferred").otherwise("").alias("confidence"),
    )


def channel_filter(hits: DataFrame, names: list[str]) -> DataFrame:
    """Rows that aren't chat and rows of the channels; all rows if that leaves nothing."""
    from quern.operators.fusion import keep_or_all

    return keep_or_all(hits, (F.col("kind") != "slack") | F.col("channel_name").isin(names))


def new_messages(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return incoming.join(existing.select("channel_id", "ts").distinct(), ["channel_id", "ts"], "left_anti").dropDuplicates(["channel_id", "ts"])


def high_water(messages: DataFrame) -> DataFrame:
    """Per channel the largest time stamp as text, '0' if there is none."""
    return messages.groupBy("channel_id").agg(F.coalesce(F.max("ts"), F.lit("0")).alias("oldest"))


#: Characters of a thread that are cut as one text; a longer one is cut in parts of about this size.
SEGMENT = 1_000_000
#: Where a thread's text may be cut, best first; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "다. ", "요. ", " ", "")


def thread_texts(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``channel_id, channel_name, thread_ts, part, text``: a thread's header (channel and whole first message) and all its
    messages by time, a line each. Messages without text are left out.

    A thread of more than ``segment`` characters has several parts, so a row has about that many and one message at most;
    a message that is longer than that alone has parts of its own. Sums run over lengths; only a part's lines are gathered.
    """
    said = messages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.concat(F.coalesce("user_name", F.lit("")), F.lit(": "), "text")
    header = F.concat(F.lit("채널: #"), F.coalesce("channel_name", F.lit("")), F.lit("\n스레드 시작: "), "text", F.lit("\n"))
    thread = ("channel_id", "channel_name", "thread_ts")
    order = Window.partitionBy(*thread).orderBy("ts", "idx", "text")
    told = said.withColumn("line", F.when(F.row_number().over(order) == 1, F.concat(header, line)).otherwise(line))
    # a line longer than a part is cut; its pieces are joined by nothing
    cut = F.regexp_extract_all("line", F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))
    each = told.select(*thread, "ts", "idx", "text", F.posexplode(cut).alias("k", "line"))
    before = Window.partitionBy(*thread).orderBy("ts", "idx", "text", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).withColumn("part", F.floor(F.col("at") / segment).cast("long"))
    item = F.struct("at", "k", F.concat(F.when(F.col("k") > 0, "").otherwise("\n"), "line").alias("line"))
    parts = placed.groupBy(*thread, "part").agg(F.array_sort(F.collect_list(item)).alias("lines"))  # about a segment's characters
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return parts.select(*thread, "part", F.when(F.col("lines")[0]["k"] == 0, F.substring(joined, 2, 2**31 - 1)).otherwise(joined).alias("text"))


def thread_chunks(messages: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """``channel_id, channel_name, thread_ts, idx, text``: a thread with its header as one piece, or cut into pieces if it
    doesn't fit. Every word of a thread is in a piece. ``idx`` grows with the place; it has gaps after blank pieces and
    between the parts of a thread of more than ``segment`` characters."""
    from quern.operators.chunking import split

    whole = thread_texts(messages, segment)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for c, name, t, part, text in frame.itertuples(index=False):
                pieces = [text] if len(text) <= size else split(text, size, overlap, SEPARATORS)
                rows += [(c, name, t, int(part) * segment + i, p) for i, p in enumerate(pieces) if p.strip()]
            yield pd.DataFrame(rows, columns=["channel_id", "channel_name", "thread_ts", "idx", "text"])

    prepared(whole.sparkSession)
    return whole.mapInPandas(run, "channel_id string, channel_name string, thread_ts string, idx long, text string")
