"""Queries of chat as a vector store: a message is a piece, its vector one of ``embeddings``; a conversation is a thread."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chat, retrieve, threads
from quern.plans.base import MESSAGES, messages, query
from quern.plans.retrieval import CREDENTIAL, EVENT, QUESTION, SHAPES, TOKENS, stores
from quern.plans.vectors import query_vector
from quern.scratch import folder
from quern.session import table
from quern.sources.chat import SCHEMA, ChatPages
from quern.streaming import incremental


def _vectors(spark, d):
    """``vec_id, vector``, and how many there are; a piece or parent without a vector of its own number takes that number's
    remainder."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e, e.count()


def store(spark, d) -> chat.Chat:
    e, n = _vectors(spark, d)
    m = messages(spark, d)
    piece = m.withColumn("vec_id", (F.col("conv_id") * 7 + F.col("idx") * 3 + 1) % n).join(e, "vec_id")
    whole = threads.assemble(m).withColumn("vec_id", (F.split("thread_ts", r"\.")[0].cast("long") - 1785000000) * 11 % n).join(e, "vec_id")
    text = F.concat(F.lit("채널: #"), "channel_name", F.lit("\n스레드 전체 대화:\n"), "body")
    return chat.Chat(
        piece.select("channel_id", "channel_name", "thread_ts", F.col("idx").cast("long").alias("idx"), "text", "vector"),
        whole.select("channel_id", "channel_name", "thread_ts", text.alias("text"), "vector"),
    )


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
STORE_SQL = MESSAGES + f""", e AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {Q}) AS score FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
piece AS (SELECT m.*, score FROM messages m, n JOIN e ON e.vec_id = (conv_id * 7 + idx * 3 + 1) % n.n),
whole AS (SELECT conv_id, channel_id, channel_name, thread_ts, '채널: #' || channel_name || chr(10) || '스레드 전체 대화:' || chr(10) || substr(string_agg(user_name || ': ' || text, chr(10) ORDER BY ts, idx), 1, 7000) AS text FROM messages WHERE trim(text) <> '' GROUP BY 1, 2, 3, 4),
parent AS (SELECT w.*, score FROM whole w, n JOIN e ON e.vec_id = conv_id * 11 % n.n),
dense AS (SELECT channel_id, channel_name, thread_ts, idx, text, row_number() OVER (ORDER BY score DESC, channel_id, thread_ts, idx) AS pos FROM piece QUALIFY pos <= 50),
parents AS (SELECT *, row_number() OVER (ORDER BY score DESC, channel_id, thread_ts) AS pos FROM parent QUALIFY pos <= 20),
cand AS (SELECT 'slack:' || channel_id || ':' || thread_ts AS file_id, CAST(idx AS BIGINT) AS idx, pos, text, 'slack' AS kind, channel_id, channel_name, thread_ts, (SELECT substr(p.text, 1, 900) FROM parents p WHERE p.channel_id = d.channel_id AND p.thread_ts = d.thread_ts) AS ctx FROM dense d
 UNION ALL SELECT 'slack-thread:' || channel_id || ':' || thread_ts, 0, 200000 + pos, text, 'slack_parent', channel_id, channel_name, thread_ts, NULL FROM parents WHERE (channel_id, thread_ts) NOT IN (SELECT channel_id, thread_ts FROM dense)),
safe AS (SELECT * REPLACE (regexp_replace(regexp_replace(text, '{CREDENTIAL}', '\\1\\2[REDACTED]', 'g'), '{SHAPES}', '[REDACTED]', 'g') AS text, regexp_replace(regexp_replace(ctx, '{CREDENTIAL}', '\\1\\2[REDACTED]', 'g'), '{SHAPES}', '[REDACTED]', 'g') AS ctx) FROM cand WHERE NOT regexp_matches(coalesce(text, ''), '{EVENT}')),
q AS (SELECT {TOKENS.format("'{QUESTION}'")} AS w)"""
SCORE = f"len(list_intersect(w, {TOKENS.format(chr(39) + 'channel: ' + chr(39) + ' || channel_name || chr(10) || coalesce(' + chr(39) + 'thread: ' + chr(39) + ' || ctx || chr(10), ' + chr(39) + chr(39) + ') || text')})) / len(w)"
RANKED_SQL = f"ranked AS (SELECT file_id, idx, kind, channel_id, thread_ts, text, {SCORE} AS score, CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank FROM chosen, q)"


@query("chat_dense", STORE_SQL.replace("{QUESTION}", QUESTION) + "SELECT file_id, idx, kind, pos, sha256(text) AS text_hash, sha256(ctx) AS context_hash FROM safe")
def chat_dense(spark, d):
    """The 50 nearest pieces and the 20 nearest parents, collapsed, as they are shown."""
    found = chat.candidates(store(spark, d), query_vector(spark, d), 50)
    return found.select("file_id", "idx", "kind", F.col("pos").cast("long").alias("pos"), F.sha2("text", 256).alias("text_hash"), F.sha2("parent_context", 256).alias("context_hash"))


LINK = "'https://slack.com/archives/' || channel_id || '/p' || replace(thread_ts, '.', '') AS file_url"
IN_CHANNEL = STORE_SQL.replace("{QUESTION}", QUESTION + " #team-3") + f""", chosen AS (SELECT * FROM safe WHERE channel_name = 'team-3' OR NOT EXISTS (SELECT 1 FROM safe WHERE channel_name = 'team-3')), {RANKED_SQL},
one AS (SELECT *, row_number() OVER (PARTITION BY channel_id, thread_ts ORDER BY rank) AS k FROM ranked WHERE rank <= 6)
SELECT file_id, idx, kind, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, round(score, 4) AS score, {LINK} FROM one WHERE k = 1"""


def _shown(hits):
    return hits.select("file_id", "idx", "kind", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score"), "file_url")


@query("retrieve_channel", IN_CHANNEL)
def retrieve_channel(spark, d):
    """A question that names a channel: chat alone, narrowed to it, each thread once."""
    s = retrieve.Stores(*[None] * 3, chat=store(spark, d))
    return _shown(retrieve.answer(s, f"{QUESTION} #team-3", query_vector(spark, d)).hits)


@query("retrieve_latest", MESSAGES + f"""SELECT 'slack:' || channel_id || ':' || thread_ts AS file_id, CAST(min(idx) AS BIGINT) AS idx, 'slack' AS kind, CAST(row_number() OVER (ORDER BY CAST(thread_ts AS DOUBLE) DESC) AS INTEGER) AS rank, 0.0::DOUBLE AS score, {LINK} FROM messages GROUP BY channel_id, thread_ts QUALIFY rank <= 6""")
def retrieve_latest(spark, d):
    """A question for the latest chat: the newest threads, without a search."""
    s = retrieve.Stores(*[None] * 3, chat=store(spark, d))
    return _shown(retrieve.answer(s, "최근 슬랙 대화 알려줘", query_vector(spark, d)).hits)


MONTH = ("2026-07-26", "2026-07-27")
DAY = "CAST(to_timestamp(CAST(split_part(thread_ts, '.', 1) AS BIGINT) + 32400) AT TIME ZONE 'UTC' AS DATE)"
IN_MONTH = STORE_SQL.replace("{QUESTION}", QUESTION).split("cand AS")[0] + f"""heads AS (SELECT channel_id, channel_name, thread_ts, min(idx) AS idx, row_number() OVER (ORDER BY CAST(thread_ts AS DOUBLE) DESC, channel_id, thread_ts) AS pos FROM messages GROUP BY 1, 2, 3 QUALIFY pos <= 5000),
scan AS (SELECT h.channel_id, h.channel_name, h.thread_ts, h.idx, m.text, 100000 + pos AS pos FROM heads h JOIN messages m USING (channel_id, thread_ts, idx)),
every AS (SELECT channel_id, channel_name, thread_ts, idx, text, pos FROM dense UNION ALL SELECT * FROM scan WHERE (channel_id, thread_ts, idx) NOT IN (SELECT channel_id, thread_ts, idx FROM dense)),
both_ AS (SELECT * FROM every WHERE {DAY} = DATE '{MONTH[0]}')
SELECT 'slack:' || channel_id || ':' || thread_ts AS file_id, CAST(idx AS BIGINT) AS idx, CAST(pos AS BIGINT) AS pos FROM both_ WHERE NOT regexp_matches(coalesce(text, ''), '{EVENT}')"""


@query("chat_month", IN_MONTH)
def chat_month(spark, d):
    """Pieces for a period: the nearest ones and the first ones of its newest threads, without parents."""
    s = store(spark, d)
    found = chat.in_period(chat.candidates(chat.Chat(s.pieces), query_vector(spark, d), 50, MONTH), MONTH)
    return found.select("file_id", "idx", F.col("pos").cast("long").alias("pos"))


@query("chat_stream", MESSAGES + "SELECT channel_id, ts, count(*) AS n FROM messages GROUP BY 1, 2")
def chat_stream(spark, d):
    """Messages of a chat service by a stream that is stopped and started again when there are more: each is read once. The
    service is stood in for by pages of the conversations, the earlier half first."""
    spark.dataSource.register(ChatPages)
    at = folder(spark, "chat-stream")
    m = messages(spark, d)
    second = F.split("ts", r"\.")[0].cast("long")
    middle = m.agg(F.percentile_approx(second, 0.5)).first()[0] or 0
    for part in (second <= middle, second > middle):
        said = F.collect_list(F.struct("ts", "thread_ts", "channel_name", F.col("user_name").alias("user"), "text")).alias("messages")
        pages = m.where(part).groupBy("channel_id", "thread_ts").agg(said)  # a page for each thread
        pages.select("channel_id", "messages").write.mode("append").partitionBy("channel_id").json(f"{at}/pages")
        stream = spark.readStream.format("chat_pages").load(f"{at}/pages")
        incremental.run_available(stream, f"{at}/checkpoint", lambda batch, _: batch.write.mode("append").parquet(f"{at}/table"))
    return spark.read.schema(SCHEMA).parquet(f"{at}/table").groupBy("channel_id", "ts").agg(F.count(F.lit(1)).alias("n"))
