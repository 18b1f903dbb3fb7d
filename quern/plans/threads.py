"""Queries of chat threads and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import threads
from quern.plans.base import MESSAGES, messages, query, rows
from quern.session import table

BODY = "string_agg(user_name || ': ' || text, chr(10) ORDER BY ts, idx)"


@query("thread_assembly", MESSAGES + f"SELECT channel_id, thread_ts, sha256(substr({BODY}, 1, 7000)) AS body_hash, count(*) AS n_messages, max(ts) AS last_ts FROM messages WHERE trim(text) <> '' GROUP BY 1, 2")
def thread_assembly(spark, d):
    return threads.assemble(messages(spark, d)).select("channel_id", "thread_ts", F.sha2("body", 256).alias("body_hash"), "n_messages", "last_ts")


@query("latest_threads", MESSAGES + "SELECT channel_id, thread_ts, arg_min(text, idx) AS text, arg_min(user_name, idx) AS user_name FROM messages GROUP BY 1, 2 ORDER BY CAST(thread_ts AS DOUBLE) DESC, channel_id LIMIT 6")
def latest_threads(spark, d):
    return threads.latest(messages(spark, d), 6)


RANKED = MESSAGES + ", hits AS (SELECT *, CAST(row_number() OVER (ORDER BY length(text) DESC, thread_ts, idx) AS INTEGER) AS rank FROM messages)"


def _ranked(spark, d):
    from quern.operators.fusion import with_rank

    top = messages(spark, d).orderBy(F.length("text").desc(), "thread_ts", "idx").limit(50)
    return with_rank(top, "rank", F.length("text").desc(), F.col("thread_ts"), F.col("idx"))


@query("thread_dedup", RANKED + ", one AS (SELECT *, row_number() OVER (PARTITION BY channel_id, thread_ts ORDER BY rank) AS k FROM hits WHERE rank <= 50) SELECT channel_id, thread_ts, rank FROM one WHERE k = 1 ORDER BY rank LIMIT 6")
def thread_dedup(spark, d):
    return threads.first_per_thread(_ranked(spark, d), 6).select("channel_id", "thread_ts", "rank")


@query("parent_child_collapse", MESSAGES + f""", p AS (SELECT channel_id, thread_ts, substr({BODY}, 1, 900) AS ctx FROM messages WHERE trim(text) <> '' GROUP BY 1, 2), c AS (SELECT channel_id, thread_ts, idx FROM messages WHERE conv_id % 3 = 0)
SELECT c.channel_id, c.thread_ts, c.idx, sha256(ctx) AS context_hash, 'child' AS kind FROM c LEFT JOIN p USING (channel_id, thread_ts)
UNION ALL SELECT channel_id, thread_ts, NULL, NULL, 'parent' FROM p WHERE (channel_id, thread_ts) NOT IN (SELECT channel_id, thread_ts FROM c)""")
def parent_child_collapse(spark, d):
    m = messages(spark, d)
    out = threads.collapse_parents(m.where(F.col("conv_id") % 3 == 0), threads.assemble(m))
    return out.select("channel_id", "thread_ts", "idx", F.sha2("parent_context", 256).alias("context_hash"), "kind")


@query("last_n_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def last_n_turns(spark, d):
    return threads.last_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("followup_lag", "SELECT conv_id, turn, sha256(trim(text)) AS routed_hash FROM conversations WHERE role = 'user'")
def followup_lag(spark, d):
    """Follow-ups begin with Korean cues, which the conversations here don't have; the cases below show them."""
    return threads.routing_queries(table(spark, d, "conversations")).select("conv_id", "turn", F.sha2("routed", 256).alias("routed_hash"))


@query("followup_cases", "SELECT CAST(c AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS routed FROM (VALUES (1, 0, '출장 일정 알려줘'), (1, 2, '출장 일정 알려줘' || chr(10) || '그 사람은 누구야'), (1, 4, '새 질문'), (2, 0, '그때 뭐 했지')) x(c, t, r)")
def followup_cases(spark, d):
    cases = ((1, 0, "user", "출장 일정 알려줘"), (1, 1, "assistant", "네"), (1, 2, "user", "그 사람은 누구야"), (1, 4, "user", " 새 질문 "), (2, 0, "user", "그때 뭐 했지"))
    return threads.routing_queries(rows(spark, "conv_id long, turn long, role string, text string", *cases))


@query("chat_order", MESSAGES + "SELECT channel_name, thread_ts, ts, CAST(row_number() OVER (PARTITION BY channel_name ORDER BY thread_ts, ts, idx) AS INTEGER) AS pos FROM messages")
def chat_order(spark, d):
    """Messages in the order of their texts as strings, numbered in each channel."""
    from pyspark.sql import Window

    m = messages(spark, d)
    return m.select("channel_name", "thread_ts", "ts", F.row_number().over(Window.partitionBy("channel_name").orderBy("thread_ts", "ts", "idx")).alias("pos"))


@query("channel_names", MESSAGES + "SELECT DISTINCT channel_name FROM messages WHERE channel_name <> '' ORDER BY 1")
def channel_names(spark, d):
    return messages(spark, d).where(F.col("channel_name") != "").select("channel_name").distinct().orderBy("channel_name")


@query("system_event_drop", "SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(text, '(?i)joined the channel')")
def system_event_drop(spark, d):
    return table(spark, d, "conversations").where(threads.meaningful(F.col("text"))).select("conv_id", "turn")


@query("system_event_cases", "SELECT * FROM (VALUES (1, false), (2, false), (3, true), (4, true)) t(id, kept)")
def system_event_cases(spark, d):
    return rows(spark, "id int, t string", (1, "X Joined the channel"), (2, "님이 채널에 민수님을 추가했습니다"), (3, "회의 결과"), (4, None)).select("id", threads.meaningful(F.col("t")).alias("kept"))


@query("user_names", "SELECT c_custkey AS user_id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, ''), CAST(c_custkey AS VARCHAR)) AS user_name FROM customer")
def user_names(spark, d):
    """Display name, else real name, else id; empty ones count as missing."""
    c = table(spark, d, "customer")
    display, real = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(""), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("user_id"), F.coalesce(F.nullif(display, F.lit("")), F.nullif(real, F.lit("")), F.col("c_custkey").cast("string")).alias("user_name"))


@query("new_messages_antijoin", MESSAGES + "SELECT channel_id, ts, count(*) AS n FROM messages WHERE (channel_id, ts) NOT IN (SELECT channel_id, ts FROM messages WHERE idx < 2) GROUP BY 1, 2")
def new_messages_antijoin(spark, d):
    m = messages(spark, d)
    return threads.new_messages(m, m.where(F.col("idx") < 2)).groupBy("channel_id", "ts").agg(F.count(F.lit(1)).alias("n"))


@query("high_water_mark", MESSAGES + "SELECT channel_id, max(ts) AS oldest FROM messages GROUP BY 1")
def high_water_mark(spark, d):
    return threads.high_water(messages(spark, d))


@query("contexts_to_build", MESSAGES + "SELECT DISTINCT channel_id, thread_ts FROM messages WHERE conv_id % 4 <> 1")
def contexts_to_build(spark, d):
    """Threads without a context yet, so that an interrupted run goes on where it stopped."""
    m = messages(spark, d).select("channel_id", "thread_ts", "conv_id").distinct()
    return m.join(m.where(F.col("conv_id") % 4 == 1).select("channel_id", "thread_ts"), ["channel_id", "thread_ts"], "left_anti").select("channel_id", "thread_ts")


CHANNELS = ("프로젝트운영", "공지사항", "논문-리뷰", "work-log", "데이터 수집", "데이터_정제", "general", "연구-회의", "장비관리", "random")


@query("channel_resolution", """SELECT * FROM (VALUES (1, ['프로젝트운영'], 'confirmed'), (2, ['프로젝트운영'], 'inferred'), (3, CAST([] AS VARCHAR[]), ''), (4, CAST([] AS VARCHAR[]), ''), (5, ['work-log'], 'confirmed'), (6, ['공지사항'], 'confirmed')) t(id, names, confidence)""")
def channel_resolution(spark, d):
    cases = ((1, "#프로젝트 운영 채널 요약해줘"), (2, "슬랙에서 운영 기록 알려줘"), (3, "운영 기록 알려줘"), (4, "슬랙 데이터 찾아줘"), (5, "#work-log 정리"), (6, "공지사항 채널에 뭐 있어"))
    return threads.resolve_channels(rows(spark, "id int, q string", *cases), rows(spark, "name string", *[(c,) for c in CHANNELS]))


@query("channel_filter_giveup", MESSAGES + "SELECT channel_name, count(*) AS n FROM messages GROUP BY 1")
def channel_filter_giveup(spark, d):
    """No row is in the wanted channel, so the filter gives up and all stay."""
    return threads.channel_filter(messages(spark, d).withColumn("kind", F.lit("slack")), ["missing"]).groupBy("channel_name").agg(F.count(F.lit(1)).alias("n"))


@query("channel_filter", MESSAGES + "SELECT channel_name, count(*) AS n FROM messages WHERE channel_name IN ('team-1', 'team-3') GROUP BY 1")
def channel_filter(spark, d):
    return threads.channel_filter(messages(spark, d).withColumn("kind", F.lit("slack")), ["team-1", "team-3"]).groupBy("channel_name").agg(F.count(F.lit(1)).alias("n"))
