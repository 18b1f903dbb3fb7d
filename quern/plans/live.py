"""Queries of live lookups, web results and thread pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import live, threads
from quern.plans.base import FILES, MESSAGES, files, messages, query, rows
from quern.session import table


def _items(spark, d):
    f = files(spark, d)
    text = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    return f.join(text, "seq").select("file_id", "name", "text", F.col("mod_time").alias("modified"), (F.col("seq") % 5 == 0).alias("trashed"))


ITEMS = FILES + ", items AS (SELECT file_id, name, text, mod_time AS modified FROM files JOIN documents ON seq = doc_id WHERE seq % 5 <> 0)"


@query("live_search_all", ITEMS + "SELECT file_id, CAST(row_number() OVER (ORDER BY modified DESC, file_id) AS INTEGER) AS pos FROM items WHERE contains(lower(name), 'src1_') AND contains(lower(name), 'pdf') QUALIFY pos <= 20")
def live_search_all(spark, d):
    """The first search finds items, so the wider ones don't count."""
    return live.search(_items(spark, d), ["SRC1_", "pdf"]).select("file_id", "pos")


@query("live_search_wide", ITEMS + """, a AS (SELECT file_id, 1 AS b, modified, row_number() OVER (ORDER BY modified DESC, file_id) AS k FROM items WHERE contains(lower(name), 'src2_') QUALIFY k <= 20),
t AS (SELECT file_id, 3 AS b, modified, row_number() OVER (ORDER BY modified DESC, file_id) AS k FROM items WHERE contains(lower(text), 'src2_') OR contains(lower(text), 'erst') QUALIFY k <= 20),
u AS (SELECT file_id, min(b) AS b, any_value(modified) AS modified FROM (SELECT * FROM a UNION ALL SELECT * FROM t) GROUP BY 1)
SELECT file_id, CAST(row_number() OVER (ORDER BY b, modified DESC, file_id) AS INTEGER) AS pos FROM u""")
def live_search_wide(spark, d):
    """No name has both terms: items with either, then texts with any."""
    return live.search(_items(spark, d), ["src2_", "erst"]).select("file_id", "pos")


@query("live_search_exact", ITEMS + "SELECT file_id, CAST(row_number() OVER (ORDER BY modified DESC, file_id) AS INTEGER) AS pos FROM items WHERE contains(lower(name), '_11.pdf')")
def live_search_exact(spark, d):
    return live.search(_items(spark, d), ["ignored"], file_name="_11.PDF").select("file_id", "pos")


@query("web_results", r"SELECT page_id % 10 AS id, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id % 17 DESC, url) AS k FROM pages) WHERE k <= 3")
def web_results(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 10).alias("id"), F.lit("question").alias("q"), "url", F.lit("t").alias("title"), (F.col("page_id") % 17).alias("score"))
    return live.web_results(p, 3).select("id", "url")


@query("web_metrics", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT))) t(calls, ok, empty, skipped_too_long)")
def web_metrics(spark, d):
    q = rows(spark, "id int, q string", (1, "short"), (2, "none"), (3, "x" * 401))
    r = rows(spark, "id int, url string, title string, score double", (1, "https://a.example", "A", 1.0), (2, "ftp://b", "B", 1.0), (3, "https://c.example", "C", 1.0))
    return live.web_metrics(q, r)


@query("result_channels", "SELECT 'team-' || (conv_id % 7) AS channel, count(*) AS n FROM conversations GROUP BY 1")
def result_channels(spark, d):
    m = messages(spark, d).select(F.concat(F.lit("#"), "channel_name", F.lit(" · "), "ts").alias("citation"))
    return live.channels_of(m)


WHOLE_THREADS = MESSAGES + """, o AS (SELECT *, row_number() OVER (PARTITION BY channel_id, channel_name, thread_ts ORDER BY ts, idx, text) AS nth FROM messages WHERE trim(text) <> ''),
whole AS (SELECT channel_id, channel_name, thread_ts, '채널: #' || channel_name || chr(10) || '스레드 시작: ' || arg_min(text, nth) || chr(10) || string_agg(user_name || ': ' || text, chr(10) ORDER BY nth) AS text FROM o GROUP BY 1, 2, 3)"""


@query("thread_chunks", WHOLE_THREADS + """ SELECT channel_id, thread_ts, CAST(len(list_distinct(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'))) AS INTEGER) AS n_tokens, CASE WHEN length(text) <= 1200 THEN sha256(text) END AS whole_hash, CASE WHEN length(text) <= 1200 THEN 1 END AS n_pieces FROM whole""")
def thread_chunks(spark, d):
    """What the pieces of each thread cover: its distinct tokens, whatever its length, and the text of a thread that fits one
    piece. Where cuts fall is tested against the splitter."""
    p = threads.thread_chunks(messages(spark, d)).withColumn("tokens", X.tokens(F.col("text")))
    per = p.groupBy("channel_id", "thread_ts").agg(F.count(F.lit(1)).alias("n"), F.max(F.sha2("text", 256)).alias("h"))
    covered = p.select("channel_id", "thread_ts", F.explode("tokens").alias("t")).groupBy("channel_id", "thread_ts").agg(F.count_distinct("t").cast("int").alias("n_tokens"))
    one = F.when(F.col("n") == 1, 1)
    return per.join(covered, ["channel_id", "thread_ts"]).select("channel_id", "thread_ts", "n_tokens", F.when(F.col("n") == 1, F.col("h")).alias("whole_hash"), one.alias("n_pieces"))
