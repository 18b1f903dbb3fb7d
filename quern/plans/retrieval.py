"""Queries of the whole retrieval: ``embeddings`` are the vectors of the first files' first five chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import providers, retrieve, vector
from quern.plans.base import CHUNKS, FILES, MESSAGES, chunks, files, messages, query
from quern.plans.vectors import POINTS, file_points, query_vector, synopses
from quern.session import table

QUESTION = "the thing that and of erst on"


def stores(spark, d, chat=False):
    points = file_points(spark, d).select("file_id", F.col("idx").cast("long").alias("idx"), "root", "vector")
    return retrieve.Stores(points, chunks(spark, d), files(spark, d), messages(spark, d) if chat else None, synopses(spark, d))


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[0-9A-Za-z가-힣]+'))"
LISTS_SQL = CHUNKS + f""", f AS ({FILES} SELECT * FROM files), {POINTS},
dense AS (SELECT file_id, idx, row_number() OVER (ORDER BY score DESC, file_id, idx) AS pos FROM points QUALIFY pos <= 50),
n AS (SELECT *, trim(regexp_replace(lower(name), '[\\/_\\-.()\\[\\]{{}}]', ' ', 'g')) AS nn FROM f WHERE status = 'indexed'),
best AS (SELECT file_id, seq FROM n WHERE contains(nn, 'src4') ORDER BY seq LIMIT 5),
near AS (SELECT file_id, idx, p.score, seq, row_number() OVER (PARTITION BY file_id ORDER BY p.score DESC, idx) AS k FROM points p JOIN best USING (file_id)),
lex AS (SELECT file_id, idx, row_number() OVER (ORDER BY seq, near.score DESC, idx) AS pos FROM near WHERE k <= 2),
top_syn AS (SELECT file_id, synopsis, score AS file_score FROM syn ORDER BY score DESC, file_id LIMIT 5),
near_syn AS (SELECT file_id, idx, p.score, synopsis, file_score, row_number() OVER (PARTITION BY file_id ORDER BY p.score DESC, idx) AS k FROM points p JOIN top_syn USING (file_id)),
by_syn AS (SELECT file_id, idx, synopsis, row_number() OVER (ORDER BY file_score DESC, file_id, near_syn.score DESC, idx) AS pos FROM near_syn WHERE k <= 2),
every AS (SELECT file_id, idx, pos AS place, NULL AS synopsis FROM dense UNION ALL SELECT file_id, idx, 1000000 + pos, NULL FROM lex UNION ALL SELECT file_id, idx, 2000000 + pos, synopsis FROM by_syn),
m AS (SELECT file_id, idx, min(place) AS place, max(synopsis) AS synopsis FROM every GROUP BY 1, 2),
q AS (SELECT {TOKENS.format("'" + QUESTION + "'")} AS w),
r AS (SELECT m.file_id, m.idx, 'drive' AS kind, len(list_intersect(w, {TOKENS.format("coalesce('synopsis: ' || synopsis || chr(10), '') || text")})) / len(w) AS score, place FROM m JOIN chunks USING (file_id, idx), q)"""
RETRIEVE_SQL = LISTS_SQL + """,
top AS (SELECT file_id, idx, score, CAST(row_number() OVER (ORDER BY score DESC, place) AS INTEGER) AS rank FROM r QUALIFY rank <= 6),
nb AS (SELECT c.file_id, c.idx, t.rank, t.score FROM chunks c JOIN top t ON c.file_id = t.file_id AND abs(c.idx - t.idx) = 1 WHERE t.rank = 1 AND (c.file_id, c.idx) NOT IN (SELECT file_id, idx FROM top))
SELECT file_id, idx, rank, round(score, 4) AS score, 0 AS is_neighbour FROM top UNION ALL SELECT file_id, idx, rank, round(score, 4), 1 FROM nb"""


@query("hybrid_retrieve", RETRIEVE_SQL)
def hybrid_retrieve(spark, d):
    hits = retrieve.retrieve(stores(spark, d), QUESTION, query_vector(spark, d), terms=["src4"])
    return hits.select("file_id", "idx", "rank", F.round("score", 4).alias("score"), "is_neighbour")


CREDENTIAL, SHAPES, EVENT = (x.replace("'", "''") for x in (fixed.CREDENTIAL, fixed.TOKEN_SHAPES, fixed.SYSTEM_EVENT))
CHAT_SQL = LISTS_SQL + f""", msg AS ({MESSAGES} SELECT * FROM messages),
said AS (SELECT 'slack:' || channel_id || ':' || thread_ts AS file_id, CAST(idx AS BIGINT) AS idx, text, ts, channel_id, len(list_intersect(w, {TOKENS.format("text")})) / len(w) AS score FROM msg, q WHERE NOT regexp_matches(coalesce(text, ''), '{EVENT}')),
chat AS (SELECT file_id, idx, 3000000 + row_number() OVER (ORDER BY score DESC, ts DESC, channel_id, idx) AS place, regexp_replace(regexp_replace(text, '{CREDENTIAL}', '\\1\\2[REDACTED]', 'g'), '{SHAPES}', '[REDACTED]', 'g') AS text FROM said QUALIFY place <= 3000050),
either_ AS (SELECT file_id, idx, kind, score, place FROM r UNION ALL SELECT file_id, idx, 'slack', len(list_intersect(w, {TOKENS.format("text")})) / len(w), place FROM chat, q),
ranked AS (SELECT file_id, idx, kind, score, CAST(row_number() OVER (ORDER BY score DESC, place) AS INTEGER) AS rank FROM either_),
missing AS (SELECT kind, min(rank) AS rank FROM ranked WHERE kind NOT IN (SELECT kind FROM ranked WHERE rank <= 6) GROUP BY kind)
SELECT file_id, idx, rank, round(score, 4) AS score, kind FROM ranked WHERE rank <= 6 - (SELECT count(*) FROM missing) OR rank IN (SELECT rank FROM missing)"""


@query("hybrid_retrieve_chat", CHAT_SQL)
def hybrid_retrieve_chat(spark, d):
    """With chat: both sources keep a row in the answer."""
    hits = retrieve.retrieve(stores(spark, d, True), QUESTION, query_vector(spark, d), terms=["src4"], chat=True)
    return hits.select("file_id", "idx", "rank", F.round("score", 4).alias("score"), "kind")


@query("recent_first", RETRIEVE_SQL.split("nb AS")[0].replace("QUALIFY rank <= 6", "").rstrip().rstrip(",") + """
SELECT file_id, idx, CAST(row_number() OVER (ORDER BY mod_time DESC, rank) AS INTEGER) AS rank, round(score, 4) AS score, 0 AS is_neighbour FROM top JOIN f USING (file_id) ORDER BY mod_time DESC, top.rank LIMIT 6""")
def recent_first(spark, d):
    """The candidates by their files' times, the latest first; no neighbours."""
    hits = retrieve.retrieve(stores(spark, d), QUESTION, query_vector(spark, d), terms=["src4"], recent=True, expand=0)
    return hits.select("file_id", "idx", "rank", F.round("score", 4).alias("score"), "is_neighbour")


@query("drive_only", RETRIEVE_SQL)
def drive_only(spark, d):
    """A question that names the drive alone: chat is there and isn't asked."""
    hits = retrieve.retrieve(stores(spark, d, True), QUESTION, query_vector(spark, d), terms=["src4"], chat=True, sources=["drive"])
    return hits.select("file_id", "idx", "rank", F.round("score", 4).alias("score"), "is_neighbour")


@query("slack_only", CHAT_SQL.split("either_ AS")[0] + f"""ranked AS (SELECT file_id, idx, len(list_intersect(w, {TOKENS.format("text")})) / len(w) AS score, place FROM chat, q)
SELECT file_id, idx, CAST(row_number() OVER (ORDER BY score DESC, place) AS INTEGER) AS rank, round(score, 4) AS score, 0 AS is_neighbour FROM ranked QUALIFY rank <= 6""")
def slack_only(spark, d):
    hits = retrieve.retrieve(stores(spark, d, True), QUESTION, query_vector(spark, d), terms=["src4"], sources=["slack"])
    return hits.select("file_id", "idx", "rank", F.round("score", 4).alias("score"), "is_neighbour")


@query("rerank_order", CHUNKS + f""", q AS (SELECT list_distinct(regexp_extract_all('{QUESTION}', '[0-9A-Za-z가-힣]+')) AS w), s AS (SELECT file_id, idx, seq, len(list_intersect(w, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')))) / len(w) AS score FROM chunks, q)
SELECT file_id, idx, round(score, 4) AS score FROM s ORDER BY s.score DESC, seq, idx LIMIT 6""")
def rerank_order(spark, d):
    """The reranker over all chunks; the top k keeps k rows of each partition."""
    c = chunks(spark, d).withColumn("score", providers.overlap(QUESTION, F.col("text")))
    return vector.top_k(c, 6, "seq", "idx").select("file_id", "idx", F.round("score", 4).alias("score"))


@query("chunk_index", CHUNKS + f""", h AS (SELECT *, sha1(from_hex('{fixed.POINT_NAMESPACE.replace('-', '')}') || encode(file_id || ':' || idx)) AS h FROM chunks)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, file_id, idx, sha256(text) AS content_hash, 64 AS dim FROM h""")
def chunk_index(spark, d):
    """The vector table of all chunks by the default provider; vectors are tested against the provider called directly."""
    return retrieve.chunk_index(chunks(spark, d)).select("point_id", "file_id", "idx", "content_hash", F.size("vector").alias("dim"))


@query("file_synopses")
def file_synopses(spark, d):
    """A synopsis of every file by the default provider, none of short texts; tested against the provider."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), providers.synopsis(F.col("text")).alias("synopsis")).where(F.col("synopsis").isNotNull())
