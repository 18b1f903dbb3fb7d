"""Queries of rank fusion and list merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import fusion
from quern.plans.base import CHUNKS, FILES, chunks, files, query, rows


def _list(spark, d, root, start):
    f = files(spark, d).where(F.col("root") == root)
    return f.select("file_id", F.col("seq"), (F.col("n_chunks") % 2).alias("idx"), F.col("seq").alias("pos"), F.when(F.col("seq") % 3 == start, F.concat(F.lit("s"), "file_id")).alias("synopsis"))


MERGE_SQL = FILES + """, a AS (SELECT file_id, n_chunks % 2 AS idx, seq AS pos, CASE WHEN seq % 3 = 0 THEN 's' || file_id END AS synopsis, 0 AS branch FROM files WHERE root IN ('lab/src1')
UNION ALL SELECT file_id, n_chunks % 2, seq, CASE WHEN seq % 3 = 1 THEN 's' || file_id END, 1 FROM files WHERE root IN ('lab/src1') UNION ALL SELECT file_id, n_chunks % 2, seq, CASE WHEN seq % 3 = 2 THEN 's' || file_id END, 2 FROM files WHERE root = 'lab/src2')
SELECT file_id, idx, min(branch) AS branch, arg_min(synopsis, branch) FILTER (WHERE synopsis IS NOT NULL) AS synopsis FROM a GROUP BY 1, 2"""


@query("candidate_merge", MERGE_SQL)
def candidate_merge(spark, d):
    lists = [_list(spark, d, "lab/src1", 0), _list(spark, d, "lab/src1", 1), _list(spark, d, "lab/src2", 2)]
    return fusion.merge_candidates(lists).select("file_id", "idx", "branch", "synopsis")


LISTS_SQL = FILES + """, lex AS (SELECT file_id, row_number() OVER (ORDER BY size DESC, seq) AS rank FROM files WHERE root = 'lab/src3' QUALIFY rank <= 40),
syn AS (SELECT file_id, row_number() OVER (ORDER BY size, seq) AS rank, 1.0 / (1 + seq % 9) AS score FROM files WHERE root IN ('lab/src3', 'lab/src6') QUALIFY rank <= 40),
fused AS (SELECT coalesce(l.file_id, s.file_id) AS file_id, l.rank AS lexical_rank, s.rank AS synopsis_rank, s.score AS synopsis_score,
 coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf,
 CASE WHEN l.rank IS NOT NULL AND s.rank IS NOT NULL THEN 'high' WHEN l.rank <= 5 THEN 'medium' ELSE 'low' END AS confidence
 FROM lex l FULL OUTER JOIN syn s ON l.file_id = s.file_id) """


def _fused(spark, d):
    f = files(spark, d)
    lex = fusion.with_rank(f.where(F.col("root") == "lab/src3"), "rank", F.col("size").desc(), F.col("seq")).where(F.col("rank") <= 40)
    syn = fusion.with_rank(f.where(F.col("root").isin("lab/src3", "lab/src6")), "rank", F.col("size"), F.col("seq")).where(F.col("rank") <= 40)
    return fusion.fuse_locations(lex, syn.withColumn("score", 1.0 / (1 + F.col("seq") % 9)))


@query("rrf_fusion", LISTS_SQL + "SELECT file_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(synopsis_rank AS INTEGER) AS synopsis_rank, round(rrf, 6) AS rrf, confidence FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("file_id", "lexical_rank", "synopsis_rank", F.round("rrf", 6).alias("rrf"), "confidence")


@query("weak_tail_trim", LISTS_SQL + """, b AS (SELECT *, max(synopsis_score) OVER () AS best FROM fused)
SELECT file_id, round(rrf, 6) AS rrf FROM b WHERE NOT coalesce(lexical_rank IS NULL AND synopsis_rank IS NOT NULL AND synopsis_score < best * 0.88, false) ORDER BY b.rrf DESC, file_id LIMIT 5""")
def weak_tail_trim(spark, d):
    return fusion.trim_weak(_fused(spark, d)).select("file_id", F.round("rrf", 6).alias("rrf"))


LIVE_SQL = LISTS_SQL + """, ind AS (SELECT f.file_id, name, path, mod_time AS modified, rrf FROM fused JOIN files f USING (file_id)),
live AS (SELECT file_id, 'live-' || name AS name, 'live/' || path AS path, mod_time AS modified, seq % 5 = 0 AS trashed, seq % 4 <> 0 AS inside_root, CASE WHEN seq % 3 = 0 THEN 'application/vnd.google-apps.folder' ELSE 'text/plain' END AS mime_type, row_number() OVER (ORDER BY seq) AS live_rank FROM files WHERE root IN ('lab/src6', 'lab/src8')),
m AS (SELECT coalesce(i.file_id, l.file_id) AS file_id, coalesce(l.name, i.name) AS name, coalesce(l.path, i.path) AS path, coalesce(l.modified, i.modified) AS modified, mime_type,
 coalesce(i.rrf, 0) + coalesce(1.0::DOUBLE / (60 + l.live_rank), 0) AS rrf, CASE WHEN i.file_id IS NULL THEN 'live' WHEN l.file_id IS NULL THEN 'indexed' ELSE 'both' END AS provenance
 FROM ind i FULL OUTER JOIN (SELECT * FROM live WHERE NOT trashed AND inside_root) l ON i.file_id = l.file_id) """


def _merged(spark, d):
    f = files(spark, d)
    indexed = _fused(spark, d).join(f.select("file_id", "name", "path", F.col("mod_time").alias("modified")), "file_id").select("file_id", "name", "path", "modified", "rrf")
    live = f.where(F.col("root").isin("lab/src6", "lab/src8")).select(
        "file_id", F.concat(F.lit("live-"), "name").alias("name"), F.concat(F.lit("live/"), "path").alias("path"), F.col("mod_time").alias("modified"),
        (F.col("seq") % 5 == 0).alias("trashed"), (F.col("seq") % 4 != 0).alias("inside_root"), F.col("seq").alias("pos"),
        F.when(F.col("seq") % 3 == 0, "application/vnd.google-apps.folder").otherwise("text/plain").alias("mime_type"),
    )
    return fusion.merge_live(indexed, live)


@query("location_full_outer", LIVE_SQL + "SELECT file_id, name, path, modified, round(rrf, 6) AS rrf, provenance FROM m")
def location_full_outer(spark, d):
    return _merged(spark, d).select("file_id", "name", "path", "modified", F.round("rrf", 6).alias("rrf"), "provenance")


NORMAL_NAME = "trim(regexp_replace(lower(name), '[\\\\/_\\-.()\\[\\]{}]', ' ', 'g'))"


@query("location_order", LIVE_SQL + f"SELECT file_id, provenance FROM m ORDER BY coalesce(mime_type, '') LIKE '%folder' DESC, name LIKE '%1%' DESC, provenance = 'both' DESC, m.rrf DESC, {NORMAL_NAME} DESC, file_id LIMIT 5")
def location_order(spark, d):
    return fusion.order_locations(_merged(spark, d), year="1", folder=True).select("file_id", "provenance")


@query("location_recency", LIVE_SQL + f""", p AS (SELECT *, modified LIKE '2026-05%' AS hit FROM m), r AS (SELECT *, row_number() OVER (ORDER BY modified DESC, {NORMAL_NAME} DESC, file_id) AS a, row_number() OVER (ORDER BY m2.rrf DESC, modified DESC, {NORMAL_NAME} DESC, file_id) AS b FROM (SELECT *, rrf AS keep FROM p) m2)
SELECT file_id, 'all' AS asked FROM r WHERE a <= 5 UNION ALL (SELECT file_id, 'month' FROM r WHERE hit OR NOT (SELECT bool_or(hit) FROM p) ORDER BY b LIMIT 5)""")
def location_recency(spark, d):
    """The latest files, and those of a month by fused rank (digits in names here are ids, so they are no years)."""
    m = _merged(spark, d)
    every = fusion.order_locations_by_time(m).select("file_id", F.lit("all").alias("asked"))
    return every.unionByName(fusion.order_locations_by_time(m, year="2026", month="05", named=False).select("file_id", F.lit("month").alias("asked")))


@query("live_union", FILES + "SELECT file_id, arg_min(b, b) AS first_batch FROM (SELECT file_id, 0 AS b FROM files WHERE root = 'lab/src1' UNION ALL SELECT file_id, 1 FROM files WHERE root IN ('lab/src1', 'lab/src2') AND seq % 5 <> 0) GROUP BY 1")
def live_union(spark, d):
    """Batches of several live searches: distinct by id, the first one wins, items in the trash go."""
    f = files(spark, d).select("file_id", "seq", F.lit(0).cast("long").alias("idx"), F.col("seq").alias("pos"), "root")
    both = fusion.merge_candidates([f.where(F.col("root") == "lab/src1"), f.where(F.col("root").isin("lab/src1", "lab/src2") & (F.col("seq") % 5 != 0))], keys=("file_id",), notes=())
    return both.select("file_id", F.col("branch").alias("first_batch"))


@query("neighbour_expand", CHUNKS + """, hits AS (SELECT file_id, idx, CAST(row_number() OVER (ORDER BY length(text) DESC, seq, idx) AS INTEGER) AS rank, 1.0::DOUBLE / row_number() OVER (ORDER BY length(text) DESC, seq, idx) AS score FROM chunks WHERE idx = 2 QUALIFY rank <= 6),
n AS (SELECT c.file_id, c.idx, h.rank, h.score FROM chunks c JOIN hits h ON c.file_id = h.file_id AND c.idx BETWEEN h.idx - 1 AND h.idx + 1 AND c.idx <> h.idx WHERE h.rank <= 2)
SELECT file_id, idx, rank, round(score, 4) AS score, 0 AS is_neighbour FROM hits UNION ALL SELECT file_id, idx, rank, round(score, 4), 1 FROM n WHERE (file_id, idx) NOT IN (SELECT file_id, idx FROM hits)""")
def neighbour_expand(spark, d):
    c = chunks(spark, d)
    hits = fusion.with_rank(c.where(F.col("idx") == 2), "rank", F.length("text").desc(), F.col("seq"), F.col("idx")).where(F.col("rank") <= 6).withColumn("score", F.lit(1.0) / F.col("rank"))
    return fusion.expand_neighbours(hits, c, top=2).select("file_id", "idx", "rank", F.round("score", 4).alias("score"), "is_neighbour")


BALANCE = tuple((i, "drive" if i < 7 else "slack") for i in range(1, 9))


@query("source_balance", "SELECT * FROM (VALUES (1, 'drive'), (2, 'drive'), (3, 'drive'), (7, 'slack')) t(rank, kind)")
def source_balance(spark, d):
    return fusion.balance_sources(rows(spark, "rank int, kind string", *BALANCE), 4)


@query("source_balance_room", "SELECT * FROM (VALUES (1, 'drive'), (2, 'slack'), (3, 'drive')) t(rank, kind)")
def source_balance_room(spark, d):
    return fusion.balance_sources(rows(spark, "rank int, kind string", (1, "drive"), (2, "slack"), (3, "drive")), 6)


@query("near_dup_drop", "SELECT * FROM (VALUES (1, 'a'), (3, 'c'), (4, 'd')) t(rank, id)")
def near_dup_drop(spark, d):
    """A chain: b is like a and goes; c is like b but not like a, and stays."""
    words = [f"w{i}" for i in range(20)]
    cases = ((1, "a", " ".join(words)), (2, "b", " ".join(words[1:] + ["x"])), (3, "c", " ".join(words[2:] + ["x", "y"])), (4, "d", "other words here"), (5, "e", "Other words, here!"))
    return fusion.drop_similar(rows(spark, "rank int, id string, text string", *cases), 6)
