"""Queries of the location drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import location
from quern.plans.base import FILES, files, query, rows
from quern.plans.catalog import NORMAL, RECORD_DDL, RECORDS
from quern.plans.vectors import POINTS, query_vector, synopses

SEARCH_SQL = f"""WITH f AS ({FILES} SELECT * FROM files), {POINTS}, n AS (SELECT *, {NORMAL.format('name')} AS nn FROM f WHERE status IN ('indexed', 'skipped')),
lex AS (SELECT file_id, row_number() OVER (ORDER BY seq) AS rank FROM n WHERE contains(nn, 'src4') QUALIFY rank <= 40),
near AS (SELECT file_id, score, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM syn QUALIFY rank <= 40),
fused AS (SELECT file_id, l.rank AS lexical_rank, s.rank AS synopsis_rank, s.score AS synopsis_score, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf,
 CASE WHEN l.rank IS NOT NULL AND s.rank IS NOT NULL THEN 'high' WHEN l.rank <= 5 THEN 'medium' ELSE 'low' END AS confidence FROM lex l FULL OUTER JOIN (SELECT * FROM near WHERE file_id IN (SELECT file_id FROM f)) s USING (file_id)),
best AS (SELECT * FROM fused WHERE NOT coalesce(lexical_rank IS NULL AND synopsis_score < 0.88 * (SELECT max(synopsis_score) FROM fused), false) ORDER BY fused.rrf DESC, file_id LIMIT 5)"""
QUESTION = "src4 파일 어디에 있어?"


@query("locate", SEARCH_SQL + """SELECT file_id, name, root || '/' || path AS location, status, CAST(row_number() OVER (ORDER BY rrf DESC, file_id) AS INTEGER) AS rank, round(rrf, 6) AS rrf, confidence, 'location' AS intent FROM best JOIN f USING (file_id)""")
def locate(spark, d):
    """Files by name and by synopsis, fused; skipped files are found by name too."""
    found = location.locate(spark, QUESTION, files(spark, d), synopses(spark, d), query_vector(spark, d))
    return found.files.select("file_id", "name", "location", "status", "rank", F.round("rrf", 6).alias("rrf"), "confidence", F.lit(found.intent).alias("intent"))


def _live(spark, d):
    f = files(spark, d).where(F.col("root").isin("lab/src4", "lab/src8"))
    return f.select(
        "file_id", F.concat(F.lit("live-"), "name").alias("name"), F.concat(F.lit("live/"), "path").alias("path"), F.col("mod_time").alias("modified"),
        (F.col("seq") % 5 == 0).alias("trashed"), (F.col("seq") % 4 != 0).alias("inside_root"), F.col("seq").alias("pos"),
    )


HYBRID_SQL = SEARCH_SQL + """, live AS (SELECT file_id, 'live-' || name AS name, 'live/' || path AS path, mod_time AS modified, seq % 5 = 0 OR seq % 4 = 0 AS unusable, row_number() OVER (ORDER BY seq) AS live_rank FROM f WHERE root IN ('lab/src4', 'lab/src8') QUALIFY live_rank <= 20),
i AS (SELECT file_id, name, root || '/' || path AS path, mod_time AS modified, rrf FROM best JOIN f USING (file_id)),
m AS (SELECT file_id, coalesce(l.name, i.name) AS name, coalesce(l.path, i.path) AS path, coalesce(l.modified, i.modified) AS modified, coalesce(i.rrf, 0) + coalesce(1.0::DOUBLE / (60 + l.live_rank), 0) AS rrf,
 CASE WHEN i.name IS NULL THEN 'live' WHEN l.name IS NULL THEN 'indexed' ELSE 'both' END AS provenance FROM i FULL OUTER JOIN (SELECT * FROM live WHERE NOT unusable) l USING (file_id)) """
NORMAL_NAME = NORMAL.format("name")


@query("locate_hybrid", HYBRID_SQL + f"""(SELECT file_id, path, round(rrf, 6) AS rrf, provenance, 'ok' AS live, 'plain' AS asked FROM m ORDER BY provenance = 'both' DESC, m.rrf DESC, {NORMAL_NAME} DESC, file_id LIMIT 5)
UNION ALL (SELECT file_id, path, round(rrf, 6), provenance, 'ok', 'latest' FROM m ORDER BY modified DESC, {NORMAL_NAME} DESC, file_id LIMIT 5)
UNION ALL SELECT file_id, root || '/' || path, round(rrf, 6), 'indexed', 'ValueError', 'broken' FROM best JOIN f USING (file_id)""")
def locate_hybrid(spark, d):
    """With a live listing, with one ordered by time, and with one that fails, which leaves the indexed files."""

    def broken():
        raise ValueError("no listing")

    out = []
    for asked, question, live in (("plain", QUESTION, lambda: _live(spark, d)), ("latest", "최신 src4 파일 어디에 있어?", lambda: _live(spark, d)), ("broken", QUESTION, broken)):
        found = location.locate_hybrid(spark, question, files(spark, d), live, seconds=300, synopses=synopses(spark, d), query=query_vector(spark, d))
        f = found.files if asked != "broken" else found.files.select("file_id", F.col("location").alias("path"), "rrf", F.lit("indexed").alias("provenance"))
        out.append(f.select("file_id", "path", F.round("rrf", 6).alias("rrf"), "provenance", F.lit(found.live).alias("live"), F.lit(asked).alias("asked")))
    return out[0].unionByName(out[1]).unionByName(out[2])


DECISIONS = ((1, "src4 파일 어디에 있어?", "location"), (2, "연구 폴더에 뭐가 있어", ""), (3, "구성원 명단 어디 있어?", ""), (4, "이 실험은 왜 실패했어", ""), (5, "출장 신청은 어디에 작성해야 해", "write_target"), (6, "보고서 위치와 작성 방법은", "ambiguous"))


@query("locate_decisions", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, _, want in DECISIONS) + ") t(id, intent)")
def locate_decisions(spark, d):
    """Listings of folders, canonical records and questions about content go elsewhere."""
    records = rows(spark, RECORD_DDL, *RECORDS)
    return rows(spark, "id int, intent string", *[(i, location.decide(spark, q, records) or "") for i, q, _ in DECISIONS])


@query("live_fallback", f"SELECT * FROM (VALUES (1, ''), (2, ''), (3, '{fixed.LIVE_FALLBACK}'), (4, '{fixed.LIVE_FALLBACK}')) t(id, note)")
def live_fallback(spark, d):
    cases = ((1, False, None), (2, True, "ok"), (3, True, "timeout"), (4, True, None))
    return rows(spark, "id int, e boolean, s string", *cases).select("id", location.fallback(F.col("e"), F.col("s")).alias("note"))


@query("located_table", SEARCH_SQL + """SELECT string_agg('| ' || name || ' | `' || root || '/' || path || '` | ' || substr(mod_time, 1, 10) || ' |', chr(10) ORDER BY rrf DESC, file_id) AS body FROM best JOIN f USING (file_id)""")
def located_table(spark, d):
    return location.table_rows(location.locate(spark, QUESTION, files(spark, d), synopses(spark, d), query_vector(spark, d)).files)
