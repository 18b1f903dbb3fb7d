"""Queries of file-level search and the manifest's predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import catalog
from quern.plans.base import CHUNKS, FILES, chunks, files, query, rows
from quern.plans.vectors import POINTS, file_points, query_vector, synopses

CATEGORY_SQL = """CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'xlsx' THEN 'xlsx'
WHEN 'hwp' THEN 'hwp' WHEN 'py' THEN 'code' WHEN 'png' THEN 'image' WHEN 'csv' THEN 'table' WHEN 'zip' THEN 'archive' ELSE 'other' END"""
NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '[\\/_\-.()\[\]{{}}]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("file_category", FILES + f"SELECT file_id, {CATEGORY_SQL} AS category FROM files")
def file_category(spark, d):
    return files(spark, d).select("file_id", X.category(F.col("name")).alias("category"))


@query("file_category_cases", "SELECT * FROM (VALUES (1, 'xlsx'), (2, 'image'), (3, 'text'), (4, 'other'), (5, 'archive'), (6, 'audio')) t(id, category)")
def file_category_cases(spark, d):
    cases = ((1, "Plan.XLSX", None), (2, "scan", "image/png"), (3, "notes", "text/plain"), (4, "x.unknown", "application/x"), (5, "a.tar.gz", None), (6, "v.m4a", None))
    return rows(spark, "id int, n string, m string", *cases).select("id", X.category(F.col("n"), F.col("m")).alias("category"))


@query("skip_reason", FILES + f""", c AS (SELECT *, {CATEGORY_SQL} AS category FROM files)
SELECT file_id, CASE WHEN category IN ('text','pdf','docx','xlsx','hwp','table') THEN NULL WHEN category = 'image' THEN 'needs_model' ELSE 'not_a_target' END AS skip FROM c""")
def skip_reason(spark, d):
    f = files(spark, d)
    return f.select("file_id", X.skip_reason(F.col("name"), X.category(F.col("name"))).alias("skip"))


@query("friendly_reason", """SELECT * FROM (VALUES (1, '스캔 문서라 본문 검색이 아직 지원되지 않습니다'), (2, '빈 파일이라 내용이 없습니다'), (3, '현재 본문 검색이 지원되지 않는 파일입니다'), (4, '현재 본문 검색이 지원되지 않는 파일입니다')) t(id, reason)""")
def friendly_reason(spark, d):
    return rows(spark, "id int, e string", (1, "OCR 필요"), (2, "빈 파일"), (3, "?"), (4, None)).select("id", X.friendly_reason(F.col("e")).alias("reason"))


@query("root_prefix_filter", FILES + "SELECT file_id, root FROM files WHERE root = 'lab/src1' OR root LIKE 'lab/src1/%' OR root = 'lab/src7' OR root LIKE 'lab/src7/%'")
def root_prefix_filter(spark, d):
    """Folders are compared level by level: ``lab/src1`` doesn't take in ``lab/src10``."""
    return files(spark, d).where(X.within(F.col("root"), "lab/src1") | X.within(F.col("root"), "Lab/SRC7/")).select("file_id", "root")


LEXICAL_SQL = FILES + f""", n AS (SELECT *, {NORMAL.format('name')} AS nn, {NORMAL.format('path')} AS pp FROM files WHERE status = 'indexed'),
s AS (SELECT *, 60 * CAST(contains(nn, 'src1 42') AS INT) + CASE WHEN contains(nn, 'src1') THEN 20 WHEN contains(pp, 'src1') THEN 5 ELSE 0 END + CASE WHEN contains(nn, '42') THEN 20 WHEN contains(pp, '42') THEN 5 ELSE 0 END
 + 30 * CAST(contains(nn, 'pdf') AS INT) + 30 * CAST(root = 'lab/src1' AS INT) AS score FROM n) """


@query("lexical_score", LEXICAL_SQL + "SELECT file_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0")
def lexical_score(spark, d):
    return catalog.score_documents(files(spark, d), ["src1", "42"], preferred=["lab/src1"], hints=["pdf"]).select("file_id", "score")


@query("lexical_topk", LEXICAL_SQL + "SELECT file_id, name, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, seq LIMIT 5")
def lexical_topk(spark, d):
    return catalog.search_documents(files(spark, d), ["src1", "42"], preferred=["lab/src1"], hints=["pdf"]).select("file_id", "name", "score")


@query("lexical_candidates", CHUNKS + f""", f AS ({FILES} SELECT * FROM files), {POINTS}, n AS (SELECT *, {NORMAL.format('name')} AS nn, {NORMAL.format('path')} AS pp FROM f WHERE status = 'indexed'),
s AS (SELECT *, 60 * CAST(contains(nn, 'src3') AS INT) + CASE WHEN contains(nn, 'src3') THEN 20 WHEN contains(pp, 'src3') THEN 5 ELSE 0 END AS score FROM n),
best AS (SELECT file_id, CAST(score AS DOUBLE) AS name_score FROM s WHERE score > 0 ORDER BY s.score DESC, seq LIMIT 5),
near AS (SELECT file_id, idx, p.score, name_score, row_number() OVER (PARTITION BY file_id ORDER BY p.score DESC, idx) AS k FROM points p JOIN best USING (file_id))
SELECT file_id, idx, name_score, round(near.score, 4) AS score FROM near JOIN chunks USING (file_id, idx) WHERE k <= 2""")
def lexical_candidates(spark, d):
    found = catalog.lexical_candidates(files(spark, d), chunks(spark, d), file_points(spark, d), query_vector(spark, d), ["src3"])
    return found.select("file_id", "idx", "name_score", F.round("score", 4).alias("score"))


@query("synopsis_candidates", CHUNKS + f""", {POINTS}, top AS (SELECT file_id, synopsis, score AS file_score FROM syn ORDER BY score DESC, file_id LIMIT 5),
near AS (SELECT file_id, idx, p.score, synopsis, file_score, row_number() OVER (PARTITION BY file_id ORDER BY p.score DESC, idx) AS k FROM points p JOIN top USING (file_id))
SELECT file_id, idx, synopsis, round(file_score, 4) AS file_score, round(near.score, 4) AS score FROM near JOIN chunks USING (file_id, idx) WHERE k <= 2""")
def synopsis_candidates(spark, d):
    found = catalog.synopsis_candidates(synopses(spark, d), chunks(spark, d), file_points(spark, d), query_vector(spark, d))
    return found.select("file_id", "idx", "synopsis", F.round("file_score", 4).alias("file_score"), F.round("score", 4).alias("score"))


@query("unindexed_notice", FILES + f""", n AS (SELECT *, {NORMAL.format('name')} AS nn FROM files WHERE status = 'skipped' AND contains({NORMAL.format('name')}, 'src5'))
SELECT file_id, name, '현재 본문 검색이 지원되지 않는 파일입니다' AS reason, 'https://drive.google.com/file/d/' || file_id || '/view' AS link FROM n ORDER BY seq LIMIT 1""")
def unindexed_notice(spark, d):
    return catalog.unindexed_notice(files(spark, d), ["src5"]).select("file_id", "name", "reason", "link")


RECORDS = (
    (0, "members", ["구성원", "member"], ["명단", "list"], ["논문", "paper"], ["lab/src1"], ["src1"], "canonical_record"),
    (1, "folders", ["하위 폴더", "subfolder"], [], [], ["lab"], [], "subfolder_listing"),
)
RECORD_DDL = "ord int, key string, intent_terms array<string>, context_terms array<string>, exclude_if_present array<string>, preferred_roots array<string>, filename_hints array<string>, operation string"


@query("canonical_intent", "SELECT * FROM (VALUES (1, 'members'), (2, NULL), (3, NULL), (4, 'folders'), (5, 'members')) t(id, record)")
def canonical_intent(spark, d):
    cases = ((1, "구성원 명단 보여줘"), (2, "구성원 논문 명단"), (3, "구성원이 누구"), (4, "하위 폴더 뭐 있어"), (5, "Member List please, subfolder"))
    return catalog.canonical_intents(rows(spark, "id int, q string", *cases), rows(spark, RECORD_DDL, *RECORDS))


@query("canonical_retrieve", CHUNKS + f""", f AS ({FILES} SELECT * FROM files), n AS (SELECT *, {NORMAL.format('name')} AS nn FROM f WHERE status = 'indexed'),
best AS (SELECT file_id FROM n WHERE contains(nn, 'src1') ORDER BY 30 * CAST(contains(nn, 'src1') AS INT) + 30 * CAST(root = 'lab/src1' AS INT) DESC, seq LIMIT 1)
SELECT file_id, idx FROM chunks WHERE file_id IN (SELECT file_id FROM best) ORDER BY idx LIMIT 100""")
def canonical_retrieve(spark, d):
    """All chunks, 100 at most, of the best file that a record's hint finds by name."""
    found = catalog.score_documents(files(spark, d), [], preferred=["lab/src1"], hints=["src1"])
    best = found.where(F.exists("reasons", lambda r: r.startswith("name has hint"))).orderBy(F.col("score").desc(), "seq").limit(1)
    return chunks(spark, d).join(F.broadcast(best.select("file_id")), "file_id").orderBy("idx").limit(100).select("file_id", "idx")
