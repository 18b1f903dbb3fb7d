"""Queries of the scalar functions over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.plans.base import CHUNKS, FILES, MESSAGES, chunks, files, messages, query, rows
from quern.session import table


@query("tokenize", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9A-Za-z가-힣]+')) AS INTEGER) AS n_tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+'))) AS INTEGER) AS n_distinct FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), F.size(X.token_set(F.col("text"))).alias("n_distinct"))


@query("normalize_ascii", FILES + r"SELECT file_id, trim(regexp_replace(regexp_replace(lower(path), '[\\/_\-.()\[\]{}]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM files")
def normalize_ascii(spark, d):
    return files(spark, d).select("file_id", X.normalize(F.col("path")).alias("normal"))


@query("normalize_nfkc", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[\\/_\-.()\[\]{}／·]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM documents""")
def normalize_nfkc(spark, d):
    """Whole texts in decomposed form, normalised. SQL has NFC, which gives the same for letters of these languages; NFKC's own
    cases are tested against Python's ``unicodedata``."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2(X.normalize(F.col("text"), compatibility=True), 256).alias("h"))


TERMS = (
    (1, "2026년 구성원들 명단 알려줘"), (2, "실험 데이터셋 정리해줘"), (3, "프로젝트에서 쓰는 장비는?"), (4, "lab report 2025 final"), (5, "최근 자료"),
    (6, "연구비 사용을 위한 서류"),
)


@query("lexical_terms", """SELECT * FROM (VALUES (1, ['구성원들', '구성원', '명단']), (2, ['실험', '데이터셋']), (3, ['프로젝트에서', '프로젝트', '쓰는', '장비는', '장비']),
(4, ['lab', 'report', 'final']), (5, CAST([] AS VARCHAR[])), (6, ['연구비', '사용을', '사용', '위한', '서류'])) t(id, terms)""")
def lexical_terms(spark, d):
    return rows(spark, "id int, q string", *TERMS).select("id", X.lexical_terms(F.col("q")).alias("terms"))


@query("redact_secrets", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(비밀번호|비번|password|passwd|pwd|pass|pw)(\s*(?:(?:은|는|:|=)\s*|is\s+)|\s+)([^\s,;]+)', '\1\2[REDACTED]', 'gi'),
'\b(?:xox[baprs]-[A-Za-z0-9-]+|xapp-[A-Za-z0-9-]+|gh[pousr]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+|sk-[A-Za-z0-9_-]{16,})\b', '[REDACTED]', 'gi') AS safe FROM conversations""")
def redact_secrets(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.redact(F.col("text")).alias("safe"))


@query("redact_cases", """SELECT * FROM (VALUES (1, 'password: [REDACTED] ok'), (2, '비밀번호는 [REDACTED] 입니다'), (3, 'token [REDACTED] x'), (4, 'use [REDACTED]'), (5, 'nothing here')) t(id, safe)""")
def redact_cases(spark, d):
    cases = ((1, "password: hunter2 ok"), (2, "비밀번호는 abc123 입니다"), (3, "token xoxb-12-abcDEF x"), (4, "use ghp_abcdef123456"), (5, "nothing here"))
    return rows(spark, "id int, t string", *cases).select("id", X.redact(F.col("t")).alias("safe"))


@query("point_ids", CHUNKS + """, h AS (SELECT file_id, idx, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(file_id || ':' || idx)) AS h FROM chunks)
SELECT file_id, idx, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab89ab89ab89ab', CAST('0x'||substr(h,17,1) AS INTEGER)+1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS point_id FROM h""")
def point_ids(spark, d):
    """Stable ids of chunks: the same file and index always give the same point."""
    return chunks(spark, d).select("file_id", "idx", X.uuid5(F.concat_ws(":", "file_id", F.col("idx").cast("string"))).alias("point_id"))


@query("content_hash", CHUNKS + "SELECT file_id, idx, sha256(text) AS content_hash FROM chunks")
def content_hash(spark, d):
    return chunks(spark, d).select("file_id", "idx", F.sha2("text", 256).alias("content_hash"))


@query("url_clean", r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^/?#\s]+[^\s]*$') THEN trim(url) ELSE '' END AS url FROM pages")
def url_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_url(F.col("url")).alias("url"))


@query("url_clean_cases", "SELECT * FROM (VALUES (1, 'https://a.example/x'), (2, ''), (3, ''), (4, ''), (5, 'http://b.example'), (6, '')) t(id, url)")
def url_clean_cases(spark, d):
    cases = ((1, " https://a.example/x\n"), (2, "javascript:alert(1)"), (3, "https://a.example/x y"), (4, "https:///path"), (5, "http://b.example"), (6, None))
    return rows(spark, "id int, u string", *cases).select("id", X.clean_url(F.col("u")).alias("url"))


@query("permalinks", MESSAGES + "SELECT DISTINCT channel_id, thread_ts, 'https://slack.com/archives/' || channel_id || '/p' || replace(thread_ts, '.', '') AS link FROM messages")
def permalinks(spark, d):
    return messages(spark, d).select("channel_id", "thread_ts").distinct().withColumn("link", X.permalink(F.col("channel_id"), F.col("thread_ts")))


@query("permalink_cases", "SELECT * FROM (VALUES (1, 'https://slack.com/archives/C07RXJNFGAC/p1785399154691819'), (2, ''), (3, ''), (4, 'https://slack.com/archives/C07RXJNFGAC/p1785399154690000')) t(id, link)")
def permalink_cases(spark, d):
    cases = ((1, "C07RXJNFGAC", "1785399154.691819"), (2, "C1", "1785399154.691819"), (3, "C07RXJNFGAC", "not-a-ts"), (4, "C07RXJNFGAC", "1785399154.69"))
    return rows(spark, "id int, c string, t string", *cases).select("id", X.permalink(F.col("c"), F.col("t")).alias("link"))


@query("human_sizes", FILES + "SELECT file_id, CASE WHEN size <= 0 THEN '0B' WHEN size < 1024 THEN printf('%.0fB', CAST(size AS DOUBLE)) ELSE printf('%.1fKB', size / 1024.0) END AS human FROM files")
def human_sizes(spark, d):
    return files(spark, d).select("file_id", X.human_size(F.col("size")).alias("human"))


@query("primary_ids", "SELECT * FROM (VALUES (1, 'abc', 'https://drive.google.com/file/d/abc/view'), (2, 'x1', 'https://drive.google.com/file/d/x1/view')) t(id, primary_id, link)")
def primary_ids(spark, d):
    return rows(spark, "id int, f string", (1, "abc"), (2, "  x1\t x2")).select("id", X.primary_id(F.col("f")).alias("primary_id"), X.file_link(F.col("f")).alias("link"))


@query("markdown_links", FILES + r"SELECT file_id, '[' || regexp_replace(name, '([\\\[\]])', '\\\1', 'g') || '](' || replace(replace('https://x/' || path, '(', '%28'), ')', '%29') || ')' AS link FROM files")
def markdown_links(spark, d):
    link = F.concat(F.lit("["), X.markdown_text(F.col("name")), F.lit("]("), X.markdown_url(F.concat(F.lit("https://x/"), "path")), F.lit(")"))
    return files(spark, d).select("file_id", link.alias("link"))


@query("squeezed_names", MESSAGES + r"SELECT DISTINCT channel_name, lower(regexp_replace(channel_name, '[\s_-]+', '', 'g')) AS squeezed FROM messages")
def squeezed_names(spark, d):
    return messages(spark, d).select("channel_name").distinct().withColumn("squeezed", X.squeezed(F.col("channel_name")))


SECTIONS = (
    (1, "Abstract:"), (2, "3 Methods"), (3, "4.2. Discussion"), (4, "2011 창업"), (5, "제 3 장 결과"), (6, "Ⅱ. 실험"), (7, "1 This is a sentence."), (8, "plain line"), (9, ""), (10, "4.120 Too far"),
)


@query("section_detect", """SELECT * FROM (VALUES (1, 'Abstract'), (2, '3 Methods'), (3, '4.2 Discussion'), (4, NULL), (5, '3 결과'), (6, 'Ⅱ 실험'), (7, NULL), (8, NULL), (9, NULL), (10, NULL)) t(id, section)""")
def section_detect(spark, d):
    return rows(spark, "id int, l string", *SECTIONS).select("id", X.section(F.col("l")).alias("section"))


@query("citations", "SELECT * FROM (VALUES (1, 'a.pdf · 3쪽 · §Methods · T1'), (2, 'b.docx'), (3, 'c.txt · §Intro')) t(id, citation)")
def citations(spark, d):
    cases = ((1, "a.pdf", 3, "Methods", "T1"), (2, "b.docx", None, None, None), (3, "c.txt", None, "Intro", ""))
    return rows(spark, "id int, n string, p int, s string, l string", *cases).select("id", X.citation(F.col("n"), F.col("p"), F.col("s"), F.col("l")).alias("citation"))


@query("web_titles", "SELECT page_id, trim(substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200)) AS title FROM pages")
def web_titles(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
