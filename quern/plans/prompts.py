"""Queries of prompt and answer assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import intent as I
from quern.operators import prompts, providers
from quern.plans.base import CHUNKS, FILES, chunks, files, query, rows
from quern.session import table

HITS = FILES + ", hits AS (SELECT *, CAST(row_number() OVER (ORDER BY size DESC, seq) AS INTEGER) AS rank, CASE WHEN seq % 2 = 0 THEN 'drive' ELSE 'slack' END AS kind FROM files QUALIFY rank <= 6)"


def _hits(spark, d):
    from quern.operators.fusion import with_rank

    top = files(spark, d).orderBy(F.col("size").desc(), "seq").limit(6)
    h = with_rank(top, "rank", F.col("size").desc(), F.col("seq"))
    return h.withColumns({"kind": F.when(F.col("seq") % 2 == 0, "drive").otherwise("slack"), "citation": F.col("name"), "text": F.col("path"), "file_url": F.concat(F.lit("https://x/"), "file_id")})


@query("context_block", HITS + "SELECT string_agg('[' || rank || '] ' || name || chr(10) || path, chr(10) || chr(10) ORDER BY rank) AS block FROM hits")
def context_block(spark, d):
    return prompts.context_block(_hits(spark, d))


@query("sources_block", HITS + "SELECT kind, string_agg('[' || rank || '] [' || name || '](https://x/' || file_id || ')', chr(10) ORDER BY rank) AS block, count(*) AS n FROM hits GROUP BY kind")
def sources_block(spark, d):
    return prompts.sources_block(_hits(spark, d))


KINDS, FORMATS = (["drive", "slack"], ["drive"], ["slack"], []), (*[x for x, _ in fixed.ANSWER_FORMATS], "summary")
STRUCTURE_SQL = f"""SELECT k.i * 10 + f.i AS id, CASE WHEN k.heads <> '' AND f.form <> '' THEN k.heads || chr(10) || f.form ELSE k.heads || f.form END AS layout
FROM (VALUES (0, '{fixed.ANSWER_BOTH}'), (1, '{fixed.ANSWER_DRIVE}'), (2, '{fixed.ANSWER_SLACK}'), (3, '')) k(i, heads), (VALUES {", ".join(f"({i}, '{dict(fixed.ANSWER_FORMATS).get(x, '')}')" for i, x in enumerate(FORMATS))}) f(i, form)"""


@query("answer_structure", STRUCTURE_SQL)
def answer_structure(spark, d):
    """Every set of kinds with every format."""
    cases = [(10 * i + j, k, f) for i, k in enumerate(KINDS) for j, f in enumerate(FORMATS)]
    return rows(spark, "id int, k array<string>, f string", *cases).select("id", prompts.structure(F.col("k"), F.col("f")).alias("layout"))


@query("message_history", """WITH l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last FROM conversations GROUP BY 1), b AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS k FROM conversations c JOIN l ON c.conv_id = l.conv_id AND turn < last WHERE role IN ('user', 'assistant'))
SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS history FROM b WHERE k <= 6 GROUP BY 1""")
def message_history(spark, d):
    return prompts.histories(table(spark, d, "conversations"))


@query("web_block", r"""SELECT '[W1] A title' || chr(10) || 'URL: https://a.example' || chr(10) || 'text a' || chr(10) || chr(10) || '[W2] C' || chr(10) || 'URL: http://c.example' || chr(10) AS block, CAST(2 AS BIGINT) AS n""")
def web_block(spark, d):
    cases = ((1, "A\n title", "https://a.example", "text a"), (2, "B", "javascript:x", "text b"), (3, "C", "http://c.example", None))
    return prompts.web_block(rows(spark, "rank int, title string, url string, content string", *cases))


@query("intent_block", "SELECT 1 AS id, 'task: content' || chr(10) || 'period: 2026-06-01 to 2026-07-01' || chr(10) || 'sources: slack' || chr(10) || 'topics: 출장' || chr(10) || 'people: 김철수' || chr(10) || 'format: summary' AS block")
def intent_block(spark, d):
    q = rows(spark, "id int, q string", (1, "6월 슬랙에서 김철수님 출장 기록"))
    return q.select("id", prompts.intent_block(I.intent(F.col("q"), F.expr("date'2026-07-31'"))).alias("block"))


@query("rerank_texts", CHUNKS + "SELECT file_id, idx, sha256('folder: ' || root || chr(10) || text) AS h FROM chunks")
def rerank_texts(spark, d):
    return chunks(spark, d).select("file_id", "idx", F.sha2(providers.rerank_text({"root": F.col("root"), "text": F.col("text")}), 256).alias("h"))


@query("location_table", HITS + "SELECT string_agg('| ' || rank || ' | ' || name || ' | ' || root || '/' || path || ' |', chr(10) ORDER BY rank) AS body FROM hits")
def location_table(spark, d):
    """Located files as the rows of a Markdown table."""
    line = F.concat(F.lit("| "), F.col("rank").cast("string"), F.lit(" | "), "name", F.lit(" | "), "root", F.lit("/"), "path", F.lit(" |"))
    return _hits(spark, d).agg(prompts.joined(F.col("rank"), line, "\n").alias("body"))
