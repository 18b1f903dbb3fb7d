"""Queries of late chunking and of prompts for chunk contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import context
from quern.plans.base import CHUNKS, FILES, chunks, files, query


@query("late_chunks", CHUNKS + "SELECT file_id, idx, strlen(text) + 13 AS n_tokens, 64 AS dim, 1.0::DOUBLE AS norm FROM chunks")
def late_chunks(spark, d):
    """Vectors of all chunks from windows of their files, by the deterministic provider. SQL has their tokens and lengths; the
    vectors are tested against brute force."""
    v = context.late_chunks(chunks(spark, d))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("file_id", "idx", "n_tokens", F.size("vector").alias("dim"), F.round(norm, 3).alias("norm"))


PROMPTS = CHUNKS.replace("WITH chunks", "WITH c0").rstrip() + """, f AS ({files} SELECT * FROM files), c AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'part ' || (idx // 3) END AS section FROM c0),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY file_id) AS file_chars, sum(length(text)) OVER (PARTITION BY file_id, section) AS section_chars, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS nth, count(*) OVER (PARTITION BY file_id) AS n FROM c),
w AS (SELECT *, CASE WHEN file_chars <= 7200 THEN 'full' WHEN section IS NOT NULL AND section_chars <= 5000 THEN 'section' ELSE 'local' END AS scope FROM s),
b AS (SELECT *, trim(CASE scope WHEN 'full' THEN (SELECT string_agg(x.text, chr(10) ORDER BY x.idx) FROM c x WHERE x.file_id = w.file_id) WHEN 'section' THEN (SELECT string_agg(x.text, chr(10) ORDER BY x.idx) FROM c x WHERE x.file_id = w.file_id AND x.section = w.section)
 ELSE (SELECT string_agg(x.text, chr(10) ORDER BY x.idx) FROM w x WHERE x.file_id = w.file_id AND abs(x.nth - w.nth) <= 2) END, ' ' || chr(9) || chr(10) || chr(13)) AS raw, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t,
 trim((SELECT substr(x.text, 1, 701) FROM c x WHERE x.file_id = w.file_id ORDER BY x.idx LIMIT 1), ' ' || chr(9) || chr(10) || chr(13)) AS h FROM w),
p AS (SELECT *, CASE WHEN length(raw) <= 7200 THEN raw ELSE substr(raw, 1, 7200) || ' …' END AS body, CASE WHEN length(t) <= 2000 THEN t ELSE substr(t, 1, 2000) || ' …' END AS target, CASE WHEN length(h) <= 700 THEN h ELSE substr(h, 1, 700) || ' …' END AS head FROM b)
SELECT p.file_id, p.idx, scope, sha256('<문서 이름="' || f.name || '" 폴더="' || f.root || '" 경로="' || f.path || '">' || chr(10) || CASE WHEN scope <> 'full' AND head <> '' AND NOT contains(body, head) THEN '<문서 앞부분>' || chr(10) || head || chr(10) || '</문서 앞부분>' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN section IS NOT NULL THEN '현재 절: ' || section || chr(10) ELSE '' END || '<본문' || CASE scope WHEN 'full' THEN ' 전체' WHEN 'section' THEN ' 중 ''' || section || ''' 절' ELSE ' 중 ' || greatest(1, nth - 2) || '~' || least(n, nth + 2) || '번째 조각' END || '>' || chr(10) || body || chr(10) || '</본문>' || chr(10) || '</문서>' || chr(10) || chr(10)
 || '<대상>' || chr(10) || target || chr(10) || '</대상>' || chr(10) || chr(10) || '위 대상이 문서의 어떤 맥락에 있는지 문서에서 확인되는 내용만으로 한두 문장으로 써라.') AS prompt_hash FROM p JOIN f USING (file_id)""".replace("{files}", FILES)


@query("context_prompts", PROMPTS)
def context_prompts(spark, d):
    """Prompts of all chunks; a third of the files has sections of three chunks."""
    c = chunks(spark, d)
    section = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("part "), F.floor(F.col("idx") / 3).cast("string")))
    p = context.context_prompts(c.select("file_id", "idx", "text", section.alias("section")), files(spark, d))
    return p.select("file_id", "idx", "scope", F.sha2("prompt", 256).alias("prompt_hash"))
