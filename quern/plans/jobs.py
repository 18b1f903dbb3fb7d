"""The two jobs as queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import chat_sync, common, corpus_chunks
from quern.plans.base import MESSAGES, query
from quern.scratch import shared_dir
from quern.session import prepared

REDACTED = r"""regexp_replace(regexp_replace(text, '(비밀번호|비번|password|passwd|pwd|pass|pw)(\s*(?:(?:은|는|:|=)\s*|is\s+)|\s+)([^\s,;]+)', '\1\2[REDACTED]', 'gi'),
 '\b(?:xox[baprs]-[A-Za-z0-9-]+|xapp-[A-Za-z0-9-]+|gh[pousr]_[A-Za-z0-9]+|github_pat_[A-Za-z0-9_]+|sk-[A-Za-z0-9_-]{16,})\b', '[REDACTED]', 'gi')"""


def _folder(spark, name: str) -> str:
    prepared(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("job1_chat_sync", MESSAGES + f""", m AS (SELECT *, {REDACTED} AS safe FROM messages WHERE thread_ts IS NOT NULL AND ts IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(text, '(?i)채널에 참여(?:함|했습니다)|채널에 .*추가했습니다|채널을 떠남|채널에서 자신을 제거했습니다|joined the channel')),
o AS (SELECT channel_id, thread_ts, ts, CAST(ts AS DOUBLE) AS secs, max(struct_pack(t := safe, u := user_name, c := channel_name)) AS m FROM m GROUP BY 1, 2, 3)
SELECT channel_id, DATE '1970-01-01' + CAST(floor(CAST(thread_ts AS DOUBLE) / 86400) AS INTEGER) AS day, max(m.c) AS channel_name, thread_ts,
 'https://slack.com/archives/' || channel_id || '/p' || split_part(thread_ts, '.', 1) || rpad(split_part(thread_ts, '.', 2), 6, '0') AS link, count(*) AS n_messages, count(DISTINCT m.u) AS n_users, CAST(sum(length(m.t)) AS BIGINT) AS n_chars,
 arg_min(ts, secs) AS first_ts, arg_max(ts, secs) AS last_ts, arg_min(substr(m.t, 1, 400), secs) AS opening, arg_max(substr(m.t, 1, 400), secs) AS latest FROM o GROUP BY channel_id, thread_ts""")
def job1_chat_sync(spark, d):
    """Threads after two runs of the sync over all conversations; the second finds nothing new."""
    at, settings = _folder(spark, "chat-sync"), common.settings(chat_sync.DEFAULT)
    for _ in range(2):  # a stream wants a folder or a pattern; the table may be one file
        chat_sync.sync(spark, f"{d}/conversations.parque[t]", at, f"{at}/checkpoint", settings)
    return chat_sync.table(spark, at, "threads")


@query("job2_corpus_chunks", f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS root, lang, {REDACTED} AS safe FROM documents),
c AS (SELECT file_id, root, lang, i AS idx, substr(safe, CAST(i * 1000 + 1 AS BIGINT), 1200) AS text FROM (SELECT *, unnest(range(0, CAST((length(safe) + 999) // 1000 AS BIGINT))) AS i FROM t)),
h AS (SELECT *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(file_id || ':' || idx)) AS h FROM c WHERE length(trim(text, ' ')) >= 60)
SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab89ab89ab89ab', CAST('0x'||substr(h,17,1) AS INTEGER)+1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS chunk_id,
 file_id, idx, length(text) AS n_chars, sha256(text) AS content_hash, sha256(text) AS text_hash, root, lang FROM h""")
def job2_corpus_chunks(spark, d):
    """Chunks of all documents after two runs; the second replaces what the first wrote. Texts are compared by hashes of what was read."""
    at, settings = _folder(spark, "corpus-chunks"), common.settings(corpus_chunks.DEFAULT)
    for _ in range(2):
        corpus_chunks.build(spark, f"{d}/documents.parquet", at, settings)
    return corpus_chunks.table(spark, at, "chunks").withColumn("text_hash", F.sha2("text", 256)).drop("text")
