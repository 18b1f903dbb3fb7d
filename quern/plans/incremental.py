"""Queries of incremental maintenance, the manifest's sinks, the audit, and streams over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import manifest
from quern.plans.base import CHUNKS, FILES, chunks, files, query, rows
from quern.scratch import folder
from quern.session import table
from quern.streaming import incremental


def _listed(spark, d):
    """The drive as it is now: some files gone, some changed, some new."""
    f = files(spark, d)
    mod = F.when(F.col("seq") % 6 == 1, F.lit("2026-12-01T00:00:00Z")).otherwise(F.col("mod_time"))
    size = F.when(F.col("seq") % 6 == 2, F.col("size") + 1).when(F.col("seq") % 6 == 3, -1).otherwise(F.col("size"))
    fid = F.when(F.col("seq") % 6 == 4, F.concat(F.lit("n"), "file_id")).otherwise(F.col("file_id"))
    return f.where(F.col("seq") % 6 != 5).select(fid.alias("file_id"), "name", mod.alias("mod_time"), size.alias("size"))


LISTED = FILES + """, listed AS (SELECT CASE WHEN seq % 6 = 4 THEN 'n' || file_id ELSE file_id END AS file_id, name, CASE WHEN seq % 6 = 1 THEN '2026-12-01T00:00:00Z' ELSE mod_time END AS mod_time,
 CASE seq % 6 WHEN 2 THEN size + 1 WHEN 3 THEN -1 ELSE size END AS size FROM files WHERE seq % 6 <> 5) """


@query("changed_files", LISTED + """SELECT l.file_id, CASE WHEN f.file_id IS NULL THEN 'new' WHEN f.status = 'failed' THEN 'retry' WHEN f.status = 'skipped' THEN NULL WHEN l.mod_time <> f.mod_time THEN 'mod_time' WHEN l.size >= 0 AND l.size <> f.size THEN 'size' END AS change FROM listed l LEFT JOIN files f USING (file_id)""")
def changed_files(spark, d):
    return manifest.needs_index(_listed(spark, d), files(spark, d), retry_failed=True).select("file_id", "change")


@query("deleted_files", LISTED + "SELECT file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM listed)")
def deleted_files(spark, d):
    return manifest.deleted(files(spark, d), _listed(spark, d)).select("file_id")


@query("manifest_upsert", LISTED + "SELECT file_id, mod_time, size FROM listed UNION ALL SELECT file_id, mod_time, size FROM files WHERE file_id NOT IN (SELECT file_id FROM listed)")
def manifest_upsert(spark, d):
    return manifest.upsert(files(spark, d).select("file_id", "mod_time", "size"), _listed(spark, d).select("file_id", "mod_time", "size"), ["file_id"], F.col("mod_time"))


@query("delete_root", FILES + "SELECT root, count(*) AS n FROM files WHERE root <> 'lab/src3' GROUP BY 1")
def delete_root(spark, d):
    f = files(spark, d)
    return manifest.without(f, f.where(F.col("root") == "lab/src3")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query("replace_on_change", CHUNKS + "SELECT file_id, count(*) AS n FROM chunks WHERE seq % 5 <> 0 OR seq % 10 = 0 GROUP BY 1")
def replace_on_change(spark, d):
    """Every file of the run loses its chunks; those that were indexed get new ones."""
    c = chunks(spark, d)
    outcome = c.where(F.col("seq") % 5 == 0).select("file_id").distinct()
    return manifest.replace_files(c, outcome, c.where(F.col("seq") % 10 == 0)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query("run_counts", FILES + """, o AS (SELECT *, seq % 3 <> 0 AS touched FROM files)
SELECT count(*) FILTER (status = 'indexed' AND touched) AS indexed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed' AND touched) AS failed, count(*) FILTER (status = 'indexed' AND NOT touched) AS unchanged,
 count(*) FILTER (status = 'failed' AND NOT touched) AS still_failed, CAST(sum(n_chunks) FILTER (touched) AS BIGINT) AS chunks, (SELECT count(DISTINCT error) FROM files) AS n_reasons FROM o""")
def run_counts(spark, d):
    """Outcomes of a run that left a third of the files alone."""
    r = manifest.run_counts(files(spark, d).withColumn("change", F.when(F.col("seq") % 3 != 0, "mod_time")))
    return r.select("indexed", "skipped", "failed", "unchanged", "still_failed", "chunks", F.size("reasons").cast("long").alias("n_reasons"))


@query("scope_roots", "SELECT * FROM (VALUES ('folders', 'a'), ('folders', 'c'), ('all', 'a'), ('all', 'c'), ('all', 'd')) t(mode, root)")
def scope_roots(spark, d):
    cases = (("a", True, False, True), ("b", True, False, False), ("c", True, False, True), ("x", False, True, True), ("d", False, False, True))
    scope = rows(spark, "root string, included boolean, excluded boolean, enabled boolean", *cases)
    each = [manifest.scope_roots(scope, m).select(F.lit(m).alias("mode"), "root") for m in ("off", "all", "folders")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("synopsis_fingerprints", FILES + "SELECT file_id FROM files WHERE status = 'indexed' AND (seq % 3 = 0 OR seq % 4 = 1)")
def synopsis_fingerprints(spark, d):
    f = files(spark, d)
    have = f.where(F.col("seq") % 3 != 0).select("file_id", "mod_time", "path", "root", F.when(F.col("seq") % 4 == 1, "v0").otherwise("v1").alias("version"))
    return manifest.fingerprint_changes(have, f, "v1")


@query("audit_cases", "SELECT * FROM (VALUES ('a', 4, 'private_address'), ('b', 2, 'credential')) t(path, line, rule)")
def audit_cases(spark, d):
    cases = (
        ("a", 1, 'password = "hunter2hunter2"'), ("a", 2, "api_key: settings.key"), ("a", 3, "access_token = your-token-here"), ("a", 4, "host 192.168.0.12"),
        ("b", 1, "client_secret: <redacted>"), ("b", 2, "refresh_token=abc-123-def-456 # x"), ("b", 3, "nothing"), ("b", 4, "password = variable_name"),
    )
    return manifest.audit(rows(spark, "path string, line int, text string", *cases))


@query("audit_documents", r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'host 10.0.' || (doc_id % 250) || '.7' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'api_key = "k' || doc_id || '-secret-value"' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'password = your-password' ELSE '' END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
r AS (SELECT doc_id, line, trim(regexp_extract(line, '(?i)\b(?:client_secret|access_token|refresh_token|password|passwd|api_key)\b["\x27]?\s*[:=]\s*([^#]+)', 1)) AS raw, regexp_matches(line, '\b(?:10(?:\.[0-9]{1,3}){3}|192\.168(?:\.[0-9]{1,3}){2}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.[0-9]{1,3}){2})\b') AS address FROM l),
v AS (SELECT *, CASE WHEN raw LIKE '"%' THEN regexp_extract(raw, '^"(.*?)(?:"|$)', 1) WHEN starts_with(raw, chr(39)) THEN split_part(raw, chr(39), 2) ELSE regexp_extract(raw, '^([^\s"\x27,)}\]]*)', 1) END AS value FROM r),
k AS (SELECT doc_id, 'private_address' AS rule FROM v WHERE address UNION ALL SELECT doc_id, 'credential' FROM v WHERE length(value) >= 8 AND NOT regexp_matches(value, '^(settings\.|section\.|self\.|os\.|config\.|token\.|data\[|str\(|getenv\(|None|\{\}|\[\])')
 AND NOT contains(lower(value), '<redacted>') AND NOT regexp_matches(lower(value), '^(your-|your_|example-|example_|changeme)') AND NOT regexp_matches(value, '^<.*>$') AND NOT regexp_matches(value, '^[A-Za-z_]\w*(?:\.\w+)*(?:[),}\]]+)?$'))
SELECT CAST(doc_id AS VARCHAR) AS path, rule, count(*) AS n FROM k GROUP BY 1, 2""")
def audit_documents(spark, d):
    """Lines of all documents with a private address or a literal credential; some documents have such lines added."""
    docs = table(spark, d, "documents")
    number, when = F.col("doc_id").cast("string"), lambda n, *parts: F.when(F.col("doc_id") % n == 0, F.concat(F.lit("\n"), *parts)).otherwise("")
    host = when(5, F.lit("host 10.0."), (F.col("doc_id") % 250).cast("string"), F.lit(".7"))
    text = F.concat("text", host, when(7, F.lit('api_key = "k'), number, F.lit('-secret-value"')), when(11, F.lit("password = your-password")))
    lines = docs.select(number.alias("path"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return manifest.audit(lines).groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("event_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Tumbling windows of a day; the same function serves a stream. An addition of ours."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = incremental.windowed(e, "at", "1 day", ["event_type"])
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("event_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s.s""")
def event_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return incremental.sessions(e, "at", "6 hours", "user_id").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@query("event_stream", "SELECT user_id, arg_max(event_id, ts || '|' || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS event_id FROM events GROUP BY 1")
def event_stream(spark, d):
    """A stream over all events into a keyed table: the last event of each user. Runs until everything is read."""
    at = folder(spark, "event-stream")
    # a stream wants a folder or a pattern; the table may be one file
    e = incremental.read_stream(spark, f"{d}/events.parque[t]", incremental.EVENTS)
    e = e.select("user_id", "event_id", F.concat(F.col("ts").cast("string"), F.lit("|"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("newest"))
    incremental.run_available(e, f"{at}/checkpoint", incremental.keyed_sink(spark, f"{at}/table", ["user_id"], "newest"))
    return manifest.read_keyed(spark, f"{at}/table").select("user_id", "event_id")
