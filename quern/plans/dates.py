"""Queries of periods and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates
from quern.functions import text as X
from quern.plans.base import FILES, MESSAGES, files, messages, query, rows

TODAY = "date'2026-07-31'"
PERIODS = (
    (1, "2026년 6월 회의록"), (2, "6월 회의록"), (3, "지난달 업무"), (4, "최근 2주 슬랙"), (5, "최근 10일"), (6, "이번 달 일정"), (7, "그냥 질문"), (8, "12월"),
)


@query("period_parse", """SELECT id, CAST(s AS DATE) AS start_day, CAST(e AS DATE) AS end_day, i AS inferred, q AS full_query FROM (VALUES
(1, '2026-06-01', '2026-07-01', false, '2026년 6월 회의록'), (2, '2026-06-01', '2026-07-01', true, '2026년 6월 회의록'), (3, '2026-06-01', '2026-07-01', true, '2026년 6월 지난달 업무'),
(4, '2026-07-18', '2026-08-01', false, '2026년 최근 2주 슬랙'), (5, '2026-07-22', '2026-08-01', false, '2026년 최근 10일'), (6, '2026-07-01', '2026-08-01', true, '2026년 7월 이번 달 일정'),
(7, NULL, NULL, NULL, '그냥 질문'), (8, '2026-12-01', '2027-01-01', true, '2026년 12월')) t(id, s, e, i, q)""")
def period_parse(spark, d):
    q = rows(spark, "id int, q string", *PERIODS).withColumn("p", dates.period(F.col("q"), F.expr(TODAY)))
    return q.select("id", F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"), F.col("p.inferred").alias("inferred"), dates.with_year(F.col("q"), F.col("p")).alias("full_query"))


@query("explicit_dates", """SELECT id, CAST(x AS DATE[]) AS days FROM (VALUES (1, ['2026-06-16']), (2, ['2026-06-16']), (3, ['2026-06-02', '2025-01-31']), (4, []), (5, ['2026-07-01']), (6, [])) t(id, x)""")
def explicit_dates(spark, d):
    cases = ((1, "260616_report.pdf"), (2, "plan 20260616"), (3, "2025-02-30 2026년 6월 2일 and 20250131"), (4, "v1234567890"), (5, "2026/7/1.txt 260701"), (6, None))
    return rows(spark, "id int, t string", *cases).select("id", dates.explicit_dates(F.coalesce("t", F.lit(""))).alias("days"))


@query("period_filter", FILES + """SELECT file_id FROM files WHERE CAST(CAST(replace(replace(mod_time, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 9 HOUR AS DATE) >= DATE '2026-06-01'
AND CAST(CAST(replace(replace(mod_time, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 9 HOUR AS DATE) < DATE '2026-07-01'""")
def period_filter(spark, d):
    """Files of June 2026 by the local day of their time stamp alone: numbers of six digits in names here are ids, not dates."""
    f = files(spark, d)
    hit = {"source": F.lit("drive"), "thread_ts": F.lit(None).cast("string"), "mod_time": F.col("mod_time")}
    return f.where(dates.in_period(hit, F.expr("date'2026-06-01'"), F.expr("date'2026-07-01'"))).select("file_id")


@query("period_filter_cases", "SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, false), (5, true), (6, false), (7, false)) t(id, kept)")
def period_filter_cases(spark, d):
    cases = (
        (1, "drive", None, "x", "note 2025-06-02", "2026-06-20T00:00:00Z"), (2, "drive", None, "260616_a.pdf", None, None), (3, "drive", None, "a", None, "2026-06-20T00:00:00Z"),
        (4, "drive", None, "a", None, "2026-07-01T00:00:00Z"), (5, "slack", "1781200000.000100", "", None, None), (6, "slack", "bad", "", None, None), (7, "drive", None, "a", None, None),
    )
    c = rows(spark, "id int, source string, thread_ts string, name string, citation string, mod_time string", *cases)
    hit = {k: F.col(k) for k in ("source", "thread_ts", "name", "citation", "mod_time")}
    return c.select("id", dates.in_period(hit, F.expr("date'2026-06-01'"), F.expr("date'2026-07-01'")).alias("kept"))


@query("thread_days", MESSAGES + "SELECT CAST(to_timestamp(CAST(thread_ts AS DOUBLE)) AT TIME ZONE 'UTC' + INTERVAL 9 HOUR AS DATE) AS day, count(DISTINCT thread_ts) AS threads FROM messages GROUP BY 1")
def thread_days(spark, d):
    return messages(spark, d).groupBy(dates.epoch_day(F.col("thread_ts")).alias("day")).agg(F.countDistinct("thread_ts").alias("threads"))


@query("filename_year", "SELECT * FROM (VALUES (1, true, true), (2, true, false), (3, false, false), (4, true, true)) t(id, in_year, in_month)")
def filename_year(spark, d):
    c = rows(spark, "id int, n string", (1, "260407_plan.hwp"), (2, "260107 budget"), (3, "25 plan"), (4, "report 2026 final"))
    n = X.normalize(F.col("n"))
    return c.select("id", dates.name_has_year(n, "2026").alias("in_year"), dates.name_has_year(n, "2026", "04").alias("in_month"))


@query("date_filter_fallback", FILES + """, m AS (SELECT *, mod_time LIKE '2026-03%' AS hit, mod_time LIKE '2031%' AS never FROM files)
SELECT file_id, 'some' AS filter FROM m WHERE hit OR NOT (SELECT bool_or(hit) FROM m) UNION ALL SELECT file_id, 'none' FROM m WHERE never OR NOT (SELECT bool_or(never) FROM m)""")
def date_filter_fallback(spark, d):
    """Rows of a month, and rows of a year that no file is of, where all stay."""
    from quern.operators.fusion import keep_or_all

    f = files(spark, d)
    some = keep_or_all(f, F.col("mod_time").startswith("2026-03")).select("file_id", F.lit("some").alias("filter"))
    return some.unionByName(keep_or_all(f, F.col("mod_time").startswith("2031")).select("file_id", F.lit("none").alias("filter")))
