"""How the test tables stand in for files, chunks, threads and vectors, in DataFrames and in the comparison SQL.

The SQL texts are written for another engine and independently of the DataFrame code; a query's SQL begins with the
common tables it needs (``FILES``, ``CHUNKS``, ...) and continues with a SELECT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import ORACLE_SQL, QUERIES
from quern.session import table

#: Endings of the stand-in files, by the last digit of their id.
ENDINGS = ("txt", "pdf", "docx", "xlsx", "hwp", "py", "PNG", "csv", "zip", "md")
CHUNK_CHARS, CHUNK_STEP = 1200, 1000


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query, with the SQL that gives the same rows if there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def files(spark: SparkSession, d: str) -> DataFrame:
    """The manifest: one row for each file, with its status and number of chunks. No text is read."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 10 + 1).cast("int"))
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ending)
    status = F.when(F.col("doc_id") % 7 == 5, "skipped").when(F.col("doc_id") % 7 == 6, "failed").otherwise("indexed")
    error = F.when(F.col("doc_id") % 7 == 5, F.concat(F.lit("needs "), ending)).when(F.col("doc_id") % 7 == 6, "parse error")
    return docs.select(
        F.col("doc_id").cast("string").alias("file_id"),
        name.alias("name"),
        F.concat("lang", F.lit("/"), name).alias("path"),
        F.concat(F.lit("lab/"), "source").alias("root"),
        F.col("n_chars").alias("size"),
        F.date_format(F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(cast(doc_id % 240 as int), cast(doc_id % 24 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mod_time"),
        status.alias("status"),
        error.alias("error"),
        F.when(status == "indexed", F.ceil(F.col("n_chars") / CHUNK_STEP)).otherwise(0).cast("long").alias("n_chunks"),
        F.col("doc_id").alias("seq"),
    )


FILES = """
WITH files AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id,
    source || '_' || doc_id || '.' || (['txt','pdf','docx','xlsx','hwp','py','PNG','csv','zip','md'])[doc_id % 10 + 1] AS name,
    lang || '/' || source || '_' || doc_id || '.' || (['txt','pdf','docx','xlsx','hwp','py','PNG','csv','zip','md'])[doc_id % 10 + 1] AS path,
    'lab/' || source AS root, n_chars AS size,
    strftime(TIMESTAMP '2026-01-01 00:00:00' + to_days(CAST(doc_id % 240 AS INTEGER)) + to_hours(CAST(doc_id % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS mod_time,
    CASE doc_id % 7 WHEN 5 THEN 'skipped' WHEN 6 THEN 'failed' ELSE 'indexed' END AS status,
    CASE doc_id % 7 WHEN 5 THEN 'needs ' || (['txt','pdf','docx','xlsx','hwp','py','PNG','csv','zip','md'])[doc_id % 10 + 1] WHEN 6 THEN 'parse error' END AS error,
    CASE WHEN doc_id % 7 IN (5, 6) THEN 0 ELSE CAST(ceil(n_chars / 1000.0) AS BIGINT) END AS n_chunks,
    doc_id AS seq
  FROM documents)
"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of 1,200 characters that begin every 1,000: ``file_id, idx, text, root, mod_time``."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "n_chars").where(F.col("n_chars") > 0)
    at = docs.withColumn("idx", F.explode(F.sequence(F.lit(0), ((F.col("n_chars") - 1) / CHUNK_STEP).cast("int"))))
    return at.select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.col("idx").cast("long").alias("idx"),
        F.substring("text", F.col("idx") * CHUNK_STEP + 1, F.lit(CHUNK_CHARS)).alias("text"),
        F.concat(F.lit("lab/"), "source").alias("root"),
        F.col("doc_id").alias("seq"),
    )


CHUNKS = """
WITH chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, i AS idx, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS text, 'lab/' || source AS root, doc_id AS seq
  FROM (SELECT *, unnest(range(0, CAST((n_chars - 1) // 1000 + 1 AS BIGINT))) AS i FROM documents WHERE n_chars > 0))
"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages: ``channel_id, channel_name, thread_ts, ts, user_name, text, idx``; a conversation is a thread."""
    c = table(spark, d, "conversations")
    channel = (F.col("conv_id") % 7).cast("string")
    return c.select(
        F.concat(F.lit("C0CHANNEL"), channel).alias("channel_id"),
        F.concat(F.lit("team-"), channel).alias("channel_name"),
        F.concat((F.col("conv_id") + 1785000000).cast("string"), F.lit(".000100")).alias("thread_ts"),
        F.concat((F.col("conv_id") + 1785000000 + F.col("turn") * 60).cast("string"), F.lit(".000100")).alias("ts"),
        F.col("role").alias("user_name"),
        "text",
        F.col("turn").alias("idx"),
        "conv_id",
    )


MESSAGES = """
WITH messages AS (
  SELECT 'C0CHANNEL' || (conv_id % 7) AS channel_id, 'team-' || (conv_id % 7) AS channel_name,
    CAST(conv_id + 1785000000 AS VARCHAR) || '.000100' AS thread_ts,
    CAST(conv_id + 1785000000 + turn * 60 AS VARCHAR) || '.000100' AS ts, role AS user_name, text, turn AS idx, conv_id
  FROM conversations)
"""


def rows(spark: SparkSession, ddl: str, *values: tuple) -> DataFrame:
    """A small table of cases."""
    return spark.createDataFrame(list(values), ddl)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
