"""Queries of dense search over ``embeddings``: a vector's label is its file and its root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import vector
from quern.plans.base import query
from quern.session import table


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("file_id"), (F.col("label") % 3).alias("root"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One row by its id; the filter reaches the scan."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SCORED = f"WITH hits AS (SELECT vec_id AS point_id, label AS file_id, label % 3 AS root, list_cosine_similarity(embedding::DOUBLE[], {Q}) AS score FROM embeddings)"


def file_points(spark: SparkSession, d: str) -> DataFrame:
    """Five vectors for each of the first files: ``point_id, file_id, idx, root, vector``."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.floor(F.col("vec_id") / 5).cast("string").alias("file_id"), (F.col("vec_id") % 5).alias("idx"), F.lit("").alias("root"), F.col("embedding").alias("vector"))


def synopses(spark: SparkSession, d: str) -> DataFrame:
    """A synopsis for each of these files, with the file's third vector: ``file_id, root, synopsis, vector``."""
    p = file_points(spark, d).where(F.col("idx") == 2)
    return p.select("file_id", "root", F.concat(F.lit("the erst of file "), "file_id").alias("synopsis"), "vector")


POINTS = """points AS (SELECT CAST(vec_id // 5 AS VARCHAR) AS file_id, CAST(vec_id % 5 AS BIGINT) AS idx, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings),
syn AS (SELECT file_id, score, 'the erst of file ' || file_id AS synopsis FROM points WHERE idx = 2)"""


@query("dense_topk", f"{SCORED} SELECT point_id, file_id, round(score, 4) AS score FROM hits ORDER BY hits.score DESC, point_id LIMIT 6")
def dense_topk(spark, d):
    hits = vector.search(points(spark, d), query_vector(spark, d), 6)
    return hits.select("point_id", "file_id", F.round("score", 4).alias("score"))


@query("dense_filtered", f"{SCORED} SELECT point_id, file_id, root, round(score, 4) AS score FROM hits WHERE root IN (0, 2) AND file_id IN (2, 3, 5) ORDER BY hits.score DESC, point_id LIMIT 50")
def dense_filtered(spark, d):
    hits = vector.search(points(spark, d), query_vector(spark, d), 50, roots=[0, 2], file_ids=[2, 3, 5])
    return hits.select("point_id", "file_id", "root", F.round("score", 4).alias("score"))


@query("dense_grouped", f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, point_id) AS k FROM hits),
best AS (SELECT file_id FROM ranked WHERE k = 1 ORDER BY score DESC, point_id LIMIT 5)
SELECT file_id, CAST(k AS INTEGER) AS rank_in_group, point_id, round(score, 4) AS score FROM ranked WHERE k <= 3 AND file_id IN (SELECT file_id FROM best)""")
def dense_grouped(spark, d):
    hits = vector.search_grouped(points(spark, d), query_vector(spark, d), groups=5, per_group=3)
    return hits.select("file_id", "rank_in_group", "point_id", F.round("score", 4).alias("score"))


@query("probe_max", f"""{SCORED}, a AS (SELECT score FROM hits WHERE file_id % 2 = 0 ORDER BY score DESC LIMIT 3), b AS (SELECT score FROM hits WHERE file_id % 2 = 1 ORDER BY score DESC LIMIT 3)
SELECT round(max(score), 4) AS probe_score, max(score) >= 0.5 AS relevant FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def probe_max(spark, d):
    """The best of three candidates from each of two stores, and whether it reaches the threshold of 0.5."""
    p, q = points(spark, d), query_vector(spark, d)
    both = vector.search(p.where(F.col("file_id") % 2 == 0), q, 3).unionByName(vector.search(p.where(F.col("file_id") % 2 == 1), q, 3))
    return both.agg(F.round(F.max("score"), 4).alias("probe_score"), (F.max("score") >= 0.5).alias("relevant"))


@query("vector_dim_check", "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS points, count(DISTINCT label) AS files FROM embeddings GROUP BY 1")
def vector_dim_check(spark, d):
    """The lengths of stored vectors: a collection must have one."""
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("points"), F.countDistinct("label").alias("files"))


@query("collection_stats", "SELECT label % 3 AS root, count(*) AS points, count(DISTINCT label) AS files FROM embeddings GROUP BY 1")
def collection_stats(spark, d):
    return table(spark, d, "embeddings").groupBy((F.col("label") % 3).alias("root")).agg(F.count(F.lit(1)).alias("points"), F.countDistinct("label").alias("files"))


@query("vector_norms", "SELECT label AS file_id, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS mean_norm FROM embeddings GROUP BY 1")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("file_id")).agg(F.round(F.avg(vector.norm(F.col("embedding"))), 4).alias("mean_norm"))
