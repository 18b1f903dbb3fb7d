"""Exact vector search: cosine, filters, top-k, grouped top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def literal_vector(values: Sequence[float]) -> Column:
    """A query vector as one constant of the plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def scored(points: DataFrame, query: Sequence[float], vector: str = "vector") -> DataFrame:
    """``points`` with their cosine to the query as ``score``, without the vectors. The query's own norm is computed once."""
    length = sum(float(v) ** 2 for v in query) ** 0.5
    if length == 0:
        raise ValueError("a zero vector has no direction")
    q = literal_vector([float(v) / length for v in query])
    return points.withColumn("score", dot(F.col(vector), q) / norm(F.col(vector))).drop(vector)


def top_k(hits: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k rows of the highest score; planned as a top-k on every partition and one merge of k rows each."""
    return hits.orderBy(F.col("score").desc(), *[F.col(t) for t in ties]).limit(k)


def search(points: DataFrame, query: Sequence[float], k: int, roots: Sequence | None = None, file_ids: Sequence | None = None, ties: Sequence[str] = ("point_id",)) -> DataFrame:
    """Dense top-k; root and file filters are pushed to the scan, before any vector is read."""
    if roots:
        points = points.where(F.col("root").isin(list(roots)))
    if file_ids is not None:
        points = points.where(F.col("file_id").isin(list(file_ids)))
    return top_k(scored(points, query), k, *ties)


def search_grouped(points: DataFrame, query: Sequence[float], groups: int = 25, per_group: int = 3, group: str = "file_id", tie: str = "point_id") -> DataFrame:
    """The best ``per_group`` rows of the best ``groups`` groups, best score first.

    The window's rank filter becomes a limit per group before the shuffle; groups are then ranked by their best row.
    """
    hits = scored(points, query)
    within = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(tie))
    best = hits.withColumn("rank_in_group", F.row_number().over(within)).where(F.col("rank_in_group") <= per_group)
    heads = best.where(F.col("rank_in_group") == 1).orderBy(F.col("score").desc(), F.col(tie)).limit(groups).select(F.col(group).alias("__group"))
    return best.join(F.broadcast(heads), F.col(group) == F.col("__group"), "left_semi")  # groups rows at most
