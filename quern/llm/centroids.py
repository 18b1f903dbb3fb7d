"""Centroid clustering by sort-means, in exact integer arithmetic.

Every component becomes the integer ``floor(SCALE * x)``. Each round orders, for every centroid, all others by their distance
from it. A vector is compared with the centroid it was assigned to, and then with the others in that centroid's order, until
one lies strictly beyond twice the vector's distance to it: by the triangle inequality that one, and all after it, are
further away than the centroid it has (one at exactly twice the distance may tie, so it is still compared).

A round is one pass over the vectors, which are written with their assignment for the next round, so no task keeps state. A
task also writes the sums and counts of its own vectors, a row for each centroid; these are added up in ``MERGES`` tasks
at most, and the driver gets ``MERGES`` rows for each centroid. Vectors aren't shuffled and clusters aren't gathered, so a
cluster, or one vector, may have most of the rows. Centroids go to the tasks in the closure: ``k`` times ``dim`` numbers.

Defined cases: only vectors of exactly ``dim`` components take part, none of them null or non-finite; a null id is an id like
others, but such rows are the last to be chosen as starts; repeated ids are rows of their own, and of equal ids the smaller
vector is chosen first; fewer than ``k`` vectors give as many centroids, none an empty result. Vectors with numbers beyond
``plain(dim)`` are computed with integers of any size, and a distance or sum of distances beyond a long is returned as the
largest long. Other columns take no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import arrow_schema
from quern.scratch import dropped, written
from quern.session import prepared

SCALE, ROUNDS, K, DIM, SEED = 1024, 10, 8, 64, 3
#: Tasks that add up the sums of all others, at most.
MERGES = 32
MOST = 2**63 - 1


def plain(dim: int) -> int:
    """The integers up to which four times a squared distance of ``dim`` components fits a long."""
    return math.isqrt(2**62 // (16 * max(dim, 1)))


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: longs if all are within ``plain``, else Python integers. ``scale`` is a power of two, so products
    are exact unless they leave the range of doubles."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * scale)
    if np.abs(whole).max(initial=0) <= plain(values.shape[-1]):
        return whole.astype(np.int64)
    # beyond 2 ** 53 doubles are integers themselves
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def centroid_array(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) > plain(len(c)) for c in centroids for x in c)
    return np.array(centroids, dtype=object if wide else np.int64)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Squared distances between centroids, and for each centroid the others, nearest first."""
    gap = centroids[:, None, :] - centroids[None, :, :]
    between = (gap * gap).sum(axis=2)
    rows = between.tolist()
    return between, [sorted((j for j in range(len(rows)) if j != i), key=lambda j, i=i: (rows[i][j], j)) for i in range(len(rows))]


def assign(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, ordered=None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance, ties to the smaller number. ``before``: where each was."""
    if vectors.dtype != centroids.dtype:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
        ordered = None
    between, after = ordered or orders(centroids)
    nearest, least = before.copy(), np.zeros(len(vectors), vectors.dtype)
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        gap = vectors[rows] - centroids[c]
        own = (gap * gap).sum(axis=1)
        best, at = own.copy(), np.full(len(rows), c)
        left = np.arange(len(rows))
        for j in after[c]:
            left = left[~(between[c][j] > 4 * own[left]).astype(bool)]
            if not len(left):
                break
            gap = vectors[rows[left]] - centroids[j]
            far = (gap * gap).sum(axis=1)
            closer = ((far < best[left]) | ((far == best[left]) & (j < at[left]))).astype(bool)
            best[left[closer]], at[left[closer]] = far[closer], j
        nearest[rows], least[rows] = at, best
    return nearest, least


def _numbers(column) -> np.ndarray:
    """A batch's vectors as doubles; all have the same length and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _round(points: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """One pass: every vector with its nearest centroid and distance (``kind`` 0), and each task's sums (``kind`` 1)."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    ddl = f"id {kinds['id']}, vector {kinds['vector']}, cluster int, distance long, n long, sums array<string>, kind int"
    schema = arrow_schema(ddl)
    k = len(centroids)

    def run(batches):
        import pyarrow as pa

        ours = centroid_array(centroids)
        ordered = orders(ours)
        counts, sums = [0] * k, [None] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = integers(_numbers(batch.column(1)), scale)
            nearest, least = assign(vectors, batch.column(2).to_numpy(zero_copy_only=False), ours, ordered)
            for c in np.unique(nearest).tolist():
                mine = vectors[nearest == c]
                total = [int(x) for x in mine.sum(axis=0)]
                counts[c] += len(mine)
                sums[c] = total if sums[c] is None else [a + b for a, b in zip(sums[c], total, strict=True)]
            n, far = batch.num_rows, [min(int(x), MOST) for x in least]
            cells = [batch.column(0), batch.column(1), nearest.astype(np.int32), far, [None] * n, [None] * n, [0] * n]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)
        full = [c for c in range(k) if counts[c]]
        none = [None] * len(full)
        cells = [none, none, full, none, [counts[c] for c in full], [[str(x) for x in sums[c]] for c in full], [1] * len(full)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)

    prepared(points.sparkSession)
    return points.mapInArrow(run, ddl)


def _moved(partial: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the means; one without vectors stays. ``partial``: ``cluster, n, sums``."""
    k = len(centroids)

    def merge(batches):
        import pyarrow as pa

        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for c, n, sums in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                had = total.get(c)
                total[c] = (n, [int(x) for x in sums]) if had is None else (had[0] + n, [a + int(b) for a, b in zip(had[1], sums, strict=True)])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(total), pa.int32()), "n": pa.array([x[0] for x in total.values()], pa.int64()), "sums": pa.array([[str(y) for y in x[1]] for x in total.values()], pa.list_(pa.string()))})

    rows = partial.coalesce(MERGES).mapInArrow(merge, "cluster int, n long, sums array<string>").collect()  # MERGES rows of each centroid at most
    counts, sums = [0] * k, [[0] * len(c) for c in centroids]
    for r in rows:
        counts[r["cluster"]] += r["n"]
        sums[r["cluster"]] = [a + int(b) for a, b in zip(sums[r["cluster"]], r["sums"], strict=True)]
    return [[x // n for x in s] if n else c for c, s, n in zip(centroids, sums, counts, strict=True)]


def starts(points: DataFrame, k: int = K, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = points.select(key.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    return [integers(np.array([r["vector"]], np.float64), scale)[0].tolist() for r in first]


def clustered(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """``id, vector, cluster, distance`` of every usable vector after ``rounds`` rounds and a last assignment, and the centroids."""
    v = F.col(f"`{vector}`")
    points = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("vector")).where(usable(v, dim)).withColumn("cluster", F.lit(0))
    centroids = starts(points, k, seed, scale)
    empty = points.select("id", "vector", "cluster", F.lit(0).cast("long").alias("distance")).limit(0)
    if not centroids:
        return empty, []
    done = None
    for step in range(rounds + 1):
        before, done = done, written(_round(points, centroids, scale), "centroids", by=("kind",))
        if before is not None:
            dropped(before)
        points = done.where(F.col("kind") == 0).select("id", "vector", "cluster")
        if step < rounds:
            centroids = _moved(done.where(F.col("kind") == 1).select("cluster", "n", "sums"), centroids)
    return done.where(F.col("kind") == 0).select("id", "vector", "cluster", "distance"), centroids


def cluster_table(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every usable vector."""
    spark = vectors.sparkSession
    found, centroids = clustered(vectors, id_col=id_col, vector=vector, **how)
    own = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    names = spark.createDataFrame(own, "of int, centroid_sha256 string")
    # sums of longs as decimals: they may leave the range of a long
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in per.collect()}  # a row for each centroid
    inertia = spark.createDataFrame([(c, min(s, MOST)) for c, s in sums.items()], "at int, cluster_inertia long")
    facts = names.join(inertia, F.col("of") == F.col("at")).select("of", "centroid_sha256", "cluster_inertia")
    out = found.join(F.broadcast(facts), F.col("cluster") == F.col("of"))  # a row for each centroid
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), "centroid_sha256")
