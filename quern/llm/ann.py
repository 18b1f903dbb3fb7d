"""Nearest neighbours by collision counting over query-centred windows.

A part of the vectors keeps ``PROJECTIONS`` sorted arrays, one for each random direction. A query opens a window around
its own value in each array; a vector collides where it lies in the window. The windows widen round by round (virtual
rehashing: a radius ``R`` stands for a half width of ``WIDTH / 2 * R``), and only what a round adds is counted. A vector
with ``NEEDED`` collisions is verified: its distance is computed from the original numbers in double precision. The search
ends when the k-th verified distance is within the radius, or when the windows hold the whole part; no number of
candidates ends it before.

At distance ``R`` a direction collides with probability 0.82 and 47 of 64 are needed, so a neighbour at the very edge of
the final radius is missed about once in thirty and hardly ever further in. All vectors are indexed.
Parts hold ``PART_ROWS`` vectors; every query visits every part, and the best of all parts are merged per query. The work is
thus queries times rows, as it is for any method where windows of most directions hold a fixed share of the vectors.

Defined cases: vectors that are null, zero or hold null or non-finite numbers take no part, as queries neither; only
vectors of a query's length are its candidates; rows with the query's id are not. Numbers are searched and measured as
doubles; a distance beyond their range is infinite and comes last. Repeated ids count as rows of their own on the
candidates' side, a repeated query is asked once, with the first of its vectors in order. Ties go to the smaller id. An empty
table gives an empty result. Other columns take no part, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import arrow_schema
from quern.session import prepared

PROJECTIONS, WIDTH, NEEDED, GROW = 64, 2.719, 47, 1.1
PART_ROWS = 16_384
SEED = 2024


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(PROJECTIONS, dim))


class Part:
    """The sorted arrays of one part of the vectors, all of one length.

    The arrays lie one after another in ``keys``, each shifted by its number times ``step``, so that one binary search
    places a window in all of them.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        with np.errstate(over="ignore"):
            self.squares = (self.vectors**2).sum(axis=1)
        self.axes = directions(vectors.shape[1])
        # projections of numbers near the end of the range would overflow; a power of two scales them without loss
        largest = float(np.abs(self.vectors).max())
        self.scale = 2.0**-512 if largest > 1e150 else 1.0
        values = self.axes @ (self.vectors * self.scale).T
        rows = np.argsort(values, axis=1, kind="stable")
        n, self.most = len(ids), float(np.abs(values).max()) + 1
        self.shift = np.arange(PROJECTIONS) * 4 * self.most
        self.rows = rows.astype(np.int32).ravel()
        self.keys = (np.take_along_axis(values, rows, axis=1) + self.shift[:, None]).ravel()
        self.begin = np.arange(PROJECTIONS) * n
        self.radius = 0.0

    def window(self, center: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of all arrays begin and end."""
        low, high = np.maximum(center - half, -self.most), np.minimum(center + half, self.most)
        return np.searchsorted(self.keys, low + self.shift, "left"), np.searchsorted(self.keys, high + self.shift, "right")

    def nearest(self, own: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest found, as (distance, id), nearest first.

        The first radius is one step below that of the part's last query; the first query begins where its windows hold
        about a fiftieth of the vectors.
        """
        n = len(self.ids)
        query = query.astype(np.float64)
        center = np.clip(self.axes @ (query * self.scale), -self.most + 1e-9, self.most - 1e-9)
        seen = self.ids == own
        left = n - int(seen.sum())
        radius = self.radius / GROW
        if radius <= 0:
            at = np.searchsorted(self.keys, center + self.shift)
            reach = np.clip(at + max(k, n // 100), self.begin, self.begin + n - 1)
            radius = max(float(np.median(np.abs(self.keys[reach] - self.shift - center))) * 2 / WIDTH, 1e-9)
        low = high = None
        count = np.zeros(n, np.int64)
        best: list[tuple[float, int]] = []
        while left:
            a, b = self.window(center, WIDTH / 2 * radius)
            spans = list(zip(a, b, strict=True)) if low is None else [*zip(a, low, strict=True), *zip(high, b, strict=True)]
            count += np.bincount(np.concatenate([self.rows[x:y] for x, y in spans]), minlength=n)
            low, high = a, b
            new = np.flatnonzero((count >= NEEDED) & ~seen)
            if len(new):
                seen[new] = True
                left -= len(new)
                best = self.verified(new, query, best, k)
            if len(best) == k and best[-1][0] * self.scale <= radius:
                break
            if a[0] == self.begin[0] and (b - a == n).all():
                rest = np.flatnonzero(~seen)
                return self.verified(rest, query, best, k)
            radius *= GROW
        self.radius = radius
        return best

    def verified(self, rows: np.ndarray, query: np.ndarray, best: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
        """The best so far with these rows. A matrix product bounds the distances; those that can count are computed exactly."""
        if not len(rows):
            return best
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.squares[rows] - 2 * (self.vectors[rows] @ query) + float(query @ query)
            if len(rows) > k and np.isfinite(rough).all():
                limit = np.partition(rough, k - 1)[k - 1]
                # what rounding can do to a rough value grows with the squares that it is the difference of
                rows = rows[rough <= limit + 1e-9 * (float(self.squares[rows].max()) + float(query @ query))]
            gap = self.vectors[rows] - query
            dist = np.sqrt((gap * gap).sum(axis=1))
        return sorted([*best, *zip(dist.tolist(), self.ids[rows].tolist(), strict=True)])[:k]


def usable(vector: Column) -> Column:
    """Not null, not zero, and all numbers finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` of its id holds."""
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("vector")).where(usable(v) & F.col(f"`{id_col}`").isNotNull())
    n = vectors.count()
    parts = max(1, -(-n // PART_ROWS))
    index = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "vector")
    asked = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "vector")
    dealt = index.unionByName(asked).repartitionByRange(parts, "part").sortWithinPartitions("part", "kind", "id")
    ddl = "query_id long, vec_id long, score double"
    kinds = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        here, kept, built = -1, [], None
        for batch in batches:
            part, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                if part[i] != here:
                    here, kept, built = part[i], [], None
                x = flat[starts[i] : starts[i + 1]]
                if kind[i] == 0:
                    kept.append((ids[i], x.copy()))
                    continue
                if built is None:
                    by_dim: dict[int, list] = {}
                    for item in kept:
                        by_dim.setdefault(len(item[1]), []).append(item)
                    built = {d: Part(np.array([a for a, _ in items], np.int64), np.stack([b for _, b in items])) for d, items in by_dim.items()}
                    kept = []
                found = built[len(x)].nearest(int(ids[i]), x, k) if len(x) in built else []
                out[0].extend([int(ids[i])] * len(found))
                out[1].extend(b for _, b in found)
                out[2].extend(a for a, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)

    prepared(vectors.sparkSession)
    found = dealt.mapInArrow(run, ddl)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
