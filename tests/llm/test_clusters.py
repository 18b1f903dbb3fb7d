"""Centroid clustering against brute force in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quern.llm import centroids
from quern.session import table


def brute(rows, k=8, rounds=10, dim=64, seed=3):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(middle)) for _, v in kept]
        if step < rounds:
            for j in range(len(middle)):
                if mine := [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]:
                    middle[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sums = [sum(d for d, c in at if c == j) for j in range(len(middle))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    top = lambda x: min(x, 2**63 - 1)
    return [(i, c, top(d), top(sums[c]), top(sum(sums)), names[c]) for (i, _), (d, c) in zip(kept, at, strict=True)]


def order(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_embeddings(spark, data):
    vectors = table(spark, data, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    got = centroids.cluster_table(vectors)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert order(got.collect()) == order(brute(rows))


@pytest.mark.parametrize("big", [False, True])
def test_edges(spark, big):
    """Nulls, other lengths, non-finite and huge numbers, repeated rows, equal and null ids, many ties, clashing names."""
    r = random.Random(4)
    rows = [(i, [r.choice((-1.0, 0.0, 0.5, 2.25)) for _ in range(3)]) for i in range(60)]
    rows += [(5, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0]), (70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 2.0]), (74, [1.0, float("nan"), 2.0]), (75, [float("inf"), 0.0, 0.0]), (None, None)]
    rows += [(80 + i, [0.25, 0.25, 0.25]) for i in range(40)]
    if big:
        rows += [(200, [1e300, -1e300, 3.5]), (201, [1.5e308, 1.0, 1.0]), (202, [123456789012.625, -7.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    got = centroids.cluster_table(df, dim=3)
    assert order(got.collect()) == order(brute(rows, dim=3))


def test_few_and_none(spark):
    ddl = "vec_id long, embedding array<float>, kind int"
    few = [(3, [1.5, 2.5], 0), (1, [0.5, 0.5], 0)]
    got = centroids.cluster_table(spark.createDataFrame(few, ddl), dim=2)
    assert order(got.collect()) == order(brute([(i, v) for i, v, _ in few], dim=2))
    for none in ([], [(1, [1.0], 0), (2, None, 0)]):
        empty = centroids.cluster_table(spark.createDataFrame(none, ddl), dim=2)
        assert empty.columns == got.columns and empty.count() == 0


def test_scan_stops_strictly_beyond():
    """A centroid at exactly twice the distance ties and has the smaller number; the scan must still reach it."""
    middle = centroids.centroid_array([[0, 0], [4, 0], [100, 0]])
    nearest, least = centroids.assign(np.array([[2, 0], [3, 0], [60, 1]]), np.array([1, 2, 0]), middle)
    assert nearest.tolist() == [0, 1, 2] and least.tolist() == [4, 1, 1601]


def test_assign_equals_all_distances():
    r = np.random.default_rng(7)
    for n, k, dim in ((500, 17, 3), (200, 40, 9), (300, 1, 2)):
        x, c, before = r.integers(-6, 6, (n, dim)), r.integers(-6, 6, (k, dim)), r.integers(0, k, n)
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        nearest, least = centroids.assign(x, before, c)
        assert (nearest == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
