"""The chunk table: one bucket for one file, folders that searches pass over, growth, runs that broke off."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from quern.operators import indexing, points, vector

SCHEMA = "point_id string, file_id string, idx long, root string, vector array<double>"
PROSE = "This file says something about the greenhouse and its plants. "


def rows(spark, *files):
    """``files``: id, root, number of chunks, mark."""
    return spark.createDataFrame([(f"{f}-{i}", f, i, root, [float(mark), float(i)]) for f, root, n, mark in files for i in range(n)], SCHEMA)


def names(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file_id string, root string")


def state(spark, at, **how):
    return sorted((r.file_id, r.idx, r.root, r.vector[0]) for r in points.read(spark, at, SCHEMA, **how).collect())


def stored_files(at):
    return {str(p.relative_to(at)): p.stat().st_mtime_ns for p in at.rglob("*.parquet")}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(points, "ROWS", 50)


def test_one_file_costs_one_bucket(spark, tmp_path, small):
    at = tmp_path / "t"
    files = [(f"f{k}", "lab/a b", 20, 1) for k in range(100)] + [("g", "", 3, 1), ("h", None, 2, 1)]
    points.replace(spark, str(at), rows(spark, *files), names(spark, ("none", "none")).limit(0), SCHEMA)
    want = {(f, i, root, 1.0) for f, root, n, _ in files for i in range(n)}
    assert set(state(spark, str(at))) == want and len({os.path.dirname(x) for x in stored_files(at)}) > 20
    before = stored_files(at)
    points.replace(spark, str(at), rows(spark, ("f7", "lab/a b", 200, 2)), names(spark, ("f7", "lab/a b")), SCHEMA)
    after = stored_files(at)
    changed = {os.path.dirname(x) for x in set(before) ^ set(after)}
    assert len(changed) == 1
    want = {w for w in want if w[0] != "f7"} | {("f7", i, "lab/a b", 2.0) for i in range(200)}
    assert set(state(spark, str(at))) == want and len(state(spark, str(at))) == len(want)
    # again: the same
    points.replace(spark, str(at), rows(spark, ("f7", "lab/a b", 200, 2)), names(spark, ("f7", "lab/a b")), SCHEMA)
    assert set(state(spark, str(at))) == want
    # a file that moves to another root, and one that goes
    points.replace(spark, str(at), rows(spark, ("f8", "lab/z", 5, 3)), names(spark, ("f8", "lab/a b"), ("g", ""), ("never there", "lab/q")), SCHEMA)
    want = {w for w in want if w[0] not in ("f8", "g")} | {("f8", i, "lab/z", 3.0) for i in range(5)}
    assert set(state(spark, str(at))) == want and not (at / "root_key=r.").exists() or not list((at / "root_key=r.").rglob("*.parquet"))
    points.remove_root(spark, str(at), "lab/a b")
    assert {x[0] for x in state(spark, str(at))} == {"f8", "h"}


def test_searches_read_their_folders(spark, tmp_path, small):
    at = str(tmp_path / "t")
    points.replace(spark, at, rows(spark, *[(f"f{k}", f"r{k % 4}", 30, k) for k in range(40)]), names(spark, ("x", "x")).limit(0), SCHEMA)
    some = points.read(spark, at, SCHEMA, roots=["r1", None])
    assert {r.root for r in some.select("root").distinct().collect()} == {"r1"} and all("root_key=r.r1" in f for f in _read(some))
    assert len({os.path.dirname(f) for f in _read(points.read(spark, at, SCHEMA, roots=["r2"], files=["f2"]))}) == 1
    assert state(spark, at, files=["f5", "f6"]) == state(spark, at, roots=["r1", "r2"], files=["f5", "f6"]) != []
    assert state(spark, at, roots=[]) == state(spark, at, files=[]) == []
    plan = vector.search(points.read(spark, at, SCHEMA, roots=["r3"]), [1.0, 2.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "root_key IN" in plan.split("PartitionFilters")[1] or "r.r3" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def _read(df):
    """The files that a plan's scan reads after pruning."""
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_roots_get_more_buckets(spark, tmp_path, small):
    at = str(tmp_path / "t")
    none = names(spark, ("x", "x")).limit(0)
    points.replace(spark, at, rows(spark, ("a", "r", 10, 1), ("b", "s", 10, 1)), none, SCHEMA)
    assert {(r.root_key, r.n) for r in points.buckets(spark, at).collect()} == {("r.r", 1), ("r.s", 1)}
    for k in range(3):
        points.replace(spark, at, rows(spark, *[(f"n{k}-{i}", "r", 10, 1) for i in range(12)]), none, SCHEMA)
    assert {(r.root_key, r.n) for r in points.buckets(spark, at).collect()} == {("r.r", 8), ("r.s", 1)}
    assert len(state(spark, at)) == 10 + 10 + 360
    # growing broke off before the old folder went: readers see the old one, and the next run repairs it
    shutil.copytree(f"{at}/root_key=r.s/n=1", f"{at}/root_key=r.s/n=4")
    assert len(state(spark, at)) == 380 and len(state(spark, at, roots=["s"])) == 10


def test_lost_buckets_are_found(spark, tmp_path):
    at = str(tmp_path / "index")
    listed = spark.createDataFrame([(i, f"{i}.txt", f"{i}.txt", "r", 9, "1") for i in "abc"], "file_id string, name string, path string, root string, size long, mod_time string")
    contents = spark.createDataFrame([(i, bytearray((PROSE * (20 + k)).encode())) for k, i in enumerate("abc")], "file_id string, content binary")
    indexing.run(spark, listed, contents, at)
    want = state_of(spark, at)
    assert points.incomplete(points.read(spark, f"{at}/points", indexing.POINTS), indexing.stored(spark, f"{at}/manifest", indexing.MANIFEST)).count() == 0
    shutil.rmtree(next((tmp_path / "index" / "points").glob("root_key=*/n=*/bucket=*")))
    r = indexing.run(spark, listed, contents, at).counts.first()
    assert r.indexed == 0 and state_of(spark, at) != want
    r = indexing.run(spark, listed, contents, at, verify=True).counts.first()
    assert r.indexed == 3 and state_of(spark, at) == want


def state_of(spark, at):
    return sorted((r.point_id, r.text) for r in points.read(spark, f"{at}/points", indexing.POINTS).collect())
