"""Every query with SQL gives the same rows in DuckDB; every other one runs with a stable schema."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()
LLM = {n for n in QUERIES if n.startswith("op") and n[2].isdigit() or n == "pipeline"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def _planted():
    """Queries, an operator that each calls, and a wrong one in its place."""
    from pyspark.sql import functions as F

    from quern.functions import intent
    from quern.operators import catalog, chunking, fusion, manifest, tabular

    first = lambda best, points, query, n: catalog.vector.scored(points.join(best, "file_id"), query).where(F.col("idx") < n).select("idx", "score", *best.columns)
    sections, profile, audit, counts = chunking.line_blocks, tabular.numeric_profile, manifest.audit, manifest.run_counts
    return [
        ("lexical_candidates", catalog, "nearest_of_files", first),
        ("synopsis_candidates", catalog, "nearest_of_files", first),
        ("hybrid_retrieve", catalog, "nearest_of_files", first),
        ("hybrid_retrieve_chat", fusion, "balance_sources", lambda hits, k: hits.where(F.col("rank") <= k)),
        ("running_section", chunking, "line_blocks", lambda f: sections(f).withColumn("section", F.when(F.col("section") != "Methods", F.col("section")))),
        ("numeric_profile", tabular, "numeric_profile", lambda f: profile(f).withColumn("is_table", F.lit(False))),
        ("audit_documents", manifest, "audit", lambda f: audit(f).where(F.col("rule") != "credential")),
        ("run_counts", manifest, "run_counts", lambda f: counts(f.drop("change"))),
        ("route_generated", intent, "task", lambda q: F.lit("content")),
        ("location_order", fusion, "order_locations", lambda f, **how: f.limit(5)),
        ("locate", fusion, "trim_weak", lambda f: f.orderBy("file_id").limit(5)),
    ]


@pytest.mark.parametrize("name, module, attribute, wrong", _planted(), ids=lambda x: x if isinstance(x, str) else "")
def test_sql_notices_errors(spark, data, duck, monkeypatch, name, module, attribute, wrong):
    monkeypatch.setattr(module, attribute, wrong)
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) != sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LLM))
def test_runs(spark, data, name):
    first, second = QUERIES[name](spark, data), QUERIES[name](spark, data)
    assert first.schema == second.schema
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_imports_without_llm():
    """The rest of the library doesn't import the package that may be missing."""
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "quern")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"quern\.llm|from quern import llm", open(os.path.join(folder, n)).read()), n
