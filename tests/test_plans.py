"""Plans that must hold at scale: pruned columns, pushed filters, top-k nodes, limits per group, no Python where none is needed."""

import re

from pyspark.sql import functions as F

from quern.plans import registry

registry.load()
Q = registry.QUERIES


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_metadata_queries_read_no_text(spark, data):
    for name in ("status_summary", "files_in_root", "listing_rollup", "lexical_score", "changed_files"):
        assert "text:string" not in plan(Q[name](spark, data)), name


def test_dense_topk(spark, data):
    p = plan(Q["dense_topk"](spark, data))
    assert "TakeOrderedAndProject" in p and "Python" not in p


def test_filters_reach_the_scan(spark, data):
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan(Q["dense_filtered"](spark, data)))[1]
    assert "In(label, [2,3,5])" in pushed.replace(", ", ",").replace("In(label,[", "In(label, [")


def test_candidates_are_ranked_per_file_before_the_shuffle(spark, data):
    for name in ("lexical_candidates", "synopsis_candidates"):
        p = plan(Q[name](spark, data))
        assert "WindowGroupLimit" in p and "BroadcastHashJoin" in p and "CartesianProduct" not in p, name


def test_group_limits(spark, data):
    assert "WindowGroupLimit" in plan(Q["dense_grouped"](spark, data))


def test_no_python_outside_parsers_and_providers(spark, data):
    runs = ("event_stream", "chat_stream", "job1_chat_sync", "job2_corpus_chunks")
    plans = {n: plan(Q[n](spark, data)) for n in Q if n not in runs}
    python = {n for n, p in plans.items() if any(x in p for x in ("MapInPandas", "ArrowEvalPython", "MapInArrow"))}
    assert python == {"html_blocks", "chunk_recursive", "chunk_index", "file_synopses", "normalize_nfkc", "thread_chunks", "late_chunks"}


def test_keep_or_all_has_no_single_partition_window(spark):
    from quern.operators.fusion import keep_or_all

    df = spark.range(100).withColumn("x", F.col("id") % 3)
    assert "Window" not in plan(keep_or_all(df, F.col("x") == 5))
    assert keep_or_all(df, F.col("x") == 5).count() == 100 and keep_or_all(df, F.col("x") == 1).count() == 33
