"""Queries over tables with what only larger ones have: long ids, rare lines, many rows of a kind."""

import duckdb
import pytest

import __spark_entry__ as contract
from quern.operators import context, providers

QUERIES, SQL = contract.queries(), contract.oracle_sql()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def compared(spark, tmp_path):
    """The rows of a query over documents, compared with its SQL's."""

    def run(name, rows):
        at = str(tmp_path / "documents.parquet")
        spark.createDataFrame([(i, t, "de", source, len(t)) for i, t, source in rows], DOCUMENTS).repartition(5).write.mode("overwrite").parquet(at)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        return got

    return run


def test_ids_that_look_like_dates(compared):
    got = compared("period_filter", [(i, "x", "src1") for i in [*range(260590, 260640), *range(250100, 250140), *range(0, 240, 7)]])
    assert {"260620", "260630"} - {r[0] for r in got} and got


def test_lines_that_look_like_headings(compared):
    odd = ("Vi. La", "Vi. Lesèle oivile", "12.7.31.75 Keit in lich", "Conclusion", "제 3 장 Les", "12 Keit in", "31 Keit in", "results:", "# Ung", "II) An")
    got = compared("running_section", [(i, f"one\n{line}\ntwo", "src1") for i, line in enumerate(odd)] + [(50, "\n".join(odd), "src2")])
    assert {r[2] for r in got if r[0] in ("0", "2", "3")} == {3} and {r[2] for r in got if r[0] in ("5", "7")} == {4}


def many():
    return [(i, "x" * (i * 37 % 211), f"src{(3, 6, 8)[i % 3]}") for i in range(900)]


def test_all_live_items_count(compared):
    got = compared("location_full_outer", many())
    live = {str(i) for i, _, source in many() if source in ("src6", "src8") and i % 5 and i % 4}
    assert len(live) > 300 and live == {r[0] for r in got if r[5] != "indexed"}


@pytest.mark.parametrize("name", ["location_order", "location_recency"])
def test_order_of_all_live_items(compared, name):
    """The best items aren't among the first; ids such as 2026 are no years."""
    rows = [(i, "x", "src1") for i in range(1, 60)] + [(i, "x" * (i % 50), ("src6", "src8")[i % 2]) for i in range(1501, 2100)]
    got = {r[0] for r in compared(name, rows)}
    assert {"1679", "1919"} <= got if name == "location_recency" else any(int(i) > 1560 for i in got)


def test_token_vectors_on_demand():
    """Vectors of all bytes of a text aren't made for the few that are asked for, and equal running sums."""
    import tracemalloc

    import numpy as np

    data = np.random.default_rng(1).integers(0, 0x500, 3000)
    text = "".join(map(chr, data))
    raw = np.frombuffer(text.encode(), np.uint8)
    one = np.zeros((len(raw), providers.DIM), np.float32)
    one[np.arange(len(raw)), raw % providers.DIM] = np.where(raw & 0x80, -1, 1)
    (got,) = providers.running_tokens([text])
    assert len(got) == len(raw)
    for i in (0, 7, 7, 2000, 5, len(raw) - 1, -1):
        assert (got[i] == one.cumsum(axis=0)[i]).all()
    with pytest.raises(IndexError):
        got[len(raw)]
    tracemalloc.start()
    (long,) = providers.running_tokens(["x" * 2_000_000])
    assert long[1_999_999].sum() == 2_000_000 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_marks_that_overlap(monkeypatch):
    """A mark found more often than there are texts leaves each text to be tokenised alone; ids are any numbers."""
    monkeypatch.setitem(providers.PROVIDERS, "tokenize", lambda texts: [[100_000 + ord(c) for c in t] for t in texts])
    assert providers.token_counts(["b", "", "cc"], "aa") == [3, 2, 4] and providers.token_counts(["ba", "a"], "aa") == [4, 3]
    assert providers.token_counts([], "aa") == [] and providers.token_counts(["ab"], "") == [2]


def test_tasks_by_size(spark, monkeypatch):
    """Tasks that go through files become more with the texts, and files stay whole."""
    chunks = spark.range(4000).selectExpr("cast(id % 400 as string) file_id", "id idx", "repeat('가', 100) text", "if(id % 3 = 0, null, 's') section")
    few = context.by_file(chunks).rdd.getNumPartitions()
    monkeypatch.setattr(context, "TASK_BYTES", 20_000)
    dealt = context.by_file(chunks)
    assert few == 4 and dealt.rdd.getNumPartitions() == 60
    held = dealt.selectExpr("file_id", "spark_partition_id() p").distinct().collect()
    assert len(held) == 400 and max(sum(r.p == p for r in held) for p in range(60)) < 25
    assert context.by_file(chunks.limit(0)).rdd.getNumPartitions() == 4
    plan = context.context_material(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and "hashpartitioning(file_id#" in plan and ", 60)" in plan


def test_hints_miss_nothing(spark):
    """Texts without a hint are left alone, and those have nothing that the whole patterns match."""
    import random

    from pyspark.sql import functions as F

    from jobs import corpus_chunks
    from quern.functions import fixed
    from quern.functions import text as X
    from quern.operators import manifest

    r = random.Random(5)
    words = "비밀번호 비번 password PassWd pwd pass PW paß xoxb- XAPP- ghp_ GHR_ github_pat_ sk- client_secret ACCESS_TOKEN refresh_token api_key 10. 172.16 192.168. 192.168.1.1 10.1.2.3 172.31.0.9 is 은 는 : = a1b2c3d4e5f6a7b8c9 hunter2hunter2 , ; # \" . - _".split()
    texts = ["".join(r.choice(words) + r.choice(("", "", " ", "\n", "\t")) for _ in range(r.randint(1, 6))) for _ in range(6000)]
    t = spark.createDataFrame([(str(i), "r", x) for i, x in enumerate([*texts, "plain words", "compass was", None])], "file_id string, root string, text string")
    plain = F.regexp_replace(F.regexp_replace("text", fixed.CREDENTIAL, "$1$2[REDACTED]"), fixed.TOKEN_SHAPES, "[REDACTED]")
    both = t.select("text", X.redact(F.col("text")).alias("a"), plain.alias("b"), F.col("text").rlike(fixed.REDACT_HINT).alias("hint")).collect()
    assert all(x.a == x.b for x in both) and sum(x.a != x.text for x in both) > 1000
    assert [x.hint for x in both[-3:]] == [False, True, None]
    lines = t.select(F.struct("file_id", "root").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    want = sorted((x.path.file_id, x.line, x.rule) for x in manifest.audit(lines).collect())
    assert want == sorted((x.file_id, x.line, x.rule) for x in corpus_chunks.findings(t).collect()) and len({x[2] for x in want}) == 2
