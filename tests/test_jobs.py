"""The jobs: growing input, replays, planted secrets, odd rows, and a command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import chat_sync, common, corpus_chunks
from quern.operators import chat as retrieval
from quern.operators import providers

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RAW = "channel string, name string, thread string, ts string, who string, body string"
COLUMNS = {"channel_id": "channel", "channel_name": "name", "thread_ts": "thread", "ts": "ts", "user_name": "who", "text": "body"}
DAY = 86_400


@pytest.fixture
def chat():
    return common.settings(chat_sync.DEFAULT, schema=RAW, columns=COLUMNS, excerpt=30)


def message(thread, at, who, body, channel="C0CHANNEL1"):
    return (channel, "team-1", f"{1785000000 + thread}.000100", f"{1785000000 + at}.000100", who, body)


FIRST = [
    message(0, 0, "ann", "first"), message(0, 60, "ben", "password: hunter2 here"), message(0, 90, "ben", "joined the channel"), message(0, 95, "ann", "  "),
    message(DAY, DAY, "ann", "next day"), message(0, 0, "eve", "elsewhere", "C0CHANNEL2"), (None, "n", "1785000000.0001", "1785000000.0001", "x", "no channel"),
    ("C0CHANNEL1", "n", "no time", "1785000000.0001", "x", "bad"), message(0, 70, None, None), message(0, 9, None, "nobody"),
]
SECOND = [
    message(0, 5 * DAY, "cat", "a late reply"), message(0, 60, "ben", "edited"), message(0, 0, "ann", "first"), message(9 * DAY, 9 * DAY, "dan", "a new thread"),
    message(9 * DAY, 9 * DAY, "dan", "a new thread"),
]


def put(spark, rows, path, n):
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{path}/export-{n}")


def state(spark, out, name="threads"):
    df = chat_sync.table(spark, out, name)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_sync_of_growing_input(spark, tmp_path, chat):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    put(spark, FIRST, src, 1)
    assert [x["read"] for x in chat_sync.sync(spark, f"{src}/*", out, mark, chat)] == [len(FIRST)]
    rows = {(r.channel_id, r.thread_ts): r for r in chat_sync.table(spark, out, "threads").collect()}
    assert len(rows) == 3
    one = rows["C0CHANNEL1", "1785000000.000100"]
    assert (one.n_messages, one.n_users, one.opening, one.latest, one.link) == (3, 2, "first", "password: [REDACTED] here", "https://slack.com/archives/C0CHANNEL1/p1785000000000100")
    before = state(spark, out), state(spark, out, "messages")
    assert chat_sync.sync(spark, f"{src}/*", out, mark, chat) == []
    assert (state(spark, out), state(spark, out, "messages")) == before

    put(spark, SECOND, src, 2)
    (done,) = chat_sync.sync(spark, f"{src}/*", out, mark, chat)
    assert (done["read"], done["unusable"], done["partitions"]) == (len(SECOND), 0, 2)
    rows = {(r.channel_id, r.thread_ts): r for r in chat_sync.table(spark, out, "threads").collect()}
    assert len(rows) == 4
    late = rows["C0CHANNEL1", "1785000000.000100"]
    assert (late.n_messages, late.n_users, late.latest, late.day) == (4, 3, "a late reply", one.day)
    assert late.n_chars == len("first") + len("edited") + len("nobody") + len("a late reply")
    assert rows["C0CHANNEL1", str(1785000000 + 9 * DAY) + ".000100"].n_messages == 1

    cut = {(r.channel_id, r.thread_ts, r.idx): r for r in chat_sync.table(spark, out, "pieces").collect()}
    assert len(cut) == 4 and cut["C0CHANNEL1", late.thread_ts, 0].text == "채널: #team-1\n스레드 시작: first\nann: first\n: nobody\nben: edited\ncat: a late reply"
    assert cut["C0CHANNEL1", late.thread_ts, 0].day == late.day and cut["C0CHANNEL1", late.thread_ts, 0].link == late.link

    # all at once gives the same threads
    whole = str(tmp_path / "whole")
    for n, part in enumerate((FIRST, SECOND), 1):
        put(spark, part, str(tmp_path / "src2"), n)
        chat_sync.sync(spark, str(tmp_path / "src2" / "*"), whole, whole + "-mark", chat | {"files_per_batch": 1})
    assert state(spark, whole) == state(spark, out) and state(spark, whole, "pieces") == state(spark, out, "pieces")
    # the pieces, embedded, are what chat retrieval searches
    store = str(tmp_path / "store")
    chat_sync.sync(spark, f"{src}/*", store, store + "-mark", chat | {"embed": True})
    query = providers.hashed_embedding(["late reply"])[0]
    assert retrieval.dense(retrieval.Chat(chat_sync.table(spark, store, "pieces")), query, 1).first().thread_ts == late.thread_ts


def test_sync_batch_again(spark, tmp_path, chat):
    """A batch that failed half-way runs again with its number: nothing doubles, other batches stay."""
    out = str(tmp_path / "out")
    for name, schema in chat_sync.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}")
    raw = [common.mapped(spark.createDataFrame(rows, RAW), COLUMNS) for rows in (FIRST, SECOND)]
    chat_sync.load(raw[0], 0, out, 30)
    chat_sync.saved(chat_sync.shown(raw[1]).withColumn("batch", F.lit(1).cast("long")), f"{out}/messages", ["channel_id", "day", "batch"])  # and then it stopped
    chat_sync.load(raw[1], 1, out, 30)
    want = state(spark, out), state(spark, out, "messages")
    for number in (1, 1):
        chat_sync.load(raw[number], number, out, 30)
        assert (state(spark, out), state(spark, out, "messages")) == want


def test_sync_of_nothing(spark, tmp_path, chat):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    os.makedirs(src)
    assert chat_sync.sync(spark, src, out, str(tmp_path / "mark"), chat) == []
    assert chat_sync.table(spark, out, "threads").count() == 0


def test_sync_reads_touched_partitions_only(spark, tmp_path, chat):
    out = str(tmp_path / "out")
    spark.createDataFrame([], chat_sync.MESSAGES).write.parquet(f"{out}/messages")
    chat_sync.load(common.mapped(spark.createDataFrame(FIRST, RAW), COLUMNS), 0, out, 30)
    kept = chat_sync.table(spark, out, "messages")
    touched = kept.where(F.col("batch") == 0).select("channel_id", "day").distinct()
    plan = kept.join(F.broadcast(touched), ["channel_id", "day"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def texts():
    long = "".join(f"line {i} ü😀\n" for i in range(3000))
    return [
        ("a", "r1", "en", "x" * 999 + "y" * 500), ("b", "r1", "en", "password: hunter2 " + "z" * 80 + "\nhost 192.168.0.12\napi_key = \"k-123-secret-value\""), ("c", "r2", "de", None), ("d", "r2", "de", ""),
        ("e", None, None, "w " * 600), ("f", "r2", "fr", long), ("g", "r2", "fr", "short"), ("a", "r1", "en", "x" * 999 + "y" * 500), (None, "r3", "en", "n" * 70),
    ]


def test_corpus_chunks(spark, tmp_path):
    columns = {"file_id": "f", "root": "r", "lang": "l", "text": "t"}
    how = common.settings(corpus_chunks.DEFAULT, columns=columns)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame(texts(), "f string, r string, l string, t string").repartition(3).write.parquet(src)
    done = corpus_chunks.build(spark, src, out, how)
    rows = corpus_chunks.table(spark, out, "chunks").collect()
    assert done["read"] == len(texts()) and done["chunks"] == len(rows)
    want = []
    for f, r, lang, t in texts():
        t = (t or "").replace("hunter2", "[REDACTED]")
        want += [(f, i // 1000, r, lang, t[i : i + 1200]) for i in range(0, len(t), 1000) if len(t[i : i + 1200].strip(" ")) >= 60]
    assert sorted(map(str, want)) == sorted(str((x.file_id, x.idx, x.root, x.lang, x.text)) for x in rows)
    assert all(x.n_chars == len(x.text) for x in rows) and len({x.chunk_id for x in rows if x.file_id == "f"}) == sum(x.file_id == "f" for x in rows)
    found = {(x.file_id, x.line, x.rule, x.root) for x in corpus_chunks.table(spark, out, "findings").collect()}
    assert found == {("b", 2, "private_address", "r1"), ("b", 3, "credential", "r1")}
    report = {(x.root, x.lang): x for x in corpus_chunks.table(spark, out, "report").collect()}
    assert (report["r1", "en"].n_files, report["r1", "en"].n_masked, report["r1", "en"].n_findings) == (3, 1, 2)
    assert (report["r2", "de"].n_files, report["r2", "de"].n_empty, report["r2", "de"].n_chars, report["r2", "fr"].n_empty) == (2, 2, 0, 1)
    assert report[None, None].n_files == 1

    # a second run over other texts leaves nothing of the first
    spark.createDataFrame(texts()[2:6], "f string, r string, l string, t string").write.mode("overwrite").parquet(src)
    for _ in range(2):
        done = corpus_chunks.build(spark, src, out, how)
        assert (done["read"], done["findings"], done["report"]) == (4, 0, 3)
        assert {x.root for x in corpus_chunks.table(spark, out, "chunks").select("root").distinct().collect()} == {None, "r2"}
    with pytest.raises(ValueError):
        corpus_chunks.chunks(spark.createDataFrame(texts(), "file_id string, root string, lang string, text string"), 500, 600, 1)


def test_command_line(spark, tmp_path, chat):
    put(spark, FIRST, str(tmp_path / "src"), 1)
    config = tmp_path / "my.json"
    config.write_text(json.dumps(chat))
    args = ["--config", str(config), "--source", str(tmp_path / "src" / "*"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    got = subprocess.run([sys.executable, "-m", "jobs.chat_sync", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert f"batches=1 read={len(FIRST)} written=5" in got.stderr
    assert chat_sync.table(spark, str(tmp_path / "out"), "threads").count() == 3
    with pytest.raises(ValueError):
        common.settings(chat_sync.DEFAULT, no_such=1)
