import json
import os

import pytest
from pyspark.sql import functions as F

from quern.operators import manifest, threads
from quern.sources import chat as chat_source
from quern.sources.chat import SCHEMA, ChatPages, RateLimited, collect, read_jsonl, write_jsonl
from quern.sources.listing import FolderListing, large_folders
from quern.streaming import incremental


def test_listing(spark, tmp_path):
    for path in ("a/x.txt", "a/b/y.pdf", "c/z.md", "top.txt", "skip/n.txt"):
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_text("hello")
    spark.dataSource.register(FolderListing)
    read = lambda **o: {r.path for r in spark.read.format("folder_listing").options(roots=str(tmp_path), **o).load().collect()}
    whole = {"a/x.txt", "a/b/y.pdf", "c/z.md", "top.txt", "skip/n.txt"}
    assert read() == whole
    assert read(split="true") == whole
    assert read(exclude="skip", split="true") == whole - {"skip/n.txt"}
    assert read(depth="1") == {"top.txt"}
    with pytest.raises(Exception, match="No such file"):
        spark.read.format("folder_listing").options(roots=str(tmp_path / "gone")).load().count()
    assert spark.read.format("folder_listing").options(roots=str(tmp_path / "gone"), skip_errors="true").load().count() == 0


def test_chat(spark, tmp_path):
    page = {"messages": [{"ts": "10.1", "user": "u1", "text": "root", "reply_count": 1}, {"ts": "11.0", "user": "u9", "text": " "}]}
    replies = {"messages": [{"ts": "10.1", "text": "root"}, {"ts": "10.5", "thread_ts": "10.1", "user": "u2", "text": "reply"}]}
    os.makedirs(tmp_path / "C1" / "replies")
    (tmp_path / "C1" / "0.json").write_text(json.dumps(page))
    (tmp_path / "C1" / "replies" / "10.1.json").write_text(json.dumps(replies))
    spark.dataSource.register(ChatPages)
    users = spark.createDataFrame([("u1", "", "Real"), ("u2", "Disp", "R2")], "user_id string, display_name string, real_name string")
    got = collect(spark.read.format("chat_pages").load(str(tmp_path)), users)
    assert [(r.ts, r.thread_ts, r.user_name) for r in got.collect()] == [("10.1", "10.1", "Real"), ("10.5", "10.1", "Disp")]
    assert spark.read.format("chat_pages").option("oldest", "10.2").load(str(tmp_path)).count() == 1
    out = str(tmp_path / "out")
    write_jsonl(got, out)
    (tmp_path / "out" / "bad.json").write_text("{broken\n")
    assert read_jsonl(spark, out).count() == 2


def test_keyed_sink_and_stream(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int").coalesce(1).write.parquet(src)
    stream = incremental.read_stream(spark, src, "k int, v string, n int", 1)
    incremental.run_available(stream, str(tmp_path / "cp"), incremental.keyed_sink(spark, table, ["k"], "n"))
    spark.createDataFrame([(2, "c", 2), (2, "old", 0), (3, "d", 1)], "k int, v string, n int").coalesce(1).write.mode("append").parquet(src)
    stream = incremental.read_stream(spark, src, "k int, v string, n int", 1)
    incremental.run_available(stream, str(tmp_path / "cp"), incremental.keyed_sink(spark, table, ["k"], "n"))
    assert sorted((r.k, r.v) for r in manifest.read_keyed(spark, table).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    again = spark.createDataFrame([(2, "c", 2)], "k int, v string, n int")
    manifest.save_keyed(spark, table, again, ["k"], F.col("n"))
    assert sorted((r.k, r.v) for r in manifest.read_keyed(spark, table).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_windows_equal_batch(spark, data, tmp_path):
    def counts(df):
        return incremental.windowed(df.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", ["event_type"]).select(F.col("w.start").alias("day"), "event_type", "n")

    stream = counts(incremental.read_stream(spark, f"{data}/events.parque[t]", incremental.EVENTS))
    q = stream.writeStream.format("memory").queryName("day_counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = counts(spark.read.parquet(f"{data}/events.parquet"))
    assert sorted(map(str, spark.table("day_counts").collect())) == sorted(map(str, batch.collect()))


def test_distinct_messages_stream(spark, tmp_path):
    src = str(tmp_path / "m")
    rows = [("C", "1", "2026-01-01 00:00:00"), ("C", "1", "2026-01-01 00:00:00"), ("C", "2", "2026-01-01 01:00:00")]
    spark.createDataFrame(rows, "c string, ts string, t string").write.parquet(src)
    stream = incremental.read_stream(spark, src, "c string, ts string, t string").withColumn("at", F.to_timestamp("t"))
    q = incremental.distinct_messages(stream, ["c", "ts"], "at").writeStream.format("memory").queryName("distinct_m").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_m").count() == 2


def test_steps():
    def bad():
        raise ValueError("x")

    report = incremental.run_steps([("a", True, lambda: "1"), ("b", True, bad), ("c", False, lambda: "3")])
    assert [s for _, s, _ in report] == ["ok", "failed", "ok"] and incremental.exit_code(report) == 1
    assert [s for _, s, _ in incremental.run_steps([("a", True, bad), ("c", False, lambda: "3")], check_only=True)] == ["skipped", "ok"]


def test_scope_conflict(spark):
    scope = spark.createDataFrame([("a", True, True, True)], "root string, included boolean, excluded boolean, enabled boolean")
    with pytest.raises(Exception, match="included and excluded: a"):
        manifest.scope_roots(scope).collect()


def test_deletion_of_nothing(spark):
    t = spark.createDataFrame([("a", 1)], "file_id string, x int")
    assert manifest.without(t, t.limit(0)).count() == 1


def test_long_threads_are_cut(spark):
    rows = [("C", "n", "1", str(i), "u", "x" * 1000, i) for i in range(20)]
    m = spark.createDataFrame(rows, "channel_id string, channel_name string, thread_ts string, ts string, user_name string, text string, idx int")
    r = threads.assemble(m).first()
    assert len(r.body) == 7000 and r.n_messages == 20


def _page(path, *messages):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"messages": [{"ts": t, "text": x, "user": "u", "reply_count": n} for t, x, n in messages]}))


def test_chat_stream_stops_and_starts(spark, tmp_path):
    """Each message is read once over three runs, with new pages, a new channel and a run that finds nothing new."""
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    _page(src / "C1" / "p1.json", ("10.1", "a", 0), ("11.1", "b", 1))
    _page(src / "C1" / "replies" / "11.1.json", ("11.1", "b", 0), ("11.5", "reply", 0))
    spark.dataSource.register(ChatPages)

    def run():
        stream = spark.readStream.format("chat_pages").load(str(src))
        incremental.run_available(stream, mark, lambda batch, n: batch.write.mode("append").parquet(out))
        return sorted((r.channel_id, r.text) for r in spark.read.schema(SCHEMA).parquet(out).collect())

    assert run() == [("C1", "a"), ("C1", "b"), ("C1", "reply")]
    assert run() == [("C1", "a"), ("C1", "b"), ("C1", "reply")]
    _page(src / "C1" / "p2.json", ("12.1", "c", 0))
    _page(src / "C2" / "p1.json", ("9.1", "other", 0))
    assert run() == [("C1", "a"), ("C1", "b"), ("C1", "c"), ("C1", "reply"), ("C2", "other")]


class Flaky:
    """Three pages of one channel; the second is refused twice and the third fails once."""

    calls: list = []

    def __init__(self, options):
        pass

    def channels(self):
        return ["C"]

    def history(self, channel, oldest, latest, cursor):
        Flaky.calls.append(cursor)
        n = Flaky.calls.count(cursor)
        if cursor == "2" and n < 3:
            raise RateLimited(900 if n == 1 else None)
        if cursor == "3" and n < 2:
            raise ConnectionError
        return [{"ts": f"1{cursor or 1}.0", "text": cursor}], {"": "2", "2": "3", "3": ""}[cursor]


def test_chat_calls_are_patient(monkeypatch):
    waits = []
    monkeypatch.setattr(chat_source.patiently, "__kwdefaults__", {"sleep": waits.append})
    Flaky.calls = []
    reader = chat_source.PageStream({"client": f"{__name__}:Flaky"})
    rows = list(reader.read(chat_source.ChannelPartition("C", "0", "99")))
    assert [r[2] for r in rows] == ["11.0", "12.0", "13.0"] and waits == [120.0, 5.0, 2.0 ** 0]
    assert reader.partitions({"C": "12.0"}, {"C": "12.0", "D": "3.0"}) == [chat_source.ChannelPartition("D", "0", "3.0")]

    def never():
        raise RateLimited(1)

    waits.clear()
    with pytest.raises(RateLimited):
        chat_source.patiently(never)
    assert waits == [1] * 5
    assert sorted(["9.9", "10.1", "10.05", "x", None], key=chat_source.moment) == ["x", None, "9.9", "10.05", "10.1"]


def test_listing_planned_from_the_one_before(spark, tmp_path):
    """What had many files is dealt to several tasks the next time; each file is listed once, new folders as well."""
    for path in [f"big/a/{i}.txt" for i in range(30)] + [f"big/b/c/{i}.txt" for i in range(30)] + ["big/own.txt", "small/x.txt", "top.txt", "skip/y.txt"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    spark.dataSource.register(FolderListing)
    read = lambda **how: spark.read.format("folder_listing").options(roots=str(tmp_path), exclude="skip", **how).load()
    first = read()
    want = sorted(r.path for r in first.collect())
    assert first.rdd.getNumPartitions() == 1 and len(want) == 63
    large = large_folders(first, 20)
    assert json.loads(large) == [str(tmp_path), f"{tmp_path}/big", f"{tmp_path}/big/a", f"{tmp_path}/big/b", f"{tmp_path}/big/b/c"]
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "n.txt").write_text("x")
    second = read(large=large)
    sizes = second.groupBy(F.spark_partition_id()).count().collect()
    assert second.rdd.getNumPartitions() > 4 and max(r["count"] for r in sizes) <= 30
    assert sorted(r.path for r in second.collect()) == sorted([*want, "new/n.txt"])
    assert sorted(r.path for r in read(large=large, split="true").collect()) == sorted([*want, "new/n.txt"])
    assert sorted(r.path for r in read(large=large, depth="2").collect()) == ["big/own.txt", "new/n.txt", "small/x.txt", "top.txt"]
    assert large_folders(first.limit(0), 1) == "[]"
