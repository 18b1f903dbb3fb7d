"""Chat as a vector store: top k and collapse by brute force, what a question says of its sources, what a reranker reads."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import chat, providers, retrieve

PIECES = "channel_id string, channel_name string, thread_ts string, idx long, text string, vector array<double>"
PARENTS = "channel_id string, channel_name string, thread_ts string, text string, vector array<double>"
QUERY = [1.0, 0.0, 0.5]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vec = lambda: [r.uniform(-1, 1) for _ in range(3)]
    pieces = [(f"C0CHANNEL{t % 3}", f"team-{t % 3}", f"{1785000000 + t * 40_000}.000100", i, f"w{t} piece {i} pw: s3cret{t}", vec()) for t in range(40) for i in range(1 + t % 4)]
    pieces += [("C0CHANNEL9", "quiet", "1785000001.000100", 0, "ann joined the channel", QUERY), ("C0CHANNEL9", "quiet", "not a time", 0, "no time", [-1.0, 0.0, -0.5])]
    parents = [(*p[:3], "whole " * 300 + p[2], vec()) for p in pieces if p[3] == 0 and p[1] != "quiet"]
    return pieces, parents


@pytest.fixture(scope="module")
def store(spark, rows):
    return chat.Chat(spark.createDataFrame(rows[0], PIECES).repartition(4), spark.createDataFrame(rows[1], PARENTS).repartition(3))


@pytest.fixture(scope="module")
def stores(spark, store):
    files = spark.createDataFrame([("f1", "lab/a", "note.txt", "note.txt", "2026-01-01T00:00:00Z", "indexed")], "file_id string, root string, name string, path string, mod_time string, status string")
    chunks = spark.createDataFrame([("f1", 0, "w1 drive text", "lab/a")], "file_id string, idx long, text string, root string")
    points = spark.createDataFrame([("f1", 0, "lab/a", [0.9, 0.1, 0.4])], "file_id string, idx long, root string, vector array<double>")
    return retrieve.Stores(points, chunks, files, chat=store)


def seoul_day(ts):
    return str(datetime.datetime.fromtimestamp(float(ts) + 9 * 3600, datetime.UTC).date())


def test_candidates(rows, store):
    pieces, parents = rows
    near = sorted(pieces, key=lambda p: (-cosine(p[5], QUERY), p[:4]))[:12]
    whole = {p[:1] + p[2:3]: p for p in sorted(parents, key=lambda p: (-cosine(p[4], QUERY), p[0], p[2]))[: chat.PARENTS]}
    found = chat.candidates(store, QUERY, 12).orderBy("pos").collect()
    children = [r for r in found if r.kind == "slack"]
    assert [(r.channel_id, r.thread_ts, r.idx) for r in children] == [(p[0], p[2], p[3]) for p in near if "joined" not in p[4]]
    for r in children:
        parent = whole.get((r.channel_id, r.thread_ts))
        assert r.parent_context == (parent[3][:900] if parent else None)
        assert "s3cret" not in r.text and r.file_url.startswith("https://slack.com/archives/C0CHANNEL")
    rest = {(r.channel_id, r.thread_ts) for r in found if r.kind == "slack_parent"}
    assert rest == set(whole) - {(p[0], p[2]) for p in near} and children and rest
    assert any(r.parent_context for r in children)


def test_latest(rows, store):
    first = {}
    for p in rows[0]:
        first.setdefault((p[0], p[2]), p)
    number = lambda t: float(t) if t[0].isdigit() else 0.0
    want = sorted(first, key=lambda k: (-number(k[1]), k))[:7]
    assert [(r.channel_id, r.thread_ts) for r in chat.latest(store, 7).orderBy("pos").collect()] == want
    assert chat.latest(store, 100).count() == len(first)


def test_what_a_question_says(store):
    read = lambda q: chat.asked(q, store.pieces)
    a = read("#team-1 정리해줘")
    assert a.channels == ("team-1",) and a.chat_only and a.notes == ()
    a = read("슬랙에서 qui 대화 알려줘")
    assert a.channels == ("quiet",) and a.notes == (fixed.NOTE_CHANNEL_INFERRED.format("quiet"),)
    a = read("#nowhere 슬랙 정리")
    assert a.channels == () and a.chat_only and a.notes == (fixed.NOTE_CHANNEL_UNKNOWN,)
    assert read("최근 슬랙 대화 알려줘").only_latest and not read("최근 슬랙 로봇 대화 알려줘").only_latest
    assert read("드라이브 문서 찾아줘").sources == {"drive"} and read("robot").sources == frozenset()

    def fails():
        raise OSError("no listing")

    assert chat.asked("#team-1 정리해줘", store.pieces, fails).channels == ()


def test_answer_from_a_channel(store, stores):
    got = retrieve.answer(stores, "w1 #team-1", QUERY)
    hits = got.hits.collect()
    assert got.notes == [] and hits and {r.file_id.split(":")[1] for r in hits} == {"C0CHANNEL1"}
    threads = [r.file_id.split(":", 2)[2] for r in hits]
    assert len(set(threads)) == len(threads) and [r.rank for r in hits] == list(range(1, len(hits) + 1))
    # nothing of this channel is near: the whole chat answers, and a note says so
    got = retrieve.answer(stores, "#quiet 채널 정리", QUERY, candidates=5)
    assert got.notes == [fixed.NOTE_CHANNEL_EMPTY.format("quiet")] and got.hits.count() == fixed.TOP_K


def test_answer_by_time_and_of_both(rows, store, stores):
    got = retrieve.answer(stores, "최근 슬랙 대화 알려줘", QUERY, top_k=4).hits.orderBy("rank").collect()
    newest = sorted({p[2] for p in rows[0] if p[2][0].isdigit()}, key=float, reverse=True)[:4]
    assert [r.thread_ts for r in got] == newest
    recent = retrieve.answer(stores, "최근 슬랙 w1 대화", QUERY).hits.orderBy("rank").collect()
    stamps = [float(r.file_id.split(":")[2]) for r in recent]
    assert stamps == sorted(stamps, reverse=True)
    both = retrieve.answer(stores, "드라이브와 슬랙에서 w1", QUERY).hits.collect()
    assert {"drive"} < {r.kind for r in both}
    assert {r.file_id for r in retrieve.answer(stores, "드라이브 문서 w1", QUERY).hits.collect()} == {"f1"}
    period = ("2026-07-27", "2026-08-02")
    some = retrieve.answer(stores, "슬랙 w1", QUERY, period=period).hits.collect()
    assert some and all(period[0] <= seoul_day(r.file_id.split(":")[2]) < period[1] for r in some)


def test_a_reranker_reads_candidates_only(spark, tmp_path, monkeypatch, store, stores):
    out = str(tmp_path / "read")

    def score(query, texts):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write("x" * len(texts))
        return [float(len(t)) for t in texts]

    monkeypatch.setitem(providers.PROVIDERS, "rerank", score)
    retrieve.retrieve(stores, "슬랙 w1", QUERY, sources=["slack"], candidates=10).collect()
    n = sum(p.stat().st_size for p in (tmp_path / "read").iterdir())
    assert 0 < n <= 10 + chat.PARENTS
    # chat without vectors: the words choose, the model reads what they chose
    said = store.pieces.withColumns({"ts": F.col("thread_ts"), "user_name": F.lit("u")})
    plain = retrieve.Stores(stores.points, stores.chunks, stores.files, messages=said)
    for p in (tmp_path / "read").iterdir():
        p.unlink()
    retrieve.retrieve(plain, "w1", QUERY, sources=["slack"], candidates=10).collect()
    assert 0 < sum(p.stat().st_size for p in (tmp_path / "read").iterdir()) <= 10


def test_indexes(spark):
    ddl = "channel_id string, channel_name string, thread_ts string, ts string, user_name string, text string, idx long"
    m = spark.createDataFrame([("C1", "one", "1.0", "1.0", "ann", "hello " * 400, 0), ("C1", "one", "1.0", "2.0", "ben", "bye", 1), ("C1", "one", "9.0", "9.0", "ann", "short", 0)], ddl)
    contexts = spark.createDataFrame([("C1", "9.0", "about greetings")], "channel_id string, thread_ts string, context string")
    pieces = chat.pieces_index(m, contexts).collect()
    parents = {r.thread_ts: r for r in chat.parents_index(m, contexts).collect()}
    assert {r.thread_ts for r in pieces} == set(parents) == {"1.0", "9.0"} and sum(r.thread_ts == "1.0" for r in pieces) > 1
    for r in pieces:
        told = f"[Slack 대화 맥락]\nabout greetings\n\n{r.text}" if r.thread_ts == "9.0" else r.text
        assert r.vector == pytest.approx(providers.hashed_embedding([told])[0])
    assert parents["9.0"].text == "채널: #one\n스레드 전체 대화:\nann: short"
    assert parents["9.0"].vector == pytest.approx(providers.hashed_embedding(["[Slack 스레드 전체 맥락]\nabout greetings\n\n" + parents["9.0"].text])[0])


def test_search_reads_keys_and_vectors(spark, tmp_path, rows):
    """The search itself reads no texts; they are read for the rows found."""
    spark.createDataFrame(rows[0], PIECES).write.parquet(str(tmp_path / "p"))
    c = chat.Chat(spark.read.parquet(str(tmp_path / "p")))
    plan = chat.dense(c, QUERY, 5)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert len(scans) == 2 and sum("vector" in x.split("ReadSchema")[1] for x in scans) == 1
    assert all("text" not in x.split("ReadSchema")[1] for x in scans if "vector" in x.split("ReadSchema")[1])
    assert "TakeOrderedAndProject" in plan
