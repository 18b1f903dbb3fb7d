import unicodedata
import uuid

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.operators import catalog, fusion, providers, retrieve, vector


def one(spark, ddl, value, column):
    return spark.createDataFrame([(value,)], ddl).select(column.alias("x")).first().x


def test_uuid5(spark):
    for name in ("12:0", "listing:root:dir", "파일:3", ""):
        assert one(spark, "s string", name, X.uuid5(F.col("s"))) == str(uuid.uuid5(uuid.UUID(fixed.POINT_NAMESPACE), name))


def test_nfkc(spark):
    text = "Ｆｉｌｅ／名①.PDF"
    expect = unicodedata.normalize("NFKC", text).lower()
    got = one(spark, "s string", text, X.normalize(F.col("s"), compatibility=True))
    assert got == " ".join(expect.replace("/", " ").replace(".", " ").split())


def test_redaction_is_idempotent(spark):
    text = "pw: abc, token xoxb-1-abc and ghp_0123456789"
    once = one(spark, "s string", text, X.redact(F.col("s")))
    assert "abc" not in once and one(spark, "s string", once, X.redact(F.col("s"))) == once


def test_empty_terms_find_nothing(spark, data):
    from quern.plans.base import files

    assert catalog.search_documents(files(spark, data), []).count() == 0


def test_topk_prefix(spark, data):
    from quern.plans.vectors import points, query_vector

    q = query_vector(spark, data)
    six = [r.point_id for r in vector.search(points(spark, data), q, 6).collect()]
    assert [r.point_id for r in vector.search(points(spark, data), q, 3).collect()] == six[:3]


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([("a", 0, 1, None), ("b", 0, 2, "n")], "file_id string, idx int, pos int, synopsis string")
    once = fusion.merge_candidates([df, df]).drop("branch")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_balance_edge_cases(spark):
    df = spark.createDataFrame([(1, "drive"), (2, "drive")], "rank int, kind string")
    assert sorted(r["rank"] for r in fusion.balance_sources(df, 1).collect()) == [1]
    assert fusion.balance_sources(df.limit(0), 3).count() == 0


def test_providers(spark, data):
    a, b = providers.hashed_embedding(["same words here", "same words here"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9
    df = spark.createDataFrame([("same words here",), (None,)], "t string").select(providers.embed(F.col("t")).alias("v"))
    assert [abs(x - y) < 1e-6 for x, y in zip(df.first().v, a)] == [True] * providers.DIM
    long = "A first sentence. " + "more " * 60
    assert providers.first_sentence([long, "short", None]) == ["A first sentence.", None, None]


def test_chat_retrieval_keeps_both(spark, data):
    from quern.plans.retrieval import hybrid_retrieve_chat

    rows = hybrid_retrieve_chat(spark, data).collect()
    assert {r.kind for r in rows} == {"drive", "slack"} and len(rows) <= fixed.TOP_K


def test_period_retrieval(spark, data):
    from quern.plans.retrieval import QUESTION, stores
    from quern.plans.vectors import query_vector

    hits = retrieve.retrieve(stores(spark, data), QUESTION, query_vector(spark, data), period=("2026-03-01", "2026-04-01"), expand=0)
    for r in hits.collect():
        assert 58 <= int(r.file_id) % 240 <= 90


def _whole_threads(rows):
    """The text of each thread by plain Python. ``rows``: channel_id, channel_name, thread_ts, ts, user_name, text, idx."""
    by = {}
    for r in rows:
        if (r.text or "").strip(" "):
            by.setdefault((r.channel_id, r.thread_ts), []).append(r)
    out = {}
    for k, rs in by.items():
        rs.sort(key=lambda r: (r.ts, r.idx, r.text))
        out[k] = f"채널: #{rs[0].channel_name or ''}\n스레드 시작: {rs[0].text}\n" + "\n".join(f"{r.user_name or ''}: {r.text}" for r in rs)
    return out


def test_thread_pieces(spark, data):
    from quern.operators import threads
    from quern.operators.chunking import split
    from quern.plans.base import messages

    m = messages(spark, data)
    want = _whole_threads(m.collect())
    pieces = {}
    for r in threads.thread_chunks(m).orderBy("channel_id", "thread_ts", "idx").collect():
        pieces.setdefault((r.channel_id, r.thread_ts), []).append(r.text)
    assert pieces == {k: [t] if len(t) <= fixed.CHUNK_SIZE else split(t, separators=threads.SEPARATORS) for k, t in want.items()}
    assert any(len(p) > 1 for p in pieces.values())


def test_pieces_of_long_threads(spark):
    """All words of threads far over 7,000 characters, of one long message, and of threads cut into parts, are in the pieces."""
    from quern.operators import threads

    ddl = "channel_id string, channel_name string, thread_ts string, ts string, user_name string, text string, idx long"
    rows = [("C1", "one", "t1", f"{i:06d}", "ann", " ".join(f"w{i}x{j}" for j in range(40)), i) for i in range(400)]
    rows += [("C1", "one", "t2", "1", None, " ".join(f"long{j}" for j in range(20_000)), 0), ("C2", "two", "t3", "1", "ben", "  ", 0), ("C2", None, "t4", "1", "ben", "\nshort\n", 0), ("C2", "two", "t5", "1", "b", None, 0)]
    df = spark.createDataFrame(rows, ddl)
    want = _whole_threads(df.collect())
    assert max(map(len, want.values())) > 100_000
    for segment in (threads.SEGMENT, 5_000):
        got = {}
        for r in threads.thread_chunks(df, segment=segment).orderBy("channel_id", "thread_ts", "idx").collect():
            assert len(r.text) <= fixed.CHUNK_SIZE
            got.setdefault((r.channel_id, r.thread_ts), []).append(r.text)
        assert set(got) == {("C1", "t1"), ("C1", "t2"), ("C2", "t4")}
        if segment == threads.SEGMENT:
            assert all({w for p in got[k] for w in p.split()} == set(want[k].split()) for k in got)
        parts = {}
        for r in threads.thread_texts(df, segment).collect():
            parts.setdefault((r.channel_id, r.thread_ts), []).append((r.part, r.text))
            assert len(r.text) <= 2 * segment + 400
        for k, p in parts.items():  # parts are the whole text: line ends between them aside, nothing is lost or doubled
            assert "".join(t for _, t in sorted(p)).replace("\n", "") == want[k].replace("\n", "")
