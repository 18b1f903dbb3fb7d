"""The indexing run, keyed tables, location drivers' parts, providers and caches."""

import json
import os
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import cache, catalog, indexing, location, manifest, prompts, providers, threads
from quern.operators import points as points_table
from quern.sources import listing, parsers
from quern.sources.listing import FolderListing

LISTED = "file_id string, name string, path string, root string, size long, mod_time string"
PROSE = "This file says something about the greenhouse and its plants. " * 4


def listed(spark, *rows):
    return spark.createDataFrame([(i, n, n, "r", s, m) for i, n, s, m in rows], LISTED)


def contents(spark, **by_id):
    return spark.createDataFrame([(i, bytearray(c.encode())) for i, c in by_id.items()], "file_id string, content binary")


def test_indexing_run(spark, tmp_path):
    at = str(tmp_path / "index")
    decomposed = unicodedata.normalize("NFD", "예산표.txt")
    first = listed(spark, ("a", decomposed, 10, "1"), ("b", "notes.md", 10, "1"), ("c", "photo.png", 5, "1"), ("d", "empty.txt", 0, "1"), ("e", "bad.docx", 9, "1"), ("f", "~$x.docx", 1, "1"))
    data = contents(spark, a=PROSE + "\n\n" + PROSE * 8, b=PROSE, c="x", d="", e="not a zip file")
    r = indexing.run(spark, first, data, at).counts.first()
    assert (r.indexed, r.skipped, r.failed, r.unchanged, r.still_failed) == (2, 3, 1, 0, 0)
    points = lambda: {(x.file_id, x.idx): x for x in points_table.read(spark, f"{at}/points", indexing.POINTS).collect()}
    files = lambda: {x.file_id: x for x in manifest.read_keyed(spark, f"{at}/manifest").collect()}
    before, status = points(), {k: (x.status, x.error) for k, x in files().items()}
    assert status == {"a": ("indexed", None), "b": ("indexed", None), "c": ("skipped", "needs_model"), "d": ("skipped", "skipped: empty file"), "e": ("failed", "failed: BadZipFile"), "f": ("skipped", "temporary")}
    assert {k[0] for k in before} == {"a", "b"} and len([k for k in before if k[0] == "a"]) > 1
    assert before["b", 0].vector == pytest.approx(providers.hashed_embedding([f"{before['b', 0].citation}\n{before['b', 0].text}"])[0])
    # names in decomposed form are found, by terms in either form
    for term in ("예산표", unicodedata.normalize("NFD", "예산표")):
        assert [x.file_id for x in catalog.search_documents(manifest.read_keyed(spark, f"{at}/manifest"), [term]).collect()] == ["a"]
    # nothing changed: nothing is touched
    r = indexing.run(spark, first, data, at).counts.first()
    assert (r.indexed, r.unchanged, r.skipped, r.still_failed, r.chunks) == (0, 2, 3, 1, 0) and points() == before
    # one file is shorter now, one is gone, one is new, and the failed one is tried again
    second = listed(spark, ("a", decomposed, 4, "2"), ("e", "bad.docx", 9, "1"), ("g", "new.txt", 4, "1"))
    r = indexing.run(spark, second, contents(spark, a=PROSE, e="still no zip", g=PROSE), at, retry_failed=True).counts.first()
    assert (r.indexed, r.failed) == (2, 1) and set(files()) == {"a", "e", "g"}
    assert sorted(points()) == [("a", 0), ("g", 0)]
    # a root can be removed, and a listing of other roots misses nothing of it
    indexing.run(spark, second.limit(0), contents(spark, a="").limit(0), at, roots=["other"])
    assert set(files()) == {"a", "e", "g"}
    assert indexing.remove_root(spark, at, "r") == 3 and not points() and not files()


def test_vectors_must_have_one_length(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "index")
    indexing.run(spark, listed(spark, ("a", "a.txt", 1, "1")), contents(spark, a=PROSE), at)
    monkeypatch.setitem(providers.PROVIDERS, "embed", lambda texts: [[1.0, 2.0]] * len(texts))
    with pytest.raises(ValueError, match="vectors of"):
        indexing.run(spark, listed(spark, ("b", "b.txt", 1, "1")), contents(spark, b=PROSE), at)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    manifest.save_keyed(spark, at, rows, ["k"])
    old = {f for f in manifest.read_keyed(spark, at).inputFiles()}
    manifest.save_keyed(spark, at, spark.createDataFrame([(7, "b"), (2000, "c")], "k long, v string"), ["k"], deleted=spark.createDataFrame([(8,), (3000,)], "k int"))
    new = manifest.read_keyed(spark, at)
    files = set(new.inputFiles())
    assert len(old - files) <= 4 and len(files - old) <= 4  # two new keys and two deleted ones
    got = {r.k: r.v for r in new.collect()}
    assert got == {k: "a" for k in range(1000) if k not in (7, 8)} | {7: "b", 2000: "c"}
    for k in range(3):  # folders that no kept version names go
        manifest.save_keyed(spark, at, spark.createDataFrame([(7, f"v{k}")], "k long, v string"), ["k"])
    kept = {os.path.dirname(p) for p in map(str, (tmp_path / "t" / "data").glob("v*/__bucket=*/*.parquet"))}
    assert len(kept) <= manifest.BUCKETS + 1 and {r.v for r in manifest.read_keyed(spark, at).where("k = 7").collect()} == {"v2"}
    assert manifest.versions(spark, at) == [3, 4]
    with pytest.raises(RuntimeError, match="another writer"):  # one that began from the version before
        manifest._commit(spark, at, 4, ["schema\t{}"])
    assert manifest.versions(spark, at) == [3, 4] and manifest.read_keyed(spark, at).count() == 1000


def test_keyed_tables_get_more_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "BUCKETS", 2)
    monkeypatch.setattr(manifest, "BUCKET_ROWS", 10)
    at = str(tmp_path / "t")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    sizes = []
    for a, b in ((0, 10), (10, 400), (400, 401), (401, 402)):
        manifest.save_keyed(spark, at, rows(a, b), ["k"])
        sizes.append(manifest._version(spark, at, manifest.versions(spark, at)[-1])[2])
    assert sizes == [2, 2, 64, 64] and sorted(r.k for r in manifest.read_keyed(spark, at).collect()) == list(range(402))
    manifest.save_keyed(spark, at, rows(0, 1).withColumn("v", F.lit("b")), ["k"], deleted=spark.createDataFrame([(5,)], "k long"))
    got = {r.k: r.v for r in manifest.read_keyed(spark, at).collect()}
    assert got == {k: "b" if k == 0 else "a" for k in range(402) if k != 5}


def test_adaptive_listing(spark, tmp_path, monkeypatch):
    """A tree that takes too long is listed in parts, each file once; below the last level only files directly there."""
    for path in ("x.txt", "a/y.txt", "a/b/z.txt", "a/b/c/d/e/f/deep.txt", "skip/n.txt"):
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_text("hello")
    reader = listing.FolderReader({"roots": str(tmp_path), "timeout_s": "0.05", "exclude": "skip"})
    real = os.scandir

    def slow(at):
        time.sleep(0.06 if str(at).rstrip("/").endswith(("a", str(tmp_path))) else 0)
        return real(at)

    monkeypatch.setattr(listing.os, "scandir", slow)
    found = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(found) == ["a/b/c/d/e/f/deep.txt", "a/b/z.txt", "a/y.txt", "x.txt"]
    never = listing.FolderReader({"roots": str(tmp_path), "timeout_s": "-1"})
    monkeypatch.setattr(listing.os, "scandir", real)
    assert sorted(r[1] for p in never.partitions() for r in never.read(p)) == ["a/b/z.txt", "a/y.txt", "skip/n.txt", "x.txt"]
    spark.dataSource.register(FolderListing)
    assert spark.read.format("folder_listing").options(roots=str(tmp_path), timeout_s="30").load().count() == 5


def test_default_roots_and_copies(tmp_path):
    assert listing.default_roots("own", "shared", lambda: ["d1", "d2"]) == ["own", "shared", "d1", "d2"]

    def fails():
        raise OSError

    assert listing.default_roots("own", "shared", fails) == ["own", "shared"]
    asked = []

    def fetch(i):
        asked.append(i)
        return b"data" if i == "good" else None

    at = listing.cached(str(tmp_path), "bad\tgood", "n" * 300 + ".pdf", fetch)
    assert open(at, "rb").read() == b"data" and at.endswith(".pdf") and asked == ["bad", "good"]
    assert listing.cached(str(tmp_path), "bad\tgood", "n" * 300 + ".pdf", fetch) == at and asked == ["bad", "good"]
    assert listing.cached(str(tmp_path), "gone", "x", fetch) is None


@pytest.mark.parametrize("name", ["a/b\\c", ".", "..", "", "가" * 200 + ".hwp", unicodedata.normalize("NFD", "각" * 100), "x" * 500, "a." + "z" * 300])
def test_safe_names(name):
    out = X.safe_name(name)
    assert 0 < len(out.encode()) <= 200 and not set("/\\") & set(out) and out not in (".", "..")
    assert unicodedata.is_normalized("NFC", out) and (not name.endswith(".hwp") or out.endswith(".hwp"))


def test_rerank_provider(spark, monkeypatch):
    hits = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, "cc")], "pos int, text string")
    monkeypatch.setitem(providers.PROVIDERS, "rerank", lambda query, texts: [len(t) + len(query) for t in texts])
    got = providers.rerank(hits, "qq").orderBy("rank").collect()
    assert [(r.text, r.score) for r in got] == [("bbb", 5.0), ("cc", 4.0), ("a", 3.0)]
    with pytest.raises(ValueError, match="unknown kind"):
        providers.register_provider("nothing", None)


def test_health_and_token_counts(monkeypatch):
    assert set(providers.health().values()) == {"ok"}

    def down(*_):
        raise ConnectionError

    monkeypatch.setitem(providers.PROVIDERS, "embed", down)
    assert providers.health()["embed"] == "ConnectionError"
    end = len(b"<|endoftext|>")
    assert providers.token_counts(["ab", "", "xyz"]) == [2 + end, end, 3 + end]
    monkeypatch.setitem(providers.PROVIDERS, "tokenize", lambda texts: [list(range(len(t) // 4 + 1)) for t in texts])
    assert providers.token_counts(["ab", "xyz" * 9]) == [len(t + "<|endoftext|>") // 4 + 1 for t in ("ab", "xyz" * 9)]


def test_generated_texts(spark, monkeypatch):
    seen = []

    def generate(asked):
        seen.extend(asked)
        return [{"s": "SKIP", "t": "tiny", "j": "새 사람이 참여했다고 합니다"}.get(p[-1], ' "' + "useful words " * 60 + '" ') for p in asked]

    monkeypatch.setitem(providers.PROVIDERS, "generate", generate)
    bodies = spark.createDataFrame([("C1", "n", str(i), b) for i, b in enumerate(["x" * 150 + "s", "x" * 150 + "t", "x" * 150 + "j", "x" * 150, "x" * 50, "상태 변경됨" + "x" * 200])], "channel_id string, channel_name string, thread_ts string, body string")
    got = providers.thread_contexts(bodies).collect()
    assert [(r.thread_ts, len(r.context)) for r in got] == [("3", 500)]
    docs = spark.createDataFrame([(1, "y" * 300), (2, "y" * 100), (3, "y" * 300 + "s"), (4, "y" * 300 + "t")], "id int, text string")
    out = {r.id: r.s for r in docs.select("id", providers.file_synopsis(F.col("text")).alias("s")).collect()}
    assert out[1].startswith("useful words") and out[2] is None and out[3] is None and out[4] is None
    pieces = spark.createDataFrame([("C1", "3", "piece"), ("C1", "9", "other")], "channel_id string, thread_ts string, text string")
    told = {r.thread_ts: r.embed_text for r in threads.with_context(pieces, spark.createDataFrame([("C1", "3", "ctx")], "channel_id string, thread_ts string, context string")).collect()}
    assert told == {"3": "[Slack 대화 맥락]\nctx\n\npiece", "9": "other"}


def test_messages():
    history = [("user", f"q{i}") if i % 2 else ("assistant", f"a{i}") for i in range(20)] + [("system", "no"), ("user", " ")]
    for mode, turns, has in (("rag", 6, ("CTX", "LAY")), ("general", 7, ()), ("web", 6, ("WEB", "LAY")), ("rag_web", 6, ("CTX", "WEB", "LAY"))):
        m = prompts.messages(mode, "Q?", "SYS", history, "CTX", "WEB", "LAY")
        assert m[0] == {"role": "system", "content": "SYS"} and len(m) == turns + 2 and m[-2]["content"] == "q19"
        assert m[-1]["content"] == "\n\n".join([*has, "Q?"])
    with pytest.raises(ValueError, match="unknown mode"):
        prompts.messages("x", "", "")


def test_cached_dimension(spark):
    now, made = [0.0], []

    def load():
        if len(made) == 2:
            raise ConnectionError
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    c = cache.Cached(load, 300, lambda: now[0])
    value = lambda: c.get().first().n
    assert value() == 1 and value() == 1
    now[0] = 299
    assert value() == 1
    now[0] = 300
    assert value() == 2
    now[0] = 900
    assert value() == 2  # it can't be read again: the old one stays


def test_channels_that_cant_be_listed(spark):
    q = spark.createDataFrame([(1, "슬랙 #x 채널")], "id int, q string")

    def fails():
        raise ConnectionError

    assert threads.resolve_or_none(q, fails).collect()[0][1:] == ([], "")
    assert threads.resolve_or_none(q, lambda: spark.createDataFrame([("x",)], "name string")).first().names == ["x"]
    assert q.select(threads.names_a_channel(F.col("q")).alias("n")).first().n


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"records": {"b": {"intent_terms": ["x"]}, "a": {"operation": "list"}}}))
    got = catalog.load_records(spark, str(tmp_path / "r.json")).orderBy("ord").collect()
    assert [(r.key, r.intent_terms, r.operation) for r in got] == [("b", ["x"], "canonical_record"), ("a", [], "list")]
    (tmp_path / "list.json").write_text(json.dumps({"records": [{"key": "z", "intent_terms": ["소개"], "preferred_roots": ["[W]/ops"]}, {"key": "a"}]}))
    got = catalog.load_records(spark, str(tmp_path / "list.json")).orderBy("ord").collect()
    assert [(r.key, r.intent_terms, r.preferred_roots) for r in got] == [("z", ["소개"], ["[W]/ops"]), ("a", [], [])]
    for bad in ("[]", '{"records": 3}', '{"records": [{"intent_terms": []}]}', '{"records": [{"key": "a"}, {"key": "a"}]}', '{"records": ["a"]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError, match="records"):
            catalog.load_records(spark, str(tmp_path / "bad.json"))


def test_summaries_and_pdf():
    numbers = "t,x,y\n" + "\n".join(f"{i},{i}.5,-0.{i}" for i in range(200))
    (block,), why = parsers.parse("n.csv", "table", numbers.encode())
    assert why is None and block.label == "summary" and "columns: t, x, y" in block.text and "199,199.5" in block.text and "201 lines" in block.text
    records = json.dumps({"data": {"rows": [{"a": i, "b": {"c": 1}} for i in range(40)]}})
    (block,), _ = parsers.parse("n.json", "text", records.encode())
    assert block.text == "records: 40\nkeys: a, b.c"
    blocks, _ = parsers.parse("n.txt", "text", b"Abstract\none\n\n2. Methods\ntwo\n\n1999. no heading, as it is a year.\nthree")
    assert [b.section for b in blocks][:2] == ["Abstract", "2 Methods"] and blocks[-1].section == "2 Methods"
    assert parsers.pdf_blocks(["", "", "", "", "", " ", "", "", "", "x"])[1] == "skipped: no text layer"
    assert [b.page for b in parsers.pdf_blocks(["a", "", "c"])[0]] == [1, 3] and parsers.pdf_text_ratio([]) == 0


def test_chat_alone_is_not_available(spark, data):
    from quern.operators import retrieve
    from quern.plans.retrieval import stores

    with pytest.raises(LookupError, match="not available"):
        retrieve.retrieve(stores(spark, data), "q", [1.0] * 64, sources=["slack"])


def test_ambiguous_questions(spark, data):
    """A question that may be about content is answered by files only if there are some; a forced one always."""
    from quern.plans.base import files

    f = files(spark, data)
    assert location.locate(spark, "없는이름 보고서 위치와 작성 방법은", f) is None
    assert location.locate(spark, "src4 보고서 위치와 작성 방법은", f).note
    assert location.locate(spark, "왜 실패했어", f) is None and location.locate(spark, "왜 실패했어", f, force=True).intent == "location"


def test_operators_without_a_table(tmp_path):
    """Python stages find the library in a fresh session, on a DataFrame made any other way, from another folder."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000").getOrCreate()
from quern.sources import parsers
df = s.createDataFrame([("a", "a.txt", bytearray(b"some text"))], "file_id string, name string, content binary")
assert parsers.parse_files(df).first().blocks[0].text == "some text"
assert s.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
