"""WARC archives: round trips, and chains against a plain reader, in files of many splits with version lines in payloads."""

import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import warc
from quern.session import table

MAGIC = b"WARC/1.1\r\n"


def plain(data):
    """The records of an archive: (place behind the version line, header, block)."""
    out, at = [], 0
    while data[at : at + 10] == MAGIC:
        end = data.find(b"\r\n\r\n", at + 10)
        sizes = [int(x.partition(b":")[2]) for x in data[at + 10 : end].split(b"\r\n") if x.lower().startswith(b"content-length:")] if end >= 0 else []
        if not sizes or len(data) < end + 4 + sizes[0]:
            break
        out.append((at + 10, data[at + 10 : end], data[end + 4 : end + 4 + sizes[0]]))
        at = end + 8 + sizes[0]
    return out


def record(r, i, body):
    fields = [b"WARC-Type: resource", b"WARC-Record-ID: <urn:x:%d>" % i, b"Content-Length: %d" % len(body)]
    r.shuffle(fields)
    return MAGIC + b"\r\n".join(fields) + b"\r\n\r\n" + body + b"\r\n\r\n"


def body(r, depth=0):
    """Payloads with version lines, false records (some with plausible successors), line ends and whole records inside."""
    bits = [b"abc", b"\r\n", b"\r\n\r\n", MAGIC, MAGIC + b"Content-Length: 7\r\n\r\n", MAGIC + b"content-length: %d\r\n\r\n" % r.randint(0, 400), b"WARC/1.1", b"\xff\x00\xfe", b"x" * r.randint(1, 90)]
    out = b"".join(r.choice(bits) for _ in range(r.choice((0, 1, 5, 30))))
    return out + record(r, 0, body(r, 1)) if depth == 0 and r.random() < 0.4 else out


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "211", "spark.sql.files.openCostInBytes": "1"}
    had = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast", [100_000, 2])
def test_chains(spark, tmp_path, tiny_splits, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST", broadcast)
    r = random.Random(broadcast)
    want = Counter()
    for f in range(6):
        data = b"".join(record(r, i, body(r)) for i in range(14))
        if f == 3:
            data = data[:-300]  # cut off
        if f == 4:
            data = b"no archive\r\n" + data
        if f == 5:
            data = record(r, 1, body(r)) + b"garbage" + data  # the chain breaks
        (tmp_path / f"f{f}").write_bytes(data)
        want.update((f"f{f}", *x) for x in plain(data))
    got = warc.raw_records(spark, str(tmp_path)).collect()
    assert Counter((x["path"].rsplit("/", 1)[-1], x["at"], bytes(x["header"]), bytes(x["block"])) for x in got) == want
    assert sum(len(x[3]) > 500 for x in want) > 3  # longer than two splits


def expected(rows, least=0):
    first = {}
    for i, _, text in rows:
        key = text or ""
        first[key] = min((x for x in (first.get(key, i), i) if x is not None), default=None)
    n = Counter(t or "" for _, _, t in rows)
    out = Counter()
    for i, _, text in rows:
        raw = (text or "").encode()
        again = n[text or ""] > 1 and len(raw) >= least and i != first[text or ""]
        out[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[text or ""] if again else None)] += 1
    return out


def edge_pages():
    long = "lang ü 😀\n" * 60_000
    rows = [(1, "http://a/b", "<p>x</p>"), (2, "http://a/c", "<p>x</p>"), (3, None, None), (4, "http://x/WARC/1.1", ""), (None, "http://n", "<p>x</p>"), (None, "u", "only null"), (None, "u", "only null")]
    rows += [(5, "a\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"), (6, "q", long), (7, "q", long), (8, "same", "twice"), (8, "same", "twice"), (9, "same", "twice")]
    rows += [(10, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (-3, "u", "ü"), (11, "", "ü"), (None, None, None)]
    return rows + [(100 + i, "hot", "hot text") for i in range(60)]


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    rows = edge_pages()
    df = spark.createDataFrame([(*x, "p", 1) for x in rows], "page_id long, url string, html string, payload string, first int").repartition(3)
    got = warc.archived_pages(df, least=least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == expected(rows, least)


def test_without_broadcast(spark, monkeypatch, tiny_splits):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    rows = [(i, u, t if t is None or len(t) < 1000 else t[:2000]) for i, u, t in edge_pages()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert Counter(map(tuple, warc.archived_pages(df).collect())) == expected(rows)


def test_pages(spark, data, tmp_path):
    pages = table(spark, data, "pages")
    rows = [tuple(x) for x in pages.select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, warc.archived_pages(pages, path=str(tmp_path / "w")).collect())) == expected(rows)
    files = [x.read_bytes() for x in (tmp_path / "w").glob("part-*")]
    assert sum(len(plain(x)) for x in files) == len(rows) and all(x.endswith(b"\r\n\r\n") for x in files)
    back = {int(x["page"]): (x["url"], bytes(x["payload"]).decode()) for x in warc.read_archives(spark, str(tmp_path / "w")).where(F.col("record_type") == "response").collect()}
    assert all(back[i] == (u, t) for i, u, t in rows if i in back) and back


def test_none(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
