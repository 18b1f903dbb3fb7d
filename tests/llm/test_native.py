"""Quality rules, mixing, sharding and URL filter against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, quality_rules, sharding, url_filter
from quern.session import table


def statistics(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_statistics(request, which):
    df = request.getfixturevalue(which)
    got = quality_rules.quality_table(df).collect()
    want = Counter((r.doc_id, *statistics(r.text)) for r in df.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_by_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}

    def rejected(t):
        n, chars, symbols, dup, repeat = statistics(t)
        lines = len([x for x in t.split("\n") if x.encode().split()])
        upper, marks = sum("A" <= c <= "Z" for c in t), t.count("!")
        return n < 20 or 10 * symbols > n or 4 * upper > chars or 10 * marks > n or chars < 2 * n or chars > 20 * n or 2 * dup > lines or 100 * repeat > 30 * n

    want = {i for i, t in texts.items() if not rejected(t)}
    assert {r.doc_id for r in quality_rules.quality_filter(docs).collect()} == want
    for order in (["repeats", "short"], ["short", "same_lines", "symbols"]):
        some = quality_rules.judged(docs, order=order)
        assert some.columns == [*docs.columns, "kept"]
        assert {r.doc_id for r in some.where("kept").collect()} >= want
    assert {r.doc_id for r in quality_rules.quality_table(docs).where("kept").collect()} == want


def test_keeps_clean_documents(spark, data, docs):
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    rows = quality_rules.quality_table(docs).collect()
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert clean and all(r.kept for r in clean)


def test_cascade_order(docs):
    found = quality_rules.estimate_rules(docs)
    assert sorted(e.rule for e in found) == sorted(r.name for r in quality_rules.RULES)
    gains = [e.new_rejected / e.seconds for e in found]
    assert gains[0] == max(gains) and sum(e.new_rejected for e in found) <= found[0].rows


def test_filter_keeps_columns(edge, nothing):
    out = quality_rules.quality_filter(edge)
    assert out.columns == edge.columns
    assert {r.doc_id for r in out.collect()} == {1, None, 5, 6, 7, 8, 9, 10, 15, 16}
    assert quality_rules.quality_filter(nothing).count() == 0 and quality_rules.quality_table(nothing).count() == 0


def targets(sizes):
    """Shares by weight, limited to twice a source's size, by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[x] for x in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    source = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in df.collect()]
    sizes = defaultdict(int)
    for _, s, n in source:
        sizes[s] += n
    want = targets(sizes)
    rows = mixing.mix_table(df).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, n) for i, _, n in source)
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(n, round(want[s], 6)) for s, n in sizes.items()})
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    if which == "docs":
        by_size = defaultdict(int)
        for r in rows:
            by_size[r.source_size, r.target] += r.taken
        assert all(abs(got - t) <= 0.03 * t for (_, t), got in by_size.items())
    else:  # a few rows of very different sizes: the nearest subset misses by half of the largest one at most
        got, wanted, most = defaultdict(int), defaultdict(float), defaultdict(int)
        for s, n in sizes.items():  # sources of one size and target can't be told apart in the result
            wanted[n, round(want[s], 6)] += want[s]
            most[n, round(want[s], 6)] += max(x for _, t, x in source if t == s)
        for r in rows:
            got[r.source_size, round(r.target, 6)] += r.taken
        assert all(abs(got[k] - wanted[k]) <= most[k] / 2 + 1e-6 for k in wanted)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_table(df).collect()))


def test_mixed_documents(docs, edge, nothing):
    times = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix_table(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({i: n for i, n in times.items() if n})
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns and out.count() > 0
    assert mixing.mixed_documents(nothing).count() == 0 and mixing.mix_table(nothing).count() == 0


@pytest.mark.parametrize("n", [1000, 100_000])
def test_mixing_of_equal_rows(spark, n):
    """Rows that are equal in everything are items of their own; the documents of the mix agree with its table."""
    equal = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("ten words " * 5).alias("text"), F.lit("a").alias("source"), (F.col("id") % 3).alias("lang"))
    other = spark.range(6 * n // 100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100).alias("text"), F.lit("b").alias("source"), F.lit(0).cast("long").alias("lang"))
    df = equal.unionByName(other).repartition(5)
    rows = mixing.mix_table(df).groupBy("source_size", "target", "taken").count().collect()
    got = defaultdict(int)
    for r in rows:
        got[r.source_size, r.target] += r.taken * r["count"]
    assert len(got) == 2 and all(abs(x - t) <= 0.03 * t for (_, t), x in got.items())
    again = mixing.mix_table(df.repartition(3)).groupBy("source_size", "target", "taken").count().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    if n == 1000:
        taken = mixing.mixed_documents(df).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
        assert sorted(r["n"] for r in taken) == sorted(got.values())


def test_thresholds_by_sorting(docs):
    """The first threshold takes the longest run of rows, by hash, that fits."""
    rows, _ = mixing._rows(docs, "text", "source", "doc_id")
    budget = rows.groupBy("__key").agg((F.sum("size") * 0.4).alias("__budget"))
    state = {r["__key"]: (r["__upto"], r["__left"]) for r in mixing.thresholds(rows.select("__key", "__h", "size").where("size > 0"), budget, True).collect()}
    want = {r["__key"]: r["__budget"] for r in budget.collect()}
    by_key = defaultdict(list)
    for r in rows.collect():
        if r["size"]:
            by_key[r["__key"]].append(((r["__h"] % (1 << 64)) >> 28, r["size"]))
    for k, items in by_key.items():
        left = want[k]
        for h, n in sorted(items):
            if n > left:
                assert state[k][0] == h
                break
            left -= n
        assert abs(state[k][1] - left) < 1e-6


def test_subsets_at_the_threshold(spark):
    """Of the rows next to a threshold the subset nearest to the budget is taken: with few rows, of all rows."""
    r = random.Random(2)
    sizes = {f"s{k:02d}": [r.randint(1, 3000) for _ in range(r.randint(1, 8))] for k in range(30)}
    df = spark.createDataFrame([(100 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)], "doc_id long, text string, source string")
    got, target = defaultdict(int), {}
    key = {100 * k + i: s for k, (s, ns) in enumerate(sizes.items()) for i in range(len(ns))}
    for x in mixing.mix_table(df).collect():
        got[key[x.doc_id]] += x.taken
        target[key[x.doc_id]] = x.target
    for s, ns in sizes.items():
        if len(ns) <= mixing.NEAR:
            base = sum(ns) * int(target[s] // sum(ns))
            best = min(abs(base + sum(x for j, x in enumerate(ns) if m >> j & 1) - target[s]) for m in range(1 << len(ns))) if base < 2 * sum(ns) else 0
            assert abs(abs(got[s] - target[s]) - best) < 1e-6, s


def test_many_sources(spark):
    """Targets of many sources, and nulls, as by repeated sharing; places go on across ranges."""
    df = spark.range(30_000).select((F.col("id") % 7 + 1).alias("size"), F.when(F.col("id") > 0, F.concat(F.lit("h"), F.hash("id").cast("string"))).alias("__source"))
    df = df.withColumn("__key", mixing.source_key(F.col("__source")))
    rows = mixing.source_targets(df).collect()
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r["__source"]] += r["size"]
    want = targets(sizes)
    assert len(rows) == len(sizes) and all(abs(r.target - want[r["__key"][1:] or None]) < 1e-6 for r in rows)
    assert mixing.fill_rate(spark.createDataFrame([(1.0, 1.0)], "limit double, weight double"), 5.0) == float("inf")


def test_sample_of_copies(spark, monkeypatch):
    """One text on half of all rows: the estimate sees about as many rows as asked for, half of them copies."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "one text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    found = quality_rules.estimate_rules(df, quality_rules.RULES[:2])
    assert 800 < found[0].rows < 1200


def test_differencing():
    part = sharding.differenced([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], part) if p == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    assert sharding.differenced([], 3) == [] and set(sharding.differenced([5], 3)) <= {0, 1, 2}
    many = [(i * 7919) % 1000 + 1 for i in range(500)]
    part = sharding.differenced(many, 7)
    sums = [sum(s for s, p in zip(many, part) if p == k) for k in range(7)]
    assert max(sums) - min(sums) <= 2


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    rows = sharding.sharded(df).collect()
    source = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == source
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = defaultdict(set)
    by_id = {(r.doc_id, r.text_crc32): r.shard for r in rows}
    for r in df.collect():
        if r.text is not None:
            texts[r.text].add(by_id[r.doc_id, zlib.crc32(r.text.encode())])
    assert all(len(s) == 1 for s in texts.values())
    if which == "docs":
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r["size"]
        largest = max(Counter((r.text_crc32) for r in rows).values()) and max(r["size"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= largest


def test_sharding_runs_and_empty(spark, docs, nothing):
    assert sharding.sharded(nothing).count() == 0
    same = spark.createDataFrame([(None, "one text", "s")], "doc_id long, text string, source string").crossJoin(spark.range(100_000)).drop("id")
    for df in (docs.repartition(13), same.repartition(16)):
        slots = defaultdict(list)
        for r in sharding.sharded(df).collect():
            slots[r.shard].append(r.slot)
        assert sum(map(len, slots.values())) == df.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def judged(url, listed):
    host, path = parts(url)
    best = None
    for verdict, at, start in url_filter.RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(start) and (best is None or len(at + start) > len(best[1])):
            best = (verdict, at + start)
    return host, path, best and best[1], best[0] if best else "block" if host in listed else "allow"


URLS = [
    "http://A.Example.COM/en/7x", "https://www.casino-win.example.net/x", "http://casino-win.example.net", "no scheme", None, "", "x://", "http://net/de/", "http://b.net/de/9?u=/de/8",
    "http://q.example.net/de/8#f", "http://notnet/de/", "http://h?x://y/z", "http://ÄB.org/es/ñ", "http://free-bets.example.com/en/5", "http://free-bets.example.com/en/5", "a\nb://c.com/en/\nq",
]


def test_urls(spark):
    junk = "<p>%%% *** ### $$$</p>"
    html = [junk if i % 3 == 1 else "<p>%%% ***</p>" if i % 3 else None for i in range(len(URLS))]
    rows = [(i, u, "h", "r", True, h) for i, (u, h) in enumerate(zip(URLS, html, strict=True))] + [(None,) * 6]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, __hit boolean, html string")
    hosts = {h for u in URLS for h, _ in [parts(u)] if set(h.split(".")) & set(url_filter.LISTED_LABELS)}
    addresses = {"".join(parts(u)) for u, h in zip(URLS, html, strict=True) if h == junk}

    def want(hosts, addresses):
        out = []
        for i, u in [*enumerate(URLS), (None, None)]:
            host, path = parts(u)
            out.append(str((i, *judged(u, {host} if host in hosts or host + path in addresses else set()))))
        return sorted(out)

    text = lambda df: sorted(str(tuple(r)) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())
    for most in (url_filter.MAX_BYTES, 20):
        assert text(url_filter.judged_urls(pages, max_bytes=most)) == want(hosts, addresses)
    assert text(url_filter.judged_urls(pages.drop("html"))) == want(hosts, set())
    assert text(url_filter.judged_urls(pages, hosts=spark.createDataFrame([("notnet",)], "k string"))) == want({"notnet"}, addresses)
    assert url_filter.judged_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    """Also where the first level is far too small: more levels repair it."""
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32(F.col("key").cast("binary")) % 5 == 0)
    for first in (url_filter.FIRST_RATE, 1 / 2):
        monkeypatch.setattr(url_filter, "FIRST_RATE", first)
        cascade = url_filter.build_cascade(url_filter.known_keys(listed, keys))
        assert len(cascade.levels) > 2
        hits = {r.key for r in keys.where(cascade.listed(F.col("key"))).collect()}
        assert hits == {r.key for r in listed.collect()}
        assert abs(cascade.n_bytes - url_filter.expected_bytes(len(hits), 3000 - len(hits))) < 0.1 * cascade.n_bytes + 64
    assert url_filter.build_cascade(url_filter.known_keys(keys.limit(0), keys)).listed(F.lit("x")) is not None


def test_more_than_a_million_listed_keys(spark):
    """Keys for several cascades: every verdict is right, null keys and unlisted ones included, and each cascade is bounded."""
    rows = spark.range(1_600_000).select(F.when(F.col("id") % 100_000 != 7, F.concat(F.lit("host"), "id")).alias("k"), F.col("id").alias("of"))
    listed = spark.range(1_100_000).select(F.concat(F.lit("host"), "id").alias("key"))
    out = url_filter.with_listed(rows, "k", listed, "hit")
    wrong = out.where(F.col("hit") != (F.col("k").isNotNull() & (F.col("of") < 1_100_000)))
    assert out.columns == ["k", "of", "hit"] and out.count() == 1_600_000 and wrong.count() == 0
    assert url_filter.expected_bytes(1_100_000, 500_000) > url_filter.MAX_BYTES
