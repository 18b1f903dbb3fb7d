"""SimHash, substring dedup, components and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from samples import prose

from quern.llm import graph, simhash, substring_dedup


class Sets(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_table(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, fp(r.text)) for r in df.collect()]
    sets, seen = Sets(), sorted({f for _, f in rows})
    for i, a in enumerate(seen):
        sets.root(a)
        for b in seen[:i]:
            if (a ^ b).bit_count() <= 2:
                sets.join(a, b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[sets.root(f)] = min(i, least.get(sets.root(f), i))
    want = Counter((i, f"{f:016x}", least.get(sets.root(f))) for i, f in rows)
    assert Counter(map(tuple, simhash.near_duplicate_table(df).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_bk_tree():
    r = random.Random(3)
    keys = [r.getrandbits(64) for _ in range(300)]
    keys += [k ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for k in keys]
    tree = simhash.BKTree()
    assert tree.within(5, 64) == []
    for k in keys:
        tree.add(k)
    for q in keys[::17]:
        for radius in (0, 2, 25):
            assert sorted(tree.within(q, radius)) == [i for i, k in enumerate(keys) if (k ^ q).bit_count() <= radius]


def sets_within(keys, radius):
    sets = Sets()
    for i, a in enumerate(keys):
        sets.root(a)
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                sets.join(a, b)
    want = defaultdict(set)
    for x in list(sets):
        want[sets.root(x)].add(x)
    return sorted(sorted(v) for v in want.values() if len(v) > 1)


def cloud(seed, n=50):
    r = random.Random(seed)
    center, other = r.getrandbits(64), r.getrandbits(64)
    near = {c ^ (1 << a) ^ (1 << b) for c, k in ((center, 3), (other, 9)) for a in range(0, 64, k) for b in range(1, 64, 5)}
    return sorted(near | {r.getrandbits(64) for _ in range(n)})


def test_links_span_sets():
    """Links of one group give the sets of all pairs within the radius, whichever order rows come in, and no more than span them."""
    for seed in range(6):
        keys = cloud(seed)
        random.Random(seed).shuffle(keys)
        keys += keys[:9]
        found = simhash.links_of(keys, 2)
        sets = Sets()
        for i, j in found:
            assert (keys[i] ^ keys[j]).bit_count() <= 2
            sets.join(keys[i], keys[j])
        got = defaultdict(set)
        for x in list(sets):
            got[sets.root(x)].add(x)
        assert sorted(sorted(v) for v in got.values() if len(v) > 1) == sets_within(keys, 2) and len(found) < len(keys)
        labelled = simhash.links_of(keys, 2, labels=[sets.root(k) for k in keys])
        assert labelled == []


@pytest.mark.parametrize("size", [40, 100, 100_000])
def test_large_shards(spark, monkeypatch, size):
    """A shard in several parts: whatever isn't linked within parts meets all of them, and no link is lost."""
    keys = cloud(4)
    rows = spark.createDataFrame([(s, simhash.signed(k), simhash.signed(k)) for s in (7, 8) for k in keys], "shard long, vertex long, fp long")
    monkeypatch.setattr(simhash, "TREE_SIZE", size)
    links = simhash.linked(rows, 2)
    assert links.count() < 20 * len(keys)
    got = defaultdict(set)
    for x in graph.components(links).collect():
        got[x["root"]].add(x["vertex"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(map(simhash.signed, v)) for v in sets_within(keys, 2))


@pytest.mark.parametrize("words", [8, 30, 200, 2000])
def test_links_by_length(spark, monkeypatch, words):
    """Pairs just above and just below similarity 0.8, of short and long texts: every one above shares a group and none below does."""
    monkeypatch.setattr(simhash, "TREE_SIZE", 64)
    r, rows, want = random.Random(words), [], 0
    for k in range(120):
        body = prose(100_000 * words + k, words).split()
        other = list(body)
        for _ in range(r.randint(1, max(1, words // 40))):
            other[r.randrange(words)] = f"x{r.random()}"
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want += len(a & b) >= 0.8 * len(a | b)
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == len(rows) - want and (want > 10 or words == 8)


def test_large_groups(spark, monkeypatch):
    """Groups that need many parts, and some that are too many and go by bands: the same documents stay."""
    rows = []
    for g in range(3):
        body = prose(700 + g, 120).split()
        for k in range(60):
            copy = list(body)
            copy[(7 * k) % 120] = f"y{k}"
            rows.append((1000 * g + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id for r in simhash.without_near_duplicates(df).collect()}
    assert want == {0, 1000, 2000}
    for size, bands in ((16, 54), (16, 2)):
        monkeypatch.setattr(simhash, "TREE_SIZE", size)
        monkeypatch.setattr(simhash, "PARTS_BEFORE_BANDS", bands)
        assert {r.doc_id for r in simhash.without_near_duplicates(df).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 502), (502, 500), (7, 7)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r["vertex"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 500 for i in (500, 501, 502)) and all(got[1000 + i] == 1000 for i in range(60))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_similar_groups(request, which):
    df = request.getfixturevalue(which)
    rows = df.collect()
    texts = sorted({r.text or "" for r in rows})
    sets, grams = Sets(), [shingles(t) for t in texts]
    for i, a in enumerate(grams):
        sets.root(i)
        for j, b in enumerate(grams[:i]):
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b) and a & b:
                sets.join(i, j)
    number = {t: i for i, t in enumerate(texts)}
    groups = Counter(sets.root(number[r.text or ""]) for r in rows)
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    got = Counter(sets.root(number[r.text or ""]) for r in kept.collect())
    assert got == Counter(dict.fromkeys(groups, 1))
    smallest = {}
    for r in rows:
        k, i = sets.root(number[r.text or ""]), (r.doc_id is not None, r.doc_id or 0)
        smallest[k] = min(i, smallest.get(k, i))
    assert {(r.doc_id is not None, r.doc_id or 0) for r in kept.collect()} == set(smallest.values())


def test_repeated_lines_dont_hide_similarity(spark):
    """The same words with a line 30 times and once: similarity 0.996, whatever the repeats do to a fingerprint."""
    rows = []
    for k in range(40):
        body, line = prose(k, 1000), prose(9000 + k, 8)
        rows += [(2 * k, body + ("\n" + line) * 30), (2 * k + 1, body + "\n" + line)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2 * k for k in range(40)]


@pytest.mark.parametrize("shared, left, right", [(4, 0, 1), (8, 1, 1), (80, 20, 0), (80, 10, 10), (800, 100, 100)])
def test_min_hash_bits_at_the_limit(shared, left, right):
    """Bits of pairs at similarity 0.8 differ as often as the binomial law says, for small sets and one-sided ones too."""
    assert simhash.miss_rate(0.8) < 1e-9
    r, far = np.random.default_rng(shared + left), []
    number = lambda h: int.from_bytes(simhash.min_hash_bits(simhash.min_hashes(h)), "little")
    for _ in range(300):
        h = r.integers(0, 1 << 64, shared + left + right, dtype=np.uint64)
        far.append((number(h[: shared + left]) ^ number(np.concatenate((h[:shared], h[shared + left :])))).bit_count())
    assert abs(np.mean(far) - 25.6) < 2 and max(far) <= 50


def test_pairs_at_the_limit_meet():
    """At similarity 0.8 the bands lose less than one link in a thousand million; all of 4,000 pairs share one."""
    assert (1 - 0.8**simhash.ROWS) ** simhash.BANDS < 1e-9
    r = np.random.default_rng(8)
    for _ in range(4000):
        h = r.integers(0, 1 << 64, 45, dtype=np.uint64)
        assert set(simhash.band_keys(simhash.min_hashes(h[:40]))) & set(simhash.band_keys(simhash.min_hashes(h[[*range(36), *range(40, 45)]])))


def test_empty(nothing):
    assert simhash.near_duplicate_table(nothing).count() == 0
    assert simhash.without_near_duplicates(nothing).count() == 0
    assert substring_dedup.repeat_table(nothing).count() == 0
    assert substring_dedup.without_repeats(nothing).count() == 0


def test_gear_hash():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(200)), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 2) + int(substring_dedup.GEAR[b])) % (1 << 32)
        want.append(h)
    assert substring_dedup.rolled(data).tolist() == want


def test_chunks_cover_and_resist_shifts():
    text = ("  " + prose(20, 400) + "\n\t " + prose(22, 400) + " \n").encode()
    line, starts, words = substring_dedup.chunk_places(text)
    assert line == b" ".join(text.split()) + b" " and starts[0] == 0 and starts[-1] == len(line) and words[-1] == 800
    assert np.diff(words)[1:-1].max() <= substring_dedup.SPAN and (np.diff(words) > 0).all()
    real = substring_dedup.byte_places(text, words)
    assert real[0] == 0 and real[-1] == len(text)
    assert [text[a:b].split() for a, b in zip(real, real[1:])] == [line[a:b].split() for a, b in zip(starts, starts[1:])]

    def pieces(t):
        line, at, _ = substring_dedup.chunk_places(t)
        return {line[a:b] for a, b in zip(at, at[1:])}

    changed = prose(21, 3).encode() + b" " + text[:2000] + b" inserted words " + text[2000:]
    assert len(pieces(text) & pieces(changed)) > 0.85 * len(pieces(text))
    assert pieces(text) == pieces(b"\n".join(text.split()))
    for none in (b"  \n ", b""):
        assert [len(x) for x in substring_dedup.chunk_places(none)] == [0, 1, 1]


def shared_runs(texts, n):
    """Documents (id, text) that have ``n`` words in a row which an earlier document has."""
    first, found = {}, set()
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) != i:
                found.add(i)
    return found


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_repeats(request, which):
    df = request.getfixturevalue(which)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rows = substring_dedup.repeat_table(df).collect()
    got = {r.doc_id for r in rows}
    assert shared_runs(texts, 51) <= got <= shared_runs(texts, 8)
    bodies = defaultdict(list)
    for i, t in texts:
        bodies[i].append((t or "").encode())
    for r in rows:
        assert r.doc_id != r.first_doc_id and any(len(b) >= r.end_byte > r.start_byte for b in bodies[r.doc_id])
        assert r.n_words >= substring_dedup.MIN_WORDS


def test_every_long_passage_is_found(spark):
    """A passage of 51 words at any place of another document, many times over."""
    r, rows = random.Random(9), []
    for k in range(150):
        passage = prose(1000 + k, 51)
        rows.append((2 * k, prose(5000 + k, 80) + " " + passage + " " + prose(6000 + k, 80)))
        rows.append((2 * k + 1, prose(7000 + k, r.randint(0, 90)) + "\n" + passage + " " + prose(8000 + k, r.randint(1, 90))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeat_table(df).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(150)}


def test_repeated_units_are_found(spark):
    """A passage of one to eight words again and again, also where line breaks stand elsewhere than in the first document."""
    rows, key = [], 0
    for period in range(1, 9):
        for length in (51, 60, 200):
            for k in range(20):
                unit = prose(50_000 + 100 * period + 1000 * length + k, period).split()
                passage = (unit * length)[:length]
                wrapped = "\n".join(" ".join(passage[i : i + 10]) for i in range(0, length, 10)) if k % 2 else " ".join(passage)
                rows.append((key, prose(2_000_000 + key, 80) + " " + " ".join(passage) + " " + prose(3_000_000 + key, 80)))
                rows.append((key + 1, prose(4_000_000 + key, 60) + "\t" + wrapped + "  " + prose(5_000_000 + key, 60)))
                key += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in substring_dedup.repeat_table(df).collect()}
    assert {i for i, _ in rows if i % 2} <= shared_runs(rows, 51) <= found <= shared_runs(rows, 8)
    cut = {r.doc_id: len(r.text.split()) for r in substring_dedup.without_repeats(df).collect()}
    assert all(cut[i] < len(t.split()) for i, t in rows if i % 2)


def test_rows_without_an_id(spark):
    """Each text without an id is a document of its own: repeats among them and with others are found, and cut where they are."""
    passage = prose(1, 80)
    rows = [(None, prose(10 + k, 50) + " " + passage + " " + prose(20 + k, 50)) for k in range(3)] + [(5, prose(30, 40) + "\n" + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeat_table(df).collect()
    assert sorted(str(r.doc_id) for r in found) == ["5", "None", "None"] and all(r.first_doc_id is None for r in found)
    texts = {r.text for r in substring_dedup.without_repeats(df).collect()}
    before = {t for _, t in rows}
    assert len(texts & before) == 1 and all(len(t) < len(max(before, key=len)) - 200 for t in texts - before)
    one = spark.createDataFrame([(None, rows[0][1])] * 2, "doc_id long, text string")
    assert substring_dedup.repeat_table(one).count() == 0  # rows of equal id and text are one document


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_without_repeats(request, which):
    df = request.getfixturevalue(which)
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    spans = defaultdict(set)
    for r in substring_dedup.repeat_table(df).collect():
        spans[r.doc_id].add((r.start_byte, r.end_byte))
    before = {}
    for r in df.collect():
        before.setdefault(r.doc_id, []).append(r.text)
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        if r.doc_id not in spans:
            assert r.text in before[r.doc_id]
        elif len(before[r.doc_id]) == 1:
            b = before[r.doc_id][0].encode()
            for a, e in sorted(spans[r.doc_id], reverse=True):
                b = b[:a] + b[e:]
            assert r.text == b.decode()


def test_pipeline(spark, data, docs, edge, nothing):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_dedup", "mixing", "bpe"]
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    for df in (edge, nothing):
        stage = df
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            stage = f(spark, stage, data)
            if k < 4:
                assert stage.columns == df.columns
        assert stage.count() >= 0
