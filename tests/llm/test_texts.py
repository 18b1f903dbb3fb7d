"""BPE, language ID, classifier and nearest neighbours against libraries and brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, bpe, language_id, quality_cnn
from quern.session import table


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_bpe(request, library, which):
    df = request.getfixturevalue(which)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.round_trip(df).collect()))) == sorted(map(str, want))


def test_bpe_parts(spark, edge, nothing, library):
    c = bpe.Codec(bpe.vocabulary_path())
    for text in ("", " ", "\n\n  x", "don't I'LL", "a<|endoftext|>b", " 　 z", "\x85\x1c", "é́", "١٢٣ Ⅷ", "x" * 300, "😀😀", "<|endoftext|>" * 2):
        ids = library.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids, repr(text)
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    some = [list(range(n, n + 5)) for n in range(100, 50_000, 997)]  # ids that are no valid UTF-8 on their own
    assert [c.decode(x) for x in some] == [library.decode(x, skip_special_tokens=False) for x in some]
    back = bpe.decoded(bpe.encoded(edge))
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in edge.collect())
    assert bpe.round_trip(nothing).count() == 0 and bpe.encoded_rows(nothing).columns == ["doc_id", "source", "n_tokens", "ids"]


def test_stale_entries():
    """Merging by a priority queue equals merging the best pair of all, again and again."""
    c = bpe.Codec(bpe.vocabulary_path())
    for word in ("aaaaaaaaab", " ththththth", "ababababab", "  ", "inininin"):
        ids = [c.byte_id[b] for b in word.encode()]
        while True:
            best = min(((c.merges[p][0], i) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in c.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [c.merges[ids[i], ids[i + 1]][1]]
        assert list(c.merge(word.encode())) == ids


def test_language_segmentations():
    model = language_id.learn({"aa": {"the": 5, "cat": 3}, "bb": {"der": 4, "schung": 2}})
    known = language_id.pieces(model.path)

    def brute(w, lang):
        def rest(i):
            if i == len(w):
                return 1.0
            return sum(model.prob[known.get(w[i : i + k], len(known) if k == 1 else len(known) + 1), lang] * rest(i + k) for k in range(1, min(language_id.MOST_PIECE, len(w) - i) + 1))

        return np.log(rest(0))

    for w in ("the", "schung", "ñandú", "x"):
        got = language_id.log_likelihoods([w], known, model.prob)[0]
        assert np.allclose(got, [brute(language_id.MARK + w, k) for k in (0, 1)])
    long = language_id.log_likelihoods(["the" * 2000], known, model.prob)[0]
    assert np.isfinite(long).all()


def test_all_pieces_take_part():
    """The longest pieces of letters are in the vocabulary and in the segmentations."""
    known = language_id.pieces(language_id.vocabulary_path())
    assert {"▁function", "▁business", "translation"} <= set(known) and max(map(len, known)) == language_id.MOST_PIECE
    assert known["▁function"] in language_id.lattices(["▁function"], known) and known["translation"] in language_id.lattices(["▁translation"], known)


def test_every_language_is_learnt(spark, monkeypatch):
    """With more languages than fit at the full number of rows, each has fewer rows; long runs of letters are learnt too."""
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(10 * k + i, f"l{k}", f"word{'abcde'[k]}") for k in range(5) for i in range(10)], "doc_id long, lang string, text string")
    got = language_id.training_words(df, lambda i: i.isNotNull(), most=5)
    assert {x: sum(c.values()) for x, c in got.items()} == {f"l{k}": 2 for k in range(5)}
    model = language_id.learn({"aa": {"the" * 30: 9}, "bb": {"der" * 30: 9}})
    assert language_id.predict(model, ["thethe", "derder"])[0] == ["aa", "bb"]
    known = language_id.pieces(model.path)
    assert not np.allclose(model.prob[:-1, 0], model.prob[0, 0]) and model.prob[known["the"], 0] > model.prob[known["the"], 1]


def test_language_table(docs, edge, nothing):
    rows = language_id.language_table(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    got = [(r.doc_id, r.lang_pred) for r in language_id.language_table(edge).collect()]
    assert {(2, "und"), (3, "und"), (4, "und"), (14, "und")} <= set(got) and len(got) == edge.count()
    assert all(p in ("en", "fr", "de", "und") for _, p in got)
    assert language_id.language_table(nothing).count() == 0
    unlearned = language_id.language_table(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_network_learns():
    """Filters and layers learn to tell two kinds of texts apart."""
    texts, labels = [b"abcdef" * 30, b"uvwxyz" * 30] * 20, [1, 0] * 20
    net = quality_cnn.train(texts, labels, epochs=15)
    assert quality_cnn.score(net, texts[0]) > 0.9 and quality_cnn.score(net, texts[1]) < 0.1


def test_network_covers_text():
    """The last bytes count as much as the first, and chunks are pooled as if each were computed alone."""
    net = quality_cnn.Network.fresh()
    data = np.frombuffer(bytes((i * 37) % 251 for i in range(3 * quality_cnn.CHUNK)), np.uint8)
    whole = quality_cnn.pooled(net, data)
    by_chunk = [quality_cnn.answers(net, data[a : a + quality_cnn.CHUNK + quality_cnn.WIDTH - 1]).max(axis=0) for a in range(0, len(data) - quality_cnn.CHUNK + 1, quality_cnn.STEP)]
    assert np.allclose(whole[:-1], np.maximum(by_chunk + net.bias, 0)[: len(whole) - 1], atol=1e-5)
    changed = data.copy()
    changed[-quality_cnn.WIDTH :] = 255 - changed[-quality_cnn.WIDTH :]
    assert not np.allclose(quality_cnn.pooled(net, changed)[-1], whole[-1])


def test_training_sees_whole_texts():
    """A signal that stands in the middle of long texts alone is learnt."""
    r, texts, labels = np.random.default_rng(3), [], []
    for k in range(80):
        body = b" ".join(r.choice([b"plain", b"words", b"of", b"some", b"text"], 5_000).tolist())[:20_000]
        texts.append(body[:6000] + b"#$%&" * 25 + body[6100:] if k % 2 else body)
        labels.append(1 - k % 2)
    net = quality_cnn.train(texts[:60], labels[:60], epochs=20)
    assert np.mean([(quality_cnn.score(net, t) > 0.5) == y for t, y in zip(texts[60:], labels[60:], strict=True)]) > 0.9


@pytest.mark.parametrize("n", [6, 100, 261, 262, 517, 518, 800, 5000, 16_389, 16_390, 40_000])
def test_training_pools_as_scoring(n):
    net = quality_cnn.Network.fresh()
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    rows, places = quality_cnn.pooled_from(net, data)
    assert np.allclose(rows, quality_cnn.pooled(net, data), atol=1e-5)
    every = quality_cnn.answers(net, data)
    assert np.allclose(rows, np.maximum(every[places, np.arange(quality_cnn.FILTERS)] + net.bias, 0), atol=1e-5)


def test_quality_table(spark, docs, edge, nothing):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    big = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r for r in quality_cnn.quality_table(big, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(rows[i].predicted, y) for i, y in truth.items() if rows[i].held_out]
    assert len(rows) == 1000 and sum(p == y for p, y in held) / len(held) > 0.85
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    small = quality_cnn.quality_table(edge, labels).collect()
    assert len(small) == edge.count() and all(0 <= r.score <= 1 for r in small)
    assert quality_cnn.quality_table(nothing, labels).count() == 0
    assert {r.score for r in quality_cnn.quality_table(edge, labels.limit(0)).collect()} == {0.5}


def brute(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((w.astype(float) - v.astype(float)) ** 2).sum())), j) for j, w in usable if j != i and len(w) == len(v))[:k]
    return out


@pytest.mark.parametrize("part_rows", [16_384, 700])
def test_neighbours(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ann, "PART_ROWS", part_rows)
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()], 10)
    got = {}
    for r in ann.neighbours(e, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    assert np.mean([len({j for _, j in got[i]} & {j for _, j in want[i]}) / 10 for i in want]) >= 0.9
    exact = {i: {j: d for d, j in brute_row} for i, brute_row in want.items()}
    assert all(d == exact[i][j] for i, x in got.items() for d, j in x if j in exact[i])


def test_neighbour_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (100, [0.0, 0.0]), (200, [2.0, 0.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, part string")
    got = [tuple(r) for r in ann.neighbours(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 8, 0.0), (0, 3, 8, 0.0), (0, 4, 2, 2.0**0.5)]
    assert ann.neighbours(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_neighbours_of_doubles(spark):
    """Scores are those of the original doubles, bit for bit, whatever their size; what overflows comes last."""
    r = np.random.default_rng(5)
    for scale in (1.0, 1e-200, 1e160):
        rows = [(i, (scale * r.normal(size=8)).tolist()) for i in range(300)]
        got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()
        want = brute(rows, 10)
        assert len(got) == 30
        for q, expected in want.items():
            mine = [(x.score, x.vec_id) for x in got if x.query_id == q]
            assert scale == 1e160 or len(set(mine) & set(expected)) >= 9, (scale, q)
            assert all(d == float(np.sqrt(((np.array(rows[j][1]) - np.array(rows[q][1])) ** 2).sum())) for d, j in mine)
    near = [(0, [0.1, 0.2]), (1, [0.3, 0.2]), (2, [1e300, 0.0]), (3, [5e-324, 0.0])]
    got = ann.neighbours(spark.createDataFrame(near, "vec_id long, embedding array<double>"), lambda i: i == 0).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(1, 0.19999999999999998), (3, float(np.hypot(0.1, 0.2))), (2, float("inf"))]


def test_training_rows(spark):
    """Labels of ids that the table doesn't have take no places, and texts too long for the bound leave all others in."""
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(None, "y"), (7, "other")], "doc_id long, text string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    texts, y = quality_cnn.training_rows(docs, labels, lambda i: i.isNotNull(), most=40)
    assert len(texts) == len(y) == 40
    texts, _ = quality_cnn.training_rows(docs, labels, lambda i: i.isNotNull(), most_bytes=1234)
    assert 1000 < sum(map(len, texts)) <= 1234 and {len(t) for t in texts} <= {100, 5}
    long = docs.union(spark.createDataFrame([(i, "z" * 5000) for i in range(100, 130)], docs.schema))
    texts, _ = quality_cnn.training_rows(long, labels, lambda i: i.isNotNull(), most_bytes=4000)
    assert sum(len(t) == 100 for t in texts) > 35 and max(map(len, texts)) == 100
    texts, y = quality_cnn.training_rows(long.where("doc_id >= 100"), labels, lambda i: i.isNotNull(), most_bytes=4000)
    assert sorted(y) == [0, 1]


def test_score_by_plain_forward_pass():
    """The score of a text, computed place by place, chunk by chunk and layer by layer."""
    q, r = quality_cnn, np.random.default_rng(9)
    net = q.Network.fresh()
    net.bias += r.normal(0, 0.3, q.FILTERS).astype(np.float32)
    net.b1 += r.normal(0, 0.3, q.HIDDEN).astype(np.float32)
    net.mean, net.scale = r.normal(0, 1, len(net.mean)).astype(np.float32), r.uniform(0.5, 2, len(net.mean)).astype(np.float32)
    for n in (0, 3, 6, 300, 517, 700, 1300, 2000):
        text = bytes(r.integers(0, 256, n, dtype=np.uint8))
        data = text + b"\0" * max(0, q.WIDTH - n)
        answer = [[sum(float(net.table[k][data[i + k]][f]) for k in range(q.WIDTH)) for f in range(q.FILTERS)] for i in range(len(data) - q.WIDTH + 1)]
        halves = [answer[a : a + q.STEP] for a in range(0, len(answer), q.STEP)]
        if len(halves) > 2 and len(answer) % q.STEP:
            halves[-2:] = [halves[-2] + halves[-1]]
        chunks = [a + b for a, b in zip(halves, halves[1:], strict=False)] or halves
        rows = [[max(0.0, max(x[f] for x in chunk) + float(net.bias[f])) for f in range(q.FILTERS)] for chunk in chunks]
        columns = list(zip(*rows, strict=True))
        x = [*map(max, columns), *map(min, columns), *[sum(c) / len(c) for c in columns], math.log(1 + n) / 10]
        x = [(a - float(m)) / float(s) for a, m, s in zip(x, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * float(net.w1[i][h]) for i, a in enumerate(x)) + float(net.b1[h])) for h in range(q.HIDDEN)]
        z = sum(a * float(w) for a, w in zip(hidden, net.w2, strict=True)) + float(net.b2[0])
        assert abs(q.score(net, text) - 1 / (1 + math.exp(-z))) < 1e-4
