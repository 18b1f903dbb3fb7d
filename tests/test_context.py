"""Late chunking against brute force, and prompts for chunk contexts: bounds, scopes and texts with odd characters."""

import math
import random

import pytest

from quern.functions import fixed
from quern.operators import context, providers

CHUNKS = "file_id string, idx long, text string"


def vector(text):
    """The default provider's vector of the last token of a text: signed counts of its bytes in 64 buckets, of length 1."""
    v = [0.0] * 64
    for b in text.encode():
        v[b % 64] += -1.0 if b & 0x80 else 1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def windows(counts, most, carry):
    """(first of its context, first of its own, end), the plain way."""
    out, i = [], 0
    while i < len(counts):
        j = i + 1
        while j < len(counts) and sum(counts[i : j + 1]) <= most:
            j += 1
        start = max(0, i - carry)
        while start < i and sum(counts[start:j]) > most:
            start += 1
        out.append((start, i, j))
        i = j
    return out


@pytest.mark.parametrize(("most", "carry"), [(7600, 2), (400, 2), (400, 1), (60, 3), (5, 2), (400, 0)])
def test_late_chunks(spark, most, carry):
    r = random.Random(most + carry)
    files = {f"f{k}": ["".join(r.choice("abc dé가") for _ in range(r.randint(0, 150))) for _ in range(r.randint(1, 30))] for k in range(7)}
    rows = [(f, i, t) for f, ts in files.items() for i, t in enumerate(ts)] + [("none", 0, None), ("gaps", 3, "x"), ("gaps", 9, "y")]
    r.shuffle(rows)
    got = {(x.file_id, x.idx): x for x in context.late_chunks(spark.createDataFrame(rows, CHUNKS).repartition(3), most, carry).collect()}
    assert set(got) == {(f, i) for f, i, _ in rows} and len(got) == len(rows)
    files |= {"none": [""]}
    for f, ts in files.items():
        counts = [len((t + fixed.LATE_END).encode()) for t in ts]
        for start, own, end in windows(counts, most, carry):
            for i in range(own, end):
                assert got[f, i].n_tokens == counts[i]
                assert got[f, i].vector == pytest.approx(vector("".join(t + fixed.LATE_END for t in ts[start : i + 1])), abs=1e-6)


def test_windows_hold_one_window():
    """Of a file of any length only a window's chunks are held."""
    taken = 0

    def chunks():
        nonlocal taken
        for i in range(100_000):
            taken += 1
            yield f"c{i}", 100

    seen = 0
    for texts, counts, front in context.late_windows(chunks()):
        seen += len(texts) - front
        assert sum(counts) <= fixed.LATE_TOKENS and front <= fixed.LATE_CARRY and taken - seen <= 1
    assert seen == taken == 100_000


def test_providers_that_disagree(spark, monkeypatch):
    monkeypatch.setitem(providers.PROVIDERS, "token_embed", lambda texts: [[[1.0]] for _ in texts])
    with pytest.raises(ValueError, match="token vectors"):
        context.late_window(["ab"], [15], 0)


def test_prompts(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefg {name} ") for _ in range(n))
    rows = [("small", i, f"t{i} {{body}} $1 \\n", None) for i in range(4)] + [("one", 0, None, "s")]
    rows += [("big", i, word(1200), f"s{i // 3}" if i < 9 else None) for i in range(40)] + [("long", i, "x" * 6000, "all") for i in range(3)]
    c = spark.createDataFrame(rows, f"{CHUNKS}, section string").repartition(3)
    files = spark.createDataFrame([(f, f"{f}.txt", "r", f"a/{f}.txt") for f in ("small", "big", "long")], "file_id string, name string, root string, path string")
    got = {(x.file_id, x.idx): x for x in context.context_material(c).collect()}
    texts = {(f, i): t or "" for f, i, t, _ in rows}
    assert {x.scope for x in got.values() if x.file_id in ("small", "one")} == {"full"} and got["small", 2].body == "\n".join(texts["small", i].strip() for i in range(4))
    assert [got["big", i].scope for i in (0, 8, 9, 39)] == ["section", "section", "local", "local"]
    strip = lambda t: t.strip(" \t\n\r")
    assert got["big", 4].body == strip("\n".join(texts["big", i] for i in (3, 4, 5)))
    assert got["big", 20].body == strip("\n".join(texts["big", i] for i in range(18, 23))) and got["big", 20].note == " 중 19~23번째 조각"
    assert got["big", 20].head == strip(texts["big", 0][:701])[:700] + (" …" if len(strip(texts["big", 0][:701])) > 700 else "") and got["small", 0].head == ""
    assert got["long", 1].scope == "local" and len(got["long", 1].body) == fixed.FULL_DOC + 2 and len(got["long", 1].target) == fixed.TARGET_CHARS + 2
    prompts = {(x.file_id, x.idx): x.prompt for x in context.context_prompts(c, files).collect()}
    assert set(prompts) == set(got)
    most = fixed.FULL_DOC + fixed.TARGET_CHARS + fixed.HEAD_CHARS + 500
    assert all(len(p) <= most for p in prompts.values())
    assert "t2 {body} $1 \\n" in prompts["small", 2] and '이름="small.txt"' in prompts["small", 2] and "현재 절: s1" in prompts["big", 4]
    assert context.context_prompts(c, files, "{target}|{name}|{unknown}").where("file_id = 'small' and idx = 1").first().prompt == "t1 {body} $1 \\n|small.txt|{unknown}"


def test_contexts(spark, monkeypatch):
    monkeypatch.setitem(providers.PROVIDERS, "generate", lambda prompts: ["SKIP" if "no" in p else f"context: about {p[:10]} and more" for p in prompts])
    p = spark.createDataFrame([("f", 0, "full", "yes yes yes"), ("f", 1, "full", "no")], "file_id string, idx long, scope string, prompt string")
    assert [tuple(x) for x in context.chunk_contexts(p).collect()] == [("f", 0, "full", "about yes yes ye and more")]
