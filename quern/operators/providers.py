"""Model providers: embedding, reranking and text generation behind names, with deterministic defaults that need no model.

A provider is a function of lists. ``register_provider`` puts another one in its place, for instance a client of a model
server; it then runs in Arrow batches on the executors.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.session import prepared

DIM = 64


def hashed_embedding(texts: list[str]) -> list[list[float]]:
    """Token counts in 64 signed buckets by CRC-32, of length 1."""
    out = []
    for text in texts:
        v = [0.0] * DIM
        for token in re.findall("[0-9a-z가-힣]+", (text or "").lower()):
            h = zlib.crc32(token.encode())
            v[h % DIM] += 1.0 if h & 0x10000 else -1.0
        length = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / length for x in v])
    return out


def first_sentence(texts: list[str]) -> list[str | None]:
    """A synopsis without a model: the first sentence, or none of short texts."""
    return [None if len(t or "") < 200 else re.split(r"(?<=[.!?])\s", (t or "")[:1500].strip())[0][:500] for t in texts]


def no_text(prompts: list[str]) -> list[str | None]:
    """Generation without a model: nothing."""
    return [None] * len(prompts)


class RunningCounts(Sequence):
    """A vector for each byte of a text: the signed counts, in 64 buckets, of all bytes up to it. A vector is made when it is
    asked for, from the one asked for before if that stands in front."""

    def __init__(self, text: str | None):
        import numpy as np

        self.data = np.frombuffer((text or "").encode(), np.uint8)
        self.upto, self.counts = 0, np.zeros(256, np.int64)

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int):
        import numpy as np

        end = range(len(self.data))[i] + 1
        if end < self.upto:
            self.upto, self.counts = 0, np.zeros(256, np.int64)
        self.counts = self.counts + np.bincount(self.data[self.upto : end], minlength=256)
        self.upto = end
        of = self.counts.reshape(4, DIM)  # bytes from 0x80 on, the last two rows, count against the others
        return (of[0] + of[1] - of[2] - of[3]).astype(np.float32)


def running_tokens(texts: list[str]) -> list:
    """:class:`RunningCounts` of each text. A vector depends on what stands in front, as a model's would."""
    return [RunningCounts(t) for t in texts]


#: ``embed`` and ``synopsis``: texts; ``rerank``: a query and texts, to scores, or None for :func:`overlap`; ``generate``:
#: prompts to texts or None; ``tokenize``: texts to token ids (numbers below 2**63); ``token_embed``: texts to a vector for each token.
PROVIDERS: dict[str, Callable | None] = {
    "embed": hashed_embedding, "synopsis": first_sentence, "rerank": None, "generate": no_text, "tokenize": lambda texts: [(t or "").encode() for t in texts],
    "token_embed": running_tokens,
}


def register_provider(kind: str, f: Callable | None) -> None:
    if kind not in PROVIDERS:
        raise ValueError(f"unknown kind of provider: {kind}")
    PROVIDERS[kind] = f


def health() -> dict[str, str]:
    """``ok`` for each provider that answers, else the name of what it raised."""
    probes = {"embed": (["x"],), "synopsis": (["x"],), "rerank": ("x", ["x"]), "generate": (["x"],), "tokenize": (["x"],), "token_embed": (["x"],)}
    out = {}
    for kind, f in PROVIDERS.items():
        try:
            if f is not None:
                f(*probes[kind])
            out[kind] = "ok"
        except Exception as e:  # a report on providers of any kind
            out[kind] = type(e).__name__
    return out


def token_counts(texts: list[str], end: str = fixed.LATE_END) -> list[int]:
    """Tokens of each text with the end mark: the whole is tokenised at once and cut at the mark; if that gives another
    number of parts, each text is tokenised alone."""
    import numpy as np

    ids = lambda x: np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.asarray(x, np.int64)
    f = PROVIDERS["tokenize"]
    mark, whole = ids(f([end])[0]), ids(f(["".join(t + end for t in texts)])[0])
    if 0 < len(mark) <= len(whole):
        at = np.flatnonzero(whole[: len(whole) - len(mark) + 1] == mark[0])
        for k in range(1, len(mark)):
            at = at[whole[at + k] == mark[k]]
        if len(at) == len(texts):
            return np.diff(at + len(mark), prepend=0).tolist()
    return [len(x) for x in f([t + end for t in texts])]


def _column(f: Callable[[list], list], kind: str) -> Callable[[Column], Column]:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for s in batches:
            yield pd.Series(f(list(s)), dtype=object)

    prepared(SparkSession.active())
    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)


def embed(c: Column) -> Column:
    return _column(PROVIDERS["embed"], "array<float>")(c)


def synopsis(c: Column) -> Column:
    return _column(PROVIDERS["synopsis"], "string")(c)


def embed_one(text: str) -> list[float]:
    return PROVIDERS["embed"]([text])[0]


def overlap(query: str, text: Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that a text has."""
    asked = F.array_distinct(X.tokens(F.lower(F.lit(query))))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, X.token_set(text))) / F.size(asked))


def rerank_score(query: str, text: Column) -> Column:
    """The score of texts for a query by the registered reranker, else by :func:`overlap`."""
    f = PROVIDERS["rerank"]
    if f is None:
        return overlap(query, text)
    return _column(lambda texts: [float(x) for x in f(query, texts)], "double")(text)


def rerank(hits: DataFrame, query: str, order: str = "pos", text: Column | str = "text") -> DataFrame:
    """``score`` and ``rank``: by score, ties by the order the hits came in. No threshold."""
    from quern.operators.fusion import with_rank

    return with_rank(hits.withColumn("score", rerank_score(query, F.col(text) if isinstance(text, str) else text)), "rank", F.col("score").desc(), F.col(order))


def generated(prompt: Column) -> Column:
    return _column(PROVIDERS["generate"], "string")(prompt)


def thread_contexts(threads: DataFrame, prompt: str = "#{channel}\n{text}") -> DataFrame:
    """``channel_id, thread_ts, context`` of assembled threads by the generation provider: of the first characters, none of
    short threads or notices, and only answers that can be used. Threads that have a context already are left out before."""
    body = F.left("body", F.lit(fixed.THREAD_SAMPLE))
    asked = threads.where((F.length(body) >= fixed.THREAD_LEAST) & ~body.contains("상태 변경됨"))
    before, after = prompt.replace("{channel}", "\0").split("{text}")
    filled = F.concat(F.replace(F.lit(before), F.lit("\0"), F.col("channel_name")), body, F.lit(after))
    answer = F.trim(generated(filled))
    usable = (F.length("context") >= 8) & ~F.upper("context").startswith("SKIP")
    for word in fixed.THREAD_STATUS:
        usable = usable & ~F.col("context").contains(word)
    out = asked.select("channel_id", "thread_ts", answer.alias("context")).where(usable)
    return out.withColumn("context", F.left("context", F.lit(fixed.THREAD_MOST)))


def usable_synopsis(answer: Column) -> Column:
    """A generated synopsis without quotes around it; null if it is short or says SKIP."""
    bare = F.trim(F.btrim(F.trim(answer), F.lit('"')))
    return F.when((F.length(bare) >= fixed.SYNOPSIS_SHORT) & ~F.upper(bare).startswith("SKIP"), bare)


def file_synopsis(text: Column, prompt: str = "{text}") -> Column:
    """The synopsis of a file's text by the generation provider: of its first characters, none of short texts."""
    before, after = prompt.split("{text}")
    sample = F.left(F.trim(text), F.lit(fixed.SYNOPSIS_SAMPLE))
    return F.when(F.length(sample) >= fixed.SYNOPSIS_LEAST, usable_synopsis(generated(F.concat(F.lit(before), sample, F.lit(after)))))


def rerank_text(hit: dict[str, Column]) -> Column:
    """What a reranker reads of a hit: name, folder, context, synopsis and body, or channel, thread and parent of a chat."""
    part = lambda label, k: F.when(F.coalesce(hit[k], F.lit("")) != "", F.concat(F.lit(label), hit[k])) if k in hit else F.lit(None).cast("string")
    return F.concat_ws("\n", part("file: ", "name"), part("folder: ", "root"), part("channel: ", "channel_name"), part("context: ", "context"), part("synopsis: ", "synopsis"), part("thread: ", "parent_context"), part("", "text"))
