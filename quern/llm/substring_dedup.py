"""Passages that repeat across documents, by content-defined chunks.

A gear hash rolls over the words of a text, joined by single spaces: each step shifts it by two bits and adds the byte's
random number, so that it depends on the last 16 bytes alone. A word may begin a chunk if the hash before it is the least
of ``SPAN`` words in a row; of equal ones the last is taken. Chunks thus end where the content says, an insertion moves no
cut that is further away than ``SPAN`` words, and in any ``SPAN`` words there is a cut. Chunks are compared by the digest of
their words, so white space and line breaks make no difference; places are those of the text as it is. A digest that occurs in
several documents belongs to the first one by id; in the others, neighbouring chunks of that kind form a run, and a run
of ``MIN_WORDS`` words or more is a repeat, unless it consists of short chunks that may be equal by chance. Of a passage
of ``2 * SPAN + MIN_WORDS + 2`` words all but its ends lies in whole chunks, so each such passage (over 50 words) is found
wherever it stands. Where it repeats a unit of few words, all of its chunks are short; so ``MIN_WORDS`` words in a row that
have few words in longer chunks get a digest of their own, and a run that shares one with an earlier document is a repeat.

Only narrow rows are shuffled: digest, document, place and length. Minima are aggregated before the shuffle, and the join
that follows is an equi-join whose large partitions Spark can split, so a passage in very many documents gathers nowhere.

Defined cases: null and empty texts have no chunks; rows of equal id count as one document, whatever their texts; a row
without an id is a document of its own text, and those come first, by a hash of the text. Repeats inside one document
alone are left. A text of any length is read whole, by a worker that holds some 40 times its bytes meanwhile. Columns of the
input pass through :func:`without_repeats` whatever their names; ``n_chars``, if there, is computed anew. An empty table is
fine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import arrow_schema
from quern.scratch import scope, written
from quern.session import prepared

SPAN = 16
MIN_WORDS = 16
#: Chunks of fewer words are often equal by chance: at least half of ``MIN_WORDS`` must lie in chunks of so many, or
#: ``MIN_WORDS`` words must follow one another in an earlier document too.
ANCHOR_WORDS = 4
WINDOW_BYTES = 16
STRETCH_SEED = 1
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: ``h = (h << 2) + GEAR[byte]``, of which 16 bytes fit into 32 bits.

    The sum over a window of 16 is made from sums over 1, 2, 4 and 8.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) <= k:
            break
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(2 * k)
        h = more
    return h


def chunk_places(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text, each with a space behind it; where its chunks begin there, and at which word, each with the end
    as a last item."""
    line = b" ".join(text.split()) + b" "
    if len(line) == 1:
        return b"", np.zeros(1, np.int64), np.zeros(1, np.int64)
    data = np.frombuffer(line, np.uint8)
    begins = np.concatenate(([0], np.flatnonzero(data == 32) + 1))
    inner = begins[1:-1]
    cuts = np.empty(0, np.int64)
    if len(inner) >= SPAN:
        h = rolled(data)[inner - 1]
        views = np.lib.stride_tricks.sliding_window_view(h, SPAN)
        picks = np.empty(len(views), np.int64)
        for at in range(0, len(views), 1 << 14):
            part = views[at : at + (1 << 14)]
            picks[at : at + len(part)] = np.arange(at, at + len(part)) + SPAN - 1 - part[:, ::-1].argmin(axis=1)
        cuts = np.unique(picks) + 1
    words = np.concatenate(([0], cuts, [len(begins) - 1]))
    return line, begins[words], words


def byte_places(text: bytes, words: np.ndarray) -> np.ndarray:
    """Where the words of these numbers begin in a text; the first one at 0 and one beyond the last at the end."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(data) else np.empty(0, np.int64)
    out = np.concatenate((begins, [len(data)]))[words]
    return np.where(words == 0, 0, out)


def short_stretches(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First chunks and ends (the chunk after the last) of the least stretches of ``min_words`` words, of those with less
    than half of them in chunks of ``ANCHOR_WORDS`` or more."""
    upto = np.concatenate(([0], np.cumsum(words)))
    anchored = np.concatenate(([0], np.cumsum(np.where(words >= ANCHOR_WORDS, words, 0))))
    first = np.arange(len(words))
    end = np.searchsorted(upto, upto[:-1] + min_words)
    inside = end <= len(words)
    first, end = first[inside], end[inside]
    few = 2 * (anchored[end] - anchored[first]) < min_words
    return first[few], end[few]


def _keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart, as two numbers."""
    return [F.xxhash64(text).alias("v1"), F.xxhash64(F.lit(1), text).alias("v2")]


def chunks(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``digest, doc, v1, v2, start, size, words, stretch`` for every chunk and, marked, every stretch of short chunks;
    ``v1`` and ``v2`` tell texts of equal id apart."""
    t = F.col(f"`{text}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), *_keys(t), t.cast("binary").alias("text")).where(t.isNotNull())
    kind = narrow.schema["doc"].dataType.simpleString()
    ddl = f"digest long, doc {kind}, v1 long, v2 long, start int, size int, words int, stretch boolean"
    kinds = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                digests, rows, places, marks = [], [], [], []
                for i, body in enumerate(part.column(3).to_pylist()):
                    line, s, at_word = chunk_places(body)
                    view, w, real = memoryview(line), np.diff(at_word), byte_places(body, at_word)
                    digests += [digest_of(view[a:b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                    first, end = short_stretches(w, min_words)
                    digests += [digest_of(view[a:b], STRETCH_SEED) for a, b in zip(s[first].tolist(), s[end].tolist(), strict=True)]
                    first, end = np.concatenate((np.arange(len(w)), first)), np.concatenate((np.arange(1, len(w) + 1), end))
                    rows.append(np.full(len(first), i, np.int64))
                    places.append(np.stack((real[first], real[end] - real[first], at_word[end] - at_word[first])))
                    marks.append(np.arange(len(first)) >= len(w))
                row, place = np.concatenate(rows), np.concatenate(places, axis=1).astype(np.int32)
                take = pa.array(row)
                columns = [pa.array(np.array(digests, np.uint64).view(np.int64)), *[part.column(k).take(take) for k in range(3)], *map(pa.array, place), pa.array(np.concatenate(marks))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    prepared(docs.sparkSession)
    return narrow.mapInArrow(run, ddl)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc, v1, v2, start, end, words, first_doc``: each repeat, by byte places, and a document that has it first."""
    every = written(chunks(docs, text, id_col, min_words), "chunks")
    # rows without an id are told apart by their text's first number; they come before all others
    bare = F.when(F.col("doc").isNull(), F.col("v1"))
    shared = every.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(bare).alias("least_bare"), F.max(bare).alias("most_bare"))
    several = (F.col("least") != F.col("most")) | (F.col("least_bare") != F.col("most_bare")) | (F.col("least").isNotNull() & F.col("least_bare").isNotNull())
    shared = shared.where(several).select(
        F.col("digest").alias("of"), F.col("least_bare").alias("first_bare"), F.when(F.col("least_bare").isNull(), F.col("least")).alias("first_doc")
    )
    # as a table of its own the side has no partitioning that the join would reuse, so Spark may split the hot digests
    shared = written(shared, "shared-chunks")
    own = F.col("doc").eqNullSafe(F.col("first_doc")) & bare.eqNullSafe(F.col("first_bare"))
    later = every.join(shared, F.col("digest") == F.col("of")).where(~own)
    # all chunks of a shared stretch are shared; its first one is named after the document that has the stretch
    later = later.groupBy("doc", "v1", "v2", "start").agg(
        F.min("size").alias("size"), F.min("words").alias("words"), F.max_by("first_doc", "words").alias("first_doc"), F.max("stretch").alias("stretch")
    )
    along = Window.partitionBy("doc", "v1", "v2").orderBy("start")
    fresh = F.coalesce((F.lag(F.col("start") + F.col("size")).over(along) != F.col("start")).cast("int"), F.lit(1))
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    # a run is named after the document that its largest share comes from; short chunks of common words come from anywhere
    each = runs.groupBy("doc", "v1", "v2", "run", "first_doc").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("words"),
        F.sum(F.when(F.col("words") >= ANCHOR_WORDS, F.col("words")).otherwise(0)).alias("anchored"), F.max("stretch").alias("stretch"),
    )
    spans = each.groupBy("doc", "v1", "v2", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.sum("anchored").alias("anchored"),
        F.max("stretch").alias("stretch"), F.max(F.struct("words", "first_doc")).alias("most"),
    )
    found = spans.where((F.col("words") >= min_words) & (F.col("stretch") | (2 * F.col("anchored") >= min_words)))
    return found.select("doc", "v1", "v2", "start", "end", "words", F.col("most.first_doc").alias("first_doc"))


def repeat_table(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, first_doc_id, start_byte, end_byte, n_words`` for every repeat; documents without one have no row."""
    found = repeats(docs, min_words, text, id_col)
    return found.select(
        F.col("doc").alias("doc_id"), F.col("first_doc").alias("first_doc_id"), F.col("start").cast("long").alias("start_byte"),
        F.col("end").cast("long").alias("end_byte"), F.col("words").cast("long").alias("n_words"),
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every repeat cut out of the texts; all rows stay."""
    with scope() as keep:
        found = repeats(docs, min_words, text, id_col)
        spans = found.groupBy(F.col("doc").alias("__doc"), F.col("v1").alias("__f1"), F.col("v2").alias("__f2")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
        spans = keep(written(spans, "repeat-spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("__row"), F.col(f"`{id_col}`").alias("__id"), *[k.alias(f"__k{i}") for i, k in enumerate(_keys(F.col(f"`{text}`")), 1)])
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__k1") == F.col("__f1")) & (F.col("__k2") == F.col("__f2"))
    joined = keyed.join(spans, same, "left")
    body = F.col("__row").getField(text).cast("binary")
    joined = joined.withColumn("__body", F.when(F.col("__spans").isNotNull(), body))
    starts = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["end"]))
    upto = lambda i: F.coalesce(F.get("__spans", i)["start"], F.octet_length("__body"))
    pieces = F.transform(starts, lambda at, i: F.substring(F.col("__body"), at + 1, upto(i) - at).cast("string"))
    new = F.when(F.col("__spans").isNull(), F.col("__row").getField(text)).otherwise(F.array_join(pieces, ""))
    joined = joined.withColumn("__new", new)
    columns = []
    for c in docs.columns:
        value = F.col("__row").getField(c)
        if c == text:
            value = F.col("__new")
        elif c == "n_chars":
            value = F.when(F.col("__spans").isNull(), value).otherwise(F.length("__new").cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return joined.select(*columns)
