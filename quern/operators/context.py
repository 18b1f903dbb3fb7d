"""What a chunk means in its file: late chunking, where a model reads windows of a file, and prompts for a line of context.

**Late chunking.** Chunks of a file are put together to windows of ``fixed.LATE_TOKENS`` tokens, each chunk with an end mark. A
window is read with up to two chunks of what stands before it, and a chunk's vector is that of its end mark, of length 1.
Files are dealt by id and sorted; a task goes through a file's chunks in order and holds one window at a time, so a file may
be of any length.

**Prompts.** A chunk is shown with its whole file, its section or the chunks beside it, whichever fits first. All of it comes
from windows over the file: texts are gathered only where their sum, known before, is within the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import chunking, providers
from quern.session import prepared

#: Rows of one frame of vectors.
OUT_ROWS = 1_000


#: Bytes of text of one task that goes through files.
TASK_BYTES = 16 << 20


def by_file(chunks: DataFrame) -> DataFrame:
    """``chunks`` dealt by file, into as many tasks as their texts need, which are counted first: a task's share doesn't grow with
    the table. A file stays whole."""
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(max(parts, -(-size // TASK_BYTES)), "file_id")


def late_window(texts: list[str], counts: list[int], own: int) -> list:
    """The vectors of the chunks from ``own`` on; those before are context. ``counts``: tokens of each with its end mark."""
    import numpy as np

    (tokens,) = providers.PROVIDERS["token_embed"](["".join(t + fixed.LATE_END for t in texts)])
    if len(tokens) != sum(counts):
        raise ValueError(f"{len(tokens)} token vectors for {sum(counts)} tokens")
    ends = np.cumsum(counts) - 1
    out = []
    for at in ends[own:]:
        v = np.asarray(tokens[at], np.float64)
        length = float(np.sqrt((v * v).sum()))
        out.append(v / length if length else v)
    return out


def late_windows(chunks: Iterator[tuple[str, int]], most: int = fixed.LATE_TOKENS, carry: int = fixed.LATE_CARRY) -> Iterator[tuple[list[str], list[int], int]]:
    """``(texts, counts, number of those that are context)`` of each window of a file, from its chunks with their tokens: as
    many chunks as fit, one at least, and then as much of the ``carry`` chunks before them as still fits."""
    before: list[tuple[str, int]] = []
    here: list[tuple[str, int]] = []

    def closed():
        front = list(before[-carry:]) if carry else []
        while front and sum(n for _, n in front) + sum(n for _, n in here) > most:
            front.pop(0)
        both = front + here
        return [t for t, _ in both], [n for _, n in both], len(front)

    for text, n in chunks:
        if here and sum(k for _, k in here) + n > most:
            yield closed()
            before, here = (before + here)[-carry:] if carry else [], []
        here.append((text, n))
    if here:
        yield closed()


def late_chunks(chunks: DataFrame, most: int = fixed.LATE_TOKENS, carry: int = fixed.LATE_CARRY) -> DataFrame:
    """``file_id, idx, n_tokens, vector`` of every chunk, with its end mark counted. ``chunks``: ``file_id, idx, text``; a null
    text counts as empty."""
    ordered = chunks.select("file_id", F.col("idx").cast("long").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = by_file(ordered).sortWithinPartitions("file_id", "idx")
    kind = chunks.schema["file_id"].dataType.simpleString()

    def run(frames):
        import itertools

        import pandas as pd

        def rows():
            for frame in frames:
                counts = providers.token_counts(list(frame["text"]))
                yield from zip(frame["file_id"], frame["idx"], frame["text"], counts, strict=True)

        def windows():
            for file_id, own in itertools.groupby(rows(), key=lambda r: r[0]):
                waiting: list[int] = []  # places of the chunks that no window has yet: a window's at most

                def told(own=own, waiting=waiting):
                    for _, idx, text, n in own:
                        waiting.append(idx)
                        yield text, n

                for texts, counts, front in late_windows(told(), most, carry):
                    vectors = late_window(texts, counts, front)
                    here, waiting[:] = waiting[: len(vectors)], waiting[len(vectors) :]
                    yield from zip([file_id] * len(here), here, counts[front:], vectors, strict=True)

        each = windows()
        while some := list(itertools.islice(each, OUT_ROWS)):  # most files have few chunks, so a frame has those of many
            yield pd.DataFrame(some, columns=["file_id", "idx", "n_tokens", "vector"])

    prepared(chunks.sparkSession)
    return ordered.mapInPandas(run, f"file_id {kind}, idx long, n_tokens long, vector array<float>")


PROMPT = (
    "<문서 이름=\"{name}\" 폴더=\"{root}\" 경로=\"{path}\">\n{head}{section}<본문{scope}>\n{body}\n</본문>\n</문서>\n\n"
    "<대상>\n{target}\n</대상>\n\n위 대상이 문서의 어떤 맥락에 있는지 문서에서 확인되는 내용만으로 한두 문장으로 써라."
)


def clipped(c: Column, most: int) -> Column:
    """Text without white space at its ends, ``most`` characters of it and a sign that there is more."""
    bare = F.btrim(c, F.lit(" \t\n\r"))
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.left(bare, F.lit(most)), F.lit(" …")))


def context_material(chunks: DataFrame) -> DataFrame:
    """``chunks`` (``file_id, idx, text, section``) with ``scope``, ``body``, ``head`` and ``target``.

    ``full``: the whole file, if it has ``fixed.FULL_DOC`` characters at most; ``section``: all chunks of the chunk's own
    section, if they have ``fixed.SECTION_CHARS`` at most; else ``local``: two chunks on either side. ``head`` is the file's
    beginning, unless the body has it; empty for whole files.
    """
    file, section = Window.partitionBy("file_id"), Window.partitionBy("file_id", "section")
    order = file.orderBy("idx")
    beside = order.rowsBetween(-fixed.NEIGHBOURS, fixed.NEIGHBOURS)
    # two sorts in all: both windows of the first need it alone, and texts are gathered as late as can be
    dealt = by_file(chunks.withColumn("text", F.coalesce("text", F.lit("")))).sortWithinPartitions("file_id", "section")
    item = F.struct("idx", "text")
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), "\n")
    scope = F.col("scope")
    # null items aren't gathered, so an array has a bounded number of characters
    sized = chunking.with_scope(dealt).withColumn("__section", joined(F.collect_list(F.when(scope == "section", item)).over(section)))
    gathered = sized.sortWithinPartitions("file_id", "idx").withColumns({
        "__full": F.collect_list(F.when(scope == "full", item)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "__beside": F.collect_list(item).over(beside), "__first": F.first(F.left("text", F.lit(fixed.HEAD_CHARS + 1))).over(order),
        "__n": F.row_number().over(order), "__last": F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    body = F.when(scope == "full", joined(F.col("__full"))).when(scope == "section", F.col("__section")).otherwise(joined(F.col("__beside")))
    low, high = F.greatest(F.lit(1), F.col("__n") - fixed.NEIGHBOURS), F.least(F.col("__last"), F.col("__n") + fixed.NEIGHBOURS)
    note = F.when(scope == "full", " 전체").when(scope == "section", F.concat(F.lit(" 중 '"), "section", F.lit("' 절"))).otherwise(F.concat(F.lit(" 중 "), low.cast("string"), F.lit("~"), high.cast("string"), F.lit("번째 조각")))
    out = gathered.withColumns({"body": clipped(body, fixed.FULL_DOC), "__head": clipped(F.col("__first"), fixed.HEAD_CHARS), "target": clipped(F.col("text"), fixed.TARGET_CHARS), "note": note})
    head = F.when((scope != "full") & (F.col("__head") != "") & ~F.contains("body", "__head"), F.col("__head")).otherwise("")
    return out.withColumn("head", head).select(*chunks.columns, "scope", "note", "body", "head", "target")


def context_prompts(chunks: DataFrame, files: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """``file_id, idx, scope, prompt`` of every chunk. ``files``: ``file_id, name, root, path``. ``prompt`` has the places
    ``{name} {root} {path} {head} {section} {scope} {body} {target}``; what stands for them is put in as it is."""
    facts = files.select("file_id", "name", "root", "path")
    m = context_material(chunks).join(facts, "file_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = {
        "name": text("name"), "root": text("root"), "path": text("path"), "body": F.col("body"), "target": F.col("target"), "scope": F.col("note"),
        "head": F.when(F.col("head") != "", F.concat(F.lit("<문서 앞부분>\n"), "head", F.lit("\n</문서 앞부분>\n\n"))).otherwise(""),
        "section": F.when(F.col("section").isNotNull(), F.concat(F.lit("현재 절: "), "section", F.lit("\n"))).otherwise(""),
    }
    parts, rest = [], prompt
    while rest:  # the template's own pieces, so that texts with braces stay as they are
        at = min((i for v in values if (i := rest.find(f"{{{v}}}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return m.select("file_id", "idx", "scope", F.concat(*parts).alias("prompt"))


def chunk_contexts(prompts: DataFrame) -> DataFrame:
    """``file_id, idx, scope, context`` by the generation provider; only contexts that can be used."""
    answer = chunking.valid_context(providers.generated(F.col("prompt")))
    return prompts.select("file_id", "idx", "scope", answer.alias("context")).where(F.col("context").isNotNull())
