"""Blocks to chunks: greedy merging, undersized blocks, recursive splitting, context windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.session import prepared

#: Where a long text may be cut, best first; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", "다. ", "요. ", ". ", " ", "")


@dataclass(frozen=True)
class Block:
    text: str
    page: int | None = None
    section: str | None = None
    label: str | None = None


def merged(blocks: list[Block], size: int = fixed.CHUNK_SIZE) -> list[Block]:
    """Neighbours of one page, section and label as one block while they fit."""
    out: list[Block] = []
    for b in blocks:
        text = b.text.strip()
        if not text:
            continue
        last = out[-1] if out else None
        if last and (last.page, last.section, last.label) == (b.page, b.section, b.label) and len(last.text) + 1 + len(text) <= size:
            out[-1] = Block(f"{last.text}\n{text}", b.page, b.section, b.label)
        else:
            out.append(Block(text, b.page, b.section, b.label))
    return out


def _join(a: Block, b: Block) -> Block:
    """Two blocks as one across sections: the page stays if it is the same, section names are joined."""
    sections = [s for s in dict.fromkeys((a.section, b.section)) if s]
    return Block(f"{a.text}\n{b.text}", a.page if a.page == b.page else None, " / ".join(sections) or None, a.label or b.label)


def without_undersized(blocks: list[Block], least: int = fixed.MIN_CHUNK) -> list[Block]:
    """Blocks below the least size join the next one; a last one that is left over joins the one before."""
    out: list[Block] = []
    for b in blocks:
        if out and len(out[-1].text) < least:
            out[-1] = _join(out[-1], b)
        else:
            out.append(b)
    if len(out) > 1 and len(out[-1].text) < least:
        out[-2:] = [_join(out[-2], out[-1])]
    return out


def split(text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of ``size`` characters at most. The first separator that occurs cuts (and begins the next piece); pieces that
    are still too long are cut by the next ones; small neighbours are packed together, and a piece begins with up to
    ``overlap`` characters of whole parts of the one before."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        cut = text.split(sep)
        parts = [cut[0], *[sep + c for c in cut[1:]]]
    else:
        parts = list(text)
    out: list[str] = []
    pack: list[str] = []

    def close() -> None:
        whole = "".join(pack).strip()
        if whole:
            out.append(whole)

    for part in (p for p in parts if p):
        if len(part) >= size and rest:
            close()
            pack.clear()
            out.extend(split(part, size, overlap, rest))
            continue
        if pack and sum(map(len, pack)) + len(part) > size:
            close()
            while pack and (sum(map(len, pack)) > overlap or sum(map(len, pack)) + len(part) > size):
                pack.pop(0)
        pack.append(part)
    close()
    return out


def chunked(blocks: list[Block]) -> list[Block]:
    """A file's chunks in order: merged, none undersized, long ones split, what is still too short left out."""
    out = []
    for b in without_undersized(merged(blocks)):
        for piece in split(b.text) if len(b.text) > fixed.CHUNK_SIZE else [b.text]:
            if len(piece.strip()) >= fixed.MIN_CHUNK:
                out.append(Block(piece.strip(), b.page, b.section, b.label))
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """``file_id, idx, text, page, section, label`` from rows of ``file_id`` and ``blocks`` (array of structs).

    Order within a file decides, so each file's blocks come as one array; files are independent and run in Arrow batches.
    """
    ddl = f"file_id {files.schema['file_id'].dataType.simpleString()}, idx long, text string, page int, section string, label string"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for file_id, blocks in zip(frame["file_id"], frame["blocks"], strict=True):
                items = [] if blocks is None else [Block(b["text"] or "", None if pd.isna(b["page"]) else int(b["page"]), b["section"], b["label"]) for b in blocks]
                rows += [(file_id, i, c.text, c.page, c.section, c.label) for i, c in enumerate(chunked(items))]
            yield pd.DataFrame(rows, columns=["file_id", "idx", "text", "page", "section", "label"]).astype({"page": "Int32"})

    prepared(files.sparkSession)
    return files.select("file_id", "blocks").mapInPandas(run, ddl)


def line_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """``file_id, line_no, line, section`` of plain texts: the section is the last heading above, a running value per file.
    ``files`` may have ``kinds``, the kinds of headings that count in a file (see :func:`text.section`); marked ones always do."""
    kinds = ["kinds"] if "kinds" in files.columns else []
    lines = files.select("file_id", *kinds, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    marked = F.when(F.col("line").rlike("^#{1,6} "), F.trim(F.regexp_replace("line", "^#+ ", "")))
    heading = marked.otherwise(X.section(F.col("line"), *[F.col(k) for k in kinds]))
    lines = lines.withColumn("heading", heading).drop(*kinds)
    above = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last("heading", ignorenulls=True).over(above)).drop("heading")


def with_scope(chunks: DataFrame) -> DataFrame:
    """How much of its file a chunk is explained with: ``full``, its ``section``, or the chunks beside it (``local``)."""
    size = F.length("text")
    chunks = chunks.withColumns({
        "file_chars": F.sum(size).over(Window.partitionBy("file_id")),
        "section_chars": F.sum(size).over(Window.partitionBy("file_id", "section")),
        "beside": F.count(F.lit(1)).over(Window.partitionBy("file_id").orderBy("idx").rowsBetween(-fixed.NEIGHBOURS, fixed.NEIGHBOURS)),
    })
    scope = F.when(F.col("file_chars") <= fixed.FULL_DOC, "full").when(F.col("section").isNotNull() & (F.col("section_chars") <= fixed.SECTION_CHARS), "section").otherwise("local")
    return chunks.withColumn("scope", scope)


def valid_context(c: Column, least: int = 8, most: int = 400) -> Column:
    """A generated context if it can be used: without its label, 8 to 400 characters, not the word SKIP."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(?:context|맥락)\s*:\s*", ""))
    return F.when((F.length(bare) >= least) & ~F.upper(bare).startswith("SKIP"), F.left(bare, F.lit(most)))
