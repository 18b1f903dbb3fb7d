"""Files to blocks: HTML, notebooks, plain text, tables, and Office formats by the standard library.

A parser takes bytes and gives blocks ``(text, page, section, label)``. :func:`parse_files` picks one by category and
suffix for rows of the ``binaryFile`` source and runs in Arrow batches. What needs programs or libraries that aren't
here (PDF, the old binary formats) is reported as skipped, with a reason.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.operators import tabular
from quern.operators.chunking import Block
from quern.session import prepared

MOST_TEXT_BYTES, MOST_LINES, MOST_SHEET_ROWS = 20 * 1024 * 1024, 50_000, 2000


class _Text(HTMLParser):
    """Text outside scripts, styles, navigation and footers; block elements break lines."""

    HIDDEN = ("script", "style", "nav", "footer")
    BREAKING = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "title")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BREAKING:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.BREAKING:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_blocks(source: str) -> list[Block]:
    reader = _Text()
    reader.feed(source)
    reader.close()
    lines = "\n".join(" ".join(line.split()) for line in "".join(reader.out).split("\n"))
    return [Block(p.strip()) for p in re.split(r"\n\s*\n", re.sub(r"\n{3,}", "\n\n", lines)) if p.strip()]


def notebook_blocks(source: str) -> list[Block]:
    """A block for each cell with text; a heading of a text cell is the section from there on."""
    out, section = [], None
    for cell in json.loads(source).get("cells", []):
        text = cell.get("source", "")
        text = "".join(text) if isinstance(text, list) else text
        if not text.strip():
            continue
        if cell.get("cell_type") == "markdown" and (m := re.match(r"#{1,6}\s+(.+)", text.strip())):
            section = m[1].strip()
        out.append(Block(text.strip(), section=section, label=cell.get("cell_type")))
    return out


def text_blocks(source: str) -> list[Block]:
    """Paragraphs of plain text, each under the last heading: one with ``#``, a bare one or a numbered one."""
    out, section, lines = [], None, []

    def close() -> None:
        if "\n".join(lines).strip():
            out.append(Block("\n".join(lines).strip(), section=section))
        lines.clear()

    for line in source.split("\n")[:MOST_LINES]:
        if m := re.match(r"#{1,6}\s+(.+)", line):
            close()
            section = m[1].strip()
        elif heading := tabular.heading(line):
            close()
            section = heading
        elif not line.strip():
            close()
        else:
            lines.append(line)
    close()
    return out


def summary_block(source: str) -> Block | None:
    """One block that stands for a table of numbers or for records, whose rows say little by themselves; None for others."""
    if found := tabular.json_records(source):
        return Block(f"records: {found[0]}\nkeys: {', '.join(found[1])}", label="summary")
    if told := tabular.describe(source):
        return Block(told, label="summary")
    return None


def pdf_text_ratio(pages: list[str]) -> float:
    """The share of the first pages that have text."""
    few = pages[: fixed.PDF_PAGES]
    return sum(bool(p.strip()) for p in few) / len(few) if few else 0.0


def pdf_blocks(pages: list[str]) -> tuple[list[Block], str | None]:
    """Blocks of the pages that a reader of PDF gave, or the reason why a scan has none."""
    if pdf_text_ratio(pages) < fixed.PDF_TEXT_RATIO:
        return [], "skipped: no text layer"
    return [Block(p.strip(), page=i) for i, p in enumerate(pages, 1) if p.strip()], None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, names: tuple[str, ...]) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) in names)


def docx_blocks(data: bytes) -> list[Block]:
    """Paragraphs under their headings; each table is a block of its own."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out, section, lines = [], None, []

    def close() -> None:
        if "\n".join(lines).strip():
            out.append(Block("\n".join(lines).strip(), section=section))
        lines.clear()

    for node in next(x for x in body if _local(x.tag) == "body"):
        if _local(node.tag) == "p":
            text = _texts(node, ("t",)).strip()
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            if text and style.lower().startswith("heading"):
                close()
                section = text
            elif text:
                lines.append(text)
        elif _local(node.tag) == "tbl":
            close()
            rows = [" | ".join(c for cell in row if _local(cell.tag) == "tc" and (c := _texts(cell, ("t",)).strip())) for row in node if _local(row.tag) == "tr"]
            out.append(Block("\n".join(r for r in rows if r), section=section, label="table"))
    close()
    return [b for b in out if b.text]


def pptx_blocks(data: bytes) -> list[Block]:
    """A block for each slide: its first text is the section, notes follow."""
    box = zipfile.ZipFile(io.BytesIO(data))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    out = []
    for name in sorted((n for n in box.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        parts = [t for p in ElementTree.fromstring(box.read(name)).iter() if _local(p.tag) == "p" and (t := _texts(p, ("t",)).strip())]
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        if notes in box.namelist():
            parts += [t for p in ElementTree.fromstring(box.read(notes)).iter() if _local(p.tag) == "p" and (t := _texts(p, ("t",)).strip())]
        if parts:
            out.append(Block("\n".join(parts), page=number(name), section=parts[0]))
    return out


def xlsx_blocks(data: bytes) -> list[Block]:
    """A block for each sheet: cells of a row joined, empty ones left out; the first 2,000 rows and a line on the rest."""
    box = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in box.namelist():
        shared = [_texts(x, ("t",)) for x in ElementTree.fromstring(box.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"]
    names = [x.attrib.get("name", "") for x in ElementTree.fromstring(box.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    out = []
    for i, name in enumerate(names, 1):
        path, rows = f"xl/worksheets/sheet{i}.xml", []
        if path not in box.namelist():
            continue
        found = [r for r in ElementTree.fromstring(box.read(path)).iter() if _local(r.tag) == "row"]
        for row in found[:MOST_SHEET_ROWS]:
            cells = []
            for c in (x for x in row if _local(x.tag) == "c"):
                v = _texts(c, ("v", "t"))
                cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
            if any(x.strip() for x in cells):
                rows.append(" | ".join(x.strip() for x in cells if x.strip()))
        if len(found) > MOST_SHEET_ROWS:
            rows.append(f"... {len(found) - MOST_SHEET_ROWS} more rows")
        if rows:
            out.append(Block("\n".join(rows), label=name))
    return out


def hwpx_blocks(data: bytes) -> list[Block]:
    """Paragraphs of the sections of a HWPX archive."""
    box, out = zipfile.ZipFile(io.BytesIO(data)), []
    for name in sorted(n for n in box.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
        out += [Block(t) for p in ElementTree.fromstring(box.read(name)).iter() if _local(p.tag) == "p" and (t := _texts(p, ("t",)).strip())]
    return out


def hwpml_blocks(data: bytes) -> list[Block]:
    return [Block(t) for p in ElementTree.fromstring(data).iter() if _local(p.tag).upper() == "P" and (t := _texts(p, ("CHAR", "t")).strip())]


def parse(name: str, kind: str, data: bytes) -> tuple[list[Block], str | None]:
    """Blocks of a file, or none and the reason."""
    low = name.lower()
    try:
        if kind == "docx":
            return docx_blocks(data), None
        if kind == "pptx":
            return pptx_blocks(data), None
        if kind == "xlsx":
            return xlsx_blocks(data), None
        if kind == "hwp":
            if data[:2] == b"PK":
                return hwpx_blocks(data), None
            return (hwpml_blocks(data), None) if data.lstrip()[:1] == b"<" else ([], "skipped: binary HWP needs conversion")
        if kind == "notebook":
            return notebook_blocks(data.decode("utf-8", "replace")), None
        if kind in ("text", "table", "code"):
            if len(data) > MOST_TEXT_BYTES:
                return [], "skipped: too large"
            source = data.decode("utf-8", "replace")
            if not low.endswith((".html", ".htm")) and (block := summary_block(source)):
                return [block], None
            return (html_blocks(source) if low.endswith((".html", ".htm")) else text_blocks(source)), None
        return [], f"skipped: no parser for {kind}"
    except (KeyError, ValueError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [], f"failed: {type(e).__name__}"


def parse_files(files: DataFrame) -> DataFrame:
    """``file_id, blocks, error`` from rows of ``file_id, name, content`` (binary); a file is parsed in one row."""
    with_kind = files.select("file_id", "name", X.category(F.col("name")).alias("kind"), "content")
    ddl = f"file_id {files.schema['file_id'].dataType.simpleString()}, blocks array<struct<text:string,page:int,section:string,label:string>>, error string"

    def run(frames):
        import pandas as pd

        for frame in frames:
            done = [parse(n, k, bytes(c or b"")) for n, k, c in zip(frame["name"], frame["kind"], frame["content"], strict=True)]
            yield pd.DataFrame({"file_id": frame["file_id"], "blocks": [[vars(b) for b in x] for x, _ in done], "error": [e for _, e in done]})

    prepared(files.sparkSession)
    return with_kind.mapInPandas(run, ddl)
