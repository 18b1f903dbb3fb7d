import io
import json
import zipfile

from quern.operators import tabular
from quern.operators.chunking import Block, chunked, merged, split, without_undersized
from quern.operators.tabular import delimiter, json_records, key_paths
from quern.sources import parsers

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_html():
    page = "<html><head><title>T</title><style>x{}</style><script>var a='<p>no</p>'</script></head><body><nav>menu</nav><p>One &amp; two</p><div>Three<br>four</div><footer>f</footer></body></html>"
    texts = [b.text for b in parsers.html_blocks(page)]
    assert texts == ["T", "One & two", "Three\nfour"]


def test_notebook():
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Head\n", "x"]}, {"cell_type": "code", "source": "print(1)"}, {"cell_type": "code", "source": " "}]}
    assert [(b.text, b.section, b.label) for b in parsers.notebook_blocks(json.dumps(nb))] == [("# Head\nx", "Head", "markdown"), ("print(1)", "Head", "code")]


def test_docx():
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Intro", "Heading1") + p("text") + f"<w:tbl><w:tr>{cell('a')}{cell('')}{cell('b')}</w:tr></w:tbl>" + p("after")
    data = zipped(word__document_xml=f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    assert [(b.text, b.section, b.label) for b in parsers.docx_blocks(data)] == [("text", "Intro", None), ("a | b", "Intro", "table"), ("after", "Intro", None)]


def test_pptx_xlsx_hwpx():
    slide = lambda *t: '<s xmlns:a="urn:a">' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</s>"
    deck = zipped(ppt__slides__slide2_xml=slide("Second"), ppt__slides__slide1_xml=slide("First", "body"), ppt__notesSlides__notesSlide1_xml=slide("note"))
    assert [(b.page, b.section, b.text) for b in parsers.pptx_blocks(deck)] == [(1, "First", "First\nbody\nnote"), (2, "Second", "Second")]
    sheet = '<w><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c><v></v></c></row></w>'
    book = zipped(xl__workbook_xml='<w><sheet name="Data"/></w>', xl__sharedStrings_xml="<w><si><t>name</t></si></w>", xl__worksheets__sheet1_xml=sheet)
    assert [(b.label, b.text) for b in parsers.xlsx_blocks(book)] == [("Data", "name | 5")]
    hwpx = zipped(Contents__section0_xml="<s><p><t>가나</t></p><p><t> </t></p></s>")
    assert [b.text for b in parsers.hwpx_blocks(hwpx)] == ["가나"]


def test_dispatch():
    assert parsers.parse("a.pdf", "pdf", b"%PDF")[1] == "skipped: no parser for pdf"
    assert parsers.parse("a.hwp", "hwp", b"\xd0\xcf\x11\xe0")[1].startswith("skipped")
    assert parsers.parse("a.docx", "docx", b"broken")[1] == "failed: BadZipFile"
    assert parsers.parse("a.html", "text", b"<p>x</p>")[0][0].text == "x"
    assert parsers.parse("a.txt", "text", b"")[0] == []


def test_parse_files(spark):
    rows = spark.createDataFrame([(1, "a.md", bytearray(b"# H\nx\n\ny")), (2, "b.pdf", bytearray(b"")), (3, "c.txt", None)], "file_id int, name string, content binary")
    got = {r.file_id: r for r in parsers.parse_files(rows).collect()}
    assert [(b.text, b.section) for b in got[1].blocks] == [("x", "H"), ("y", "H")]
    assert got[2].error == "skipped: no parser for pdf" and got[2].blocks == [] and got[3].blocks == []


def test_merging():
    assert [b.text for b in merged([Block("a"), Block(" "), Block("b"), Block("c", page=2)])] == ["a\nb", "c"]
    assert [len(b.text) for b in merged([Block("x" * 700), Block("y" * 600)])] == [700, 600]
    long = "z" * 70
    joined = without_undersized([Block("a", 1, "S"), Block(long, 2, "T"), Block("end", 2, "T")])
    assert [(b.text, b.page, b.section) for b in joined] == [(f"a\n{long}\nend", None, "S / T / T")]


def test_splitting():
    words = " ".join(f"word{i}" for i in range(1000))
    pieces = split(words)
    assert all(len(p) <= 1200 for p in pieces)
    for a, b in zip(pieces, pieces[1:]):
        assert b.split(" ")[0] in a.split(" ")[-40:]  # the overlap
    assert {w for p in pieces for w in p.split(" ")} == set(words.split(" "))
    assert all(len(p) <= 1200 for p in split("x" * 5000))
    paragraphs = "\n\n".join("p" * 500 for _ in range(5))
    assert all(set(p) <= {"p", "\n"} and len(p) <= 1200 for p in split(paragraphs))


def test_chunked_drops_short():
    assert chunked([Block("tiny")]) == []
    assert [c.text for c in chunked([Block("y" * 61)])] == ["y" * 61]


def test_tabular():
    assert delimiter("a;b;c\n1;2;3\n") == ";" and delimiter("plain\ntext here") is None
    assert key_paths({"a": {"b": 1, "c": [{"d": 2}]}, "e": 3}) == ["a.b", "a.c[].d", "e"]
    assert json_records("\n".join('{"x": 1}' for _ in range(30))) == (30, ["x"])
    assert json_records(json.dumps({"k": {"rows": [{"y": i} for i in range(40)]}})) == (40, ["y"])
    assert json_records('{"a": 1}') is None and json_records("no json") is None


def test_records_of_tables(spark):
    """Records of whole tables as the parser's helper tells them, for objects, lines, nested and broken texts."""
    record = {"b": 1, "a": {"c": 2, "d": {"e": {"f": 1}}}, "l": [1, 2], "n": None, "o": {}}
    cases = {
        "lines": "\n".join(json.dumps(record) for _ in range(40)) + "\n\n", "array": json.dumps([record] * 31), "few": json.dumps([record] * 29), "deep": json.dumps({"x": {"y": {"z": [record] * 50}}}),
        "deeper": json.dumps({"x": {"y": {"z": {"w": [record] * 50}}}}), "two": json.dumps({"s": [{"k": 1}] * 35, "t": {"u": [{"m": 1}] * 36}}), "numbers": json.dumps({"x": [1] * 99}), "mixed": "\n".join(["3"] * 40),
        "broken": "{" * 40, "empty": "", "null": None, "scalar": "3", "odd": json.dumps({"a.b": [{"k": [1]}] * 30}),
    }
    df = spark.createDataFrame(list(cases.items()), "file_id string, text string").repartition(3)
    got = {r.file_id: (r.n_records, r["keys"]) for r in tabular.records_profile(df).collect()}
    want = {k: tabular.json_records(t) for k, t in cases.items() if t is not None}
    assert {k: n for k, (n, _) in got.items()} == {k: x[0] for k, x in want.items() if x}
    assert got["lines"][1] == got["deep"][1] == ["a.c", "a.d.e.f", "b", "l[]", "n"] and got["two"] == (36, ["m"]) and got["odd"] == (30, ["k[]"])
