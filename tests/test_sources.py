import base64
import io
import os
import urllib.parse
import zipfile
import zlib

from pyspark.sql import functions as F

from siftwell.sources import extractors as E
from siftwell.sources import files as S


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


CORE = "<c xmlns:dc='d'><dc:title>T</dc:title><dc:creator>A</dc:creator><keywords>k</keywords></c>"


def test_office():
    word = "<w:d xmlns:w='w'><w:p><w:t>one</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl><w:p><w:t>two</w:t></w:p></w:d>"
    got = E.extract("docx", package(**{"docProps/core.xml": CORE, "word/document.xml": word}), "x.docx")
    assert (got["title"], got["author"], got["description"], got["text"]) == ("T", "A", "k", "one\ntwo\na | b")
    slide = "<s><sp><ph type='title'/><p><t>Head</t></p></sp><sp><p><t>body</t></p></sp></s>"
    got = E.extract("pptx", package(**{"ppt/slides/slide1.xml": slide}), "x.pptx")
    assert (got["title"], got["text"]) == ("Head", "Head\nbody")
    book = {"xl/workbook.xml": "<w><sheet name='S1'/></w>", "xl/sharedStrings.xml": "<s><si><t>hi</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>2</v></c></row></w>"}
    got = E.extract("xlsx", package(**book), "x.xlsx")
    assert (got["subject"], got["text"]) == ("S1", "hi | 2")
    odt = "<o><h>H</h><p>a<span>b</span></p><table><table-row><table-cell><p>c</p></table-cell><table-cell><p>d</p></table-cell></table-row></table></o>"
    assert E.extract("odt", package(**{"content.xml": odt}), "x.odt")["text"] == "H\nab\nc | d"


def test_other_formats():
    inner = "<m><mxCell value='a&lt;br&gt;b'/></m>"
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = base64.b64encode(deflate.compress(urllib.parse.quote(inner).encode()) + deflate.flush()).decode()
    assert E.extract("drawio", f"<f><diagram>{packed}</diagram></f>".encode(), "x")["text"] == "a\nb"
    book = {"META-INF/container.xml": "<c><rootfile full-path='o/p.opf'/></c>", "o/p.opf": "<p><title>B</title><creator>Doe, Jo</creator><item id='i' href='c.html'/><itemref idref='i'/></p>", "o/c.html": "<p>chapter</p>"}
    got = E.extract("epub", package(**book), "x.epub")
    assert (got["title"], got["author"], got["text"]) == ("B", "Jo Doe", "chapter")
    got = E.extract("eml", b"Subject: S\r\nFrom: a@b.c\r\nTo: d@e.f\r\n\r\nhello\r\n", "x.eml")
    assert (got["title"], got["author"], got["subject"], got["text"]) == ("S", "a@b.c", "To: d@e.f", "hello")
    assert E.extract("rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}caf\'e9\par \u8364?x}", "x.rtf")["text"] == "café\n€x"
    assert E.extract("csv", b"a;b\n\n1;2\n", "x.csv")["text"] == "a | b\n1 | 2"
    got = E.extract("tex", rb"\title{A {b} c} % \author{no}" + b"\n" + rb"\author{Me}", "x.tex")
    assert (got["title"], got["author"]) == ("A {b} c", "Me")
    assert E.extract("rst", b"Head\n====\ntext", "x.rst")["title"] == "Head"
    assert E.extract("html", b"<p>a</p><script>x</script><p>b&amp;</p>", "x.html")["text"] == "ab&"
    assert E.extract("xml", b"<r><title>T</title><b>x</b></r>", "x.xml")["text"] == "T x"


def test_failures():
    for code in ("utf-8", "utf-16-le", "utf-16-be"):
        bad = package(**{"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>".encode(code)})
        assert "entity" in E.extract("docx", bad, "x.docx")["error"]
    assert not E.extract("docx", b"nothing", "x.docx")["success"]
    assert not E.extract("txt", b"", "x.txt")["success"]
    assert E.extract("pdf", b"%PDF-", "a.pdf")["doc_type"] == "metadata"


def test_classify():
    cases = ((b"%PDF-1", "pdf"), (b"\x7fELF", ""), (b"<HTML>", "html"), (b"plain", "txt"), (b"\xff\xfe\x00", ""), (b"", ""), (package(**{"xl/a": ""}), "xlsx"))
    assert [E.classify(d) for d, _ in cases] == [k for _, k in cases]


def test_scan(spark, tmp_path):
    for name, text in (("visible.txt", "hello"), (".secret.txt", "x"), (".git/config", "x"), ("sub/b.md", "# b"), ("sub/c.bin", "x"), ("skip/d.txt", "d"), ("plain", "words here"), ("old.txt", "old")):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    files = S.without_folders(S.scannable(S.listing(spark, [root])), [f"{root}/skip"])
    known = files.where("name = 'old.txt'").select("path", F.col("modified_at"))
    fresh = S.changed(files, known)
    assert [r.rel for r in S.smallest_first(fresh).collect()] == ["sub/b.md", "visible.txt", "plain"]
    assert [r.rel for r in S.smallest_first(fresh, 1).collect()] == ["sub/b.md"]
    blocked = S.without_paths(fresh, fresh.where("name = 'plain'"))
    got = {r.name: (r.title, r.text, r.success, r.size_bytes) for r in S.records(spark, [root], blocked).collect()}
    assert got == {"visible.txt": ("visible", "hello", True, 5), "b.md": ("b", "# b", True, 3)}
    assert S.records(spark, [root], fresh).where("name = 'plain'").first().doc_type == "txt"
    assert S.records(spark, [root, f"{root}/sub"], S.scannable(S.listing(spark, [root, f"{root}/sub"]))).where("name = 'b.md'").count() == 1


def test_pdf_with_the_library(monkeypatch):
    from types import SimpleNamespace as N

    sheet = lambda t: N(extract_text=lambda: t)
    book = N(pages=[sheet("one\n \ntwo"), sheet(None), sheet("three")], metadata={"/Title": "T", "/Author": "A"})
    monkeypatch.setattr(E, "pypdf", N(PdfReader=lambda f: book))
    monkeypatch.setitem(E.READERS, "pdf", E.pdf)
    got = E.extract("pdf", b"%PDF-", "x.pdf")
    assert (got["title"], got["author"], got["text"], got["doc_type"]) == ("T", "A", "one\n \ntwo\nthree", "pdf")
    assert E.units("pdf", b"%PDF-") == [(1, "p. 1", "one"), (2, "p. 1", "two"), (3, "p. 3", "three")]


def test_large_members(monkeypatch):
    monkeypatch.setattr(E, "MEMBER_BYTES", 40)
    inner = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = base64.b64encode(inner.compress(b"x" * 100) + inner.flush()).decode()
    assert "too large" in E.extract("drawio", f"<f><diagram>{packed}</diagram></f>".encode(), "x")["error"]


def test_type_and_blacklist(spark):
    files = spark.createDataFrame([("/a/x.txt", "txt"), ("/a/y.bin", "bin"), ("/a/z", "")], "path string, ext string")
    listed = spark.createDataFrame([("/a/x.txt",), ("/a/x.txt",)], "path string")
    assert sorted(r["path"] for r in S.without_paths(files, listed).collect()) == ["/a/y.bin", "/a/z"]
