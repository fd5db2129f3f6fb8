"""Extractor records from the bytes of a file, with the standard library alone.

Each function takes bytes and returns some of FIELDS. extract() cuts texts, fills titles from the file's name and
turns any failure into success = False with its error. Formats whose readers are not part of the standard
library (djvu, mobi, binary Visio, and pdf where pypdf is not installed) give a record of the name only, with doc_type "metadata".
units() gives the passages of a file with their places.
"""

from __future__ import annotations

import base64
import csv
import gzip
import html
import io
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterable
from email import message_from_bytes, policy

from siftwell.functions.text import BLOCK_END

try:
    import pypdf
except ImportError:  # an optional library: without it a pdf has the record of its name
    pypdf = None

FIELDS = ("title", "author", "subject", "description", "text", "snippet", "doc_type", "success", "error")
TEXT_CHARS, SNIPPET_CHARS, PLAIN_CHARS = 5000, 500, 200_000
#: A zip member inflates to this many bytes at most; beyond, the file is refused.
MEMBER_BYTES = 256 << 20
PLAIN = frozenset("txt md ini conf cfg log lst puml plantuml mmd json yml yaml py sh js css rs c h cpp hpp cc go java ts tsx jsx rb php toml".split())
MARKUP = frozenset("xml xhtml sgml sgm docbook dbk svg vdx rss atom opml".split())
NAME_ONLY = frozenset("pdf djvu djv mobi azw azw3 vsd vss vst".split())


def classify(data: bytes) -> str:
    """The extension that a file without one should have, from its first 8192 bytes; no document: empty."""
    head = data[:8192]
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        return next((e for mark, e in ((b"word/", "docx"), (b"ppt/", "pptx"), (b"xl/", "xlsx"), (b"epub", "epub")) if mark in head), "")
    if head.startswith((b"\x7fELF", b"\x89PNG", b"\xff\xd8\xff", b"GIF8")):
        return ""
    if any(mark in head[:4096].lower() for mark in (b"<html", b"<!doctype html", b"<head", b"<body")):
        return "html"
    try:
        text = head[:4096].decode("utf-8")
    except UnicodeDecodeError:
        return ""
    return "txt" if text and sum(c.isprintable() or c in "\n\r\t" for c in text) > 0.9 * len(text) else ""


def parse_xml(data: bytes) -> ET.Element:
    """The root element; documents that declare entities are refused in any of the encodings that could hide one."""
    if any("<!ENTITY".encode(code) in data for code in ("utf-8", "utf-16-le", "utf-16-be")):
        raise ValueError("entity declarations are not read")
    return ET.fromstring(data)


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    with z.open(name) as f:
        return _bounded(f.read(MEMBER_BYTES + 1), name)


def _bounded(data: bytes, name: str) -> bytes:
    if len(data) > MEMBER_BYTES:
        raise ValueError(f"{name} is too large")
    return data


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text_of(e: ET.Element, leaf: str) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == leaf)


def _core(z: zipfile.ZipFile) -> dict:
    """Title, author, subject and description of an Office package."""
    if "docProps/core.xml" not in z.namelist():
        return {}
    got = {_local(e): (e.text or "").strip() for e in parse_xml(_member(z, "docProps/core.xml")).iter()}
    return {"title": got.get("title"), "author": got.get("creator"), "subject": got.get("subject"), "description": got.get("description") or got.get("keywords")}


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def plain(data: bytes) -> dict:
    return {"text": data.decode("utf-8", "replace")[:PLAIN_CHARS].strip()}


def page(data: bytes) -> dict:
    """HTML: scripts, styles and tags are removed without a space, as opposed to markup()."""
    text = data.decode("utf-8", "replace")[:PLAIN_CHARS]
    text = re.sub(r"<(script|style)\b.*?</\1\s*>", "", text, flags=re.S | re.I)
    return {"text": html.unescape(re.sub(r"<[^>]+>", "", text)).strip()}


_STEPS = [(r"(?is)<!DOCTYPE[^>]*>", " "), (r"(?s)<\?xml.*?\?>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<!\[CDATA\[(.*?)\]\]>", r"\1"), (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?s)<\?.*?\?>", " "), (r"(?s)<[^>]+>", " ")]


def _strip(text: str) -> str:
    for pattern, put in _STEPS:
        text = re.sub(pattern, put, text)
    return re.sub(r"\s+", " ", html.unescape(text)).strip()


def markup(data: bytes) -> dict:
    raw = data.decode("utf-8", "replace")

    def element(names: str) -> str:
        m = re.search(rf"(?is)<({names})\b[^>]*>(.*?)</\1>", raw)
        return _strip(m[2])[:200] if m else ""

    text = _strip(raw)
    first = next((x for line in raw.splitlines() if 3 <= len(x := _strip(line)) <= 200), "")
    return {"title": element("title|dc:title|h1") or first, "author": element("author|dc:creator"), "subject": element("subject|dc:subject"), "text": text}


def rst(data: bytes) -> dict:
    lines = data.decode("utf-8", "replace").splitlines()
    title = next((a.strip() for a, b in zip(lines, lines[1:], strict=False) if a.strip() and re.fullmatch(r"([=\-~^\"'#*+])\1{2,}", b.strip()) and len(b.strip()) >= len(a.strip())), "")
    return {"title": title, "text": "\n".join(lines).strip()}


def adoc(data: bytes) -> dict:
    text = data.decode("utf-8", "replace")
    m = re.search(r"(?m)^= +(\S.*)$", text)
    return {"title": m[1].strip() if m else "", "text": text.strip()}


def braced(text: str, command: str) -> str:
    """The argument of a LaTeX command, with braces balanced."""
    m = re.search(rf"\\{command}\*?(?:\[[^\]]*\])?\s*\{{", text)
    if not m:
        return ""
    depth = 1
    for i in range(m.end(), len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0) * (text[i - 1] != "\\")
        if not depth:
            return re.sub(r"\s+", " ", text[m.end() : i]).strip()
    return ""


def latex(data: bytes) -> dict:
    text = re.sub(r"(?m)(?<!\\)%.*$", "", data.decode("utf-8", "replace"))
    return {"title": braced(text, "title") or braced(text, "chapter") or braced(text, "section"), "author": braced(text, "author"), "text": text.strip()}


def table(data: bytes) -> dict:
    """csv and tsv: at most 500 rows, cells of at most 200 characters; the first row is the description."""
    text = data.decode("utf-8-sig", "replace")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], ",\t;|")
    except csv.Error:
        dialect = csv.excel
    rows = []
    for row in csv.reader(io.StringIO(text, newline=""), dialect):
        if any(c.strip() for c in row):
            rows.append(" | ".join(c.strip()[:200] for c in row))
        if len(rows) == 500:
            break
    return {"description": rows[0][:500] if rows else "", "text": "\n".join(rows)}


def mail(data: bytes) -> dict:
    m = message_from_bytes(data, policy=policy.default)
    subject = "; ".join(f"{h}: {m[h]}" for h in ("To", "Cc", "Date") if m[h])
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_subtype() == "html":
        text = _strip(text)
    names = [a.get_filename() for a in m.iter_attachments() if a.get_filename()]
    text = (text.strip() + ("\nAttachments: " + ", ".join(names) if names else "")).replace("\0", " ").strip()
    return {"title": str(m["Subject"] or ""), "author": str(m["From"] or ""), "subject": subject, "description": text[:500], "text": text}


def rtf(data: bytes) -> dict:
    """Text of RTF: groups of font, colour, style and picture tables are skipped, escapes are decoded."""
    text = data[:500_000].decode("latin-1")
    out, stack, skip, drop = [], [], False, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)", text, re.S):
        word, number, code, mark, brace, run = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace:
            skip = stack.pop() if stack else False
        elif mark == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            drop = 1
        elif code:
            out.append("" if drop else bytes.fromhex(code).decode("cp1252", "replace"))
            drop = 0
        elif mark:
            out.append({"~": " "}.get(mark, mark if mark in "\\{}" else ""))
        elif run:
            out.append(run[drop:])
            drop = 0
    joined = re.sub(r"[\ud800-\udbff][\udc00-\udfff]", lambda p: p[0].encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))
    return {"text": joined.encode("utf-8", "replace").decode("utf-8").strip()}


def _docx_body(body: ET.Element) -> tuple[list[str], list[str]]:
    """Paragraphs outside tables, and the rows of tables."""
    tables = [e for e in body.iter() if _local(e) == "tbl"]
    inside = {id(p) for t in tables for p in t.iter() if _local(p) == "p"}
    paragraphs = [_text_of(p, "t") for p in body.iter() if _local(p) == "p" and id(p) not in inside]
    return paragraphs, [" | ".join(_text_of(c, "t").strip() for c in row if _local(c) == "tc") for t in tables for row in t if _local(row) == "tr"]


def docx(data: bytes) -> dict:
    """Paragraphs outside tables, then tables with a line per row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        got, body = _core(z), parse_xml(_member(z, "word/document.xml"))
    paragraphs, rows = _docx_body(body)
    return got | {"text": "\n".join(x for x in paragraphs + rows if x.strip())}


def pptx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        got = _core(z)
        slides = [parse_xml(_member(z, n)) for n in _numbered(z, r"ppt/slides/slide(\d+)\.xml")]
    if re.fullmatch(r"(?i)powerpoint presentation|presentation\d*|slide \d+", got.get("title") or ""):
        got["title"] = ""
    lines, heads = [], []
    for slide in slides:
        for shape in slide.iter():
            if _local(shape) == "sp":
                text = "\n".join(t for p in shape.iter() if _local(p) == "p" and (t := _text_of(p, "t").strip()))
                lines.append(text)
                holder = next((e for e in shape.iter() if _local(e) == "ph"), None)
                if text and holder is not None and (holder.get("type") in ("title", "ctrTitle") or holder.get("idx") in ("0", "1")):
                    heads.append(text.split("\n")[0])
            elif _local(shape) == "tr":
                lines.append(" | ".join(_text_of(c, "t").strip() for c in shape if _local(c) == "tc"))
    return got | {"title": got.get("title") or (heads[0] if heads else ""), "text": "\n".join(x for x in lines if x)}


def xlsx(data: bytes) -> dict:
    """At most 500 rows of each sheet; the subject falls back to the sheets' names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        got, names = _core(z), z.namelist()
        shared = [_text_of(e, "t") for e in parse_xml(_member(z, "xl/sharedStrings.xml")) if _local(e) == "si"] if "xl/sharedStrings.xml" in names else []
        sheets = [e.get("name", "") for e in parse_xml(_member(z, "xl/workbook.xml")).iter() if _local(e) == "sheet"]
        lines: list[str] = []
        for name in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = [e for e in parse_xml(_member(z, name)).iter() if _local(e) == "row"][:500]
            for row in rows:
                cells = []
                for c in (e for e in row if _local(e) == "c"):
                    value = _text_of(c, "t") if c.get("t") == "inlineStr" else _text_of(c, "v")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
            if sum(map(len, lines)) >= TEXT_CHARS:
                break
    return got | {"subject": got.get("subject") or ", ".join(sheets), "text": "\n".join(lines)}


def odf(data: bytes) -> dict:
    """OpenDocument texts, sheets and slides: paragraphs and headings in order, table rows as lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        meta = {_local(e): (e.text or "").strip() for e in parse_xml(_member(z, "meta.xml")).iter()} if "meta.xml" in z.namelist() else {}
        body = parse_xml(_member(z, "content.xml"))
    lines, inside = [], set()
    for e in body.iter():
        if _local(e) == "table-row":
            inside |= {id(p) for p in e.iter() if _local(p) in ("p", "h")}
            lines.append(" | ".join(x for c in e if _local(c) == "table-cell" and (x := "".join(c.itertext()).strip())))
        elif _local(e) in ("p", "h") and id(e) not in inside:
            lines.append("".join(e.itertext()).strip())
    return {"title": meta.get("title"), "author": meta.get("creator") or meta.get("initial-creator"), "subject": meta.get("subject"), "description": meta.get("description") or meta.get("keyword"), "text": "\n".join(x for x in lines if x)}


def vsdx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        got = _core(z)
        names = [e.get("Name", "") for e in parse_xml(_member(z, "visio/pages/pages.xml")).iter() if _local(e) == "Page"] if "visio/pages/pages.xml" in z.namelist() else []
        lines = [f"[{n}]" for n in names]
        for name in _numbered(z, r"visio/pages/page(\d+)\.xml"):
            lines += ["".join(e.itertext()).strip() for e in parse_xml(_member(z, name)).iter() if _local(e) == "Text"]
    return got | {"text": "\n".join(x for x in lines if x)}


def drawio(data: bytes) -> dict:
    """Labels of diagrams, inline or deflated."""
    if data.startswith(b"\x1f\x8b"):
        data = _bounded(gzip.GzipFile(fileobj=io.BytesIO(data)).read(MEMBER_BYTES + 1), "the diagram")
    root, lines = parse_xml(data), []
    for d in [e for e in root.iter() if _local(e) == "diagram"] or [root]:
        if len(d) == 0 and (d.text or "").strip():
            packed = base64.b64decode(urllib.parse.unquote(d.text.strip()))
            d = parse_xml(urllib.parse.unquote(_bounded(zlib.decompressobj(-15).decompress(packed, MEMBER_BYTES + 1), "a diagram").decode("utf-8")).encode())
        for e in d.iter():
            label = e.get("value") if _local(e) == "mxCell" else e.get("label") if _local(e) == "object" else None
            if label:
                lines.append(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>", "\n", label))).strip())
    return {"text": "\n".join(x for x in lines if x)}


def given_first(author: str) -> str:
    """"Surname, Given" as "Given Surname"; other names stay."""
    parts = [p.strip() for p in author.split(",")]
    return f"{parts[1]} {parts[0]}" if len(parts) == 2 and all(parts) else author.strip()


def _spine(z: zipfile.ZipFile) -> tuple[ET.Element, list[str]]:
    """The package of an e-book and the members that its spine lists, in order."""
    at = next(e.get("full-path") for e in parse_xml(_member(z, "META-INF/container.xml")).iter() if _local(e) == "rootfile")
    package, base = parse_xml(_member(z, at)), at.rpartition("/")[0]
    hrefs = {e.get("id"): urllib.parse.unquote(e.get("href", "")) for e in package.iter() if _local(e) == "item"}
    listed = [hrefs.get(e.get("idref")) for e in package.iter() if _local(e) == "itemref"]
    present = set(z.namelist())
    return package, [name for href in listed if href and (name := f"{base}/{href}" if base else href) in present]


def epub(data: bytes) -> dict:
    """Items of the spine in order, until the text is long enough."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package, names = _spine(z)
        meta = {}
        for e in package.iter():
            meta.setdefault(_local(e), (e.text or "").strip())
        parts: list[str] = []
        for name in names:
            parts.append(_strip(_member(z, name).decode("utf-8", "replace")))
            if sum(map(len, parts)) >= TEXT_CHARS:
                break
    return {"title": meta.get("title"), "author": given_first(meta.get("creator", "")), "subject": meta.get("subject"), "description": meta.get("description"), "text": "\n".join(p for p in parts if p)}


def pdf(data: bytes) -> dict:
    """Metadata, and the text of pages until it is long enough."""
    book, parts = pypdf.PdfReader(io.BytesIO(data)), []
    for sheet in book.pages:
        parts.append((sheet.extract_text() or "").strip())
        if sum(map(len, parts)) >= TEXT_CHARS:
            break
    meta = book.metadata or {}
    named = {field: str(meta.get(key) or "").strip() for field, key in (("title", "/Title"), ("author", "/Author"), ("subject", "/Subject"), ("description", "/Keywords"))}
    return named | {"text": "\n".join(p for p in parts if p)}


READERS: dict[str, Callable[[bytes], dict]] = {
    **dict.fromkeys(PLAIN, plain), **dict.fromkeys(MARKUP, markup), **dict.fromkeys(("html", "htm"), page), "csv": table, "tsv": table, "eml": mail, "rtf": rtf,
    "docx": docx, "pptx": pptx, "xlsx": xlsx, **dict.fromkeys("odt ods odp ott ots otp".split(), odf), "vsdx": vsdx, "vsdm": vsdx, "drawio": drawio, "dio": drawio,
    "epub": epub, "rst": rst, "adoc": adoc, "asciidoc": adoc, "tex": latex, "latex": latex,
    **({"pdf": pdf} if pypdf else {}),
}


def extract(kind: str, data: bytes, name: str) -> dict:
    """FIELDS of a file; a failure is success = False with its error, and the title falls back to the name without suffix."""
    stem = name.rpartition(".")[0] or name
    blank = dict.fromkeys(FIELDS[:6], "") | {"title": stem, "doc_type": kind}
    if kind in NAME_ONLY and kind not in READERS:
        return blank | {"doc_type": "metadata", "success": True, "error": None}
    if kind not in READERS:
        return blank | {"success": False, "error": f"no reader for {kind}"}
    try:
        got = {k: v for k, v in READERS[kind](data).items() if v}
    except Exception as e:  # whatever a damaged file raises is that file's result
        return blank | {"success": False, "error": f"{type(e).__name__}: {e}"[:500]}
    text = got.get("text", "")
    return blank | got | {"text": text[:TEXT_CHARS], "snippet": text[:SNIPPET_CHARS], "success": bool(text), "error": None if text else "no text"}


def blocks(raw: str) -> list[str]:
    """Blocks of markup without scripts, styles and tags, white space collapsed."""
    bare = re.sub(BLOCK_END, "\n", re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", "", raw))
    found = (" ".join(line.split()) for line in html.unescape(re.sub(r"<[^>]+>", "", bare)).split("\n"))
    return [block for block in found if block]


def _lines(text: str) -> list[tuple[int, str, str]]:
    return [(i, f"line {i}", line.strip()) for i, line in enumerate(text.splitlines(), 1) if line.strip()]


def _sections(found: list[str]) -> list[tuple[int, str, str]]:
    return [(i, f"section {i}", text) for i, text in enumerate(found, 1)]


def _placed(label: str, groups: Iterable[list[str]]) -> list[tuple[int, str, str]]:
    """Texts numbered through, each with the label and number of its group."""
    flat = [(f"{label} {n}", text) for n, group in enumerate(groups, 1) for text in group]
    return [(i, place, text) for i, (place, text) in enumerate(flat, 1)]


def units(kind: str, data: bytes) -> list[tuple[int, str, str]]:
    """(number, place, text) of a file's passages; kinds without a reader and damaged files have none.

    Texts, mails and RTF have lines, whose numbers count blank ones; markup has blocks and office texts have paragraphs, as
    sections; an e-book has blocks by chapter, and chapters without text are not counted; a pdf has paragraphs by page.
    """
    try:
        if kind in PLAIN or kind in ("rst", "adoc", "asciidoc", "tex", "latex"):
            return _lines(data.decode("utf-8", "replace"))
        if kind in MARKUP or kind in ("html", "htm"):
            return _sections(blocks(data.decode("utf-8", "replace")))
        if kind in ("rtf", "eml"):
            return _lines(READERS[kind](data)["text"])
        if kind in ("odt", "ott"):
            return _sections([x for line in odf(data)["text"].split("\n") if (x := line.strip())])
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return _sections([x for p in _docx_body(parse_xml(_member(z, "word/document.xml")))[0] if (x := p.strip())])
        if kind == "epub":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return _placed("chapter", [found for name in _spine(z)[1] if (found := blocks(_member(z, name).decode("utf-8", "replace")))])
        if kind == "pdf" and pypdf:
            sheets = (sheet.extract_text() or "" for sheet in pypdf.PdfReader(io.BytesIO(data)).pages)
            return _placed("p.", ([x for part in re.split(r"\n\s*\n", sheet) if (x := part.strip())] for sheet in sheets))
    except Exception:  # a damaged file has no passages; its record tells the error
        return []
    return []
