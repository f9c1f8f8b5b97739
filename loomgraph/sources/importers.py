"""Readers for books as files: plain text, HTML, EPUB and DOCX, one row for each chapter.

Files come from spark.read.format("binaryFile"); parsing runs file by file in mapInArrow, nothing is fetched.
A file that can't be read gives one row with its error and no text.
"""

from __future__ import annotations

import codecs
import hashlib
import html
import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

MOST_FILES, MOST_BYTES, MOST_RATIO = 2000, 200 << 20, 200
HEADING = re.compile(r"(?m)^[ \t]*(?:(?:chapter|part|book)[ \t]+[0-9ivxlc]+\b[^\n]{0,80}|第[0-9一-鿿]{1,12}[章节回卷部篇][^\n]{0,80})[ \t]*$", re.I)
SKIPPED = {"script", "style", "svg", "iframe", "object", "noscript"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "table", "ul", "ol", "pre", "hr", "title", "body"}
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


#: Charsets that a text may declare, and the decoder of each: those of one family are read by its largest member.
CHARSETS = {"utf8": "utf-8", "utf16": "utf-16", "ascii": "utf-8", "usascii": "utf-8", "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "shiftjis": "cp932", "sjis": "cp932", "xsjis": "cp932", "windows31j": "cp932", "cp932": "cp932", "ms932": "cp932", "eucjp": "euc_jp", "euckr": "cp949", "windows1252": "cp1252", "iso88591": "cp1252", "latin1": "cp1252"}


def decode(raw: bytes) -> str:
    """By byte-order mark, else by the declared charset if it is a known one, else UTF-8, else GB 18030. ValueError if none fits."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw.decode(name)
    tried = ["utf-8", "gb18030"]
    said = re.search(rb"""(?:charset|encoding)\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", raw[:4096])
    if said:
        name = CHARSETS.get(re.sub(r"[^a-z0-9]", "", said[1].decode().lower()))
        tried = [name, *tried] if name else tried
    for name in tried:
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    raise ValueError("unknown encoding")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.heading = [], 0, "", None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        elif tag in BLOCKS:
            self.out.append("\n")
        if tag in ("h1", "h2") and not self.title:
            self.heading = []

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.out.append("\n")
        if tag in ("h1", "h2") and self.heading is not None:
            self.title, self.heading = " ".join("".join(self.heading).split())[:120], None

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.heading is not None:
                self.heading.append(data)


def tidy(text: str) -> str:
    lines = [" ".join(x.replace("　", " ").split(" ")) for x in re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in lines)).strip()


def visible(page: str) -> tuple[str, str]:
    """Title (first h1 or h2) and visible text."""
    p = _Visible()
    p.feed(page)
    p.close()
    return p.title, tidy("".join(p.out))


def chapters(text: str, title: str) -> list[tuple[str, str]]:
    """(title, body) by headings; what stands before the first one is a chapter if it isn't blank."""
    found = list(HEADING.finditer(text))
    if not found:
        return [(title, text.strip())]
    out = [("", text[: found[0].start()].strip())] if text[: found[0].start()].strip() else []
    ends = [m.start() for m in found[1:]] + [len(text)]
    return out + [(m[0].strip(), text[m.start() : e].strip()) for m, e in zip(found, ends, strict=True)]


def unpacked(raw: bytes) -> zipfile.ZipFile:
    """An archive that is safe to read: bounded, no paths out of it, not encrypted."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    items = z.infolist()
    if len(items) > MOST_FILES or sum(i.file_size for i in items) > MOST_BYTES:
        raise ValueError("archive too large")
    for i in items:
        name = i.filename.replace("\\", "/")
        if i.flag_bits & 1 or name.startswith("/") or ".." in name.split("/"):
            raise ValueError("unsafe archive")
        if i.file_size > 1 << 20 and i.file_size > MOST_RATIO * max(1, i.compress_size):
            raise ValueError("suspicious compression")
    return z


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(raw)


def epub(raw: bytes) -> list[tuple[str, str]]:
    z = unpacked(raw)
    if "META-INF/encryption.xml" in z.namelist():
        raise ValueError("encrypted book")
    root = next(e.attrib["full-path"] for e in _xml(z.read("META-INF/container.xml")).iter() if e.tag.endswith("}rootfile"))
    package = _xml(z.read(root))
    items = {e.attrib["id"]: e.attrib for e in package.iter() if e.tag.endswith("}item")}
    out = []
    for ref in (e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref")):
        item = items.get(ref, {})
        href = item.get("href", "")
        if "html" not in item.get("media-type", "") or "://" in href:
            continue
        title, text = visible(decode(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), href.split("#")[0])))))
        if text:
            out.append((title, text))
    return out


def docx(raw: bytes) -> list[tuple[str, str]]:
    body = _xml(unpacked(raw).read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in body.iter() if p.tag.endswith("}p")]
    return chapters(tidy("\n".join(lines)), "")


def about(name: str, raw: bytes) -> tuple[str, str]:
    """Title and author that a file gives of itself: an EPUB's package, a DOCX's core properties, a page's title; else its name."""
    kind = posixpath.splitext(name.lower())[1]
    own = posixpath.splitext(posixpath.basename(name))[0]
    if kind in (".epub", ".docx"):
        z = unpacked(raw)
        if kind == ".epub":
            inner = next(e.attrib["full-path"] for e in _xml(z.read("META-INF/container.xml")).iter() if e.tag.endswith("}rootfile"))
        else:
            inner = "docProps/core.xml"
        found = {"title": "", "creator": ""}
        for e in _xml(z.read(inner)).iter() if inner in z.namelist() else ():
            field = e.tag.rpartition("}")[2]
            if field in found and not found[field]:
                found[field] = " ".join((e.text or "").split())
        return found["title"] or own, found["creator"]
    if kind in (".html", ".htm"):
        text = decode(raw)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
        author = re.search(r"""(?is)<meta[^>]+name=["']author["'][^>]+content=["']([^"']*)["']""", text)
        return (" ".join(html.unescape(title[1]).split()) if title else "") or own, author[1].strip() if author else ""
    return own, ""


def parse(name: str, raw: bytes) -> list[tuple[str, str]]:
    kind = posixpath.splitext(name.lower())[1]
    if kind in (".txt", ".md", ".markdown"):
        return chapters(tidy(decode(raw)), posixpath.splitext(posixpath.basename(name))[0])
    if kind in (".html", ".htm"):
        return [visible(decode(raw))]
    if kind == ".epub":
        return epub(raw)
    if kind == ".docx":
        return docx(raw)
    raise ValueError(f"unknown format {kind or name}")


SCHEMA = "path string, source_hash string, book_title string, author string, chapter long, title string, text string, error string"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chapter of each file below path."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sha = hashlib.sha256(raw).hexdigest()
                try:
                    out += [(name, sha, *about(name, raw), k, t, x, None) for k, (t, x) in enumerate(parse(name, raw))]
                except Exception as e:  # any file may be broken in any way; the row says how
                    out.append((name, sha, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "source_hash", "book_title", "author", "chapter", "title", "text", "error"), r, strict=True)) for r in out], schema=pa.schema([("path", pa.string()), ("source_hash", pa.string()), ("book_title", pa.string()), ("author", pa.string()), ("chapter", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("error", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
