"""Part tables to text, HTML, DOCX and EPUB files: bytes are made where the rows are, one group per work."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ILLEGAL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF￾￿]")
_STAMP = (1980, 1, 1, 0, 0, 0)


def _xml(s: str) -> str:
    return escape(_ILLEGAL.sub("", s))


def _zip(entries: list[tuple[str, str, bool]]) -> bytes:
    """Entries in order, with fixed times, so that equal content gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text, packed in entries:
            z.writestr(zipfile.ZipInfo(name, _STAMP), text, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


def to_txt(title: str, parts: list[str]) -> bytes:
    return ("\n\n".join([title, *parts]) + "\n").encode()


def to_html(title: str, parts: list[str]) -> bytes:
    body = "".join(f"<p>{_xml(x)}</p>" for p in parts for x in p.split("\n") if x.strip())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"/><title>{_xml(title)}</title></head><body><h1>{_xml(title)}</h1>{body}</body></html>'.encode()


def to_docx(title: str, parts: list[str]) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    rows = [f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t xml:space="preserve">{_xml(title)}</w:t></w:r></w:p>']
    rows += [f'<w:p><w:r><w:t xml:space="preserve">{_xml(x)}</w:t></w:r></w:p>' for p in parts for x in p.split("\n") if x.strip()]
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    return _zip([("[Content_Types].xml", types, True), ("_rels/.rels", rels, True), ("word/document.xml", f"<w:document {w}><w:body>{''.join(rows)}</w:body></w:document>", True)])


def to_epub(title: str, parts: list[str], lang: str = "en") -> bytes:
    """A chapter for each part; a short first line is its heading; empty parts are left out."""
    pages = []
    for p in parts:
        ls = [x.strip() for x in p.split("\n") if x.strip()]
        if ls:
            head = ls[0] if len(ls[0]) <= 120 else f"{len(pages) + 1}"
            body = "".join(f"<p>{_xml(x)}</p>" for x in (ls[1:] if head == ls[0] else ls))
            pages.append((head, f'<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{lang}"><head><title>{_xml(head)}</title></head><body><h1>{_xml(head)}</h1>{body}</body></html>'))
    names = [f"c{i:03d}.xhtml" for i in range(1, len(pages) + 1)]
    nav = "".join(f'<li><a href="{n}">{_xml(h)}</a></li>' for n, (h, _) in zip(names, pages, strict=True))
    items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(names)))
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{_xml(title)}</dc:identifier><dc:title>{_xml(title)}</dc:title><dc:language>{lang}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    container = '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    toc = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{_xml(title)}</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>'
    return _zip([("mimetype", "application/epub+zip", False), ("META-INF/container.xml", container, True), ("OEBPS/p.opf", opf, True), ("OEBPS/nav.xhtml", toc, True), *((f"OEBPS/{n}", page, True) for n, (_, page) in zip(names, pages, strict=True))])


WRITERS = {"txt": to_txt, "html": to_html, "docx": to_docx, "epub": to_epub}


def render(parts: DataFrame, formats: tuple[str, ...] = ("txt", "epub")) -> DataFrame:
    """job_id, format, bytes: each work's parts (job_id, idx, title, text) written in each format. A group is one work."""
    kind = parts.schema["job_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        title, texts = pdf["title"].iloc[0] or "", [x or "" for x in pdf["text"]]
        return pd.DataFrame([(pdf["job_id"].iloc[0], f, WRITERS[f](title, texts)) for f in formats], columns=["job_id", "format", "bytes"])

    return parts.select("job_id", "idx", "title", "text").groupBy("job_id").applyInPandas(run, f"job_id {kind}, format string, bytes binary")


def check_epub(raw: bytes | None) -> list[str]:
    """Faults of an EPUB's structure: first entry, container, files that the manifest or the spine names, pages that aren't XML."""
    import posixpath
    from xml.etree import ElementTree

    try:
        z = zipfile.ZipFile(io.BytesIO(raw or b""))
    except zipfile.BadZipFile:
        return ["not a zip file"]
    names, faults = z.namelist(), []
    if not names or names[0] != "mimetype" or z.read("mimetype") != b"application/epub+zip":
        faults.append("mimetype is not the first entry")
    try:
        opf = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
    except (KeyError, StopIteration, ElementTree.ParseError) as e:
        return [*faults, f"no package: {e}"]
    items = {e.get("id"): posixpath.join(posixpath.dirname(opf), e.get("href")) for e in package.iter() if e.tag.endswith("}item")}
    faults += [f"missing file {x}" for x in items.values() if x not in names]
    faults += [f"missing item {e.get('idref')}" for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") not in items]
    for x in items.values():
        if x in names and x.endswith(".xhtml"):
            try:
                ElementTree.fromstring(z.read(x))
            except ElementTree.ParseError as e:
                faults.append(f"{x}: {e}")
    return faults


def write_text(parts: DataFrame, path: str) -> None:
    """One folder for each version, as text files."""
    parts.select("version", F.col("text").alias("value")).write.mode("overwrite").partitionBy("version").text(path)


def fold_note_marks(text: str) -> list[tuple[int, str]]:
    """Note references of a text as (offset in the text without them, label)."""
    out, shift = [], 0
    for m in re.finditer(r"\{\{(n\d{4,})\}\}", text):
        out.append((m.start() - shift, m[1]))
        shift += len(m[0])
    return out
