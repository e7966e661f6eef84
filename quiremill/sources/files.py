"""Files to tables: plain text, DOCX, EPUB, tagged markdown, tab-separated catalogues, folder listings, JSON state."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiremill.functions.text import ACCENTED, PLAIN
from quiremill.sources.html import parse

ITEMS = "path string, item_no long, kind string, level int, text string"
SUPPORTED = ("txt", "docx", "epub", "md", "html")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, ext, author, title, id of the files under root; names read 'author - title'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    halves = F.split(name, r" - | {2,}", 2)
    slug = F.substring(F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^a-z0-9]+", "-"), 1, 60)
    return files.select(
        "path", name.alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "length",
        F.when(F.size(halves) > 1, halves[0]).alias("author"), F.element_at(halves, -1).alias("title"), F.concat(slug, F.lit("-"), F.substring(F.sha1("path"), 1, 6)).alias("id"),
    )


def decode_text(raw: bytes) -> str:
    """UTF-8 with or without a mark, else the Turkish code page, else Latin-1."""
    for code in ("utf-8-sig", "cp1254"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def read_txt(raw: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs between blank lines, soft ends joined; page numbers alone go; short lines in capitals are headings."""
    out = []
    for part in re.split(r"\n\s*\n", decode_text(raw).replace("\r\n", "\n")):
        text = " ".join(part.split())
        if not text or re.fullmatch(r"[-–\s]*\d{1,4}[-–\s]*", text):
            continue
        head = len(text) <= 60 and any(c.isalpha() for c in text) and text == text.upper()
        out.append(("heading" if head else "p", int(head), text))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(raw: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs; styles HeadingN and Title give headings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = " ".join("".join(t.text or "" for t in p.iter(f"{_W}t")).split())
        style = next((s.get(f"{_W}val") or "" for s in p.iter(f"{_W}pStyle")), "")
        m = re.search(r"(?i)heading\s*(\d)", style)
        level = int(m[1]) if m else int(style.lower() == "title")
        if text:
            out.append(("heading" if level else "p", level, text))
    return out


def read_epub(raw: bytes) -> list[tuple[str, int, str]]:
    """Blocks in reading order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        out = []
        for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
            page = z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(items[ref])))).decode("utf-8", "replace")
            for tag, text, aside in parse(page).blocks:
                if tag == "title" or aside or re.fullmatch(r"\d{1,4}", text):
                    continue
                level = int(tag[1]) if re.fullmatch(r"h[1-6]", tag) else 0
                out.append(("heading" if level else "p", level, text))
    return out


def read_tagged(raw: bytes) -> list[tuple[str, int, str]]:
    """Tagged markdown: #META# key::value rows, '### |' headings (a bar for each level), '# ' paragraphs, '~~' goes on; a page mark names the page that ends."""
    out: list[tuple[str, int, str]] = []
    for line in decode_text(raw).splitlines():
        if m := re.match(r"#META#\s*(.*?)\s*::\s*(.*)", line):
            out.append(("meta", 0, f"{m[1]}={m[2]}"))
        elif m := re.match(r"#{1,3} (\|+)\s*(.*)", line):
            out.append(("heading", len(m[1]), m[2].strip()))
        elif line.startswith("~~") and out and out[-1][0] in ("p", "heading"):
            kind, level, text = out[-1]
            out[-1] = (kind, level, f"{text} {line[2:].strip()}".strip())
        elif line.startswith("# "):
            out.append(("p", 0, line[2:].strip()))
    pages: list[tuple[str, int, str]] = []
    for kind, level, text in out:
        marks = re.findall(r"PageV(\d+)P(\d+)", text)
        pages.append((kind, level, " ".join(re.sub(r"PageV\d+P\d+", " ", text).split())))
        pages += [("page", int(v), str(int(p))) for v, p in marks]
    return pages


def read_html(raw: bytes) -> list[tuple[str, int, str]]:
    return [("heading", int(t[1]), x) if re.fullmatch(r"h[1-6]", t) else ("p", 0, x) for t, x, aside in parse(decode_text(raw)).blocks if not aside and t != "title"]


READERS = {"txt": read_txt, "docx": read_docx, "epub": read_epub, "md": read_tagged, "html": read_html}


def parse_files(files: DataFrame) -> DataFrame:
    """The items (kind, level, text, in order) of files (path, ext, content), one reader for each extension, others left out.
    A file that can't be read gives one 'error' row; null content gives nothing."""

    def run(batches):
        for b in batches:
            rows = []
            for path, ext, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    items = READERS[ext](raw) if raw is not None else []
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    items = [("error", 0, f"{type(e).__name__}: {e}")]
                rows += [(path, i, *x) for i, x in enumerate(items)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "item_no", "kind", "level", "text"])

    return files.select("path", "ext", "content").filter(F.col("ext").isin(*SUPPORTED)).mapInArrow(run, ITEMS)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The items of all supported files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return parse_files(files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "content"))


def catalogue(spark: SparkSession, path: str, status: str = "pri") -> DataFrame:
    """A tab-separated catalogue: rows of one status, sizes as numbers, with search keys."""
    from quiremill.functions.text import fold_key

    rows = spark.read.option("sep", "\t").option("header", "true").csv(path)
    return rows.filter(F.col("status") == status).withColumn("tok_length", F.expr("try_cast(tok_length AS BIGINT)")).withColumn("key", fold_key(F.concat_ws(" ", "author", "title")))


def search_catalogue(rows: DataFrame, query_: str, limit: int = 200) -> DataFrame:
    """Rows whose key holds every word of the query; whole words, then length, then id decide."""
    from quiremill.functions.text import fold_key

    wanted = F.filter(F.split(fold_key(F.lit(query_)), " "), lambda w: w != "")
    hits = F.aggregate(wanted, F.lit(0), lambda a, w: a + F.contains("key", F.concat(F.lit(" "), w, F.lit(" "))).cast("int"))
    return rows.filter(F.forall(wanted, lambda w: F.contains("key", w))).orderBy(F.desc(hits), F.desc(F.least(F.coalesce("tok_length", F.lit(0)), F.lit(2_000_000))), "id").limit(limit)


def shelf(files: DataFrame) -> DataFrame:
    """Files of one work together: the name without ' - N' parts; parts in natural order."""
    base = F.trim(F.regexp_replace("name", r" - \d+$", ""))
    part = F.coalesce(F.nullif(F.regexp_extract("name", r" - (\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    packed = F.array_sort(F.collect_list(F.struct("ext", part.alias("part"), "path")))
    return files.groupBy(F.lower(base).alias("work")).agg(F.array_join(F.array_sort(F.collect_set("ext")), "+").alias("formats"), F.count("*").alias("files"), packed.alias("parts"))


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents as a table, one row each."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and old's whose key new lacks; columns that one side lacks are null."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def continued(lines: DataFrame, keys: list[str], at: str, starts: Column) -> DataFrame:
    """Lines gathered with those that go on from them, by a running sum of starts."""
    w = Window.partitionBy(*keys).orderBy(at)
    return lines.withColumn("group", F.sum(starts.cast("long")).over(w))
