"""Office formats to Markdown, one file at a time within tasks. Each converter returns an empty text for what it can't read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, stem, strip_tags

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx(data: bytes) -> str:
    """Headings and paragraphs, then tables as rows between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t"))
    out = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.match(r"Heading ?(\d)", style.get(f"{_W}val", "") if style is not None else "")
        if text := said(p).strip():
            out.append(f"{'#' * int(level[1])} {text}" if level else text)
    for t in body.findall(f"{_W}tbl"):
        rows = [[said(c).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        out += [_row(r) if i else f"{_row(r)}\n{_row(['---'] * len(r))}" for i, r in enumerate(rows)]
    return "\n\n".join(out)


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def xlsx(data: bytes) -> str:
    """A heading and a table for each sheet; empty rows are left out."""
    box = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in box.namelist():
        shared = ["".join(t.text or "" for t in x.iter(f"{_S}t")) for x in ElementTree.fromstring(box.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    names = [x.get("name") for x in ElementTree.fromstring(box.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for i, name in enumerate(names, 1):
        rows = []
        for r in ElementTree.fromstring(box.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{_S}row"):
            cells = []
            for c in r.findall(f"{_S}c"):
                value = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            if any(cells):
                rows.append(cells)
        out.append(f"## Sheet: {name}")
        out += [_row(r) if j else f"{_row(r)}\n{_row(['---'] * len(r))}" for j, r in enumerate(rows)]
    return "\n\n".join(out)


def epub(data: bytes) -> str:
    """The book's chapters in reading order, as HTML without tags."""
    box = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(box.read("META-INF/container.xml"))
    opf = next(x.get("full-path") for x in root.iter() if x.tag.endswith("rootfile"))
    package = ElementTree.fromstring(box.read(opf))
    items = {x.get("id"): x.get("href") for x in package.iter() if x.tag.endswith("}item") or x.tag == "item"}
    order = [x.get("idref") for x in package.iter() if x.tag.endswith("itemref")]
    folder = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    out = []
    for ref in order:
        page = box.read(folder + items[ref]).decode("utf-8", "replace")
        inner = re.search(r"<body[^>]*>([\s\S]*?)</body>", page)
        text = re.sub(r"<h([1-4])[^>]*>([\s\S]*?)</h\1>", lambda m: f"\n\n{'#' * int(m[1])} {m[2]}\n\n", inner[1] if inner else page)
        out.append(re.sub(r"\n{3,}", "\n\n", re.sub(r"<[^>]+>", "", text)).strip())
    return "\n\n".join(out)


def pptx(data: bytes) -> str:
    """A heading for each slide with its texts, paragraph by paragraph, and tables as rows between bars; notes follow as quotes."""
    box = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in box.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_A}t")).strip()
    out = []
    for nth, name in slides:
        out.append(f"## Slide {nth}")
        root = ElementTree.fromstring(box.read(name))
        tables = list(root.iter(f"{_A}tbl"))
        inside = {id(p) for t in tables for p in t.iter(f"{_A}p")}
        out += [text for p in root.iter(f"{_A}p") if id(p) not in inside and (text := said(p))]
        for t in tables:
            rows = [[said(c) for c in r.findall(f"{_A}tc")] for r in t.findall(f"{_A}tr")]
            out += [_row(r) if i else f"{_row(r)}\n{_row(['---'] * len(r))}" for i, r in enumerate(rows)]
        notes = f"ppt/notesSlides/notesSlide{nth}.xml"
        if notes in box.namelist():
            out += [f"> {text}" for p in ElementTree.fromstring(box.read(notes)).iter(f"{_A}p") if (text := said(p))]
    return "\n\n".join(out)


def pdf(data: bytes) -> str:
    """Text of a PDF by pypdf, where that is installed."""
    import pypdf

    return "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)


def looks_scanned(text: Column, pages: Column, least: int = 50) -> Column:
    """True if a document of two pages or more has hardly any text."""
    return (pages >= 2) & (F.length(F.regexp_replace(text, r"(?U)\s", "")) < least)


CONVERTERS = {".docx": docx, ".xlsx": xlsx, ".epub": epub, ".pdf": pdf, ".pptx": pptx}


def converted(files: DataFrame) -> DataFrame:
    """Adds `markdown` and `error` to files (source_file, content): HTML by expressions, other formats by a converter."""

    @F.pandas_udf("markdown string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(ext: str, data: bytes) -> tuple[str, str | None]:
            try:
                return CONVERTERS[ext](data), None
            except Exception as e:  # a broken or unsupported file is reported, it doesn't stop the build
                return "", f"{type(e).__name__}: {e}"

        for exts, contents in batches:
            yield pd.DataFrame([one(e, c) for e, c in zip(exts, contents)], columns=["markdown", "error"])

    ext = extension(F.col("source_file"))
    binary = files.where(ext.isin(*CONVERTERS)).withColumn("c", run(ext, F.col("content"))).select(*files.columns, "c.markdown", "c.error")
    html = files.where(ext.isin(".html", ".htm")).withColumns({"markdown": strip_tags(F.decode("content", "UTF-8")), "error": F.lit(None).cast("string")})
    # What no converter reads is reported, not left out.
    rest = files.where(F.coalesce(~ext.isin(*CONVERTERS, ".html", ".htm"), F.lit(True)))
    rest = rest.withColumns({"markdown": F.lit(""), "error": F.concat(F.lit("no converter for "), F.coalesce(F.when(ext != "", ext), F.lit("a file without suffix")))})
    return binary.unionByName(html).unionByName(rest)


def sidecar(source_file: Column) -> Column:
    """Name of the Markdown file that a converted one is kept in."""
    return F.concat(stem(source_file), F.lit("_"), F.substring(F.sha2(source_file, 256), 1, 8), F.lit(".md"))
