"""Office files. DOCX is read here; other formats need converters and say so."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import FLOW

#: Fixed value: the share of a page from which an image is taken for its scan.
SCAN_SHARE = 0.85
SUFFIXES = (".pdf", ".docx", ".odt", ".rtf", ".doc")
# Limits on archives.
MOST_ENTRY, MOST_TOTAL, MOST_RATIO = 50 << 20, 250 << 20, 100
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


class UnsupportedInput(ValueError):
    """No reader for this kind of file, or the tool that it needs is absent."""


def dispatched(files: DataFrame) -> DataFrame:
    """`files` (path) with suffix, route and error: pdf, docx, converter, or none with what is wrong."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    rows = files.withColumn("suffix", suffix)
    route = F.when(F.col("suffix") == ".pdf", "pdf").when(F.col("suffix") == ".docx", "docx").when(F.col("suffix").isin(*SUFFIXES), "converter")
    return rows.withColumn("route", route).withColumn("error", F.when(route.isNull(), F.concat(F.lit("unsupported input: "), F.col("suffix"))).when(route == "converter", F.concat(F.lit("needs an external converter: "), F.col("suffix"))))


def _text(paragraph: ElementTree.Element) -> str:
    return " ".join("".join(t.text or "" for t in paragraph.iter(f"{_W}t")).split())


def _cell(cell: ElementTree.Element) -> str:
    lines = []
    for block in cell:
        if block.tag == f"{_W}p" and _text(block):
            lines.append(_text(block))
        elif block.tag == f"{_W}tbl":
            lines += [" | ".join(row) for row in _rows(block)]
    return "\n".join(lines)


def _rows(table: ElementTree.Element) -> list[list[str]]:
    return [[_cell(c) for c in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]


def check_archive(z: zipfile.ZipFile) -> None:
    """Refuses unsafe names, entries that are too large or packed too tightly, and archives that are too large in all."""
    entries = z.infolist()
    for i in entries:
        parts = i.filename.replace("\\", "/").split("/")
        if not i.filename.strip() or i.filename[0] in "/\\" or ".." in parts or "\0" in i.filename or re.match("[A-Za-z]:", i.filename):
            raise UnsupportedInput(f"unsafe entry: {i.filename}")
        if i.file_size > MOST_ENTRY or (i.file_size > 1024 and i.file_size > MOST_RATIO * max(1, i.compress_size)):
            raise UnsupportedInput(f"entry too large: {i.filename}")
    if sum(i.file_size for i in entries) > MOST_TOTAL:
        raise UnsupportedInput("archive entries are too large")


def docx_items(raw: bytes) -> list[dict]:
    """Flow items of a DOCX file in document order; each image counts once."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        check_archive(z)
        xml = z.read("word/document.xml")
        if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml or b"\x00" in xml[:64]:
            raise UnsupportedInput("document types and entities aren't accepted")
        body = ElementTree.fromstring(xml).find(f"{_W}body")
    items: list[dict] = []
    seen: set[str] = set()
    for position, block in enumerate(body if body is not None else [], 1):
        if block.tag == f"{_W}tbl":
            rows = [r for r in _rows(block) if r]
            if any(c for r in rows for c in r):
                items.append({"kind": "table", "rows": rows, "has_header_row": True})
        elif block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            match = re.fullmatch(r"heading ?([1-3])", (style.get(f"{_W}val") or "").lower()) if style is not None else None
            sizes = [int(s.get(f"{_W}val") or 0) / 2 for s in block.iter(f"{_W}sz")]
            runs = [r for r in block.iter(f"{_W}r") if "".join(t.text or "" for t in r.iter(f"{_W}t")).strip()]
            bold = sum(r.find(f"{_W}rPr/{_W}b") is not None for r in runs) / len(runs) if runs else 0.0
            level, text = (int(match[1]) if match else 0), _text(block)
            if level:
                items.append({"kind": "heading", "text": text or f"Section {position}", "level": level, "is_chapter_heading": level == 1, "font": max(sizes, default=max(12.0, 22.0 - 2 * level)), "bold_ratio": bold})
            elif text:
                items.append({"kind": "paragraph", "text": text, "font": max(sizes, default=12.0), "bold_ratio": bold})
            for blip in block.iter(f"{_A}blip"):
                ref = blip.get(f"{_R}embed")
                if ref and ref not in seen:
                    seen.add(ref)
                    items.append({"kind": "image", "src": ref, "alt": "Document image"})
    return items


def docx_flow(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, the flow items of every file, and error for files that can't be read."""
    names = [c.split()[0] for c in FLOW.split(", ")]
    base = {"text": "", "level": 0, "is_chapter_heading": False, "font": 12.0, "bold_ratio": 0.0}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch[key], batch[content], strict=True):
                try:
                    if raw is None:
                        raise UnsupportedInput("no content")
                    rows += [{key: k, "ord": i, **base, **item} for i, item in enumerate(docx_items(bytes(raw)))]
                except (UnsupportedInput, zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append({key: k, "ord": 0, "kind": "error", **base, "error": str(e) or type(e).__name__})
            out = pd.DataFrame(rows, columns=[key, *names, "error"])
            for c in ("rows", "has_header_row", "src", "alt", "error"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    return files.select(key, content).mapInPandas(each, f"`{key}` {files.schema[key].dataType.simpleString()}, {FLOW}, error string")


def pdf_pages(files: DataFrame) -> DataFrame:
    """Where a PDF library would read pages; none is part of this package."""
    raise UnsupportedInput("reading PDF files needs a PDF library; start from tables of characters, words or blocks")


def ocr_route(pages: DataFrame, read_again: DataFrame | None, document: str = "doc_id") -> DataFrame:
    """`pages` with the text of those that are short of text or have bad glyphs replaced by what an engine read.

    `pages` has page_number, char_count, bad_glyph_ratio, width, height and text; `read_again` (the
    engine's document, page_number, text) is None without an engine. Adds ocr: null for pages that
    need none, else 'replaced', 'skipped' (no engine) or 'failed' (no text read); text is only
    replaced in the first case. Tables aren't touched.
    """
    from ..functions.predicates import needs_ocr

    poor = needs_ocr(F.col("char_count"), F.col("bad_glyph_ratio"), F.col("width"), F.col("height"))
    if read_again is None:
        return pages.withColumn("ocr", F.when(poor, "skipped"))
    found = read_again.select(document, "page_number", F.col("text").alias("read_text"))
    rows = pages.join(found, [document, "page_number"], "left")
    good = F.coalesce(F.col("read_text"), F.lit("")) != ""
    return rows.withColumn("ocr", F.when(poor & good, "replaced").when(poor, "failed")).withColumn("text", F.when(poor & good, F.col("read_text")).otherwise(F.col("text"))).drop("read_text")


def without_scans(images: DataFrame, routed: DataFrame, document: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(images that stay, ledger rows of scans): on replaced pages, images over 85 % of the page or more go."""
    on = routed.filter("ocr = 'replaced'").select(document, "page_number", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("page_width") * F.col("page_height"))
    marked = images.join(on, [document, "page_number"], "left").withColumn("is_scan", F.coalesce(share >= SCAN_SHARE, F.lit(False))).drop("page_width", "page_height")
    gone = marked.filter("is_scan").select(document, "page_number", F.lit("ocr_replaced_scan").alias("reason"), "x0", "y0", "x1", "y1", F.lit("").alias("text"))
    return marked.filter("not is_scan").drop("is_scan"), gone


def large_images(images: DataFrame) -> DataFrame:
    """Images that aren't empty nor, with both sides known, under 15 pixels on one."""
    tiny = F.coalesce((F.col("native_width") < 15) | (F.col("native_height") < 15), F.lit(False))
    return images.filter((F.length("content") > 0) & ~tiny)
