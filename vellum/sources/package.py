"""EPUB packages as a sink: entries as rows, one deterministic archive for each document."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import archive_entry_fits, archive_path
from ..functions.text import escaped
from .office import MOST_ENTRY, MOST_RATIO

STORED, TYPE = (".png", ".jpg", ".jpeg"), "application/epub+zip"
CSS = "body{margin:5%;line-height:1.45}p{margin:0;text-indent:1.2em}h1,h2{text-align:center}figure{margin:1em 0;text-align:center}img{max-width:100%}.verse{text-indent:0;margin:1em 2em}"
CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def package_rows(documents: DataFrame, document: str = "doc_id") -> DataFrame:
    """document, name, media_type, content: every entry of each package.

    `documents` has title, language, identifier and chapters: an array of chapter_no, title and
    content (XHTML) in order. All entries come from that one row.
    """
    listed = documents.withColumn("files", F.transform("chapters", lambda c: F.struct(c["chapter_no"].alias("chapter_no"), F.concat(F.lit("text/chapter_"), c["chapter_no"].cast("string"), F.lit(".xhtml")).alias("file"), c["title"].alias("title"), c["content"].alias("content"))))

    def each(make: object) -> Column:
        return F.array_join(F.transform("files", make), "")

    number = lambda f: f["chapter_no"].cast("string")
    nav = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>'), each(lambda f: F.concat(F.lit('<li><a href="'), f["file"], F.lit('">'), escaped(f["title"], True), F.lit("</a></li>"))), F.lit("</ol></nav></body></html>"))
    ncx = F.concat(F.lit('<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>'), escaped(F.col("title"), True), F.lit("</text></docTitle><navMap>"), each(lambda f: F.concat(F.lit('<navPoint id="n'), number(f), F.lit('" playOrder="'), number(f), F.lit('"><navLabel><text>'), escaped(f["title"], True), F.lit('</text></navLabel><content src="'), f["file"], F.lit('"/></navPoint>'))), F.lit("</navMap></ncx>"))
    opf = F.concat(
        F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:'), F.col("identifier"), F.lit("</dc:identifier><dc:title>"), escaped(F.col("title"), True), F.lit("</dc:title><dc:language>"), F.col("language"), F.lit("</dc:language></metadata><manifest>"),
        F.lit('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>'),
        each(lambda f: F.concat(F.lit('<item id="c'), number(f), F.lit('" href="'), f["file"], F.lit('" media-type="application/xhtml+xml"/>'))), F.lit('</manifest><spine toc="ncx">'), each(lambda f: F.concat(F.lit('<itemref idref="c'), number(f), F.lit('"/>'))), F.lit("</spine></package>"),
    )
    fixed = [("mimetype", TYPE, F.lit(TYPE)), ("META-INF/container.xml", "application/xml", F.lit(CONTAINER)), ("EPUB/style.css", "text/css", F.lit(CSS)), ("EPUB/nav.xhtml", "application/xhtml+xml", nav), ("EPUB/toc.ncx", "application/x-dtbncx+xml", ncx), ("EPUB/package.opf", "application/oebps-package+xml", opf)]
    entry = lambda name, media, content: F.struct(name.alias("name"), media.alias("media_type"), content.alias("content"))
    texts = F.transform("files", lambda f: entry(F.concat(F.lit("EPUB/"), f["file"]), F.lit("application/xhtml+xml"), f["content"]))
    every = F.concat(F.array(*[entry(F.lit(n), F.lit(m), c) for n, m, c in fixed]), texts)
    return listed.select(document, F.explode(every).alias("e")).select(document, "e.name", "e.media_type", F.col("e.content").cast("binary").alias("content"))


def archive(entries: list[tuple[str, bytes]], when: tuple[int, int, int, int, int, int] = (1980, 1, 1, 0, 0, 0)) -> bytes:
    """'mimetype' first and stored, the others by name, pictures stored, one time for all."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in sorted(entries, key=lambda e: (e[0] != "mimetype", e[0])):
            info = zipfile.ZipInfo(name, when)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" or name.lower().endswith(STORED) else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def archives(rows: DataFrame, document: str = "doc_id") -> DataFrame:
    """document, package (bytes), error: entries with bad names or sizes make no package."""
    checked = rows.withColumn("bad", ~archive_path(F.col("name")))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        key, bad = group[document].iloc[0], group.loc[group["bad"], "name"].tolist()
        made, error = None, f"unsafe entry: {bad[0]}" if bad else None
        if not bad:
            made = archive([(n, bytes(c)) for n, c in zip(group["name"], group["content"], strict=True)])
            with zipfile.ZipFile(io.BytesIO(made)) as z:  # sizes as packed
                tight = [i.filename for i in z.infolist() if i.file_size > MOST_ENTRY or (i.compress_type != zipfile.ZIP_STORED and i.file_size > 1024 and i.file_size > MOST_RATIO * max(1, i.compress_size))]
            if tight:
                made, error = None, f"entry too large: {sorted(tight)[0]}"
        return pd.DataFrame({document: [key], "package": [made], "error": [error]})

    return checked.select(document, "name", "content", "bad").groupBy(document).applyInPandas(each, f"`{document}` {rows.schema[document].dataType.simpleString()}, package binary, error string")


def audited(entries: DataFrame, *archive_keys: str) -> DataFrame:
    """Entries (name, size, packed) with what is wrong: their name, their size, or their archive's total."""
    total = F.sum("size").over(Window.partitionBy(*archive_keys))
    return entries.withColumn("error", F.when(~archive_path(F.col("name")), "unsafe name").when(~archive_entry_fits(F.col("size"), F.col("packed")), "entry too large").when(total > 250 * 1024 * 1024, "archive too large"))


def output_path(source: str, given: str | None = None) -> str:
    """A folder gets the source's name in it; a name with another ending gets .epub."""
    name = Path(source).with_suffix(".epub").name
    if not given:
        return str(Path(source).with_suffix(".epub"))
    path = Path(given)
    return str(path / name) if given.endswith("/") or path.is_dir() else str(path.with_suffix(".epub"))
