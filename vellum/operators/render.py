"""Rendering of chapters: markup to XHTML, tables, bodies and package documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EM, NOTE_REF, SENTINELS, STRONG, SUB, SUP, collapse, escaped, let

# Elements that styling becomes.
TAGS = {STRONG: "strong", EM: "em", SUP: "sup", SUB: "sub"}


def _styled(html: Column) -> Column:
    for (opening, closing), tag in TAGS.items():
        html = F.replace(F.replace(html, F.lit(opening), F.lit(f"<{tag}>")), F.lit(closing), F.lit(f"</{tag}>"))
    return F.regexp_replace(html, SENTINELS, "")


def inline(markup: Column) -> Column:
    """Markup as XHTML; note references become plain superscripts."""
    return _styled(F.regexp_replace(escaped(markup), NOTE_REF, "<sup>$2</sup>"))


def linked(markup: Column, targets: Column) -> Column:
    """Markup as XHTML; each note reference links into its target (a file, '' for this one), or is a superscript where that is null."""
    safe = escaped(markup)
    ids, labels = (F.regexp_extract_all(safe, F.lit(NOTE_REF), F.lit(i)) for i in (1, 2))

    def piece(gap: Column, i: Column) -> Column:
        note, label, target = F.get(ids, i), F.get(labels, i), F.get(targets, i)
        link = F.concat(F.lit('<a href="'), target, F.lit("#fn"), note, F.lit('" id="fnref'), note, F.lit('" epub:type="noteref">'), label, F.lit("</a>"))
        return F.concat(gap, F.coalesce(F.when(target.isNotNull(), link), F.concat(F.lit("<sup>"), label, F.lit("</sup>")), F.lit("")))

    return _styled(F.array_join(F.transform(F.split(safe, NOTE_REF, -1), piece), ""))


def note_targets(items: DataFrame, document: str, chapter: str, order: str = "item_no") -> DataFrame:
    """`items` (text, kind, note_id) with targets: for each note reference in text the file to link into.

    A note is linked once in a chapter, at its first reference, and only if the document has it; its
    file is that of the chapter that holds it, '' for the same one. All other places are null.
    """
    refs = items.select(document, chapter, order, F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NOTE_REF), F.lit(1))).alias("at", "ref"))
    first = F.row_number().over(Window.partitionBy(document, chapter, "ref").orderBy(order, "at")) == 1
    files = items.filter("kind = 'note' and note_id is not null").groupBy(document, F.col("note_id").cast("string").alias("ref")).agg(F.min(chapter).alias("home"))
    known = refs.withColumn("first", first).join(files, [document, "ref"], "left")
    target = F.when(F.col("first") & F.col("home").isNotNull(), F.when(F.col("home") == F.col(chapter), "").otherwise(F.concat(F.lit("chapter_"), F.col("home").cast("string"), F.lit(".xhtml"))))
    listed = known.groupBy(document, chapter, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", target.alias("to")))), lambda x: x["to"]).alias("targets"))
    return items.join(listed, [document, chapter, order], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def table_html(rows: Column, header: Column) -> Column:
    """A table of rows of texts: empty rows go, short ones are padded; '' when nothing is left."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: collapse(c) != ""))
    width = F.array_max(F.transform(full, F.size))

    def one(tag: str, scope: str = "") -> object:
        return lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.concat(F.lit(f"<{tag}{scope}>"), escaped(collapse(c), True), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    head = F.when(header, F.concat(F.lit("<thead>"), F.array_join(F.transform(F.slice(full, 1, 1), one("th", ' scope="col"')), ""), F.lit("</thead>"))).otherwise("")
    rest = F.when(header, F.slice(full, 2, 1 << 30)).otherwise(full)
    body = F.when(F.size(rest) > 0, F.concat(F.lit("<tbody>"), F.array_join(F.transform(rest, one("td")), ""), F.lit("</tbody>"))).otherwise("")
    return F.when(F.size(full) > 0, F.concat(F.lit("<table>"), head, body, F.lit("</table>"))).otherwise("")


def heading_pairs(items: DataFrame, *chapter: str, order: str = "item_no") -> DataFrame:
    """`items` with subtitle and swallowed: in a run of headings each second one is its forerunner's subtitle."""
    w = Window.partitionBy(*chapter).orderBy(order)
    is_heading = F.col("kind") == "heading"
    rows = items.withColumn("run", F.sum((~is_heading).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(*chapter, "run", is_heading).orderBy(order))
    rows = rows.withColumn("at", F.when(is_heading, at))
    second = is_heading & (F.col("at") % 2 == 0)
    follows = F.lead(F.when(second, F.col("text"))).over(w)
    return rows.withColumn("subtitle", F.when(is_heading & (F.col("at") % 2 == 1), follows)).withColumn("swallowed", second).drop("run", "at")


def first_images(images: DataFrame, *chapter: str, order: str = "ord", content: str = "content") -> DataFrame:
    """Of equal images in a chapter the first."""
    digest = F.sha2(F.col(content), 256)
    w = Window.partitionBy(*chapter, "image_key").orderBy(order)
    return images.withColumn("image_key", digest).withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


def bodies(items: DataFrame, *chapter: str, order: str = "item_no") -> DataFrame:
    """chapter keys, body: a chapter's items as XHTML, notes last.

    `items` has kind, text, is_chapter_heading, and where there are such, rows and has_header_row
    (tables), note_id and marker (notes), image_file, alt, caption and full_width (images). The first
    two keys are the document and the chapter's number; notes are linked as `note_targets` says.
    """
    optional = {"rows": "array<array<string>>", "has_header_row": "boolean", "note_id": "int", "marker": "string", "image_file": "string", "alt": "string", "caption": "string", "full_width": "boolean"}
    have = set(items.columns)
    rows = items.select("*", *[F.lit(None).cast(t).alias(c) for c, t in optional.items() if c not in have])
    if "note_id" in have:
        rows = note_targets(rows, *chapter[:2], order=order)
    else:
        rows = rows.withColumn("targets", F.array().cast("array<string>"))
    rows = heading_pairs(rows, *chapter, order=order).filter("not swallowed")
    text, kind = F.coalesce("text", F.lit("")), F.col("kind")
    subtitle = F.when(F.col("subtitle").isNotNull(), F.concat(F.lit(' <span class="subtitle">'), escaped(F.trim("subtitle"), True), F.lit("</span>"))).otherwise("")
    top = F.col("is_chapter_heading") | F.col("subtitle").isNotNull()
    title = escaped(F.trim(text), True)
    figure = F.concat(
        F.lit('<figure class="'), F.when(F.col("full_width"), "figure-block").otherwise("figure-inline"), F.lit('"><img src="../'), escaped(F.coalesce("image_file", F.lit("")), True),
        F.lit('" alt="'), escaped(F.coalesce(F.when(F.col("alt") != "", F.col("alt")), F.when(F.col("caption") != "", F.col("caption")), F.lit("Figure illustration")), True), F.lit('" />'),
        F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("<figcaption>"), escaped(F.col("caption"), True), F.lit("</figcaption>"))).otherwise(""), F.lit("</figure>"),
    )
    note = F.concat(F.lit('<aside id="fn'), F.col("note_id").cast("string"), F.lit('" epub:type="footnote" role="note"><p><a href="#fnref'), F.col("note_id").cast("string"), F.lit('">'), escaped(F.regexp_replace("marker", r"^[\[\]]+|[\[\]]+$", ""), True), F.lit(".</a> "), linked(text, F.col("targets")), F.lit("</p></aside>"))
    html = (
        F.when(kind == "table", table_html(F.coalesce("rows", F.array().cast("array<array<string>>")), F.coalesce("has_header_row", F.lit(False))))
        .when((kind == "heading") & top, F.concat(F.lit('<h1 class="chapter-title">'), title, subtitle, F.lit("</h1>")))
        .when(kind == "heading", F.concat(F.lit("<h2>"), title, F.lit("</h2>")))
        .when(kind == "verse", F.concat(F.lit('<p class="verse">'), F.replace(linked(text, F.col("targets")), F.lit("\n"), F.lit("<br />")), F.lit("</p>")))
        .when(kind == "code", F.concat(F.lit("<pre><code>"), escaped(text), F.lit("</code></pre>")))
        .when(kind == "note", note)
        .when(kind == "image", figure)
        .otherwise(F.concat(F.lit("<p>"), linked(text, F.col("targets")), F.lit("</p>")))
    )
    parts = rows.withColumn("html", html).groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct((kind == "note").alias("late"), F.col(order).alias("at"), "html"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["html"]), "")
    return parts.select(*chapter, F.when(body == "", "<p></p>").otherwise(body).alias("body"))


def page(title: Column, body: Column, css: str = "../style.css", language: str = "en") -> Column:
    """A whole XHTML document."""
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{language}"><head><title>'),
        escaped(title, True), F.lit(f'</title><link rel="stylesheet" type="text/css" href="{css}"/></head><body>'), body, F.lit("</body></html>"),
    )


def title_html(title: Column, subtitle: Column, authors: Column, imprints: Column) -> Column:
    def paragraph(name: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f'<p class="{name}">'), escaped(text, True), F.lit("</p>"))).otherwise("")

    def several(name: str, texts: Column) -> Column:
        return F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: paragraph(name, t)), "")

    return F.concat(F.lit("<h1>"), escaped(title, True), F.lit("</h1>"), paragraph("subtitle", subtitle), several("author", authors), several("imprint", imprints))


def content_id(title: Column, chapters: Column) -> Column:
    """A UUID from the SHA-256 of a document's title and its chapters' (chapter_no, title, content)."""
    listed = F.array_join(F.transform(chapters, lambda c: F.concat_ws("\u0001", c["chapter_no"].cast("string"), c["title"], F.sha2(c["content"], 256))), "\u0002")

    def shaped(h: Column) -> Column:
        version, variant = F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1)), F.substring(h, 18, 3))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), version, variant, F.substring(h, 21, 12))

    return let(F.sha2(F.concat_ws("\u0002", title, listed), 256), shaped)


# Imprint lines that name a publisher, lines about rights or years, and titles where the body begins.
PUBLISHER = r"(?i)\b(press|publishers?|publishing|publications|books|editions?|llc|inc\.?)\b"
RIGHTS = r"(?i)copyright|\x{a9}|\b(1[5-9]|20)[0-9][0-9]\b"
BODY_START = r"(?i)^\s*(prologue|chapter\s+[0-9]+|part\s+\w+)"


def metadata(title: Column, subtitle: Column, imprints: Column, given: Column) -> tuple[Column, Column]:
    """(title, publisher) of a package: the title page's, with its subtitle, and its first imprint that names a publisher."""
    some = F.coalesce(title, F.lit("")) != ""
    whole = F.when(some & (F.coalesce(subtitle, F.lit("")) != ""), F.concat(title, F.lit(": "), subtitle)).when(some, title).otherwise(given)
    houses = F.filter(F.coalesce(imprints, F.array().cast("array<string>")), lambda t: t.rlike(PUBLISHER) & ~t.rlike(RIGHTS))
    return whole, F.coalesce(F.trim(F.get(houses, F.lit(0))), F.lit(""))


def body_start(chapters: Column) -> Column:
    """Number of the first chapter (struct with chapter_no and title) whose title begins the body, else of the first."""
    begins = F.filter(chapters, lambda c: F.coalesce(c["title"], F.lit("")).rlike(BODY_START))
    return F.coalesce(F.get(begins, F.lit(0))["chapter_no"], F.get(chapters, F.lit(0))["chapter_no"])
