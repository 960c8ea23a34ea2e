"""Predicates over texts, blocks, spans and pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WORD, compact, let, plain, strip

# Thresholds of layout and headings.
MARGIN_BAND, ARTIFACT_TOP, ARTIFACT_BOTTOM, REPEAT_SHARE, REPEAT_LEAST = 0.05, 0.08, 0.92, 0.3, 2
HEADING_DELTA, HEADING_FACTOR, HEADING_BOLD, CHAPTER_FACTOR, CHAPTER_TOP = 1.4, 1.2, 0.5, 1.5, 0.35
COPYRIGHT_PAGES = 12
OCR_CHARS, OCR_BAD, OCR_AREA = 50, 0.30, 40_000.0
# How headings of chapters and parts begin, by language.
_NUMERAL = "[0-9ivxlcdm]+"
CHAPTER_WORDS = (
    ("chapter", "one|two|three|four|five|six|seven|eight|nine|ten"),
    ("part", "one|two|three|four|five|six|seven|eight|nine|ten"),
    ("kapitel", "eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn"),
    ("chapitre", "un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix"),
    ("cap[ií]tulo", "uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez"),
    ("capitolo", "uno|due|tre|quattro|cinque|sei|sette|otto|nove|dieci"),
)
MATTER_WORDS = (
    "prologue|epilogue|appendix|preface|foreword|introduction",
    "prolog|epilog|vorwort|einleitung|anhang",
    "prologue|épilogue|préface|introduction|annexe",
    "pr[óo]logo|ep[íi]logo|prefacio|introducci[óo]n|ap[ée]ndice",
    "пролог|эпилог|предисловие|введение|приложение",
)
_END = rf"({NOT_WORD}|$)"
CHAPTER = "(?iu)" + "|".join(
    [rf"^{word}\s+({_NUMERAL}|{numbers}){_END}" for word, numbers in CHAPTER_WORDS]
    + [rf"^({words}){_END}" for words in MATTER_WORDS]
    + [rf"^глава\s+{_NUMERAL}", "^第[0-9一二三四五六七八九十百千]+[章节部回]", "^(序章|序言|前言|引言|附录|尾声)"]
)
# Page numbers, junk paragraphs, texts without letters (numerals such as ½ or Ⅷ count as letters),
# reasons of drops whose words aren't missed, and lines of a copyright page that are left out.
PAGE_NUMBER = r"(?i)^\s*([0-9]+|[ivxlcdm]+)\s*$"
JUNK = r"(?i)^([0-9]+[a-z]+|[a-z]+[0-9]+|[a-z]?[0-9]+[a-z]?|&[a-z0-9]|[&gs]+)$"
SYMBOLS = r"^[^\p{L}\p{Nl}\p{No}]+$"
BOILERPLATE = ("running_header_footer", "page_number", "table_of_contents", "cover_page", "margin_artifact", "noise_text", "ocr_replaced_scan")
CATALOG_LINE = rf"(?i)^(?:ISBN(?:-1[03])?|LCCN|Library of Congress Control Number|Printed in the United States of America){_END}"
# Hints in font names.
BOLD_FONTS, ITALIC_FONTS = "bold|black|heavy|semibold|demi", "italic|oblique|slanted"
MONO_FONTS = "mono|courier|consolas|menlo|typewriter|lucida console|inconsolata|source code"


def needs_ocr(chars: Column, bad: Column, width: Column, height: Column) -> Column:
    return ((chars < OCR_CHARS) & (width * height >= OCR_AREA)) | (bad >= OCR_BAD)


def bad_glyphs(text: Column) -> Column:
    """Share of replacement characters and (cid:N) marks in what isn't white space."""
    dense = F.length(compact(text))
    marks = F.aggregate(F.regexp_extract_all(text, F.lit(r"\x{fffd}|\(cid:[0-9]+\)"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(dense > 0, marks / dense).otherwise(0.0)


def margin_artifact(lines: Column, font: Column, body: Column, y0: Column, y1: Column, height: Column) -> Column:
    return (lines == 1) & (font <= body * 1.05) & ((y1 <= height * ARTIFACT_TOP) | (y0 >= height * ARTIFACT_BOTTOM))


def page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def garbled(dense: Column) -> Column:
    """One character three or more times, or up to three marks."""
    one = (F.length(dense) >= 3) & (F.replace(dense, F.substring(dense, 1, 1), F.lit("")) == "")
    return one | ((F.length(dense) <= 3) & dense.rlike(rf"^{NOT_WORD}+$"))


def noise(text: Column, ocr: Column | bool = False) -> Column:
    ocr = ocr if isinstance(ocr, Column) else F.lit(ocr)

    def judge(dense: Column) -> Column:
        return (
            F.when(dense == "", True)
            .when((F.length(dense) <= 4) & dense.rlike(r"(?i)^[0-9&gs]+$"), True)
            .when(ocr & garbled(dense), True)
            .when(dense.rlike("[A-Za-z]"), False)
            .when(F.length(dense) <= 6, True)
            .otherwise(dense.rlike(SYMBOLS))
        )

    return let(compact(plain(text)), judge)


def chapter_like(text: Column) -> Column:
    return text.rlike(CHAPTER)


def heading_flags(text: Column, font: Column, bold: Column, y0: Column, body: Column, height: Column) -> tuple[Column, Column]:
    """(is a heading, opens a chapter); `text` is normalised."""
    named = chapter_like(text) | text.rlike(r"(?i)^chapter\s+[&s](\s|$)")
    big = (font >= body + HEADING_DELTA) | (font >= body * HEADING_FACTOR)
    strong = (F.length(text) <= 80) & (bold >= HEADING_BOLD) & (font > body)
    major = (F.length(text) <= 120) & (big | strong)
    opens = named | ((F.length(text) < 60) & (font >= body * CHAPTER_FACTOR) & (y0 < height * CHAPTER_TOP))
    some = text != ""
    return some & (named | major), some & (named | major) & opens


def toc_entry(text: Column) -> Column:
    return text.rlike(r"\.\.+\s*[0-9]+\s*$") | chapter_like(text)


def code_block(fonts: Column, flags: Column) -> Column:
    """Whether all of a block's visible spans (arrays of font names and flags) are in fixed pitch."""
    spans = F.arrays_zip(fonts.alias("font"), flags.alias("flags"))
    return (F.size(spans) > 0) & F.forall(spans, lambda x: mono(x["font"], x["flags"]))


def full_width(x0: Column, x1: Column, width: Column) -> Column:
    return x1 - x0 > width * 0.6


def copyright_page(page: Column, text: Column) -> Column:
    low = F.lower(text)
    return (page <= COPYRIGHT_PAGES) & F.contains(low, F.lit("all rights reserved")) & (F.contains(low, F.lit("©")) | F.contains(low, F.lit("copyright")))


def catalog_line(text: Column) -> Column:
    return text.rlike(CATALOG_LINE)


def bold(font: Column, flags: Column) -> Column:
    return F.lower(font).rlike(BOLD_FONTS) | (flags.bitwiseAND(16) != 0)


def italic(font: Column, flags: Column) -> Column:
    return F.lower(font).rlike(ITALIC_FONTS) | (flags.bitwiseAND(2) != 0)


def mono(font: Column, flags: Column) -> Column:
    return F.lower(font).rlike(MONO_FONTS) | (flags.bitwiseAND(8) != 0)


def bold_flag(weight: Column, font: Column, flags: Column) -> Column:
    return F.when((weight >= 600) & ~F.lower(font).rlike(ITALIC_FONTS), flags.bitwiseOR(16)).otherwise(flags)


def baseline(size: Column, origin: Column, base_size: Column, base_origin: Column, flags: Column) -> Column:
    """'sup', 'sub' or 'base' of a span beside its line's base."""
    smaller, shift = size < base_size * 0.88, origin - base_origin
    known = shift.isNotNull()
    return (
        F.when(base_size <= 0, "base")
        .when(known & smaller & (shift < base_size * -0.18), "sup")
        .when(known & smaller & (shift > base_size * 0.12), "sub")
        .when(known & ~smaller, "base")
        .when((flags.bitwiseAND(1) != 0) & smaller, "sup")
        .otherwise("base")
    )


def junk_paragraph(text: Column, top: Column | None = None, bottom: Column | None = None) -> Column:
    dense = compact(text)
    junk = ((F.length(dense) <= 6) & dense.rlike(SYMBOLS)) | dense.rlike(JUNK)
    if top is not None and bottom is not None:
        junk = junk | (F.coalesce((top <= 0.12) | (bottom >= 0.88), F.lit(False)) & (F.length(dense) <= 6))
    return (dense != "") & junk


def qa_junk(text: Column) -> Column:
    """No ASCII letters, and short or only marks; runs of scene-break stars and dots pass."""
    dense = compact(text)
    return (dense != "") & ~dense.rlike("[A-Za-z]") & ~dense.rlike(r"^[*·•.…—–~#-]+$") & ((F.length(dense) <= 6) | dense.rlike(SYMBOLS))


def misread_heading(text: Column) -> Column:
    return F.contains(text, F.lit("Chapter &")) | F.contains(text, F.lit("Chapter S")) | F.contains(text, F.lit("Chapter 1&"))


def archive_path(path: Column) -> Column:
    """Whether an archive entry's name is relative and stays inside."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return (strip(path) != "") & ~path.rlike(r"^[/\\]") & ~path.rlike("^[A-Za-z]:") & ~F.array_contains(parts, "..") & (F.locate("\u0000", path) == 0)


def archive_entry_fits(size: Column, packed: Column) -> Column:
    """At most 50 MB, and at most 100 times its packed size when above 1 KB."""
    return (size <= 50 * 1024 * 1024) & ((size <= 1024) | (size <= 100 * F.greatest(packed, F.lit(1))))
