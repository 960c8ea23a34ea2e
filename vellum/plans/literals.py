"""Literal rows for operators whose cases the driver's tables don't hold, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCK = "doc_id int, page_number int, ord int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string, font double, bold_ratio double"


def _lines(doc: int, page: int, *rows: tuple, width: float = 600.0, height: float = 800.0) -> list[tuple]:
    return [(doc, page, i, width, height, x0, y0, x1, y1, text, font, bold) for i, (x0, y0, x1, y1, text, font, bold) in enumerate(rows)]


def _plain(doc: int, page: int, *texts: str, x: float = 40.0) -> list[tuple]:
    return _lines(doc, page, *[(x, 100.0 + 25 * i, 560.0, 120.0 + 25 * i, t, 12.0, 0.0) for i, t in enumerate(texts)])


#: name: (schema, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "blocks": (
        BLOCK,
        [
            *_plain(1, 1, "The first block ends here.", "and this block continues the same paragraph.", "A third one starts."),
            *_plain(1, 2, "A word is bro-", "ken at the line's end", "Then Capitals go on without a stop", "End!"),
            *_lines(2, 1, (40.0, 300.0, 320.0, 420.0, "Left column body text", 12.0, 0.0), (520.0, 100.0, 820.0, 220.0, "Right column body text", 12.0, 0.0), (522.0, 240.0, 820.0, 260.0, "goes on here", 12.0, 0.0), width=1000.0, height=1200.0),
            *_lines(3, 1, (350.0, 100.0, 550.0, 140.0, "R1", 12.0, 0.0), (40.0, 200.0, 250.0, 240.0, "L2", 12.0, 0.0), (350.0, 200.0, 550.0, 240.0, "R2", 12.0, 0.0), (40.0, 100.0, 250.0, 140.0, "L1", 12.0, 0.0)),
            *_lines(4, 1, (0.0, 100.0, 600.0, 140.0, "A wide block", 12.0, 0.0), (800.0, 200.0, 900.0, 240.0, "aside", 12.0, 0.0), width=1000.0, height=1200.0),
            *_lines(5, 1, (99.0, 100.0, 297.0, 114.0, "A song is sung", 14.0, 0.0), (96.0, 119.0, 300.0, 133.0, "of morning's glow", 14.0, 0.0), (116.0, 138.0, 280.0, 152.0, "so softly", 14.0, 0.0), (137.0, 157.0, 260.0, 171.0, "amen", 14.0, 0.0), width=396.0, height=612.0),
            *_lines(6, 1, (54.0, 100.0, 342.0, 114.0, "Two lines of prose that", 12.0, 0.0), (54.0, 119.0, 342.0, 133.0, "fill the measure.", 12.0, 0.0), width=396.0, height=612.0),
        ],
    ),
    "headings": (
        BLOCK,
        _lines(1, 1, (40.0, 60.0, 300.0, 90.0, "Chapter 4", 24.0, 1.0), (40.0, 100.0, 300.0, 130.0, "A Seed is Sown", 22.0, 1.0), (40.0, 200.0, 560.0, 220.0, "Body text of the chapter.", 12.0, 0.0), (40.0, 240.0, 560.0, 260.0, "A Bold Line", 12.5, 0.8), (40.0, 700.0, 560.0, 720.0, "Low and large", 20.0, 0.0), (40.0, 280.0, 560.0, 300.0, "chapter s", 12.0, 0.0), (40.0, 320.0, 560.0, 340.0, "Épilogue", 12.0, 0.0), (40.0, 340.0, 560.0, 360.0, "Глава 12", 12.0, 0.0), (40.0, 360.0, 560.0, 380.0, "第三章 开始", 12.0, 0.0), (40.0, 380.0, 560.0, 400.0, "Introductions are long", 12.0, 0.0), (40.0, 400.0, 560.0, 420.0, "введение", 12.0, 0.0)),
    ),
    "margins": (
        BLOCK,
        [r for p in range(1, 5) for r in _lines(1, p, (40.0, 10.0, 300.0, 30.0, "THE BOOK" if p < 4 else "THE  END", 10.0, 0.0), (40.0, 300.0, 560.0, 320.0, f"Body of page {p}.", 12.0, 0.0), (280.0, 780.0, 300.0, 795.0, str(p), 10.0, 0.0), (40.0, 400.0, 560.0, 470.0, "BIG" if p != 2 else "OTHER", 40.0, 1.0))],
    ),
    "texts": (
        "id int, text string",
        list(enumerate(["", "  ", "12", "xiv", "&", "G2", "&S", "gs", "zzzzzz", "...", "abc", "Дом", "Длинная строка", "* * *", "1234567", "a1", "page 7", "mix", "###", "——", "12a34", "S", "—?!", "日本語の長い文章です", "½ ⅓ ¼ ⅔ ¾ ⅛ ⅜", "ⅧⅨⅩⅪⅫⅬⅭ"])),
    ),
    "toc": (
        "doc_id int, page_number int, ord int, text string",
        [(1, 1, i, t) for i, t in enumerate(["Contents", "Chapter 1", "Part 2", "Appendix A"])] + [(1, 2, i, t) for i, t in enumerate([f"Section {n} ..... {n * 7}" for n in range(1, 4)] + ["plain", "words", "here"])] + [(1, 3, i, t) for i, t in enumerate(["Once upon a time", "there was a page", "of many words", "and none", "of contents", "at all"])] + [(2, 1, 0, "Chapter 1 ... 3"), (2, 1, 1, "Chapter 2 ... 9")],
    ),
    "notices": (
        "doc_id int, page_number int, ord int, text string",
        [(1, 2, i, t) for i, t in enumerate(["Copyright © 1999 by A. Writer", "All rights reserved. No part of this", "book may be copied.", "ISBN 0-00-000000-0", "LCCN 99-00001", "Printed in the United States of America", "First edition.", "Library of Congress Cataloging-in-Publication Data", "Printed in the U.S.A."])] + [(2, 13, 0, "© All rights reserved"), (3, 1, 0, "All rights reserved"), (4, 1, 0, "Copyright. ALL RIGHTS RESERVED")],
    ),
    "titles": ("doc_id int, ord int, title string", [(1, i, t) for i, t in enumerate(["Chapter 1", "Chapter 2: On", "Chapter 2", "Interlude", "chapter 5", "Chapter 4", "Chapter"])] + [(2, 0, "CHAPTER 10 x"), (2, 1, "Chapter 12")]),
    "spans": ("doc_id int, ord int, text string, size double", [(1, 0, "a", 3.0), (1, 1, "b", 1.0), (1, 2, "c", 3.0), (1, 3, "d", 1.0), (1, 4, "e", 9.0), (1, 5, "  ", 9.0), (1, 6, " ", 9.0), (2, 0, "x", 11.96), (2, 1, "y", 12.04), (2, 2, "z", 8.0), (3, 0, " ", 7.0)]),
    "boxes": ("doc_id int, page_number int, x0 double, y0 double, x1 double, y1 double", [(2, 1, 500.0, 90.0, 830.0, 160.0), (3, 1, 0.0, 90.0, 300.0, 120.0), (3, 2, 0.0, 0.0, 999.0, 999.0), (1, 1, 300.0, 110.0, 310.0, 140.0)]),
    "elements": (
        "doc_id int, page_number int, ord int, kind string, x0 double, y0 double, x1 double, y1 double, text string, font double, body_font double, column int",
        [(1, 1, 0, "line", 40.0, 50.0, 500.0, 70.0, "Before.", 12.0, 12.0, 0), (1, 1, 1, "image", 40.0, 80.0, 300.0, 200.0, None, None, 12.0, 0), (1, 1, 2, "line", 40.0, 210.0, 300.0, 220.0, "Fig. 1", 9.0, 12.0, 0), (1, 1, 3, "image", 40.0, 300.0, 300.0, 400.0, None, None, 12.0, 0), (1, 1, 4, "line", 40.0, 410.0, 300.0, 430.0, "Body follows.", 12.0, 12.0, 0), (1, 2, 0, "image", 40.0, 10.0, 300.0, 100.0, None, None, 12.0, 0), (1, 2, 1, "line", 400.0, 110.0, 500.0, 120.0, "Elsewhere", 9.0, 12.0, 1)],
    ),
    "visuals": (
        "doc_id int, page_number int, image_ratio double, vector_ratio double, nonwhite_ratio double, word_count int, block_count int, vertical_span_ratio double",
        [(1, 1, 0.9, 0.0, 0.9, 12, 2, 0.2), (1, 2, 0.0, 0.0, 0.1, 12, 4, 0.6), (1, 3, 0.0, 0.0, 0.1, 300, 20, 0.9), (2, 1, 0.0, 0.0, 0.2, 20, 3, 0.5), (2, 2, 0.8, 0.0, 0.5, 20, 1, 0.1), (2, 3, 0.0, 0.0, 0.1, 8, 2, 0.3), (3, 1, 0.1, 0.0, 0.9, 40, 2, 0.3), (3, 4, 0.95, 0.0, 1.0, 0, 0, 0.0), (4, 1, 0.0, 0.0, 0.05, 0, 0, 0.0)],
    ),
    "paths": ("id int, path string", list(enumerate(["mimetype", "META-INF/container.xml", "", "/absolute/path", "C:/windows/path", "path/../traversal", "a\\..\\b", "text/..hidden", "  ", "~/x"]))),
    "logs": ("id int, text string", list(enumerate(["open /home/ann/books/a.pdf", "C:\\Users\\Ann\\x.pdf failed", "d:/home/bob/y and /Users/cy/z", "nothing here", "/home//x", "/srv/home/ann/b"]))),
    "images": ("chapter int, ord int, content string", [(1, 0, "aaa"), (1, 1, "bbb"), (1, 2, "aaa"), (2, 0, "aaa"), (2, 1, "aaa"), (2, 2, "")]),
    "cells": ("page int, x0 double, y0 double, x1 double, y1 double", [(1, 10.0, 10.0, 100.0, 50.0), (1, 105.0, 10.0, 200.0, 50.0), (1, 10.0, 55.0, 100.0, 100.0), (1, 105.0, 55.0, 200.0, 100.0), (2, 0.0, 0.0, 200.0, 20.0), (2, 0.0, 21.0, 99.0, 40.0), (2, 100.0, 21.0, 200.0, 40.0)]),
    "notes": (
        "doc_id int, page_number int, block_index int, height double, y0 double, font double, body_font double, starts_with_sup boolean, lines array<string>, references array<string>",
        [(1, 1, 0, 792.0, 100.0, 12.0, 12.0, False, ["Body line."], ["1", "2"]), (1, 1, 1, 792.0, 650.0, 8.0, 12.0, False, ["1. A linked note.", "going on"], []), (1, 1, 2, 792.0, 670.0, 8.0, 12.0, False, ["3. Nobody asks."], []), (1, 2, 0, 792.0, 90.0, 12.0, 12.0, False, ["More."], ["*"]), (1, 2, 1, 792.0, 700.0, 8.0, 12.0, False, ["* Starred"], []), (1, 2, 2, 792.0, 720.0, 8.0, 12.0, False, ["* Again"], [])],
    ),
    "spaced": ("page int, ord int, x0 double, y0 double, x1 double, y1 double, text string", [(1, 3 * r + c, x, 100.0 + 25 * r, x + 40.0, 110.0 + 25 * r, t) for r, row in enumerate([("Name", "Value", "Count"), ("alpha", "1", "3"), ("beta", "2", "4")]) for c, (x, t) in enumerate(zip((100.0, 250.0, 400.0), row, strict=True))]),
    "rules": ("page int, x0 double, y0 double, x1 double, y1 double", [(1, 100.0, y, 400.0, y + 1.0) for y in (150.0, 190.0, 230.0)] + [(1, x, 150.0, x + 1.0, 231.0) for x in (100.0, 250.0, 400.0)] + [(2, 100.0, 150.0, 400.0, 151.0)]),
    "ruled_words": ("page int, ord int, x0 double, y0 double, x1 double, y1 double, text string", [(1, 0, 110.0, 160.0, 150.0, 172.0, "Name"), (1, 1, 260.0, 160.0, 300.0, 172.0, "Value"), (1, 2, 110.0, 200.0, 150.0, 212.0, "alpha"), (1, 3, 260.0, 200.0, 270.0, 212.0, "1"), (1, 4, 500.0, 500.0, 550.0, 512.0, "outside")]),
    "flow": (
        "doc_id int, ord int, kind string, text string, page_number int, level int, is_chapter_heading boolean, font double, bold_ratio double",
        [(1, i, k, t, p, 1 if k == "heading" else 0, k == "heading" and top, f, 0.0) for i, (k, t, p, top, f) in enumerate([("paragraph", "To you.", 1, False, 12.0), ("heading", "Chapter 1", 2, True, 24.0), ("heading", "The Calling", 2, True, 18.0), ("paragraph", "It begins and goes", 2, False, 12.0), ("paragraph", "on, over the page-", 3, False, 12.0), ("paragraph", "break.", 4, False, 12.0), ("note", "A note.", 4, False, 8.0), ("heading", "Aside", 4, False, 14.0), ("paragraph", "More.", 4, False, 12.0), ("heading", "CHAPTER 2", 5, True, 24.0), ("paragraph", "End.", 5, False, 12.0)])] + [(2, 0, "note", "Only a note", 1, 0, False, 8.0, 0.0)],
    ),
    "book": (
        f"{BLOCK.replace('ord int', 'block_index int')}, lines int",
        [
            (*r, 1)
            for r in [
                *_lines(1, 1, (100.0, 200.0, 500.0, 260.0, "A Picture of the Sea", 30.0, 0.0)),
                *_lines(1, 2, (40.0, 100.0, 560.0, 120.0, "Contents", 12.0, 0.0), (40.0, 130.0, 560.0, 150.0, "Chapter 1 ..... 4", 12.0, 0.0), (40.0, 160.0, 560.0, 180.0, "Chapter 2 ..... 6", 12.0, 0.0), (40.0, 190.0, 560.0, 210.0, "Appendix ..... 9", 12.0, 0.0)),
                *_lines(1, 3, (40.0, 100.0, 560.0, 120.0, "Copyright © 1999 by A. Writer", 12.0, 0.0), (40.0, 130.0, 560.0, 150.0, "All rights reserved. No part of this", 12.0, 0.0), (40.0, 160.0, 560.0, 180.0, "book may be copied.", 12.0, 0.0), (40.0, 190.0, 560.0, 210.0, "ISBN 0-00-000000-0", 12.0, 0.0)),
                *_lines(1, 4, (40.0, 100.0, 560.0, 120.0, "For you.", 12.0, 0.0)),
                *[r for page, (title, *body) in enumerate((("Chapter 1", "The story begins and", "goes on without a"), (None, "stop. It ends here.", "###", "“Another” paragraph is bro-", "ken at its line's end."), ("CHAPTER 2", "The last of them.")), 5) for r in _lines(1, page, (40.0, 10.0, 300.0, 30.0, "THE BOOK", 12.0, 0.0), *([(40.0, 90.0, 300.0, 115.0, title, 24.0, 1.0)] if title else []), *([(40.0, 120.0, 300.0, 140.0, "The Calling", 20.0, 1.0)] if title == "Chapter 1" else []), *[(40.0, 200.0 + 25 * i, 560.0, 220.0 + 25 * i, text, 12.0, 0.0) for i, text in enumerate(body)], (290.0, 700.0, 300.0, 715.0, str(page), 12.0, 0.0))],
                *_lines(2, 1, (40.0, 60.0, 560.0, 63.0, "a low line in the margin", 12.0, 0.0), (350.0, 200.0, 550.0, 240.0, "right column second.", 12.0, 0.0), (40.0, 200.0, 250.0, 240.0, "The left column comes first and the", 12.0, 0.0)),
            ]
        ],
    ),
    "book_covers": ("doc_id int, cover_page int, title_page int", [(1, 1, None), (2, None, None)]),
    "web": ("page_id int, html string", [(1, "<h1>One</h1><p>Text <b>bold</b></p><table><tr><th>Name<th>Value<tr><td>alpha<td>1</table><ul><li>item<p>inner</p></ul><p><img src='a.png' alt='A'></p>"), (2, "<p>no body<h2>Two</h2><table><tr><td> </td></tr></table><img src=b.jpg>"), (3, ""), (4, "<table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table>")]),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _sql(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else f"CAST({value!r} AS {kind})"


def values(name: str) -> str:
    """The rows as a common table expression of the same name."""
    schema, rows = TABLES[name]
    columns = [c.split(" ") for c in schema.split(", ")]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    body = ", ".join("(" + ", ".join(_sql(v, kinds[k]) for v, (_, k) in zip(row, columns, strict=True)) + ")" for row in rows)
    return f"{name}({', '.join(f'"{c}"' for c, _ in columns)}) AS (VALUES {body})"
