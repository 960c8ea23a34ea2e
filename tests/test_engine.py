"""Engine queries against their SQL, and known facts of the operators that SQL can't express."""

import zipfile
from io import BytesIO
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.functions import predicates, text
from vellum.functions.text import EM, NOTE, STRONG, SUP
from vellum.operators import chapters, flow, layout, quality, render
from vellum.operators.chapters import title_roles
from vellum.operators.layout import cut, span_numbers
from vellum.plans.oracle import ORACLE_SQL
from vellum.plans.queries import QUERIES
from vellum.sources import office
from vellum.sources.html import flow_items
from vellum.sources.office import dispatched
from vellum.sources.package import archive, output_path
from vellum.streaming.pages import text_health

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    both = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert both[0].equals(both[1])


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_tables(spark):
    assert [r.rows for r in rows(spark, "whitespace_tables")] == ['[["Name","Value","Count"],["alpha","1","3"],["beta","2","4"]]']
    assert [r.rows for r in rows(spark, "ruled_tables")] == ['[["Name","Value"],["alpha","1"]]']
    cells = {(r.page, r.x0, r.y0): (r.row, r.col, r.rowspan, r.colspan) for r in rows(spark, "table_grid")}
    assert cells[1, 10.0, 10.0] == (0, 0, 1, 1) and cells[1, 105.0, 55.0][:2] == (1, 1)


def test_notes_and_chapters(spark):
    assert [(r.marker, r.text, r.note_id) for r in sorted(rows(spark, "note_pairs"), key=lambda r: r.note_id)] == [("1", "A linked note. going on", 1), ("*", "Starred", 2)]
    found = sorted((r for r in rows(spark, "chapter_split") if r.doc_id == 1), key=lambda r: (r.chapter_no, r.item_no))
    assert [t for t in dict.fromkeys(r.chapter_title for r in found)] == ["Front Matter", "Chapter 1 The Calling", "CHAPTER 2"]
    assert [r.text for r in found if r.kind == "paragraph"][1] == "It begins and goes on, over the page-break." or "pagebreak" in [r.text for r in found if r.kind == "paragraph"][1]


def test_page_flow(spark):
    found = {(r.doc_id, r.chapter_no, r.item_no): (r.chapter_title, r.kind, r.text) for r in rows(spark, "page_flow_cases")}
    assert found == {
        (1, 1, 1): ("Copyright", "heading", "Copyright"),
        (1, 1, 2): ("Copyright", "paragraph", "Copyright © 1999 by A. Writer"),
        (1, 1, 3): ("Copyright", "paragraph", "All rights reserved. No part of this book may be copied."),
        (1, 2, 1): ("Dedication", "paragraph", "For you."),
        (1, 3, 1): ("Chapter 1 The Calling", "heading", "Chapter 1 The Calling"),
        (1, 3, 2): ("Chapter 1 The Calling", "paragraph", "The story begins and goes on without a stop. It ends here."),
        (1, 3, 3): ("Chapter 1 The Calling", "paragraph", "“Another” paragraph is broken at its line's end."),
        (1, 4, 1): ("CHAPTER 2", "heading", "CHAPTER 2"),
        (1, 4, 2): ("CHAPTER 2", "paragraph", "The last of them."),
        (2, 1, 1): ("Front Matter", "paragraph", "The left column comes first and the"),
        (2, 1, 2): ("Front Matter", "paragraph", "right column second."),
    }
    gone = sorted((r.doc_id, r.page_index, r.reason, r.word_count) for r in rows(spark, "page_flow_case_drops"))
    assert gone == sorted([(1, 0, "cover_page", 5), (1, 1, "table_of_contents", 9), (1, 5, "noise_text", 0), (2, 0, "margin_artifact", 6), *[(1, p, r, n) for p in (4, 5, 6) for r, n in (("page_number", 1), ("running_header_footer", 2))]])


def test_note_links(spark):
    ref = lambda n, label: f"{NOTE[0]}{n}{NOTE[1]}{label}{NOTE[2]}"
    items = [(1, 1, "A", 1, "paragraph", f"x{ref(7, '1')} and {ref(7, '1')} & {ref(9, '*')}", None, None), (1, 1, "A", 2, "note", "said", 7, "1"), (1, 2, "B", 1, "verse", f"far{ref(7, '1')}\nline", None, None)]
    found = {r.chapter_no: r.body for r in render.bodies(spark.createDataFrame(items, "doc_id int, chapter_no int, chapter_title string, item_no int, kind string, text string, note_id int, marker string").withColumn("is_chapter_heading", F.lit(False)), "doc_id", "chapter_no", "chapter_title").collect()}
    assert found[1] == '<p>x<a href="#fn7" id="fnref7" epub:type="noteref">1</a> and <sup>1</sup> &amp; <sup>*</sup></p><aside id="fn7" epub:type="footnote" role="note"><p><a href="#fnref7">1.</a> said</p></aside>'
    assert found[2] == '<p class="verse">far<a href="chapter_1.xhtml#fn7" id="fnref7" epub:type="noteref">1</a><br />line</p>'


def test_first_superscripts_become_references(spark):
    sup = lambda t: f"{SUP[0]}{t}{SUP[1]}"
    lines = spark.createDataFrame([(1, 0, f"a{sup('1')} b{sup('x')}"), (1, 1, f"c{sup('1')}{sup('[2]')}"), (2, 0, f"d{sup('1')}")], "page int, ord int, markup string")
    notes = spark.createDataFrame([(1, "1", 5), (1, "2", 6)], "page int, name string, note_id int")
    got = {(r.page, r.ord): r.markup for r in chapters.linked_lines(lines, notes, "page").collect()}
    note = lambda n, t: f"{NOTE[0]}{n}{NOTE[1]}{t}{NOTE[2]}"
    assert got == {(1, 0): f"a{note(5, '1')} b{sup('x')}", (1, 1): f"c{sup('1')}{note(6, '[2]')}", (2, 0): f"d{sup('1')}"}


def test_scalars(spark):
    one = lambda column: spark.range(1).select(column.alias("c")).first().c
    authors = {"by Ann Lee": "Ann Lee", "Written by: Ann": "Ann", "Edited by Ann": "Edited by Ann", "by ": "by", "Byron": "Byron"}
    assert {a: one(text.author(F.lit(a))) for a in authors} == authors
    dates = {"D:20240131": "2024-01-31T00:00:00Z", "D:20240131235958": "2024-01-31T23:59:58Z", "D:1979": None, "D:19790101": None, "x": None}
    assert {d: one(text.pdf_date(F.lit(d))) for d in dates} == dates
    assert one(text.visible_separators(F.lit("a\u200b\u200bb\ufeffc"))) == "a bc"
    assert one(text.repaired(F.lit("ﬁne “quote” CafÃ©"))) == 'fine "quote" Café'
    assert one(text.archive_second(F.lit(59))) == 58 and one(text.media_type(F.lit(".JPG"))) == "image/jpeg"
    assert one(text.redacted(F.lit("/home/ann/x by Ann Lee"), "ann lee")) == "<sanitized_path>/x by <user>"
    assert one(text.joined_lines(F.array(*map(F.lit, ["A hyphen-", "ated word", "Then well-", "Known"])))) == "A hyphenated word Then well- Known"
    assert one(predicates.baseline(F.lit(7.0), F.lit(95.0), F.lit(12.0), F.lit(100.0), F.lit(0))) == "sup" and one(predicates.baseline(F.lit(7.0), F.lit(102.0), F.lit(12.0), F.lit(100.0), F.lit(0))) == "sub"
    assert one(predicates.bold_flag(F.lit(700), F.lit("Serif"), F.lit(0))) == 16 and one(predicates.bold_flag(F.lit(700), F.lit("Serif Italic"), F.lit(0))) == 0
    assert one(predicates.code_block(F.array(F.lit("Courier"), F.lit("Menlo")), F.array(F.lit(0), F.lit(0)))) and not one(predicates.code_block(F.array(F.lit("Courier"), F.lit("Serif")), F.array(F.lit(0), F.lit(0))))
    assert one(predicates.full_width(F.lit(0.0), F.lit(400.0), F.lit(600.0))) and not one(quality.gate_fails(F.lit(None).cast("boolean"))) and one(quality.gate_fails(F.lit(False)))
    chapters_ = F.array(*[F.struct(F.lit(i).alias("chapter_no"), F.lit(x).alias("title")) for i, x in ((1, "Copyright"), (2, "Part one"), (3, "Chapter 1"))])
    assert one(render.body_start(chapters_)) == 2
    title, publisher = render.metadata(F.lit("The Song"), F.lit("A Tale"), F.array(F.lit("Copyright 1999 North Press"), F.lit("North Press ")), F.lit("x"))
    assert (one(title), one(publisher)) == ("The Song: A Tale", "North Press")


def test_characters(spark):
    chars = spark.createDataFrame([(1, i, c, 10.0 * i, 100.0, 10.0 * i + 9, 112.0) for i, c in enumerate("ab c\n\ufffed\n")], "page int, ord int, char string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.text, r.x0, r.x1) for r in sorted(layout.words_of(chars.filter("char <> '\ufffe'"), "page").collect(), key=lambda r: r.first)] == [("ab", 0.0, 19.0), ("c", 30.0, 39.0), ("d", 60.0, 69.0)]
    assert [(r.block_index, r.text) for r in sorted(layout.char_lines(chars, "page").collect(), key=lambda r: r.block_index)] == [(0, "ab c"), (1, "d")]
    flat = layout.flipped(spark.createDataFrame([(5.0, 700.0, 1.0, 690.0, 792.0)], "x0 double, y0 double, x1 double, y1 double, height double")).first()
    assert (flat.x0, flat.y0, flat.x1, flat.y1) == (1.0, 92.0, 5.0, 102.0)
    styled = spark.createDataFrame([(1, 0, "He ", False, False, "base"), (1, 1, "was", True, False, "base"), (1, 2, " here", True, False, "base"), (1, 3, "2", False, True, "sup")], "line int, ord int, text string, is_bold boolean, is_italic boolean, position string")
    assert flow.styled_text(styled, "line").first().markup == f"He {STRONG[0]}was here{STRONG[1]}{EM[0]}{SUP[0]}2{SUP[1]}{EM[1]}"
    code = spark.createDataFrame([(1, 0, True, "def f():", 40.0, 120.0, 40.0), (1, 1, True, "return 1", 80.0, 160.0, 40.0), (1, 2, False, "text", 40.0, 80.0, 40.0)], "page int, ord int, is_code boolean, text string, x0 double, x1 double, block_x0 double")
    assert [r.text for r in flow.code_runs(code, "page").collect()] == ["def f():\n    return 1"]


def test_ocr_route(spark):
    pages_ = spark.createDataFrame([(1, 1, 3, 0.0, 612.0, 792.0, "x"), (1, 2, 900, 0.0, 612.0, 792.0, "long"), (1, 3, 2, 0.0, 612.0, 792.0, "y")], "doc_id int, page_number int, char_count int, bad_glyph_ratio double, width double, height double, text string")
    assert {r.page_number: r.ocr for r in office.ocr_route(pages_, None).collect()} == {1: "skipped", 2: None, 3: "skipped"}
    routed = office.ocr_route(pages_, spark.createDataFrame([(1, 1, "read"), (1, 2, "no"), (1, 3, "")], "doc_id int, page_number int, text string"))
    assert {r.page_number: (r.ocr, r.text) for r in routed.collect()} == {1: ("replaced", "read"), 2: (None, "long"), 3: ("failed", "y")}
    images = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0), (1, 1, 0.0, 0.0, 50.0, 50.0), (1, 2, 0.0, 0.0, 612.0, 792.0)], "doc_id int, page_number int, x0 double, y0 double, x1 double, y1 double")
    kept, gone = office.without_scans(images, routed)
    assert kept.count() == 2 and [r.reason for r in gone.collect()] == ["ocr_replaced_scan"]


def docx(body, name="word/document.xml"):
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    plain = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Text.</w:t></w:r></w:p></w:body></w:document>'
    files = {"good": docx(plain), "none": None, "junk": b"junk", "climb": docx(plain, "../word/document.xml"), "bomb": docx(plain + " " * 2_000_000), "entity": docx('<!DOCTYPE d [<!ENTITY a "b">]>' + plain)}
    found = office.docx_flow(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()
    assert [(r.kind, r.text) for r in found if r.path == "good"] == [("heading", "One"), ("paragraph", "Text.")]
    assert {r.path for r in found if r.kind == "error" and r.error} == set(files) - {"good"}


def test_html_closes_paragraphs_at_any_depth():
    deep = "<p>" + "<b><i>" * 5 + "deep<p>next"
    assert [i["text"] for i in flow_items(deep)] == ["deep", "next"]


def test_xy_cut_takes_columns_first():
    boxes = [(350, 100, 550, 140, "R1"), (40, 200, 250, 240, "L2"), (350, 200, 550, 240, "R2"), (40, 100, 250, 140, "L1")]
    assert [b[4] for b in cut(boxes, 6)] == ["L1", "L2", "R1", "R2"]


def test_spans_are_anchored_at_their_head():
    chars = [("", 0.0, 0, None), ("F", 12.0, 0, 0.0), ("F", 12.0, 0, 1.4), ("F", 12.0, 0, 2.0), ("", 0.0, 0, None), ("F", 9.0, 0, 2.0)]
    assert list(span_numbers(chars)) == [None, 0, 0, 1, 1, 2]


def test_title_page():
    found = title_roles([("The Song", 30, 100), ("A Tale of the Long and Winding Northern Road", 18, 150), ("By Ann Lee", 14, 300), ("North Press", 10, 700)], 800)
    assert found == {"title": "The Song", "subtitle": "A Tale of the Long and Winding Northern Road", "authors": ["By Ann Lee"], "imprints": ["North Press"]}


def test_html_quirks():
    items = flow_items("<ul><li>a<p>b</p></li></ul><h2></h2>")
    assert [(i["kind"], i["text"]) for i in items] == [("paragraph", "• ab"), ("paragraph", "b"), ("heading", "Section 3")]


def test_packages(spark):
    found = rows(spark, "epub_packages")
    assert len(found) == 50 and all(r.n_bytes > 0 and r.error is None for r in found)
    names = zipfile.ZipFile(BytesIO(archive([("b.png", b"x"), ("a", b"y"), ("mimetype", b"z")]))).namelist()
    assert names == ["mimetype", "a", "b.png"]
    assert output_path("/in/x.pdf", "/out/") == "/out/x.epub"


def test_dispatch(spark):
    found = {r.path: r.route for r in dispatched(spark.createDataFrame([("a.PDF",), ("b.docx",), ("c.odt",), ("d.exe",)], "path string")).collect()}
    assert found == {"a.PDF": "pdf", "b.docx": "docx", "c.odt": "converter", "d.exe": None}


def test_stream(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    source.write.parquet(str(tmp_path / "in"))
    job = text_health(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("health").start()
    job.processAllAvailable()
    job.stop()
    assert spark.table("health").count() == source.count()
