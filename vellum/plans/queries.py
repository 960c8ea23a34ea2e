"""The engine's queries over the driver's tables and literal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t
from ..operators import chapters, flow, layout, pages, quality, render, tables
from ..sources.html import html_chapters as chapters_of_html
from ..sources.html import html_flow as flow_of_html
from ..sources.lines import FONT, HEIGHT, WIDTH, line_blocks
from ..sources.package import archives, package_rows
from ..streaming.pages import text_health
from .literals import literal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "source")


def _is_artifact() -> Column:
    return p.margin_artifact(F.lit(1), F.col("font"), F.lit(FONT), F.col("y0"), F.col("y1"), F.lit(HEIGHT))


def _document_paragraphs(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("kind", F.lit("line")).withColumn("bold_ratio", F.lit(0.0))
    return flow.assemble(rows, "source", "doc_id", order="block_index")


@query
def paragraph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: texts to lines, margins and noise out, paragraphs, statistics by source."""
    lines = _document_lines(spark, sf_dir).filter(~_is_artifact() & ~p.page_number(F.col("text")) & ~p.noise(F.col("text")))
    return quality.paragraph_stats(_document_paragraphs(lines), "source")


@query
def line_block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_lines(spark, sf_dir).select("doc_id", "block_index", "text", "y0", "y1")


@query
def margin_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_lines(spark, sf_dir).filter(_is_artifact()).select("doc_id", "block_index", "text")


@query
def paragraph_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_paragraphs(_document_lines(spark, sf_dir)).select("doc_id", "paragraph", "n_lines", "text")


@query
def paragraph_assembly_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.columns(literal(spark, "blocks").withColumn("kind", F.lit("line")), "doc_id", "page_number", width=F.col("width"))
    return flow.assemble(rows, "doc_id", "page_number", column="column").select("doc_id", "page_number", "paragraph", "n_lines", "text")


@query
def junk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.junk(literal(spark, "texts"))


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda name, key: read(spark, sf_dir, name).select(F.lit(name).alias("of"), F.col(key).alias("id"), F.size(t.words(F.coalesce("text", F.lit("")))).alias("n_words"))
    return counted("documents", "doc_id").unionByName(counted("conversations", "conv_id").groupBy("of", "id").agg(F.sum("n_words").cast("int").alias("n_words")))


@query
def letters_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tokens(read(spark, sf_dir, "documents"), letters=True)


def _benchmark_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compared(quality.tokens(read(spark, sf_dir, "benchmark"), letters=True), quality.tokens(read(spark, sf_dir, "documents"), letters=True))


@query
def word_recall_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.word_recall(_benchmark_sides(spark, sf_dir))


@query
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = quality.compared(quality.tokens(read(spark, sf_dir, "documents"), letters=True), quality.tokens(read(spark, sf_dir, "conversations"), letters=True))
    return quality.missing(sides)


@query
def spurious_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.spurious(_benchmark_sides(spark, sf_dir))


def _recall_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = _document_lines(spark, sf_dir)
    dropped = quality.boilerplate(quality.drop_rows(lines.filter(_is_artifact()).withColumn("page_number", F.lit(1)), "margin_artifact", "source"))
    kept = _document_paragraphs(lines.filter(~_is_artifact()))
    given = read(spark, sf_dir, "documents").select("source", F.col("text"))
    return quality.tokens(given, "source"), quality.tokens(dropped, "source"), quality.tokens(kept, "source")


@query
def adjusted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.adjusted_recall(*_recall_sides(spark, sf_dir), "source").select("source", "reference_tokens", "overlap_tokens", "recall")


@query
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report_totals(*_recall_sides(spark, sf_dir), "source").select("source", "input_words", "dropped_words", "output_words", "expected_words", "recall", "recall_raw", "recall_passed")


@query
def drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _document_lines(spark, sf_dir).withColumn("page_number", F.lit(1))
    return quality.drop_report(quality.drop_rows(lines.filter(_is_artifact()), "margin_artifact", "doc_id"), "doc_id").groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("word_count"))


@query
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_health(read(spark, sf_dir, "documents")).select("doc_id", "char_count", "bad_glyph_ratio", "needs_ocr")


@query
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.repeated_margin_texts(literal(spark, "margins").withColumn("body_font", F.lit(12.0)))


@query
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return literal(spark, "texts").select("id", p.noise(text).alias("is_noise"), p.noise(text, True).alias("is_noise_ocr"), p.page_number(text).alias("is_page_number"), p.qa_junk(text).alias("is_qa_junk"))


@query
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_heading, opens = p.heading_flags(t.collapse(F.col("text")), F.col("font"), F.col("bold_ratio"), F.col("y0"), F.lit(12.0), F.col("height"))
    return literal(spark, "headings").select("ord", is_heading.alias("is_heading"), opens.alias("opens_chapter"), p.chapter_like(F.col("text")).alias("is_named"))


@query
def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.toc_pages(literal(spark, "toc"), "doc_id", "page_number")


@query
def copyright_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = literal(spark, "notices")
    whole = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("all_text"))
    found = whole.filter(p.copyright_page(F.col("page_number"), F.col("all_text"))).select("doc_id", "page_number")
    kept = lines.join(found, ["doc_id", "page_number"]).filter(~p.catalog_line(F.col("text")))
    return flow.statements(kept, "doc_id", "page_number")


@query
def chapter_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.chapter_sequence(literal(spark, "titles")).withColumn("before", F.coalesce("before", F.lit(-1)))


@query
def body_font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.body_font(literal(spark, "spans"))


@query
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(literal(spark, "blocks"), "doc_id", "page_number", width=F.col("width")).select("doc_id", "page_number", "ord", "column", "place")


@query
def blocks_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.outside_tables(literal(spark, "blocks"), literal(spark, "boxes"), "doc_id", "page_number").select("doc_id", "page_number", "ord")


@query
def verse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.verse_runs(literal(spark, "blocks").withColumn("kind", F.lit("line")), "doc_id", "page_number")


@query
def image_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.captions(literal(spark, "elements"), "doc_id", "page_number").select("doc_id", "page_number", "ord", "kind", "caption", "is_caption")


@query
def cover_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, level = chapters.cover_class(*(F.col(c) for c in ("image_ratio", "vector_ratio", "nonwhite_ratio", "word_count", "block_count", "vertical_span_ratio")))
    return literal(spark, "visuals").select("doc_id", "page_number", kind.alias("kind"), level.alias("confidence"))


@query
def cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.cover_pages(literal(spark, "visuals")).fillna(0)  # 0: none


@query
def archive_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, "paths").withColumn("is_safe", p.archive_path(F.col("path")))


@query
def redacted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, "logs").select("id", t.redacted(F.col("text")).alias("text"))


@query
def image_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.first_images(literal(spark, "images"), "chapter").select("chapter", "ord", "image_key")


@query
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid(literal(spark, "cells"), "page", near=5.0)


@query
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ruled_tables(literal(spark, "rules"), literal(spark, "ruled_words"), "page").select("page", "x0", "y0", "x1", "y1", F.to_json("rows").alias("rows"))


@query
def whitespace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spaced_tables(literal(spark, "spaced"), "page").select("page", "table", "x0", "y0", "x1", "y1", F.to_json("rows").alias("rows"))


@query
def xy_cut_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.xy_cut(literal(spark, "blocks"), "doc_id", "page_number")


@query
def note_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.note_pairs(literal(spark, "notes"))


@query
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.chapters(literal(spark, "flow"))


@query
def page_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages; paragraphs that haven't ended go on."""
    lines = _turn_lines(spark, sf_dir).withColumn("kind", F.lit("line"))
    paragraphs = flow.assemble(lines, "conv_id", "page_number", order="block_index").withColumn("ord", F.col("page_number").cast("long") * (1 << 32) + F.col("paragraph"))
    return chapters.continuations(paragraphs, "conv_id")


def _turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as its pages: lines in order of page."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page_number"), "text")
    return line_blocks(turns, "conv_id", "page_number").withColumns({"bold_ratio": F.lit(0.0), "lines": F.lit(1), "width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def _document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one page each, and conversations whose turns are pages, as blocks."""
    one = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page_number"), "text")
    lines = line_blocks(one, "doc_id", "page_number").withColumns({"bold_ratio": F.lit(0.0), "lines": F.lit(1), "width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
    turns = _turn_lines(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).drop("conv_id")
    return lines.unionByName(turns)


@query
def page_flow_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why and how often blocks or whole pages are dropped, and their words, by document."""
    found = pages.drops(pages.judged(_document_pages(spark, sf_dir)))
    return quality.drop_report(found, "doc_id").groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("word_count"))


@query
def page_flow_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters from blocks: number, title, paragraphs and words by document."""
    found, _ = pages.page_flow(_document_pages(spark, sf_dir))
    counted = found.groupBy("doc_id", "chapter_no", "chapter_title").agg(F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.sum(F.size(t.words(F.col("text")))).alias("n_words"))
    return counted


@query
def page_flow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the page flow produces, by kind of item."""
    found, _ = pages.page_flow(_document_pages(spark, sf_dir))
    return quality.produced(found, "doc_id").groupBy("kind", "token").agg(F.sum("n").alias("n"))


@query
def page_flow_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page flow over pages with a cover, contents, rights, running headers, numbers, noise, columns and headings."""
    found, _ = pages.page_flow(literal(spark, "book"), covers=literal(spark, "book_covers"))
    return found.select("doc_id", "chapter_no", "chapter_title", "item_no", "kind", "text", "page_number")


@query
def page_flow_case_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gone = pages.page_flow(literal(spark, "book"), covers=literal(spark, "book_covers"))
    return quality.drop_report(gone, "doc_id")


@query
def html_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_of_html(read(spark, sf_dir, "pages")).select("page_id", "ord", "kind", "text", "level", "font")


@query
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_of_html(literal(spark, "web")).select("page_id", "ord", "kind", "text", "level", F.to_json("rows").alias("rows"), "has_header_row", "src")


@query
def html_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters_of_html(flow_of_html(read(spark, sf_dir, "pages"))).groupBy("page_id", "chapter_no", "chapter_title").agg(F.count(F.lit(1)).alias("n_items"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = chapters_of_html(flow_of_html(read(spark, sf_dir, "pages")))
    bodies = render.bodies(items.drop("src"), "page_id", "chapter_no", "chapter_title")
    return bodies.select("page_id", "chapter_no", F.col("chapter_title").alias("title"), render.page(F.col("chapter_title"), F.col("body")).alias("content"))


@query
def chapter_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir)


@query
def epub_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _rendered(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", "title", "content"))).alias("chapters"))
    named = listed.withColumn("title", F.get("chapters", F.lit(0))["title"]).withColumn("language", F.lit("en"))
    named = named.withColumn("identifier", render.content_id(F.col("title"), F.col("chapters")))
    return archives(package_rows(named, "page_id"), "page_id").select("page_id", F.sha2("package", 256).alias("package_sha256"), F.length("package").alias("n_bytes"), "error")


@query
def heading_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ["Chapter One pg. 12", "Chapter Two -", "Chapter 1& The Seed", "Chapter & Dawn", "chapter s", "Part 3 page 9", "CHAPTER 7 & Night", "A 1&2 b", "", "Plain"]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    return rows.select("id", t.heading(F.col("text")).alias("text"), t.merged_title(F.lit("Chapter 4"), F.col("text")).alias("merged"), p.misread_heading(F.col("text")).alias("is_misread"))
