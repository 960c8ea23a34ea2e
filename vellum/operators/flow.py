"""Page-level flow: margins, headings, verse, code, captions and paragraph assembly.

All of it is windows and aggregates within a page, so pages spread over tasks however many pages a
document has; what is known per document (its body size, its repeated texts) comes by joins on the
document with tables of a row or a few for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import MARGIN_BAND, REPEAT_LEAST, REPEAT_SHARE
from ..functions.text import collapse, plain, starts_lower, strip, without_hyphen

PARAGRAPH_X, BODY_FONT = 24.0, 12.0
# What makes centred ragged lines a verse, as shares of the page's width.
VERSE_CENTRE, VERSE_RAGGED, VERSE_WIDEST, VERSE_LEAST = 0.04, 0.04, 0.72, 2


def body_font(spans: DataFrame, document: str = "doc_id") -> DataFrame:
    """document, body_font: the most frequent span size to a tenth, the first seen of equals; 12 without spans.

    `spans` has the document, ord, text and size.
    """
    rounded = F.bround(F.col("size"), 1)
    seen = spans.filter(strip(plain(F.col("text"))) != "").groupBy(document, rounded.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = seen.groupBy(document).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body_font"))
    return spans.select(document).distinct().join(best, document, "left").withColumn("body_font", F.coalesce("body_font", F.lit(BODY_FONT)))


def median_line_height(lines: DataFrame, document: str = "doc_id") -> DataFrame:
    height = F.col("y1") - F.col("y0")
    return lines.groupBy(document).agg(F.coalesce(F.percentile(F.when(height > 0, height), 0.5), F.lit(BODY_FONT)).alias("line_height"))


def line_stats(spans: DataFrame, *keys: str) -> DataFrame:
    """Largest and mean size, bold share and the dominant span of each line (spans: ord, text, size, is_bold)."""
    visible = F.length(strip(plain(F.col("text"))))
    shown = visible > 0
    return spans.groupBy(*keys).agg(
        F.max("size").alias("max_font"),
        F.avg("size").alias("mean_font"),
        F.coalesce(F.avg(F.when(shown, F.col("is_bold").cast("double"))), F.lit(0.0)).alias("bold_ratio"),
        F.max_by("ord", F.struct(visible, -F.col("ord"))).alias("dominant"),
    )


def repeated_margin_texts(blocks: DataFrame, document: str = "doc_id", band: float = MARGIN_BAND) -> DataFrame:
    """(document, margin_text): texts in the margins, or three times as large as the body, on enough pages.

    `blocks` has the document, page_number, height, text, y0, y1, font and body_font.
    """
    text = collapse(F.col("text"))
    placed = (F.col("y1") <= F.col("height") * band) | (F.col("y0") >= F.col("height") * (1 - band)) | (F.col("font") >= 3 * F.col("body_font"))
    pages = blocks.groupBy(document).agg(F.countDistinct("page_number").alias("pages"))
    found = blocks.filter(placed & (text != "")).select(document, "page_number", text.alias("margin_text")).distinct().groupBy(document, "margin_text").agg(F.count(F.lit(1)).alias("n"))
    enough = F.greatest(F.lit(REPEAT_LEAST), F.ceil(F.lit(REPEAT_SHARE) * F.col("pages")))
    return found.join(pages, document).filter(F.col("n") >= enough).select(document, "margin_text")


def outside_tables(blocks: DataFrame, tables: DataFrame, *page: str) -> DataFrame:
    """Blocks whose centre lies in no table of their page (borders count as inside)."""
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in page]
    inside = x.between(F.col("t.x0"), F.col("t.x1")) & y.between(F.col("t.y0"), F.col("t.y1"))
    on = inside
    for s in same:
        on = s & on
    return blocks.alias("b").join(tables.alias("t"), on, "left_anti")


def captions(elements: DataFrame, *page: str, order: str = "ord") -> DataFrame:
    """Images with the line below as caption: in their column, at most two body sizes below, in small print."""
    w = Window.partitionBy(*page).orderBy(order)
    after = {c: F.lead(c).over(w) for c in ("kind", "y0", "font", "column", "text")}
    gap = after["y0"] - F.col("y1")
    fits = (F.col("kind") == "image") & (after["kind"] == "line") & gap.between(F.lit(0.0), 2 * F.col("body_font")) & (after["font"] <= 0.95 * F.col("body_font")) & (after["column"] == F.col("column"))
    return elements.withColumn("caption", F.when(fits, after["text"])).withColumn("is_caption", F.coalesce(F.lag(fits).over(w), F.lit(False)))


def runs(flag: Column, *page: str, order: str = "ord") -> Column:
    """A number for each maximal stretch of rows with the same flag."""
    w = Window.partitionBy(*page).orderBy(order)
    return F.sum(F.coalesce((flag != F.lag(flag).over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def verse_runs(elements: DataFrame, *page: str, order: str = "ord") -> DataFrame:
    """One row for each run of at least two centred, ragged, narrow lines: text and bounds."""
    line = (F.col("kind") == "line") & (F.col("x1") > F.col("x0"))
    marked = elements.withColumn("is_line", line)
    marked = marked.withColumn("run", runs(F.col("is_line"), *page, order=order)).filter("is_line")
    centre, width, page_width = (F.col("x0") + F.col("x1")) / 2, F.col("x1") - F.col("x0"), F.col("width")
    found = marked.groupBy(*page, "run").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.max(F.abs(centre - page_width / 2)).alias("off"),
        (F.max(centre) - F.min(centre)).alias("spread"),
        (F.max("x0") - F.min("x0")).alias("left"),
        (F.max("x1") - F.min("x1")).alias("right"),
        F.max(width).alias("widest"),
        F.max("width").alias("page_width"),
        F.min("x0").alias("x0"),
        F.min_by("y0", order).alias("y0"),
        F.max("x1").alias("x1"),
        F.max_by("y1", order).alias("y1"),
        F.min(order).alias("first"),
    )
    p = F.col("page_width")
    centred = (F.col("off") <= p * VERSE_CENTRE) & (F.col("spread") <= p * VERSE_CENTRE)
    ragged = (F.col("left") >= p * VERSE_RAGGED) & (F.col("right") >= p * VERSE_RAGGED)
    return found.filter((F.col("n_lines") >= VERSE_LEAST) & centred & ragged & (F.col("widest") <= p * VERSE_WIDEST)).select(*page, "first", "n_lines", "text", "x0", "y0", "x1", "y1")


def code_runs(lines: DataFrame, *page: str, order: str = "ord") -> DataFrame:
    """Neighbouring code lines as one text, indented by how far each starts right of its block."""
    pitch = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    indent = F.when(pitch > 0, F.greatest(F.bround((F.col("x0") - F.col("block_x0")) / pitch), F.lit(0)).cast("int")).otherwise(0)
    marked = lines.withColumn("run", runs(F.col("is_code"), *page, order=order)).filter("is_code").withColumn("line", F.concat(F.repeat(F.lit(" "), indent), F.rtrim("text")))
    return marked.groupBy(*page, "run").agg(F.min(order).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("text"))


def assemble(elements: DataFrame, *page: str, order: str = "ord", column: str | None = None) -> DataFrame:
    """Paragraphs of each page's lines: keys, paragraph, text, n_lines, first, font, bold_ratio.

    `elements` has kind ('line' or anything that ends a paragraph), text, x0, font, bold_ratio. A
    line opens a paragraph when no line comes just before, the column changes, it shifts by more
    than PARAGRAPH_X, or it doesn't start lower case and the text before ended. Each test needs
    the row before only, so this is a lag and a running sum.
    """
    w = Window.partitionBy(*page).orderBy(order)
    shown = plain(F.col("text"))
    rows = elements.withColumn("shown", shown).withColumn("lower", starts_lower(shown))
    before = F.lag("shown").over(w)
    after_line = F.coalesce(F.lag("kind").over(w) == "line", F.lit(False))
    moved = F.abs(F.col("x0") - F.lag("x0").over(w)) > PARAGRAPH_X
    if column:
        moved = moved | (F.col(column) != F.lag(column).over(w))
    ended = before.rlike(r"[.!?]$")
    opens = ~after_line | moved | (~F.col("lower") & ended)
    rows = rows.withColumn("opens", F.coalesce(opens, F.lit(True)))
    rows = rows.withColumn("hyphen", F.coalesce(~F.col("opens") & F.col("lower") & before.rlike("-$"), F.lit(False)))
    rows = rows.withColumn("paragraph", F.sum(((F.col("kind") == "line") & F.col("opens")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next_hyphen", F.coalesce(F.lead("hyphen").over(w), F.lit(False)))
    own = F.when(F.col("next_hyphen"), without_hyphen(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("piece", F.concat(F.when(F.col("opens") | F.col("hyphen"), "").otherwise(" "), F.when(F.col("hyphen"), F.ltrim(own)).otherwise(own)))
    return (
        rows.filter("kind = 'line'")
        .groupBy(*page, "paragraph")
        .agg(
            strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "")).alias("text"),
            F.count(F.lit(1)).alias("n_lines"),
            F.min(order).alias("first"),
            F.max("font").alias("font"),
            F.max("bold_ratio").alias("bold_ratio"),
        )
    )


def statements(lines: DataFrame, *page: str, order: str = "ord") -> DataFrame:
    """Copyright-page paragraphs: a line that starts lower case goes on unless the text before ended."""
    w = Window.partitionBy(*page).orderBy(order)
    goes_on = starts_lower(F.col("text")) & ~F.lag("text").over(w).rlike(r"[.!?]$")
    rows = lines.withColumn("paragraph", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*page, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))


def styled_text(spans: DataFrame, *line: str) -> DataFrame:
    """Each line's spans as markup: neighbours of one style join, then sup/sub, em and strong wrap them."""
    from ..functions.text import EM, STRONG, SUB, SUP

    w = Window.partitionBy(*line).orderBy("ord")
    style = F.struct("is_bold", "is_italic", "position")
    rows = spans.withColumn("style", style)
    rows = rows.withColumn("run", F.sum(F.coalesce((F.col("style") != F.lag("style").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy(*line, "run", "style").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("text"))
    core = strip(F.col("text"))

    def wrapped(inner: Column, marks: tuple[str, str], when: Column) -> Column:
        return F.when(when, F.concat(F.lit(marks[0]), inner, F.lit(marks[1]))).otherwise(inner)

    inner = wrapped(wrapped(core, SUP, F.col("style.position") == "sup"), SUB, F.col("style.position") == "sub")
    inner = wrapped(wrapped(inner, EM, F.col("style.is_italic")), STRONG, F.col("style.is_bold"))
    lead, trail = F.regexp_extract("text", r"^(\s*)", 1), F.regexp_extract("text", r"(\s*)$", 1)
    piece = F.when(core == "", F.col("text")).otherwise(F.concat(lead, inner, trail))
    return joined.withColumn("piece", piece).groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "piece"))), lambda x: x["piece"]), "").alias("markup"))


def first_use(marks: DataFrame, *page: str, order: str = "ord") -> DataFrame:
    """Of each page's superscript marks, which is its name's first use and so links to the note."""
    w = Window.partitionBy(*page, "marker").orderBy(order)
    return marks.withColumn("links", F.row_number().over(w) == 1)
