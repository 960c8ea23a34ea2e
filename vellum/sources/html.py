"""HTML as flow items: headings, paragraphs, list items, tables and images in document order.

Every matching element is visited, so a paragraph inside a list item or a table cell is an item of
its own as well as part of the outer element's text, and inner tables' rows are rows of the outer.
Unbalanced markup is closed as browsers do for p, li, tr, th and td.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Elements without an end tag, elements that end others, and elements whose text isn't shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
FLOW = "ord int, kind string, text string, level int, is_chapter_heading boolean, font double, bold_ratio double, rows array<array<string>>, has_header_row boolean, src string, alt string"


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            element = stack.pop()
            yield element
            stack.extend(c for c in reversed(element.children) if isinstance(c, Element))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return " ".join("".join(out).split())


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # what an opening tag ends, looked for among all open elements up to the next list or table
        ends = ({"p"} if tag in ENDS_P else set()) | ENDS.get(tag, set())
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ends:
                    del self.open[i:]
                    break
                if self.open[i].tag in ("ul", "ol", "table"):
                    break
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def table_rows(table: Element) -> list[list[str]]:
    rows = [[c.text() for c in row.walk() if c.tag in ("th", "td")] for row in table.walk() if row.tag == "tr"]
    rows = [r for r in rows if r]
    return rows if any(c for r in rows for c in r) else []


def flow_items(markup: str) -> list[dict]:
    tree = Tree()
    tree.feed(markup or "")
    tree.close()
    body = next((e for e in tree.root.walk() if e.tag == "body"), tree.root)
    items: list[dict] = []
    position, inside = 0, set()
    for element in body.walk():
        tag = element.tag
        if tag in HEADINGS:
            position += 1
            level = min(3, HEADINGS[tag])
            items.append({"kind": "heading", "text": element.text() or f"Section {position}", "level": level, "is_chapter_heading": level == 1, "font": max(12.0, 24.0 - 2 * level), "bold_ratio": 1.0})
        elif tag in ("p", "li"):
            position += 1
            if text := element.text():
                items.append({"kind": "paragraph", "text": ("• " if tag == "li" else "") + text})
            for image in element.walk():
                if image.tag == "img" and image.attrs.get("src"):
                    inside.add(id(image))
                    items.append({"kind": "image", "src": image.attrs["src"], "alt": image.attrs.get("alt", "")})
        elif tag == "table":
            position += 1
            if rows := table_rows(element):
                items.append({"kind": "table", "rows": rows, "has_header_row": any(e.tag == "th" for e in element.walk())})
        elif tag == "img" and id(element) not in inside and element.attrs.get("src"):
            position += 1
            items.append({"kind": "image", "src": element.attrs["src"], "alt": element.attrs.get("alt", "")})
    return items


def html_flow(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the flow items of every page, in order."""
    names = [c.split()[0] for c in FLOW.split(", ")]
    base = {"text": "", "level": 0, "is_chapter_heading": False, "font": 12.0, "bold_ratio": 0.0}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{key: k, "ord": i, **base, **item} for k, markup in zip(batch[key], batch[html], strict=True) for i, item in enumerate(flow_items(markup))]
            out = pd.DataFrame(rows, columns=[key, *names])
            for c in ("rows", "has_header_row", "src", "alt"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    return pages.select(key, html).mapInPandas(each, f"`{key}` {pages.schema[key].dataType.simpleString()}, {FLOW}")


def html_chapters(flow: DataFrame, key: str = "page_id", front: str = "Front Matter") -> DataFrame:
    """Items with chapter_no and chapter_title: every level-1 heading opens a chapter."""
    w = Window.partitionBy(key).orderBy("ord")
    opens = F.col("is_chapter_heading") & (F.col("kind") == "heading")
    rows = flow.withColumn("part", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("chapter_title", F.coalesce(F.first(F.when(opens, F.col("text")), ignorenulls=True).over(Window.partitionBy(key, "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(front)))
    return rows.withColumn("chapter_no", F.dense_rank().over(Window.partitionBy(key).orderBy("part"))).withColumn("item_no", F.row_number().over(Window.partitionBy(key, "part").orderBy("ord"))).drop("part")
