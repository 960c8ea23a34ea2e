"""Page-local stages over streams: what needs one text only runs unchanged on arriving rows.

Body size, repeated margins and chapters need whole documents and are left to batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import bad_glyphs, needs_ocr
from ..functions.text import words
from ..sources.lines import HEIGHT, WIDTH, line_blocks


def text_health(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, char_count, bad_glyph_ratio, word_count and needs_ocr of each text, batch or stream."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = texts.select(key, F.length(text).cast("long").alias("char_count"), bad_glyphs(text).alias("bad_glyph_ratio"), F.size(words(text)).cast("long").alias("word_count"))
    return rows.withColumn("needs_ocr", needs_ocr(F.col("char_count"), F.col("bad_glyph_ratio"), F.lit(WIDTH), F.lit(HEIGHT)))


def stream_blocks(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line blocks of arriving texts."""
    return line_blocks(texts, key)
