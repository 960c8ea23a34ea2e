"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Within a source, a document's expected copies are in proportion
to its weight, at most MOST_COPIES, and such that they fill the target: the whole part is allocated
with certainty, the rest is the inclusion probability p of one more copy. Documents are ordered by
the Pareto ranking variable [u / (1 - u)] / [p / (1 - p)], u uniform from a hash of doc_id, and taken
in that order while the source's remaining words last. The document that would pass the target is
left out, and the next LOOK or so in order are tried for the gap it leaves, so the sample's size is
fixed in words.

Weights are any positive column or function of the size, such as `by_length`; they are rounded to
2 ** (1 / STEPS), so a source's weights are few however many documents it has, and where the cap of
copies binds follows from sums by source and weight.

The order needs no global sort: the ranking variable is cut into buckets, sums per source and
bucket find where the boundary falls, and only a few hundred rows of each source from there on are
ordered, equal ones as one row with their number. The number of buckets follows the input, so those
rows don't.

Defined cases: a null text has size 0 and is taken as often as its source's order says (0 words);
a null source is one source, last in order; a source without words has target 0; a null, zero or
negative weight is only taken when all others of its source are at the cap; rows that share a
doc_id tie and are ordered by size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, word_count

MOST_COPIES = 3
#: Weights are rounded to whole STEPS-ths of a power of two.
STEPS = 16
#: Stands for null, zero and negative weights, which are only taken when all others are at the cap.
NONE = 1e-200
CYCLE = (1, 2, 3)
#: Hexadecimal digits of the hash that make u, so many bits of it.
DIGITS, BITS = 13, 52
#: Documents for each bucket, and the most buckets: a third of 10 ** 10 documents are 3,200 a bucket then.
A_BUCKET, MOST_BUCKETS = 256, 1 << 20
#: Documents past the boundary that are tried for the gap.
LOOK = 512
#: Source tables up to so many rows are broadcast; larger ones are joined by key.
FEW_SOURCES = 100_000


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """An integer below 2 ** BITS from the id alone; a null id draws as the empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: weights by code-point order share all words, capped at `most` times the source.

    What caps cut off is reshared by weight. In the order of size by weight, the capped sources
    come first; the level rises while sources are capped and falls after, so its highest value over
    the others is where they stand.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("place") % len(cycle) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("words") - F.coalesce(F.sum(most * F.col("source_size")).over(up), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    capped = most * F.col("source_size") <= F.col("weight") * F.col("level")
    settled = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return (
        ordered.withColumn("weight", weight)
        .withColumn("words", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("capped", capped)
        .withColumn("settled", settled)
        .select("source", "source_size", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("settled")).alias("target"))
    )


def by_length(size: Column) -> Column:
    """A weight that grows by one with each doubling of a document's size: longer texts are likelier, very short ones least."""
    return 1 + F.log2(1 + size)


def weight_scales(rows: DataFrame, most: int) -> DataFrame:
    """source, step, expected: copies of the documents of each weight (2 ** (step / STEPS)) of a source.

    Copies are `scale * weight`, at most `most`. Heavy weights reach the cap first, so in falling
    order the scale is what the uncapped rest needs: it rises while weights are capped and falls
    after, and its highest value over the uncapped ones is where they stand.
    """
    sums = rows.groupBy("source", "step").agg(F.sum("size").alias("words"), F.max("target").alias("target"))
    weight = F.when(F.col("step").isNotNull(), F.pow(F.lit(2.0), F.col("step") / STEPS)).otherwise(NONE)
    heavier = Window.partitionBy("source").orderBy(F.col("step").desc_nulls_last())
    before, onward = heavier.rowsBetween(Window.unboundedPreceding, -1), heavier.rowsBetween(0, Window.unboundedFollowing)
    free = F.sum(F.col("words") * F.col("weight")).over(onward)
    scale = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.when(free > 0, free)
    stepped = sums.withColumn("weight", weight).withColumn("scale", scale).withColumn("capped", F.coalesce(F.col("weight") * F.col("scale") >= most, F.lit(False)))
    settled = F.max(F.when(~F.col("capped"), F.col("scale"))).over(Window.partitionBy("source"))
    expected = F.when(F.col("capped"), F.lit(float(most))).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.col("weight") * F.col("settled")), F.when(F.col("target") > 0, F.lit(float(most))), F.lit(0.0)))
    return stepped.withColumn("settled", settled).select("source", "step", F.least(expected, F.lit(float(most))).alias("expected"))


def pareto_mix(docs: DataFrame, weight: str | Callable[[Column], Column] | None = None, cycle: tuple[int, ...] = CYCLE, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, expected, copies and taken (words, repeats counted) of every document.

    `weight` names a positive column, or is a function of the size, that makes inclusion odds
    unequal within a source; without it they are equal.
    """
    size = word_count(F.col("text").cast("string"))
    own = F.lit(None).cast("double") if not isinstance(weight, str) else F.col(f"`{weight}`").cast("double")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), own.alias("own"))
    given = F.lit(1.0) if weight is None else F.col("own") if isinstance(weight, str) else weight(F.col("size")).cast("double")
    sizes = cut_lineage(sizes.withColumn("given", given).withColumn("step", F.when(F.col("given") > 0, F.round(F.log2("given") * STEPS).cast("int"))).drop("given", "own"))
    targets = cut_lineage(source_targets(sizes, cycle, most))
    buckets = max(64, min(sizes.count() // A_BUCKET, MOST_BUCKETS))
    small = targets.count() <= FEW_SOURCES  # the check behind the broadcasts below

    def by_source(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        side = side.withColumnRenamed("source", "of_source")
        return rows.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")

    rows = by_source(sizes, targets)
    scales = cut_lineage(weight_scales(rows, most))
    few = scales.count() <= FEW_SOURCES
    scales = scales.select(F.col("source").alias("of_source"), F.col("step").alias("of_step"), "expected")
    rows = rows.join(F.broadcast(scales) if few else scales, F.col("source").eqNullSafe(F.col("of_source")) & F.col("step").eqNullSafe(F.col("of_step"))).drop("of_source", "of_step", "step")
    p = F.col("expected") - F.col("whole")
    u = (draw(F.col("doc_id"), seed) + 0.5) / float(1 << BITS)
    # place = Q / (1 + Q) for the ranking variable Q; p = 0 comes last
    q = (u / (1 - u)) * ((1 - p) / p)
    rows = (
        rows.withColumn("whole", F.floor("expected"))
        .withColumn("place", F.when(p > 0, 1 - 1 / (1 + q)))
        .withColumn("draw", draw(F.col("doc_id"), seed))
        .withColumn("bucket", F.when(p > 0, F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1))).otherwise(buckets))
    )
    rest = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sums = cut_lineage(by_source(sums, rest).withColumn("upto", F.sum("words").over(upto)).withColumn("places", F.sum("n").over(upto)))
    ahead = F.struct("bucket", (F.col("upto") - F.col("words")).alias("words"), (F.col("places") - F.col("n")).alias("places"), "rest")
    edge = sums.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(ahead, "bucket").alias("edge"))
    last = by_source(sums, edge).filter(F.col("places") >= F.col("edge.places") + LOOK).groupBy("source").agg(F.min("bucket").alias("last"))
    rows = by_source(by_source(rows, edge, "left"), last, "left")
    near = F.coalesce(F.col("bucket").between(F.col("edge.bucket"), F.least(F.coalesce(F.col("last"), F.lit(buckets)), F.lit(buckets - 1))), F.lit(False))
    ahead_of = F.col("bucket") < F.coalesce(F.col("edge.bucket"), F.lit(buckets))
    kept = ["doc_id", "size", "source", "source_size", "target", "expected", "whole"]
    gap = (F.col("edge.rest") - F.col("edge.words")).alias("gap")
    alike = rows.filter(near).groupBy(*kept, "place", "draw", gap).agg(F.count(F.lit(1)).alias("n"))  # equal rows as one
    filled = alike.groupBy("source").applyInPandas(fill_gap, f"{', '.join(f'{c} {t}' for c, t in rows.select(*kept).dtypes)}, more long, n long")
    filled = filled.select(*kept, "more", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).drop("i")
    taken = rows.filter(~near).select(*kept, ahead_of.cast("long").alias("more")).unionByName(filled)
    return taken.withColumn("copies", F.col("whole") + F.col("more")).select("doc_id", "size", "source", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def fill_gap(rows: pd.DataFrame) -> pd.DataFrame:
    """Takes each of a source's rows, in order, that still fits its gap; `n` equal rows as many times as they fit."""
    rows = rows.sort_values(["place", "draw", "doc_id", "size"], kind="stable")
    gap, fits = rows["gap"].iloc[0], []
    for size, n in zip(rows["size"], rows["n"], strict=True):
        fits.append(n if not size else min(n, max(0, int(gap // size))))
        gap -= size * fits[-1]
    out = rows.drop(columns=["place", "draw", "gap"])
    some, others = out.assign(more=1, n=fits), out.assign(more=0, n=out["n"] - fits)
    return pd.concat([some[some["n"] > 0], others[others["n"] > 0]])
