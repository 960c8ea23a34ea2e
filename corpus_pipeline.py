"""Corpus pipeline: toxicity, near-duplicates, secrets, mixing and packing, one stage after another.

Every stage but the last returns the columns of its `docs`. Rows that share a doc_id stay or go
together in the near-duplicate and mixing stages; a null doc_id is an id like any other in mixing.
Null and empty texts stay until packing, where they are the end token alone; a null source is a
source; further columns pass through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut_lineage, spread_join, table
from vellum.llm.mixing import by_length, pareto_mix
from vellum.llm.near_dup import keep_one_of_each
from vellum.llm.packing import best_fit_packing
from vellum.llm.queries import tokenizer_path
from vellum.llm.secrets import redact_all
from vellum.llm.toxicity import fit, keep_clean


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at 0.5 or more go; it learns from the labelled ones among `docs`."""
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return keep_one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets blacked out and n_chars brought up to date."""
    return redact_all(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it: not at all, or up to three times."""
    ids = F.struct(F.col("doc_id").cast("long").alias("doc_id"))  # null is an id like any other
    taken = pareto_mix(docs, by_length).groupBy(ids.alias("mixed_id")).agg(F.max("copies").cast("int").alias("mixed_copies")).filter("mixed_copies > 0")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), ids.alias("mixed_id"))
    repeated = spread_join(rows, taken, ["mixed_id"])
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("mixed_copies")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_dup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained network and tokens are past SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
