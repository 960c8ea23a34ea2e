"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"
#: The six characters between words.
SPACES = " \t\n\x0b\x0c\r"
#: Arrow batches are worked through in slices of about so many bytes of text.
SLICE_BYTES = 2 << 20
#: Keys of over one HOT-th of all rows are dealt over several tasks, from HOT_LEAST rows on.
HOT, HOT_LEAST = 20_000, 256
#: Tables of keys of up to so many rows are broadcast to find their rows in place; larger ones are joined.
FEW_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor shares.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, as every
    executor would write to its own disk.
    """
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read back; it goes when the driver ends.

    Lost executors leave it whole. Unlike a checkpoint, it keeps neither the constraints of the plan
    that made it, which grow from round to round of a loop, nor columns that nobody reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of `cut_lineage` before the driver ends; nothing that reads them may still be open."""
    for table_ in tables:
        spark = table_.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table_._cut_path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """`rows` joined to `side`, which has a row or a few for each key, however many rows share a key.

    Keys of more than a HOT-th part of all rows (HOT_LEAST at least) are found by partial sums; there
    are fewer than HOT of them, so their list is broadcast. Their rows are dealt over as many parts
    as hold such a share each, and the side's row is repeated for every part. `rows` should be a
    table, as it is read twice; `counts` (keys, n) of the rows, or of those whose keys `side` has,
    saves counting them here.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_LEAST, (total or 0) // HOT)
    if (most or 0) <= limit:  # the same rows by a shorter plan
        return rows.join(side, on, how)
    found = counts.filter(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("long").alias("hot_parts"))
    hot = F.broadcast(found)
    # the row's number deals equal rows to different parts too
    dealt = rows.join(hot, on, "left").withColumn("hot_part", F.when(F.col("hot_parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("hot_parts")))).drop("hot_parts")
    copies = side.join(hot, on, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("hot_parts", F.lit(1)) - 1))).drop("hot_parts")
    return dealt.join(copies, [*on, "hot_part"], how).drop("hot_part")


def only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The `rows` whose `on` is in `keys`, a table; where those are few, the other rows stay where they are."""
    return rows.join(F.broadcast(keys.select(on)) if keys.count() <= FEW_KEYS else keys.select(on), on, "left_semi")


def word_count(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marks, SPACES, "")).cast("long")


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` for mapInArrow that gives its memory back when a task ends, as workers wait for the next one with what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_BYTES of text each (or a single longer row)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)
