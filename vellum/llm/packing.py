"""Best-fit packing planned on a histogram of lengths.

Texts become pieces of at most `capacity` tokens. The plan sees only how many pieces have each
length (at most `capacity` counts, whatever the size of the corpus) and repeats a best-fit
sequence as often as the counts allow. Pieces then take planned slots by joining on their rank
within their length. The rank is split over buckets, so that a length that a third of all pieces
share is spread over many tasks, equal rows as well.

Defined cases: a null or empty text is one piece, the end token alone; an empty table gives an
empty result; rows that share a doc_id (or have none) are packed each for itself.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, slices, tidy

CAPACITY, END = 4096, 1
#: Pieces of one length that a task ranks together.
RANKED_TOGETHER = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_marks() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts by way of their words, for byte-level tokenizers that lower case, compose
    (NFC) and never join across white space.

    Words are encoded once and then looked up. A word's last marks are encoded apart where that
    cannot alter the ids, and a word of plain letters goes to the vocabulary's merges at once, as
    the steps before them would leave it as it is. `limit` bounds the words held.
    """

    #: ASCII marks that the tokenizer always splits from a letter or digit before them.
    TAIL = ".,!?;:#$%&*"

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.marks = self.tokenizer.model, _byte_marks()
        self.tails: dict[str, list[int]] = {"": []}
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, part: str) -> list[int]:
        if not part.isalpha():
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        if not part.isascii():
            # letters below U+0250 but U+0130 have one lower-case letter each, in any library
            if max(part) >= "\u0250" or "\u0130" in part or not unicodedata.is_normalized("NFC", part):
                return self.tokenizer.encode(part, add_special_tokens=False).ids
            part = part.lower().encode().decode("latin-1").translate(self.marks)
        return [x.id for x in self.model.tokenize(part.lower() if part.isascii() else part)]

    def word(self, word: str) -> list[int]:
        base = word.rstrip(self.TAIL)
        if not base or not base.lower()[-1].isalnum() or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        tail = word[len(base) :]
        if (ids := self.tails.get(tail)) is None:
            ids = self.tokenizer.encode(tail, add_special_tokens=False).ids
            if len(self.tails) < 10_000:
                self.tails[tail] = ids
        return self.encode(base) + ids

    def learn(self, words: list[str]) -> None:
        found = [self.word(w) for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.pool = np.append(self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (with the end of the last)."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary
        # the tokenizer composes before it lowers, so only ASCII words are lowered here, and none that could hold a special token
        plain = pc.and_(pc.string_is_ascii(known), pc.invert(pc.match_substring(known, "<|")))
        known = pc.if_else(plain, pc.ascii_lower(known), known).to_pylist()
        if len(self.place) > self.limit:
            self.reset()
        if fresh := [w for w in dict.fromkeys(known) if w not in self.place]:
            self.learn(fresh)
        place = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        place = place[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
        sizes, ends = self.lengths[place], np.zeros(len(place) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        ids = self.pool[np.repeat(self.starts[place] - ends[:-1], sizes) + np.arange(ends[-1])]
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, ends[offsets]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. No ids leave the worker."""
    last = np.array([end], np.uint32).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer)
        for part in (x for batch in batches for x in slices(batch, "text")):
            ids, begins = encode(part.column("text"))
            rows, raw = [], memoryview(ids.astype("<u4", copy=False)).cast("B")
            for row, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                for piece in range(-(-(b - a + 1) // capacity)):
                    x = a + piece * capacity
                    y = min(b, x + capacity)
                    crc, n = zlib.crc32(raw[4 * x : 4 * y]), y - x
                    if n < capacity:  # the end token follows the document's last id
                        crc, n = zlib.crc32(last, crc), n + 1
                    rows.append((row, piece, x - a, n, crc))
            of, *others = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of)), *(pa.array(c, t) for c, t in zip(others, (pa.int32(), *[pa.int64()] * 3), strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for `counts` pieces of each length: rows (length, first rank, ranks, first sequence, per sequence, offset).

    The longest remaining length opens a sequence; the largest length that still fits comes next,
    until none does. The sequence is repeated while the counts last, so each round but for small
    remainders uses a length up: the plan's size depends on the capacity alone.
    """
    if bad := [n for n in counts if not 0 < n <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:3]}")
    left, ranks = dict(counts), dict.fromkeys(counts, 0)
    lengths: list[int] = []
    for n in left:
        insort(lengths, n)
    rows, sequence = [], 0
    while lengths:
        room, used = capacity, []
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if k := min(room // n, left[n]):
                used.append((n, k, capacity - room))
                room -= n * k
            at = min(at - 1, bisect_right(lengths, room) - 1)
        times = min(left[n] // k for n, k, _ in used)
        for n, k, offset in used:
            rows.append((n, ranks[n], times * k, sequence, k, offset))
            ranks[n] += times * k
            left[n] -= times * k
            if not left[n]:
                lengths.remove(n)
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each piece of `cut`, a table with a number `deal` of its own for every row, its sequence_id and offset.

    Only the histogram (at most `capacity` rows) reaches the driver, and only the plan, bounded by
    the capacity too, is broadcast.
    """
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, first long, ranks long, first_sequence long, per_sequence long, at long")
    buckets = spark.createDataFrame([(n, -(-k // RANKED_TOGETHER)) for n, k in counts.items()], "length long, buckets long")
    dealt = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("deal"), F.col("buckets"))).drop("buckets", "deal")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(within) - 1).join(ahead, ["length", "bucket"]).withColumn("rank", F.col("row") + F.col("ahead"))
    in_run = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (in_run < F.col("ranks")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(in_run / F.col("per_sequence")))
        .withColumn("offset", F.col("at") + in_run % F.col("per_sequence") * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenizes and packs `docs` (doc_id, text; other columns are ignored)."""
    cut = pieces(docs, tokenizer, capacity, end).withColumn("deal", F.monotonically_increasing_id())  # written, so it stays what it is
    return pack(cut_lineage(cut), capacity)
