"""Homomorphic multiset fingerprints: wide vectors hashed from paragraphs, summed modulo powers of two.

A text is the multiset of its paragraphs: lines, cut further after sentence ends, stripped, empty
ones left out. Each paragraph's keyed hash gives LANES signs and WIDE full-range 64-bit values; a
fingerprint is their sums modulo 2^32 and 2^64. Sums don't depend on order, and adding or taking
away a paragraph adds or takes away its vector, so fingerprints are kept up to date without the
text. Equal multisets have equal fingerprints; different ones differ but with a probability below
2^-128, unless paragraphs are chosen by someone who knows the key.

The signs also estimate likeness: the mean square of two fingerprints' lane differences is the size
of the multisets' difference, which over the sum of the two sizes (their mean squares) and from 1
is the Dice similarity, with a relative error of about sqrt(2 / LANES) of what differs.

Defined cases: null, empty and blank texts have the zero fingerprint; two zero fingerprints have
likeness 1; rows that share a doc_id follow each other in order of their texts; rows without one
come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LANES, WIDE = 256, 4
_SIGNS, _WORDS = LANES // 8, 8 * WIDE
BYTES = 4 * LANES + _WORDS
KEY = b"paragraph multiset 1"
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1000, 8192


def paragraphs(text: str) -> list[str]:
    for mark in ".!?":
        text = text.replace(f"{mark} ", f"{mark}\n")
    return [p for line in text.split("\n") if (p := line.strip())]


def _digest(paragraph: str) -> bytes:
    return hashlib.blake2b(paragraph.encode(), digest_size=_SIGNS + _WORDS, key=KEY).digest()


def vectors(texts: list[list[str]]) -> np.ndarray:
    """A row of BYTES bytes for each multiset of paragraphs."""
    counts = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(_digest(p) for t in texts for p in t), np.uint8).reshape(-1, _SIGNS + _WORDS)
    out = np.zeros((len(texts), BYTES), np.uint8)
    some = np.flatnonzero(counts)
    if len(some):
        begins = (np.cumsum(counts) - counts)[some]
        up = np.add.reduceat(np.unpackbits(raw[:, :_SIGNS], axis=1), begins, axis=0, dtype=np.int64)
        lanes = (2 * up - counts[some, None]).astype(np.uint64).astype("<u4")
        wide = np.add.reduceat(np.ascontiguousarray(raw[:, _SIGNS:]).view("<u8"), begins, axis=0)
        out[some] = np.concatenate([lanes.view(np.uint8), wide.astype("<u8").view(np.uint8)], axis=1)
    return out


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of `a` with the paragraphs of `b` inserted (sign 1) or deleted (-1)."""
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    parts = []
    for columns, kind in ((slice(0, 4 * LANES), "<u4"), (slice(4 * LANES, BYTES), "<u8")):
        x, y = (np.ascontiguousarray(v[..., columns]).view(kind) for v in (a, b))
        parts.append((x + y if sign > 0 else x - y).view(np.uint8))
    return np.concatenate(parts, axis=-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Dice similarity of rows of fingerprints, 0 to 1; 1 for equal ones."""
    x, y = (np.ascontiguousarray(v[:, : 4 * LANES]).view("<i4").astype(np.float64) for v in (a, b))
    apart, sizes = ((x - y) ** 2).sum(axis=1), (x**2).sum(axis=1) + (y**2).sum(axis=1)
    near = np.clip(1 - apart / np.where(sizes > 0, sizes, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, near)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "text")):
            rows = vectors([paragraphs(t or "") for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes().hex() for r in rows], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range descending and followed by a guest: the row after it.

    A range ends at an id that occurs, so that row alone goes to its own range and, as guest, to the
    one above; the largest id is the guest of the lowest range. Only the ranges' ends (at most
    MOST_RANGES) reach the driver. Every text is shuffled once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, top = own.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    ranges = max(1, min(rows // RANGE_ROWS, MOST_RANGES))
    shares = [i / ranges for i in range(1, ranges)]
    found = own.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges))).first()[0] if shares else None
    ends = np.array(sorted({*(found or ())} - {top}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
            at = np.where(known, np.searchsorted(ends, ids), 0)
            bound = known & (at < len(ends)) & (np.append(ends, 0)[at] == ids)
            last = known & (ids == top) if top is not None else ~known
            everything = np.arange(len(ids))
            for rows, to, guest in ((everything, at, False), (everything[bound], at[bound] + 1, True), (everything[last], np.zeros(last.sum(), np.int64), True)):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), guest)), *part.columns], ["range", "guest", "doc_id", "text"])

    dealt = own.mapInArrow(deal, "range int, guest boolean, doc_id long, text string")
    return dealt.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """The last half of `text` replaced by as many first code points of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and how like it the edited text's and the next document's are.

    The next document is the one with the next lesser doc_id; after the least comes the greatest.
    """

    def settle(held: list[tuple]) -> pa.RecordBatch:
        texts = [edited(own, after) for _, own, after in held]
        each, changed, nexts = (vectors([paragraphs(t) for t in some]) for some in ([h[1] for h in held], texts, [h[2] for h in held]))
        columns = [
            [h[0] for h in held],
            [len(h[1]) for h in held],
            [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            [r.tobytes().hex() for r in each],
            [r.tobytes().hex() for r in changed],
            likeness(each, changed),
            likeness(each, nexts),
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in EDITED.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for part in (x for batch in batches for x in slices(batch, "text")):
            held = []
            for row in zip(*(part.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
                if before and before[0] == row[0] and not before[1]:
                    held.append((before[2], before[3], row[3]))
                before = row
            if held:
                yield settle(held)
        # a range's last row is a guest, so nothing is left over

    return in_order(docs).mapInArrow(walk, EDITED)
