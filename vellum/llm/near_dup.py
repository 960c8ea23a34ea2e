"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full sets decide.

A document's set is its distinct five-word shingles. 512 MinHash samples are folded into a parity
bitmap (odd sketch) of 4096 bits, and the first 128 make 32 bands of 4. Two sketches' XOR has about
2048 (1 - exp(-m / 2048)) ones when m of the samples' 2 x 512 elements differ, so the count of ones
tells high similarities apart without the texts. A pair at the threshold shares no band with
probability (1 - 0.75^4)^32 = 5e-6, and fails the sketch test, at four and a half standard
deviations, with about 4e-6. Pairs that pass are compared on their full sets, so no link is false.

Work follows the documents, not the pairs:

1. Equal sets are one class, of which the smallest doc_id takes part.
2. Each bucket's leader is its densest member, the one with the most neighbours in all its buckets:
   of many edits of one text that is the text itself. Documents are compared with the leaders of
   their buckets, first with the one that they meet in most buckets, then, where components still
   differ, with the others. A component thus costs a comparison or a few for each member, and
   sketches and texts are only sent for those.
3. Only buckets that still hold several components are looked at again, in blocks, members outside
   the leader's component against all members. A block holds its members' sketches and full sets:
   pairs of different components whose sketches pass are confirmed there at once, and only links
   that join components leave it, so pairs that fall just short cost no rows, joins or shuffles.
   A bucket of one component costs nothing, however large.

Comparisons are grouped by the leader and salted, so a leader that a third of all rows
follow is copied once for GROUP followers and each group stays bounded. Buckets, leaders and classes
that very many rows share are joined in several tasks.

Defined cases: null, empty or blank texts have an empty set (n_shingles 0), are linked with nothing
and kept; rows that share a doc_id are one document with the links of all of them; rows without a
doc_id stay unlinked, with a null component_id, and are kept; equal texts keep the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, only, slices, spread_join, tidy
from .components import components
from .shingles import U64, mix, shingle_sets

SAMPLES, BANDED, BANDS, SKETCH_BITS = 512, 128, 32, 4096
THRESHOLD = 75
#: Ones in the XOR of two sketches at an estimated similarity of 0.655.
MOST_ONES = 324
#: Members of a bucket that one block of comparisons holds (and meets), and elements of their sets; followers of a leader in one group.
HELD, HELD_ELEMENTS, GROUP = 500, 2_000_000, 500
_random = np.random.default_rng(20240102)
_FACTOR = _random.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASK = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
SIGNED = "doc_id long, n_shingles long, set_sum long, set_mix long, bands array<long>, sketch array<long>"


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set of 64-bit hashes, in blocks that stay in the cache."""
    short = (hashes >> U64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 1024):
        block = (short[None, a : a + 1024] ^ _MASK[:, None]) * _FACTOR[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def bands_and_sketches(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of minima its band keys and its odd sketch."""
    wide = minima.astype(U64) + (np.arange(SAMPLES, dtype=U64) << U64(32))
    mixed = mix(wide)
    keys = mix(mixed[:, :BANDED].reshape(len(minima), BANDS, BANDED // BANDS).sum(axis=2, dtype=U64))
    places = (mixed % U64(SKETCH_BITS)).astype(np.int64) + np.arange(len(minima))[:, None] * SKETCH_BITS
    parity = np.bincount(places.ravel(), minlength=len(minima) * SKETCH_BITS).astype(np.uint8) & 1
    return keys.view(np.int64), np.packbits(parity.reshape(len(minima), SKETCH_BITS), axis=1).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, two sums that identify the set, band keys and odd sketch of every text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "text")):
            sizes, sums, mixes, minima = [], [], [], []
            for s in shingle_sets(part.column("text")):
                sizes.append(len(s))
                sums.append(s.sum(dtype=U64))
                mixes.append(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64))
                minima.append(min_hashes(s))
            keys, sketches = bands_and_sketches(np.array(minima, np.uint32).reshape(-1, SAMPLES))
            some = np.array(sizes) > 0
            offsets = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(sums, U64).view(np.int64)),
                    pa.array(np.array(mixes, U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sketches) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(sketches.ravel())),
                ],
                ["doc_id", "n_shingles", "set_sum", "set_mix", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(sign), SIGNED)


def ones(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (high, low) of a table whose sizes and sketches allow the threshold; many may share `low`."""
    low, high = (signed.select(F.col("doc_id").alias(end), F.col("n_shingles").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch")) for end in ("low", "high"))
    both = spread_join(pairs.select("high", "low"), low, ["low"]).join(high, "high")
    fits = 100 * F.least("high_n", "low_n") >= THRESHOLD * F.greatest("high_n", "low_n")
    return both.filter(fits & (ones(F.col("high_sketch"), F.col("low_sketch")) <= MOST_ONES)).select("high", "low")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (high, low) of a table whose full sets reach the threshold; `texts` has doc_id and text.

    Pairs are grouped by `low`, so that is best the one that many pairs share.
    """
    followers = cut_lineage(pairs.groupBy("low").agg(F.count(F.lit(1)).alias("n")))
    salts = followers.select("low", F.ceil(F.col("n") / GROUP).cast("int").alias("salts"))
    dealt = spread_join(pairs, salts, ["low"], counts=followers).select("low", F.pmod(F.xxhash64("high"), F.col("salts")).cast("int").alias("salt"), F.col("high").alias("doc_id"))
    leaders = salts.select("low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("low").alias("doc_id"))
    wanted = cut_lineage(dealt.unionByName(leaders))
    ids = cut_lineage(wanted.select("doc_id").distinct())
    grouped = spread_join(wanted, only(texts, ids, "doc_id"), ["doc_id"]).repartition("low", "salt").sortWithinPartitions("low", "salt", F.col("doc_id") != F.col("low"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for part in (x for batch in batches for x in slices(batch, "text")):
            links = []
            lows, salted, ids = (part.column(c).to_pylist() for c in ("low", "salt", "doc_id"))
            for low, salt, doc_id, own in zip(lows, salted, ids, shingle_sets(part.column("text")), strict=True):
                if group != (low, salt):
                    group, heads = (low, salt), []
                if doc_id == low:
                    heads.append(own)
                elif any(linked(own, head) for head in heads):
                    links.append((doc_id, low))
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return grouped.select("low", "salt", "doc_id", "text").mapInArrow(tidy(compare), "a long, b long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share at least THRESHOLD in 100 of their union."""
    small, large = sorted((a, b), key=len)
    if not len(small) or 100 * len(small) < THRESHOLD * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= THRESHOLD * (len(small) + len(large) - both)


def rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """`rows` with the component of `column` as `<column>_root`."""
    own = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return rows.join(own, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (high, low) of a table whose ends lie in different components."""
    low = spread_join(pairs.select("high", "low"), roots.select(F.col("node").alias("low"), F.col("root").alias("low_root")), ["low"], "left")
    return rooted(low, roots, "high").filter(F.col("high_root") != F.coalesce("low_root", "low")).select("high", "low")


def set_rows(texts: DataFrame) -> DataFrame:
    """doc_id and shingle set of every row of `texts`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "text")):
            sets = list(shingle_sets(part.column("text")))
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = pa.array(np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "set"])

    return texts.select("doc_id", "text").mapInArrow(tidy(each), "doc_id long, set array<long>")


class Block:
    """Some members of a bucket: others are compared with all of them at once, first by sketch, then by set."""

    def __init__(self, parts: list[list]) -> None:
        self.ids, self.roots, self.sizes, self.sketches, self.bands, sets = (sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*parts, strict=True))
        self.lengths = np.array([len(s) for s in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.lengths)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        self.parents: dict[int, int] = {}

    def find(self, root: int) -> int:
        while (up := self.parents.get(root, root)) != root:
            self.parents[root] = root = self.parents.get(up, up)
        return root

    def shared(self, some: np.ndarray) -> np.ndarray:
        """How many elements of a set each member has."""
        begin, end = np.searchsorted(self.values, some), np.searchsorted(self.values, some, "right")
        counts = end - begin
        places = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        return np.bincount(self.owners[places], minlength=len(self.ids))

    def links(self, key: int, part: list) -> Iterator[tuple[int, int]]:
        """Links to members that join components; a pair is compared only in the first of its buckets."""
        for c in range(0, len(part[0]), 128):
            ids, roots, sizes, sketches, bands, sets = (x[c : c + 128] for x in part)
            fits = 100 * np.minimum(sizes[:, None], self.sizes) >= THRESHOLD * np.maximum(sizes[:, None], self.sizes)
            i, j = np.nonzero(fits & (roots[:, None] != self.roots))
            same = bands[i] == self.bands[j]
            first = same.any(axis=1) & (bands[i, same.argmax(axis=1)] == key)
            i, j = i[first], j[first]
            near = np.bitwise_count(sketches[i] ^ self.sketches[j]).sum(axis=1) <= MOST_ONES
            i, j = i[near], j[near]
            for at in np.unique(i).tolist():
                others = [x for x in j[i == at].tolist() if self.find(int(self.roots[x])) != self.find(int(roots[at]))]
                both = self.shared(sets[at]) if others else None
                for x in others:
                    if 100 * both[x] >= THRESHOLD * (len(sets[at]) + self.lengths[x] - both[x]):
                        one, other = self.find(int(roots[at])), self.find(int(self.roots[x]))
                        if one != other:
                            self.parents[max(one, other)] = min(one, other)
                            yield int(ids[at]), int(self.ids[x])


def open_links(shared: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join what different components have in common buckets."""
    rows = rooted(shared, roots, "doc_id").withColumnRenamed("doc_id_root", "root")
    main = F.max(F.when(F.col("doc_id") == F.col("leader"), F.col("root"))).alias("main")
    several = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), main, F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("elements"))
    several = cut_lineage(several.filter("least < most"))
    blocks = F.greatest(F.ceil(F.col("members") / HELD), F.ceil(F.col("elements") / HELD_ELEMENTS)).cast("int")
    rows = cut_lineage(rows.select("key", "doc_id", "root"))
    sides = several.select("key", "main", blocks.alias("blocks"))
    rows = cut_lineage(spread_join(rows, sides, ["key"], counts=several.select("key", F.col("members").alias("n"))))
    ids = cut_lineage(rows.select("doc_id").distinct())
    sets = cut_lineage(set_rows(only(texts, ids, "doc_id")))
    # each block of members meets each slot of those outside the leader's component: groups of bounded size
    kept = ["key", "block", "slot", "probe", "doc_id", "root"]
    own = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    bases = rows.withColumn("block", own(1)).withColumn("slot", every).withColumn("probe", F.lit(False)).select(*kept)
    probes = rows.filter("root != main").withColumn("slot", own(2)).withColumn("block", every).withColumn("probe", F.lit(True)).select(*kept)
    whole = cut_lineage(bases.unionByName(probes))
    whole = spread_join(whole, classes.select("doc_id", "n_shingles", "sketch", "bands").join(sets, "doc_id"), ["doc_id"])
    grouped = whole.repartition("key", "block", "slot").sortWithinPartitions("key", "block", "slot", "probe")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys, blocks, slots, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "slot", "probe"))
            values = [batch.column(c).to_numpy() for c in ("doc_id", "root", "n_shingles")]
            values.append(batch.column("sketch").flatten().to_numpy().view(U64).reshape(-1, SKETCH_BITS // 64))
            values.append(batch.column("bands").flatten().to_numpy().reshape(-1, BANDS))
            ends = np.cumsum(batch.column("set").value_lengths().to_numpy())
            values.append(np.split(batch.column("set").flatten().to_numpy().view(U64), ends[:-1]))
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]) | (slots[1:] != slots[:-1]) | (probe[1:] != probe[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                if group != (keys[a], blocks[a], slots[a]):
                    group, held, block = (keys[a], blocks[a], slots[a]), [], None
                part = [v[a:b] for v in values]
                if not probe[a]:
                    held.append(part)
                elif held:  # a block may hold no member
                    block = block or Block(held)
                    found.extend(block.links(keys[a], part))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return grouped.select("key", "block", "slot", "probe", "doc_id", "root", "n_shingles", "sketch", "bands", "set").mapInArrow(tidy(compare), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text)."""
    signed = cut_lineage(signatures(docs))
    identity = ["n_shingles", "set_sum", "set_mix"]
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(known.groupBy(*identity).agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("first")).select(*identity, "first.*"))
    buckets = classes.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    sizes = cut_lineage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = cut_lineage(spread_join(buckets, sizes.withColumn("members", F.col("n")).drop("n"), ["key"], counts=sizes))
    density = shared.groupBy("doc_id").agg(F.sum("members").alias("density"))
    leaders = shared.join(density, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("density", -F.col("doc_id"))).alias("leader"))
    shared = cut_lineage(spread_join(shared.select("doc_id", "n_shingles", "key"), leaders, ["key"], counts=sizes))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # sketches travel only for pairs that may still join components: first each document with the leader that it meets in most buckets
    led = cut_lineage(shared.filter("doc_id != leader").groupBy(F.col("doc_id").alias("high"), F.col("leader").alias("low")).agg(F.count(F.lit(1)).alias("met")))
    # rows that share a doc_id are one document, though their texts may lie in several classes
    own = cut_lineage(spread_join(signed.select("doc_id", *identity), classes.select(*identity, F.col("doc_id").alias("low")), identity, "left"))
    split = own.filter("doc_id is not null and low is not null").groupBy("doc_id").agg(F.min("low").alias("a"), F.max("low").alias("b")).filter("a < b").select("doc_id", "a")
    links = own.join(split, "doc_id").filter("low != a").select("a", F.col("low").alias("b"))
    first = cut_lineage(led.groupBy("high").agg(F.min_by("low", F.struct(-F.col("met"), "low")).alias("low")))
    links = cut_lineage(links.unionByName(verified(cut_lineage(alike(first, classes)), texts)))
    roots = components(links)
    others = cut_lineage(apart(led, roots))
    for more in (lambda: verified(cut_lineage(alike(others, classes)), texts), lambda: open_links(shared, roots, classes, texts)):
        late = cut_lineage(more())
        if not late.isEmpty():
            links = links.unionByName(late)
            roots = components(links)
    out = spread_join(own, roots.select(F.col("node").alias("low"), "root"), ["low"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "low", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the rows of documents that aren't their component's first.

    Of rows that share a doc_id, all stay if their document does.
    """
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti").select("row.*")
