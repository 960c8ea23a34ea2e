"""Substring dedup by hashing whole lines, and word runs inside them.

Units are normalised (lower case, single spaces) and hashed. Every line that isn't blank is a unit,
however short or long; so are runs of RUN words, in the text's words without regard to line ends,
whose hash is the least of WINDOW neighbouring ones, so any RUN + WINDOW - 1 equal words have such a
run in common wherever they stand. In scripts without spaces every character is a word.

Digests are grouped over the whole corpus: the occurrence in the first document, at its first word,
stays, all others go. A run that goes and isn't part of a line that goes is lengthened word by word,
by up to REACH words a side, as far as the text around it equals the text around the occurrence that
stays; runs stand so close that a passage goes whole, wherever it begins. Units of a document that
touch make one passage, and passages of at least `least_words` words go: 1 takes out every repeated
line, PASSAGE leaves short lines that recur by custom (mottoes, licence lines) where they are.
Every word that goes equals an earlier one.

Digests are counted with partial sums, rows of digests that recur are joined to their first
occurrence with hot digests dealt over tasks, and texts are read again, in place if their ids are
few, only for runs that must be lengthened. Texts aren't joined to texts.

Defined cases: null, empty and blank texts have no units and stay as they are; a repeat within one
text goes as well; equal rows of one doc_id are one document stored twice and no repeats of each
other; different texts of one doc_id each have their own units, ranked by the text's hash; rows
without a doc_id rank last; an empty table gives an empty result; of docs only doc_id and text are
read. Offsets are code points of the original text, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, drop_tables, only, slices, spread_join, tidy
from .shingles import U64, hash_words, mix, powers, raw_bytes, word_places

RUN, WINDOW, REACH, PASSAGE = 8, 23, 32, 50
_ALONE = "฀-໿က-႟ក-៿⺀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"  # scripts without spaces
_WORD = re.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")
#: What plain byte work would cut otherwise: such scripts, and white space past the six ASCII characters.
_SPECIAL = r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STEP, _STEP2 = U64(0xD1342543DE82EF95), U64(0xAF251AF3B0F025B5)
#: Low bits of a run's hash that give way to its place.
_PLACE = U64((1 << 20) - 1)
LINES = "doc_id long, mark long, w0 int, w1 int, start int, end int, key long, check long"
RUNS = "doc_id long, mark long, w0 int, key long"


class Words:
    """The words of some texts: hashes, code-point bounds, line numbers, and each text's first word."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        lowered = pc.utf8_lower(texts)
        special = pc.match_substring_regex(texts, _SPECIAL).to_numpy(zero_copy_only=False)
        data, starts, at = word_places(texts)
        low_data, low_starts, low_at = word_places(lowered)
        if special.any() or (at != low_at).any():
            self._one_by_one(texts)
            return
        self.at = at
        self.hashes = hash_words(low_data, low_starts)
        _, text_at = raw_bytes(texts)
        points = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, np.int64)  # code points up to and with each byte
        before = np.append(0, points)[text_at[:-1]]
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.starts = points[starts] - 1 - before[of] if len(starts) else np.zeros(0, np.int64)
        gap = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        gap_at = np.append(np.flatnonzero(gap), len(data))
        stops = np.minimum(gap_at[np.searchsorted(gap_at, starts)], text_at[1:][of]) if len(starts) else starts
        self.ends = points[stops - 1] - before[of] if len(starts) else np.zeros(0, np.int64)
        self.lines = np.searchsorted(np.flatnonzero(data == 10), starts)

    def _one_by_one(self, texts: pa.Array) -> None:
        words, starts, ends, lines, sizes = [], [], [], [], []
        for text in texts.to_pylist():
            found = list(_WORD.finditer(text))
            breaks = np.array([i for i, c in enumerate(text) if c == "\n"], np.int64)
            begins = np.array([m.start() for m in found], np.int64)
            words += [m[0] for m in found]
            starts.append(begins)
            ends.append(np.array([m.end() for m in found], np.int64))
            lines.append(np.searchsorted(breaks, begins))
            sizes.append(len(found))
        self.at = np.append(0, np.cumsum(sizes, dtype=np.int64))
        self.starts, self.ends, self.lines = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (starts, ends, lines))
        # each word hashed as a text of its own, whatever is in it
        data, at = raw_bytes(pc.utf8_lower(pa.array(words, pa.string())))
        none = np.zeros(256, bool)
        self.hashes = hash_words(data, at[:-1], none)

    def line_units(self) -> tuple[np.ndarray, ...]:
        """For each line with words: its text, first word, word after the last, and two hashes."""
        n = len(self.hashes)
        of = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
        begins = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (self.lines[1:] != self.lines[:-1])))
        stops = np.append(begins[1:], n)
        within = np.arange(n) - np.repeat(begins, stops - begins)
        longest = int((stops - begins).max())
        one, two = (mix(np.add.reduceat(mix(self.hashes + step) * powers(step, longest)[within], begins) + (stops - begins).astype(U64)) for step in (_STEP, _STEP2))
        return of[begins], begins, stops, one, two

    def run_units(self) -> tuple[np.ndarray, ...]:
        """For each run that is the least of some window: its text, first word and hash."""
        of = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        span = RUN + WINDOW - 1
        if len(self.hashes) < span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        n, factors = len(self.hashes) - RUN + 1, powers(_STEP, RUN)
        grams = np.zeros(n, U64)
        for j in range(RUN):
            grams += self.hashes[j : j + n] * factors[j]
        grams = mix(grams)
        inside = of[: len(of) - span + 1] == of[span - 1 :]  # windows that lie in one text
        # the least of each window by doubling, with its place in the text in the low bits
        rel = (np.arange(n) - self.at[:-1][of[:n]]).astype(U64) & _PLACE
        least, width = (grams & ~_PLACE) | rel, 1
        while 2 * width <= WINDOW:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: n - WINDOW + 1], least[WINDOW - width :][: n - WINDOW + 1])
        heads = np.flatnonzero(inside)
        chosen = np.unique(heads + (((least[heads] & _PLACE) - rel[heads]) & _PLACE).astype(np.int64))
        if len(chosen):  # a text that repeats itself at once has the same run again and again
            same = np.append(False, (grams[chosen[1:]] == grams[chosen[:-1]]) & (chosen[1:] - chosen[:-1] < RUN) & (of[chosen[1:]] == of[chosen[:-1]]))
            heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(chosen))))
            chosen = chosen[(chosen - chosen[heads]) % RUN == 0]
        return of[chosen], chosen, grams[chosen]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part in (x for batch in batches for x in slices(batch, "text")):
        yield part, Words(part.column("text"))


def _ints(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.astype(np.int32 if kind == pa.int32() else np.int64) if values.dtype != U64 else values.view(np.int64), kind)


def _units(texts: DataFrame) -> DataFrame:
    """A table of all line and run units of `texts` (doc_id, mark, text), hashed in one pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches):
            of, begins, stops, one, two = words.line_units()
            r_of, r_begins, key = words.run_units()
            none = np.zeros(len(r_of), bool)
            rows = pa.array(np.concatenate([of, r_of]))
            first = words.at[:-1]
            columns = [
                part.column("doc_id").take(rows),
                part.column("mark").take(rows),
                _ints(np.concatenate([begins - first[of], r_begins - first[r_of]]), pa.int32()),
                _ints(np.concatenate([stops - first[of], r_begins - first[r_of] + RUN]), pa.int32()),
                _ints(np.concatenate([words.starts[begins], none]), pa.int32()),
                _ints(np.concatenate([words.ends[stops - 1], none]), pa.int32()),
                _ints(np.concatenate([one, key]), pa.int64()),
                pa.array(np.concatenate([two.view(np.int64), np.zeros(len(r_of), np.int64)]), pa.int64()),
                pa.array(np.concatenate([np.ones(len(of), bool), none])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINES.split(", ")] + ["line"])

    return cut_lineage(texts.mapInArrow(tidy(each), f"{LINES}, line boolean"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "w0")


def _repeats(units: DataFrame, on: list[str], *more: str, columns: list[str]) -> DataFrame:
    """A table of the units that go: `columns` and, of their digest's first occurrence, kept_doc_id, kept_mark, kept_w0 and kept_<more>."""
    counts = cut_lineage(units.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = cut_lineage(spread_join(units, counts.select(*on), on, counts=counts))
    firsts = again.groupBy(*on).agg(F.min(F.struct(_place().alias("at"), *more)).alias("kept"))
    kept = firsts.select(*on, *(F.col(f"kept.at.{c}").alias(f"kept_{c}") for c in ("doc_id", "mark", "w0")), *(F.col(f"kept.{c}").alias(f"kept_{c}") for c in more))
    gone = cut_lineage(spread_join(again, kept, on, counts=counts).filter(~_is_first()).select(*columns).distinct())
    drop_tables(counts, again)
    return gone


def _is_first() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("mark") == F.col("kept_mark")) & (F.col("w0") == F.col("kept_w0"))


#: A unit or passage that goes, and where what stays begins.
GONE = "doc_id long, mark long, w0 int, w1 int, start int, end int, kept_doc_id long, kept_mark long, kept_w0 int, kept_start int"
_GONE = [c.split()[0] for c in GONE.split(", ")]
#: Around a run: hashes of the words before (nearest first) and after, how far from the run they begin and end, and a second hash of the run's own words.
SEEN = "doc_id long, mark long, w0 int, key long, own long, first boolean, start int, end int, before binary, starts binary, after binary, ends binary"
_SEEN = [(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for c in SEEN.split(", ")]


def _far(distances: np.ndarray) -> bytes:
    """Distances in two bytes each if they fit, else in four."""
    return distances.astype(np.uint16 if not len(distances) or distances.max() < 1 << 16 else np.uint32).tobytes()


def _nth(distances: bytes, hashes: bytes, n: int) -> int:
    size = 4 * len(distances) // max(1, len(hashes))
    return int(np.frombuffer(distances, np.uint16 if size == 2 else np.uint32)[n - 1])


def _look(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """A table of SEEN for each (doc_id, mark, w0, key, first) of `asked`."""
    at = F.struct("doc_id", "mark").alias("at")
    wanted = cut_lineage(asked.groupBy(at).agg(F.sort_array(F.collect_set(F.struct("w0", "key", "first"))).alias("asks")))
    joined = only(texts.select(at, "text"), wanted, "at").groupBy("at").agg(F.first("text").alias("text")).join(wanted, "at").select("at.doc_id", "at.mark", "text", "asks")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = powers(_STEP2, RUN)
        for part, words in _parts(batches):
            short = (words.hashes >> U64(32)).astype(np.uint32)
            starts, ends = words.starts, words.ends
            rows = []
            ids, marks, asks = (part.column(c).to_pylist() for c in ("doc_id", "mark", "asks"))
            for i, (doc, mark, some) in enumerate(zip(ids, marks, asks, strict=True)):
                a, b = int(words.at[i]), int(words.at[i + 1])
                for ask in some:
                    x = a + ask["w0"]
                    y = x + RUN
                    left, right = slice(max(a, x - REACH), x), slice(y, min(b, y + REACH))
                    start, end, own = int(starts[x]), int(ends[y - 1]), int(((words.hashes[x:y] + _STEP2) * factors).sum(dtype=U64).view(np.int64))
                    rows.append((doc, mark, ask["w0"], ask["key"], own, ask["first"], start, end, short[left][::-1].tobytes(), _far(start - starts[left][::-1]), short[right].tobytes(), b"" if ask["first"] else _far(ends[right] - end)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _SEEN, strict=True)], [n for n, _ in _SEEN])

    seen = cut_lineage(joined.mapInArrow(tidy(each), SEEN))
    drop_tables(wanted)
    return seen


def _alike(x: bytes, y: bytes) -> int:
    """How many hashes are the same from the first on."""
    n = min(len(x), len(y)) // 4
    apart = np.frombuffer(x, np.uint32, n) != np.frombuffer(y, np.uint32, n)
    return int(apart.argmax()) if apart.any() else n


def _lengthened(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """A table of GONE rows of runs (doc_id, mark, w0, key, kept_…), as long as they equal what stays."""
    places = ["doc_id", "mark", "w0", "key"]
    kept = runs.select(*(F.col("key") if c == "key" else F.col(f"kept_{c}").alias(c) for c in places)).distinct()
    seen = _look(texts, runs.select(*places, F.lit(False).alias("first")).unionByName(kept.withColumn("first", F.lit(True))))
    stands = seen.filter("first").select("key", *(F.col(n).alias(f"kept_{n}") for n in ("doc_id", "mark", "w0", "own", "start", "before", "starts", "after")))
    pairs = spread_join(seen.filter("not first").drop("first"), stands, ["key"], counts=runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for i in range(len(batch)):
                r = {c: rows[c][i] for c in rows}
                if r["own"] != r["kept_own"]:
                    continue  # different words that share a hash
                w0, w1, start, end, k0, ks = r["w0"], r["w0"] + RUN, r["start"], r["end"], r["kept_w0"], r["kept_start"]
                if n := _alike(r["before"], r["kept_before"]):
                    w0, k0 = w0 - n, k0 - n
                    start, ks = start - _nth(r["starts"], r["before"], n), ks - _nth(r["kept_starts"], r["kept_before"], n)
                if n := _alike(r["after"], r["kept_after"]):
                    w1, end = w1 + n, end + _nth(r["ends"], r["after"], n)
                out.append((r["doc_id"], r["mark"], w0, w1, start, end, r["kept_doc_id"], r["kept_mark"], k0, ks))
            columns = zip(*out, strict=True) if out else [[]] * len(_GONE)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n.endswith(("doc_id", "mark")) else pa.int32()) for c, n in zip(columns, _GONE, strict=True)], _GONE)

    longer = cut_lineage(pairs.mapInArrow(tidy(each), GONE))
    drop_tables(seen)
    return longer


def _gone(docs: DataFrame) -> DataFrame:
    """GONE rows of every unit that goes; units may overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    every = _units(texts)
    line_rows = _repeats(every.filter("line").drop("line"), ["key", "check"], "start", columns=_GONE)
    run_columns = ["doc_id", "mark", "w0", "key", "kept_doc_id", "kept_mark", "kept_w0"]
    run_rows = _repeats(every.filter("not line").select("doc_id", "mark", "w0", "key"), ["key"], columns=run_columns)
    drop_tables(every)
    # runs that lie in a stretch of lines that go need no look
    by_text = Window.partitionBy("doc_id", "mark").orderBy("w0", F.col("key").isNotNull())
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("kept_doc_id", "long"), ("kept_mark", "long"), ("kept_w0", "int"))]
    both = line_rows.select("doc_id", "mark", "w0", "w1", *nothing).unionByName(run_rows.withColumn("w1", F.col("w0") + RUN))
    is_line = F.col("key").isNull()
    reach = F.max(F.when(is_line, F.col("w1"))).over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    stretched = both.withColumn("stretch", F.sum((is_line & F.coalesce(F.col("w0") > reach, F.lit(True))).cast("int")).over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.max(F.when(is_line, F.col("w1"))).over(Window.partitionBy("doc_id", "mark", "stretch"))
    open_ = cut_lineage(stretched.withColumn("held", F.coalesce(held, F.lit(0))).filter(~is_line & (F.col("held") < F.col("w1"))).select(*run_columns))
    longer = _lengthened(texts, open_)
    drop_tables(run_rows, open_)
    return line_rows.unionByName(longer)


def repeated_passages(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """Every passage that goes: doc_id, start, end, words, and where the text that stays begins (kept_doc_id, kept_start).

    A passage is a stretch of units that touch or overlap; it stays in the place of its first unit.
    """
    return _passages(docs, least_words).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("words").cast("long").alias("words"), "kept_doc_id", F.col("kept_start").cast("long").alias("kept_start"))


def _passages(docs: DataFrame, least_words: int) -> DataFrame:
    gone = cut_lineage(_gone(docs))
    by_text = Window.partitionBy("doc_id", "mark").orderBy("w0", F.col("w1").desc(), "kept_doc_id", "kept_w0")
    reach = F.max("w1").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("w0") > reach).cast("int"), F.lit(0))
    islands = gone.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("w0", -F.col("w1"), F.col("kept_doc_id").isNull(), "kept_doc_id", "kept_w0", "kept_start")
    merged = islands.groupBy("doc_id", "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).alias("words"), F.min(first).alias("first"), F.collect_set(F.struct("start", "end")).alias("units"))
    return merged.filter(F.col("words") >= least_words).select("doc_id", "mark", "start", "end", "words", "first.kept_doc_id", "first.kept_start", "units")


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text that stays, and the original offsets of its parts."""
    at, kept = 0, []
    for a, b in sorted(spans):
        if a > at:
            kept.append((at, a))
        at = max(at, b)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[a:b] for a, b in kept), kept


def _cut(rows: DataFrame, passages: DataFrame, how: str) -> DataFrame:
    """`rows` (kept, text, at) with the units of passages (at, gone) cut out of text, kept_spans and gone; white space between units stays."""
    span = "struct<start:int,end:int,words:int,kept_doc_id:long,kept_start:int,units:array<struct<start:int,end:int>>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in (x for batch in batches for x in slices(batch, "text")):
            gone = part.column("gone")
            pairs = [(None, []) if t is None else without(t, [(u["start"], u["end"]) for s in g or [] for u in s["units"]]) for t, g in zip(part.column("text").to_pylist(), gone.to_pylist(), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in k] for _, k in pairs], kept_kind)
            yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array([t for t, _ in pairs], pa.string()), spans, gone], ["kept", "text", "kept_spans", "gone"])

    joined = rows.join(passages, "at", how).select("kept", "text", "gone")
    return joined.mapInArrow(tidy(cut), f"kept {rows.schema['kept'].dataType.simpleString()}, text string, kept_spans array<struct<start:long,end:long>>, gone array<{span}>")


def _keyed(docs: DataFrame, others: list[str]) -> DataFrame:
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    return docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("kept"), F.col("text").cast("string").alias("text"), at.alias("at"))


def _by_text(docs: DataFrame, least_words: int) -> DataFrame:
    """at, gone: a text's passages, as many as its own units."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "words", "kept_doc_id", "kept_start", "units")))
    return cut_lineage(_passages(docs, least_words).groupBy(F.struct("doc_id", "mark").alias("at")).agg(spans.alias("gone")))


def drop_repeats(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """`docs` with repeats cut out of text and a column kept_spans: the original offsets of what stays.

    All other columns are kept, whatever their names; a column kept_spans is replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "kept_spans")]
    out = _cut(_keyed(docs, others), _by_text(docs, least_words), "left")
    return out.select(*(F.col(f"kept.`{c}`").alias(c) for c in others), "text", "kept_spans")


def shortened(docs: DataFrame, least_words: int = PASSAGE) -> DataFrame:
    """Every document that loses text: doc_id, cleaned (what stays), kept_spans, and gone, the passages cut out."""
    passages = _by_text(docs, least_words)
    out = _cut(only(_keyed(docs, ["doc_id"]), passages, "at"), passages, "inner")
    gone = F.transform("gone", lambda g: g.dropFields("units"))
    return out.select(F.col("kept.doc_id").cast("long").alias("doc_id"), F.col("text").alias("cleaned"), "kept_spans", gone.alias("gone"))
