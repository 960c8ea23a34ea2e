"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a learned vector of its own beside the mean of the learned vectors of those of its pieces that have one:
all runs of three to LONGEST characters (bytes of UTF-8, with a mark at either end of the word), so
unseen inflections of a known stem are recognised. Words and pieces of fewer than SEEN training
documents have no vector. Two gated recurrent layers read each window forwards and backwards,
attention weighs their states, and a document's score is that of its highest window: windows of
WINDOW words at every STRIDE words of the whole text are scored, so any WINDOW - STRIDE + 1 words in
a row lie whole in one. Training begins with windows drawn at random from both classes and goes on
with gradients through each document's highest window.

Only words are inputs. Labels are learned from at most POSITIVES and NEGATIVES labelled documents of
at most MOST_CHARS characters, chosen by a hash of doc_id, never from held-out rows (crc32 of doc_id
as text divisible by 5).

Defined cases: a text without words has score 0; a null doc_id counts as the empty text (held out);
each row of a repeated doc_id is scored by its own text, and the least of such texts is learned from;
conflicting labels of one doc_id count as toxic; without both labels to learn from, every score is
the share of toxic ones among them (0 without any); an empty table gives an empty result; `keep_clean`
keeps all columns and null texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy
from .shingles import U64, hash_words, mix, word_places

POSITIVES, NEGATIVES, MOST_CHARS = 1200, 2400, 12_000
WINDOW, STRIDE, BLOCK = 32, 8, 2048
WORDS, PIECES, LONGEST, EACH, HIDDEN, LOOK = 1 << 17, 1 << 18, 6, 8, 8, 8
#: Words and pieces of fewer training documents than this have no vector.
SEEN = 3
WARM, EPOCHS, TOP, BATCH, RATE, DECAY, SEED = 600, 6, 1, 128, 0.01, 0.02, 7
#: Share of words that a batch knows by their pieces only.
HIDE = 0.3
#: Bytes in no word: ASCII but for letters and digits.
_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SCORED = "doc_id long, score double"


@dataclass
class Words:
    """Distinct words of some texts: hashed ids, the pieces of each, and the texts as codes."""

    ids: np.ndarray
    pieces: np.ndarray
    begins: np.ndarray
    codes: np.ndarray
    at: np.ndarray


def read_words(texts: pa.Array) -> Words:
    data, starts, at = word_places(texts, _GAPS)
    hashes = hash_words(data, starts, _GAPS)
    codes, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    ids = (distinct >> U64(44)).astype(np.int64) % WORDS
    if not len(distinct):
        return Words(ids, np.zeros(0, np.int64), np.zeros(0, np.int64), codes, at)
    sizes = np.add.reduceat(~_GAPS[data], starts, dtype=np.int64)[first]  # only gaps follow a word up to the next
    begins = np.cumsum(sizes + 2) - (sizes + 2)
    letters = np.zeros(int((sizes + 2).sum()) + LONGEST, U64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters[np.repeat(begins + 1, sizes) + inner] = _LOWER[data[np.repeat(starts[first], sizes) + inner]]
    # a word between two marks has as many places for three bytes as bytes, and one less for each byte more
    codes_of, of = [], []
    code = letters[: len(letters) - LONGEST] + (letters[1 : len(letters) - LONGEST + 1] << U64(8))
    for k in range(3, LONGEST + 1):
        code = code + (letters[k - 1 : len(letters) - LONGEST + k - 1] << U64(8 * (k - 1)))
        n = np.maximum(sizes + 3 - k, 0)
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        codes_of.append(mix(code[np.repeat(begins, n) + which] + (U64(k) << U64(56))))
        of.append(np.repeat(np.arange(len(sizes)), n))
    order = np.argsort(np.concatenate(of), kind="stable")
    n = sum(np.maximum(sizes + 3 - k, 0) for k in range(3, LONGEST + 1))
    return Words(ids, (np.concatenate(codes_of)[order] >> U64(44)).astype(np.int64) % PIECES, np.cumsum(n) - n, codes, at)


def windows(n: int) -> np.ndarray:
    """Where the overlapping windows of n words begin; the last ends with the text."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE).clip(max=max(0, n - WINDOW))


def window_codes(words: Words, docs: Iterator[int] | range) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every window's words (-1 past the end) and each window's document."""
    starts, sizes, of = [], [], []
    for doc in docs:
        a, b = int(words.at[doc]), int(words.at[doc + 1])
        if b > a:
            begin = windows(b - a)
            starts.append(a + begin)
            sizes.append(np.full(len(begin), min(WINDOW, b - a)))
            of.append(np.full(len(begin), doc))
    if not of:
        return np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64)
    starts, sizes = np.concatenate(starts), np.concatenate(sizes)
    place = np.arange(WINDOW)[None, :]
    inside = place < sizes[:, None]
    return np.where(inside, words.codes[np.where(inside, starts[:, None] + place, 0)], -1), np.concatenate(of)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gathered(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indexes, and the sums of the rows of `values` that share one."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    begins = np.flatnonzero(np.append(True, index[1:] != index[:-1]))[: len(index)]
    return index[begins], np.add.reduceat(values[order], begins, axis=0) if len(begins) else values[:0]


class Network:
    """Weights, and the passes over them."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.known = {"word": np.ones(WORDS, bool), "piece": np.ones(PIECES, bool)}

        def some(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        g = 3 * HIDDEN
        self.w = {"word": some(WORDS, EACH, scale=0.1), "piece": some(PIECES, EACH, scale=0.1), "look": some(2 * HIDDEN, LOOK, scale=0.3), "look_at": some(LOOK, scale=0.3), "out": some(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1, np.float32)}
        for way in "fb":
            self.w |= {f"in_{way}": some(2 * EACH, g, scale=0.3), f"back_{way}": some(HIDDEN, g, scale=0.3), f"gate_{way}": np.zeros(g, np.float32)}

    def __getstate__(self) -> dict:
        """Of the tables of vectors only what is known is sent."""
        rows = {name: np.flatnonzero(known) for name, known in self.known.items()}
        return {"rows": rows, "w": {k: v[rows[k]] if k in rows else v for k, v in self.w.items()}}

    def __setstate__(self, state: dict) -> None:
        self.known, self.w = {}, dict(state["w"])
        for name, size in (("word", WORDS), ("piece", PIECES)):
            rows = state["rows"][name]
            self.known[name] = np.zeros(size, bool)
            self.known[name][rows] = True
            self.w[name] = np.zeros((size, EACH), np.float32)
            self.w[name][rows] = state["w"][name]

    def forget(self, words: Words, docs: int) -> None:
        """Takes the vectors of what occurs in fewer than SEEN documents away: it could only be learned by heart."""
        word, piece = np.zeros(WORDS, np.int32), np.zeros(PIECES, np.int32)
        ends = np.append(words.begins, len(words.pieces))
        for doc in range(docs):
            own = np.unique(words.codes[words.at[doc] : words.at[doc + 1]])
            word[np.unique(words.ids[own])] += 1
            counts = np.diff(ends)[own]
            which = np.repeat(ends[own] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            seen = np.zeros(PIECES, bool)
            seen[words.pieces[which]] = True
            piece += seen
        self.known = {"word": word >= SEEN, "piece": piece >= SEEN}
        for name, known in self.known.items():
            self.w[name][~known] = 0

    def shares(self, words: Words) -> np.ndarray:
        """How many pieces with a vector each word has, 1 at least."""
        return np.maximum(np.add.reduceat(self.known["piece"][words.pieces], words.begins, dtype=np.int64), 1)

    def inputs(self, words: Words) -> np.ndarray:
        """A row for each distinct word."""
        if not len(words.ids):
            return np.zeros((0, 2 * EACH), np.float32)
        pieces = np.add.reduceat(self.w["piece"][words.pieces], words.begins, axis=0) / self.shares(words)[:, None]
        return np.concatenate([self.w["word"][words.ids], pieces.astype(np.float32)], axis=1)

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """The inputs' share in the gates, with a last row for places past the end."""
        return {way: np.concatenate([inputs @ self.w[f"in_{way}"] + self.w[f"gate_{way}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for way in "fb"}

    def forward(self, gates: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """The windows' logits, and what the backward pass needs."""
        n, h2 = len(codes), 2 * HIDDEN
        states = np.zeros((WINDOW, n, h2), np.float32)
        here = (codes >= 0).astype(np.float32).T[:, :, None]
        whole = bool(here.all())
        places = np.ascontiguousarray(np.where(codes < 0, len(gates["f"]) - 1, codes).T)
        trace: dict = {}
        for way, steps, columns in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, h2))):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in steps:
                x = gates[way].take(places[t], axis=0)
                y = h @ self.w[f"back_{way}"]
                zr = _sigmoid(x[:, :h2] + y[:, :h2])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, h2:] + r * y[:, h2:])
                after = new + z * (h - new)
                if not whole:
                    after = h + here[t] * (after - h)
                if keep:
                    trace[way, t] = (h, z, r, new, y[:, h2:])
                h = states[t][:, columns] = after
        look = np.tanh(states @ self.w["look"])
        weight = look @ self.w["look_at"]
        if not whole:
            weight = np.where(here[:, :, 0] > 0, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ self.w["out"] + self.w["bias"][0]
        return logits, {"states": states, "here": here, "look": look, "weight": weight, "pooled": pooled, "trace": trace} if keep else {}

    def backward(self, kept: dict, slope: np.ndarray, inputs: np.ndarray, codes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights, and of each window's inputs (place, window, input)."""
        states, look, weight, here = kept["states"], kept["look"], kept["weight"], kept["here"]
        grad = {"out": kept["pooled"].T @ slope, "bias": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * self.w["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_look = d_score[:, :, None] * self.w["look_at"] * (1 - look**2)
        grad["look_at"] = np.einsum("tn,tnl->l", d_score, look)
        grad["look"] = np.einsum("tnh,tnl->hl", states, d_look)
        d_states = weight[:, :, None] * d_pooled + d_look @ self.w["look"].T
        d_inputs = np.zeros((WINDOW, len(codes), 2 * EACH), np.float32)
        for way, steps, columns in (("f", range(WINDOW - 1, -1, -1), slice(0, HIDDEN)), ("b", range(WINDOW), slice(HIDDEN, 2 * HIDDEN))):
            into, back = self.w[f"in_{way}"], self.w[f"back_{way}"]
            grad[f"in_{way}"], grad[f"back_{way}"], grad[f"gate_{way}"] = np.zeros_like(into), np.zeros_like(back), np.zeros(3 * HIDDEN, np.float32)
            d = np.zeros((len(codes), HIDDEN), np.float32)
            for t in steps:
                d = d + d_states[t][:, columns]
                h, z, r, new, y = kept["trace"][way, t]
                live = d * here[t]
                d_new = live * (1 - z) * (1 - new**2)
                d_z, d_r = live * (h - new) * z * (1 - z), d_new * y * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_y = np.concatenate([d_z, d_r, d_new * r], axis=1)
                grad[f"in_{way}"] += inputs[codes[:, t]].T @ d_x
                grad[f"back_{way}"] += h.T @ d_y
                grad[f"gate_{way}"] += d_x.sum(axis=0)
                d_inputs[t] += d_x @ into.T
                d = d - live + live * z + d_y @ back.T
        return grad, d_inputs * here

    def logits(self, words: Words, docs: range) -> np.ndarray:
        """Each document's highest window; minus infinity without words."""
        out = np.full(len(docs), -np.inf)
        gates = self.gates(self.inputs(words))
        codes, of = window_codes(words, docs)
        for a in range(0, len(codes), BLOCK):
            np.maximum.at(out, of[a : a + BLOCK] - docs.start, self.forward(gates, codes[a : a + BLOCK])[0])
        return out


class Trainer:
    """Adam on the cross entropy of windows; of the vectors' tables only the rows that a batch holds are changed."""

    def __init__(self, net: Network, words: Words, codes: np.ndarray, draw: np.random.Generator) -> None:
        self.net, self.words, self.codes, self.draw, self.steps = net, words, codes, draw, 0
        self.ends = np.append(words.begins, len(words.pieces))
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}

    def change(self, name: str, rows: np.ndarray | slice, g: np.ndarray) -> None:
        m, v = (x[rows] for x in self.moments[name])
        w = self.net.w[name]
        m = m + 0.1 * (g - m)
        v = v + 0.001 * (g * g - v)
        self.moments[name][0][rows], self.moments[name][1][rows] = m, v
        w[rows] -= RATE * (m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8) + (DECAY * w[rows] if name in self.net.known else 0))

    def step(self, some: np.ndarray, label: np.ndarray) -> None:
        net, words = self.net, self.words
        held, own = np.unique(self.codes[some], return_inverse=True)
        own = own.reshape(len(some), WINDOW)
        pad = int(held[0] < 0)
        held, own = held[pad:], own - pad
        counts = np.diff(self.ends)[held]
        which = np.repeat(words.begins[held] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        part = Words(words.ids[held], words.pieces[which], np.cumsum(counts) - counts, own, np.zeros(0))
        inputs = net.inputs(part)
        seen = (self.draw.random((len(held), 1)) >= HIDE).astype(np.float32)
        inputs[:, :EACH] *= seen
        logits, kept = net.forward(net.gates(inputs), own, keep=True)
        slope = ((_sigmoid(logits) - label) / len(some)).astype(np.float32)
        padded = np.concatenate([inputs, np.zeros((1, 2 * EACH), np.float32)])
        grad, d_inputs = net.backward(kept, slope, padded, own)
        rows, d_word = gathered(np.where(own < 0, len(held), own).T.ravel(), d_inputs.reshape(-1, 2 * EACH))
        whole = np.zeros((len(held) + 1, 2 * EACH), np.float32)
        whole[rows] = d_word
        d_word = whole[:-1]
        self.steps += 1
        for k, g in grad.items():
            self.change(k, slice(None), g)
        for name, index, g in (("word", part.ids, d_word[:, :EACH] * seen), ("piece", part.pieces, np.repeat(d_word[:, EACH:] / net.shares(part)[:, None], counts, axis=0))):
            rows, sums = gathered(index, g)
            known = net.known[name][rows]
            self.change(name, rows[known], sums[known])


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """First WARM batches of windows drawn from both classes alike, then epochs over each document's highest windows."""
    net, draw = Network(seed), np.random.default_rng(seed)
    words = read_words(pa.array(texts, pa.string()))
    net.forget(words, len(texts))
    codes, of = window_codes(words, range(len(texts)))
    label = np.array(toxic, np.float32)
    trainer = Trainer(net, words, codes, draw)
    begins, counts = np.searchsorted(of, np.arange(len(texts))), np.bincount(of, minlength=len(texts))
    classes = [np.flatnonzero((label == y) & (counts > 0)) for y in (0, 1)]
    if not all(len(c) for c in classes):
        return net
    for _ in range(WARM):
        docs = np.concatenate([draw.choice(c, BATCH // 2) for c in classes])
        trainer.step(begins[docs] + (draw.random(BATCH) * counts[docs]).astype(np.int64), label[docs])
    for _ in range(epochs):
        gates = net.gates(net.inputs(words))
        top = np.concatenate([net.forward(gates, codes[a : a + BLOCK])[0] for a in range(0, len(codes), BLOCK)])
        order = np.lexsort((top, of))
        place = np.arange(len(order)) - begins[of[order]]
        chosen = draw.permutation(order[place >= counts[of[order]] - TOP])
        for a in range(0, len(chosen), BATCH):
            some = chosen[a : a + BATCH]
            trainer.step(some, label[of[some]])
    return net


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, most_chars: int = MOST_CHARS) -> DataFrame:
    """The bounded sample that is learned from: doc_id, text, toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, most_chars))
    # more ids than needed, as some have no text of such a length
    some = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n) for t, n in ((1, positives), (0, negatives))]
    # one pass over the texts; of texts that share an id the least
    found = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("toxic") == 1, positives).otherwise(negatives)).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Network | float:
    """Learns in one task from the bounded sample, in order of doc_id; only the weights reach the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)), key=lambda r: r[0])
        toxic = [r[2] for r in rows]
        model = train([r[1] for r in rows], toxic) if len(set(toxic)) > 1 else sum(toxic) / max(1, len(toxic))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learned = training_rows(docs, labels, **bounds).coalesce(1).mapInArrow(tidy(learn), "model binary").first()
    return pickle.loads(learned.model) if learned else 0.0


def score_texts(model: Network | float, texts: pa.Array) -> np.ndarray:
    words = read_words(texts)
    if isinstance(model, float):
        return np.where(np.diff(words.at) > 0, model, 0.0)
    return _sigmoid(model.logits(words, range(len(texts))))


def keep_clean(docs: DataFrame, model: Network | float, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "text")):
            yield part.filter(pa.array(score_texts(sent.value, part.column("text")) < threshold))

    return docs.mapInArrow(tidy(each), docs.schema)


def scores(docs: DataFrame, model: Network | float) -> DataFrame:
    """`docs` (doc_id, text) with a score for each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by WORDS, PIECES and HIDDEN

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "text")):
            found = score_texts(sent.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(each), SCORED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = scores(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
