"""ISO media containers: walk nested boxes and decode sample tables, never a payload.

`read_media` returns for each track its codec, duration and the byte ranges of its keyframes
(neighbouring ones joined). `store_payload` is the counterpart that keeps bytes losslessly as
unsigned 8-bit samples ('raw ' audio) in a file of its own, in frames of 64 samples.

Defined cases: null or empty bytes, a truncated box and tables that disagree give an error text
and no tracks, never a crash; a file without 'moov' is an error; a track without a sync table has
only keyframes. Payload storing takes null and empty as no bytes, padded to one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Boxes that hold boxes (fixed values of ISO/IEC 14496-12).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
FRAME, CHUNK_FRAMES, SYNC_EVERY, RATE = 64, 256, 64, 8000
TRACK = "struct<track:int,codec:string,kind:string,timescale:long,duration:double,samples:long,payload_bytes:long,keyframes:array<struct<start:long,end:long>>>"


class BadMedia(ValueError):
    """The bytes break the container's rules."""


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body begin, body end) of the boxes side by side in a range."""
    at = begin
    while at < end:
        if end - at < 8:
            raise BadMedia(f"{end - at} bytes left over at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise BadMedia(f"truncated box size at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:  # up to the end
            size = end - at
        if size < head or at + size > end:
            raise BadMedia(f"box of {size} bytes at {at} passes its parent's end")
        yield kind, at + head, at + size
        at += size


def tree(data: memoryview, begin: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box with its path; a track's boxes follow its 'trak'."""
    for kind, a, b in boxes(data, begin, end):
        yield (*path, kind), a, b
        if kind in NESTED and len(path) < 16:
            yield from tree(data, a, b, (*path, kind))


def numbers(data: memoryview, begin: int, end: int, columns: int = 1, wide: bool = False, skip: int = 4) -> np.ndarray:
    """The counted rows of a full box; `skip` bytes stand before the count."""
    if end - begin < skip + 4:
        raise BadMedia("truncated table")
    n, width = struct.unpack_from(">I", data, begin + skip)[0], 8 if wide else 4
    if n * columns * width > end - begin - skip - 4:
        raise BadMedia(f"table of {n} rows passes its box's end")
    return np.frombuffer(data, f">u{width}", n * columns, begin + skip + 4).astype(np.int64).reshape(n, columns)


def sample_ranges(sizes: np.ndarray, chunk_at: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Where each sample begins, from its size and the chunks that the runs deal samples to."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or not len(chunk_at) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise BadMedia("samples without well-formed chunks")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.minimum(np.append(runs[:, 0], len(chunk_at) + 1), len(chunk_at) + 1)))
    if per_chunk.sum() < len(sizes):
        raise BadMedia("fewer places in chunks than samples")
    ends = np.cumsum(per_chunk)
    chunk = np.searchsorted(ends, np.arange(len(sizes)), side="right")
    before = np.cumsum(sizes) - sizes
    return chunk_at[chunk] + before - before[(ends - per_chunk)[chunk]]


def joined(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, neighbours joined."""
    out: list[tuple[int, int]] = []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], a + n)
        else:
            out.append((a, a + n))
    return out


def read_track(data: memoryview, held: dict[bytes, tuple[int, int]], number: int) -> dict:
    def need(kind: bytes) -> tuple[int, int]:
        if kind not in held:
            raise BadMedia(f"track without {kind.decode('latin-1')}")
        return held[kind]

    a, b = need(b"mdhd")
    layout, at = (">II", a + 12) if data[a] == 0 else (">IQ", a + 20)
    if at + struct.calcsize(layout) > b:
        raise BadMedia("truncated mdhd")
    scale, ticks = struct.unpack_from(layout, data, at)
    a, b = need(b"stsd")
    if b - a < 16:
        raise BadMedia("empty stsd")
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
    a, b = held.get(b"hdlr", (0, 0))
    kind = bytes(data[a + 8 : a + 12]).decode("latin-1") if b - a >= 12 else ""
    a, b = need(b"stsz")
    if b - a < 12:
        raise BadMedia("truncated stsz")
    size, n = struct.unpack_from(">II", data, a + 4)
    if size:
        if n * size > len(data):
            raise BadMedia("samples larger than the file")
        sizes = np.full(n, size, np.int64)
    else:
        sizes = numbers(data, a, b, skip=8)[:, 0]
    chunk_at = numbers(data, *held[b"co64"], wide=True)[:, 0] if b"co64" in held else numbers(data, *need(b"stco"))[:, 0]
    starts = sample_ranges(sizes, chunk_at, numbers(data, *need(b"stsc"), columns=3))
    if len(starts) and (starts + sizes).max() > len(data):
        raise BadMedia("a sample passes the file's end")
    if b"stts" in held and not ticks:
        ticks = int(numbers(data, *held[b"stts"], columns=2).prod(axis=1).sum())
    sync = np.arange(len(sizes))
    if b"stss" in held:
        sync = numbers(data, *held[b"stss"])[:, 0] - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
            raise BadMedia("a sync sample that isn't there")
    return {"track": number, "codec": codec, "kind": kind, "timescale": scale, "duration": ticks / scale if scale else 0.0, "samples": len(sizes), "payload_bytes": int(sizes.sum()), "keyframes": joined(starts[sync], sizes[sync]), "ranges": joined(starts, sizes)}


def read_media(raw: bytes | None) -> tuple[list[dict], str | None]:
    """The tracks, and what is wrong."""
    if not raw:
        return [], "no bytes"
    data = memoryview(raw)
    try:
        tracks: list[dict[bytes, tuple[int, int]]] = []
        seen = False
        for path, a, b in tree(data, 0, len(data)):
            seen |= path == (b"moov",)
            if path == (b"moov", b"trak"):
                tracks.append({})
            elif path[:2] == (b"moov", b"trak") and tracks:
                tracks[-1].setdefault(path[-1], (a, b))
        if not seen:
            raise BadMedia("no moov")
        return [read_track(data, held, i) for i, held in enumerate(tracks, 1)], None
    except (BadMedia, struct.error) as e:
        return [], str(e)


def box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def store_payload(payload: bytes) -> bytes:
    """A file with the payload (a positive multiple of FRAME bytes) as 8-bit samples."""
    n = len(payload) // FRAME
    chunks, rest = -(-n // CHUNK_FRAMES), n % CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] * (n >= CHUNK_FRAMES) + [(chunks, rest, 1)] * bool(rest)
    sync = np.arange(1, n + 1, SYNC_EVERY, dtype=">u4")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", struct.pack(">6xH8x2H4xI", 1, 1, 8, RATE << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME
        wide = len(payload) >= (1 << 32) - (1 << 24)
        offsets = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, n, FRAME)),
            full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">3I", *r) for r in runs)),
            full(b"stsz", struct.pack(">2I", FRAME, n)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", bytes([0, 0, 0, 1])))), stbl)
        long = len(payload) >= 1 << 32
        times = struct.pack(">QQIQ" if long else ">4I", 0, 0, RATE, len(payload))
        mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=int(long)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, min(len(payload), (1 << 32) - 1), 0, 0, 256, 0), matrix, bytes(8))
        mvhd = full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, min(len(payload), (1 << 32) - 1), 1 << 16, 256), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return ftyp + moov(len(ftyp) + len(moov(0)) + len(head)) + head + payload


def read_payload(media: bytes, track: dict) -> bytes:
    return b"".join(media[a:b] for a, b in track["ranges"])


def feature(track: dict) -> str:
    """Codec, duration and keyframe byte ranges as one text."""
    return json.dumps({k: track[k] for k in ("codec", "kind", "timescale", "duration", "samples", "keyframes")}, separators=(",", ":"))


def media_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with two more columns, media_tracks and media_error; the bytes column goes."""
    kept = [c for c in files.columns if c not in (content, "media_tracks", "media_error")]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_media(None if x is None else bytes(x)) for x in batch[content]]
            out = batch[kept].copy()
            out["media_tracks"] = [[{k: [{"start": a, "end": b} for a, b in v] if k == "keyframes" else v for k, v in t.items() if k != "ranges"} for t in tracks] for tracks, _ in read]
            out["media_error"] = [e for _, e in read]
            yield out

    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept), f"media_tracks array<{TRACK}>", "media_error string"])
    return files.select(*(F.col(f"`{c}`") for c in [*kept, content])).mapInPandas(describe, schema)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every whole text (null: empty) as samples, reads the file back and describes it."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "text")):
            rows = []
            for text in part.column("text").to_pylist():
                raw = (text or "").encode()
                media = store_payload(raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b"\0"))
                tracks, error = read_media(media)
                if error:
                    raise BadMedia(error)
                back = read_payload(media, tracks[0])
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(tracks[0])))
            names, kinds = zip(*(c.split() for c in STORED.split(", ")), strict=True)
            columns = [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(through, STORED)
