"""ISO base media files in a binary column: writing raw samples, walking boxes, sample tables.

``probe`` reads nested boxes and decodes the sample tables (stts, stss, stsc, stsz or stz2, stco or
co64) of the first track that has a sample description; tables of other tracks are not mixed in.
Fragmented files, whose samples are in moof boxes, are named in ``problem``. It gives codec, duration and the byte range of every keyframe and never touches
the sample data. ``wrap`` stores bytes losslessly as raw 8x8 frames of 8-bit grey samples.

Nulls: a null text is an empty one, whose payload is one frame of zeros; null and repeated ids are
rows like any other. Bytes that are no readable container have null features and say why in
``problem``; they never fail the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.text_blocks import blocks

UNIT = 64  # bytes of a frame: 8 x 8 grey samples of 8 bits
FRAMES_PER_SECOND = 25
KEY_EVERY = 16
FRAMES_PER_CHUNK = 128
STEP = 256
DEEPEST = 64  # boxes within boxes
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A file whose samples are the payload, a multiple of UNIT bytes, unchanged and in order."""
    n = len(payload) // UNIT
    chunks = -(-n // FRAMES_PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, FRAMES_PER_CHUNK)] if n % FRAMES_PER_CHUNK == 0 else ([(1, FRAMES_PER_CHUNK)] if chunks > 1 else []) + [(chunks, n % FRAMES_PER_CHUNK)]
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAMES_PER_CHUNK * UNIT)
        tables = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FRAMES_PER_SECOND, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7), media)
        movie = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, FRAMES_PER_SECOND, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, track)

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    size = 8 + len(payload)
    data_head = struct.pack(">I", size) + b"mdat" if size < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 8)
    length = len(moov(0)) if len(payload) < 1 << 31 else len(moov(1 << 32))
    return head + moov(len(head) + length + len(data_head)) + data_head + payload


def walk(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(path of kinds, begin and end of the body) of every box between begin and end, outer first."""
    open_ = [(begin, end, b"")]
    while open_:
        begin, end, path = open_.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else begin + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {begin} does not fit")
        own = path + b"/" + kind
        yield own, body, stop
        open_.append((stop, end, path))
        if kind in CONTAINERS:
            if len(open_) > DEEPEST:
                raise ValueError(f"boxes nested deeper than {DEEPEST}")
            open_.append((body, stop, own))


def table(data: memoryview, at: tuple[int, int], columns: int, kind: str = ">u4") -> np.ndarray:
    begin, end = at
    (n,) = struct.unpack_from(">I", data, begin + 4)
    if begin + 8 + n * columns * np.dtype(kind).itemsize > end:
        raise ValueError(f"table of {n} entries in a box of {end - begin} bytes")
    return np.frombuffer(data, kind, n * columns, begin + 8).reshape(n, columns).astype(np.int64)


def sample_sizes(data: memoryview, at: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Sizes of a track's samples, from stsz or the compact stz2 of 4, 8 or 16 bits a sample.

    A count is believed if its entries fit the box, and a fixed size if so many samples fit the file.
    """
    begin, end = at[b"stsz"] if b"stsz" in at else at[b"stz2"]
    fixed, n = struct.unpack_from(">II", data, begin + 4)
    if b"stsz" in at and fixed:
        if n * fixed > len(data):
            raise ValueError(f"{n} samples of {fixed} bytes in a file of {len(data)}")
        return np.full(n, fixed, np.int64)
    bits = 32 if b"stsz" in at else fixed & 0xFF
    if begin + 12 + (n * bits + 7) // 8 > end:
        raise ValueError(f"sizes of {n} samples in a box of {end - begin} bytes")
    if bits == 4:
        both = np.frombuffer(data, np.uint8, (n + 1) // 2, begin + 12)
        return np.stack([both >> 4, both & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, {8: ">u1", 16: ">u2", 32: ">u4"}[bits], n, begin + 12).astype(np.int64)


def tracks(media: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """By track and kind of box where the body of the first box of this kind begins and ends."""
    found, end_of_track = [], 0
    for path, begin, end in walk(memoryview(media), 0, len(media)):
        kind = path.rpartition(b"/")[2]
        if kind == b"moof":
            raise ValueError("fragmented file")
        if kind == b"trak":
            found.append({})
            end_of_track = end
        elif found and begin < end_of_track:
            found[-1].setdefault(kind, (begin, end))
    return found


def probe(media: bytes) -> dict:
    """codec, timescale, duration (s), n_samples, keyframes and chunk ranges of the first described track."""
    data = memoryview(media)
    at = next((t for t in tracks(media) if b"stsd" in t), None)
    if at is None:
        raise ValueError("no sample description")
    described, header = at[b"stsd"][0], at[b"mdhd"][0]
    codec = bytes(data[described + 12 : described + 16]).decode("latin-1").strip()
    timescale = struct.unpack_from(">I", data, header + (20 if data[header] else 12))[0]
    sizes = sample_sizes(data, at)
    n = len(sizes)
    ticks = table(data, at[b"stts"], 2)
    chunks = table(data, at[b"co64"], 1, ">u8")[:, 0] if b"co64" in at else table(data, at[b"stco"], 1)[:, 0]
    runs = table(data, at[b"stsc"], 3)
    until = np.append(runs[1:, 0], len(chunks) + 1)
    if n and (not len(runs) or runs[0, 0] != 1 or (until < runs[:, 0]).any()):
        raise ValueError("runs of chunks are not in order")
    per_chunk = np.repeat(runs[:, 1], until - runs[:, 0]) if n else np.zeros(0, np.int64)
    first_of_chunk = np.cumsum(per_chunk) - per_chunk
    if n > int(per_chunk.sum()):
        raise ValueError(f"{n} samples in chunks of {int(per_chunk.sum())}")
    chunk_of = np.searchsorted(first_of_chunk, np.arange(n), "right") - 1
    before = np.cumsum(sizes) - sizes
    offsets = chunks[chunk_of] + before - before[np.minimum(first_of_chunk, max(n - 1, 0))][chunk_of] if n else before
    keys = table(data, at[b"stss"], 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
    if len(keys) and not 0 <= int(keys.min()) <= int(keys.max()) < n:
        raise ValueError("key sample that is none")
    return {
        "codec": codec, "timescale": timescale, "duration": float((ticks[:, 0] * ticks[:, 1]).sum()) / timescale, "n_samples": n,
        "keyframes": list(zip(offsets[keys].tolist(), sizes[keys].tolist(), strict=True)), "offsets": offsets, "sizes": sizes,
    }


def samples(media: bytes, found: dict) -> bytes:
    """The sample bytes in order, by the byte ranges of the sample tables."""
    offsets, sizes = found["offsets"], found["sizes"]
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cuts = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    begins = offsets[np.append(0, cuts)]
    stops = ends[np.append(cuts - 1, len(ends) - 1)]
    return b"".join(media[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, 1, STEP):
        texts = [(t or "").encode() for t in part.column(1).to_pylist()]
        media = [wrap(t + bytes(-len(t) % UNIT if t else UNIT)) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_bytes and media: the text's UTF-8 bytes as frames of a file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


PROBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, n_samples long, keyframes array<struct<offset:long,length:long>>, problem string"


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    for part in blocks(batches, 2, STEP):
        rows = []
        for media in part.column(2).to_pylist():
            media = media or b""
            base = (len(media), hashlib.sha256(media).hexdigest())
            try:
                f = probe(media)
                payload = samples(media, f)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *base, f["codec"], f["duration"], f["n_samples"], [{"offset": a, "length": b} for a, b in f["keyframes"]], None))
            except (ValueError, KeyError, IndexError, OverflowError, struct.error, ZeroDivisionError) as e:
                rows.append((None, None, None, *base, None, None, None, None, f"{type(e).__name__}: {e}"))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), ranges, pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=[x.split(" ")[0].strip() for x in PROBED.replace("struct<offset:long,length:long>", "x").split(", ")])


def probe_media(rows: DataFrame) -> DataFrame:
    """rows(doc_id, n_bytes, media) with what the containers say and digests of the samples read back."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(_probed, PROBED)
