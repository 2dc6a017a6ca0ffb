"""Token ids as seekable zstandard files.

One file holds the documents of one range of doc_id, in ascending order:

* independent zstandard frames, each with its content checksum; a document is one frame, or several
  of at most FRAME_IDS ids; ids are little-endian, 16 bits wide where the vocabulary allows it and
  32 bits otherwise;
* a skippable frame with the document index (doc_id, whether it is null, number of frames);
* the seek table of the public seekable format: a skippable frame with compressed size, content
  size and the low 32 bits of the content's XXH64 for every data frame, and a footer.

A reader takes footer, seek table and index, and decompresses only the frames it wants.

Nulls: a null text is an empty one (it has the end id alone); a null doc_id sorts first. Rows that
share a doc_id each keep their own entry, ordered by their ids' checksum. An empty table gives no
file and no row.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.shared import partitions, shared_dir

FRAME_IDS = 1 << 20
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E  # fixed by the seekable format, like the footer's magic number
SEEK_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_frames", "<u4")])
ENTRY = np.dtype([("stored", "<u4"), ("content", "<u4"), ("checksum", "<u4")])
READ_ROWS, READ_BYTES = 1024, 4 << 20  # documents and stored bytes read at once

ENCODED = "doc_id long, order_key long, shard int, width int, frames array<binary>, contents array<int>, checksums array<long>"
MANIFEST = "shard int, path string, width int, n_docs long, n_tokens long"


def _encode(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, level: int, bounds: list[float]) -> Iterator[pa.RecordBatch]:
    import xxhash
    import zstandard

    from tracemill.llm.text_blocks import blocks
    from tracemill.llm.token_units import encoder

    enc = encoder(tokenizer_path)
    width = 2 if max(enc.vocabulary(), end_id + 1) <= 1 << 16 else 4
    squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
    schema = pa.schema([("doc_id", pa.int64()), ("order_key", pa.int64()), ("shard", pa.int32()), ("width", pa.int32()), ("frames", pa.list_(pa.binary())), ("contents", pa.list_(pa.int32())), ("checksums", pa.list_(pa.int64()))])
    end = struct.pack("<I", end_id)
    for part in blocks(batches, 1):
        rows = []
        for doc_id, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
            raw += end
            ids = np.frombuffer(raw, "<u4").astype(f"<u{width}")
            frames = [ids[i : i + FRAME_IDS].tobytes() for i in range(0, len(ids), FRAME_IDS)]
            rows.append((
                doc_id, zlib.crc32(raw), 0 if doc_id is None else bisect_left(bounds, doc_id), width,
                [squeeze(b) for b in frames], [len(b) for b in frames], [xxhash.xxh64_intdigest(b) & 0xFFFFFFFF for b in frames],
            ))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _write(batches: Iterator[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    """One partition's documents, which are one shard, as one file that appears when it is whole."""
    from pyspark import TaskContext

    out = path = None
    index, seek = [], []
    shard = width = n_tokens = 0
    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                shard, width = row["shard"], row["width"]
                store, folder = pafs.FileSystem.from_uri(out_dir)
                path = f"{folder}/shard-{shard:06d}.zst"
                part = f"{folder}/.shard-{shard:06d}.{TaskContext.get().taskAttemptId()}"
                out = store.open_output_stream(part)
            for frame, content, checksum in zip(row["frames"], row["contents"], row["checksums"], strict=True):
                out.write(frame)
                seek.append((len(frame), content, checksum))
                n_tokens += content // width
            index.append((row["doc_id"] or 0, row["doc_id"] is None, len(row["frames"])))
    if out is None:
        return
    docs = np.array(index, INDEX).tobytes()
    out.write(struct.pack("<II", SKIPPABLE_INDEX, len(docs)) + docs)
    table = np.array(seek, ENTRY).tobytes() + struct.pack("<IBI", len(seek), HAS_CHECKSUMS, SEEK_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
    out.close()
    store.move(part, path)
    uri = f"{out_dir}/shard-{shard:06d}.zst"
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "width": pa.array([width], pa.int32()), "n_docs": pa.array([len(index)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})


def write_token_frames(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_dir: str | None = None, level: int = 1, shards: int | None = None) -> DataFrame:
    """Encode docs(doc_id, text), write the files and return their manifest, one row a file.

    Ranges of doc_id come from approximate quantiles over all rows, so no shard depends on how ids
    are spread. What is shuffled is the compressed frames, not the texts.
    """
    spark = docs.sparkSession
    n = shards or partitions(spark)
    out_dir = out_dir or shared_dir(spark, "token-frames")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = sorted(set(rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    store, folder = pafs.FileSystem.from_uri(out_dir)
    store.create_dir(folder, recursive=True)
    encoded = rows.mapInArrow(lambda it: _encode(it, tokenizer_path, end_id, level, bounds), ENCODED)
    placed = encoded.repartitionById(n, F.col("shard")).sortWithinPartitions("doc_id", "order_key")
    placed.mapInArrow(lambda it: _write(it, out_dir), MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


class FrameFile:
    """One file: its index and seek table in memory, frames read on demand."""

    def __init__(self, path: str, width: int):
        import xxhash
        import zstandard

        store, name = pafs.FileSystem.from_uri(path)
        self.file, self.width = store.open_input_file(name), width
        self.expand, self.digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh64_intdigest
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        self.seek = np.frombuffer(self._at(size - 9 - n * ENTRY.itemsize, n * ENTRY.itemsize), ENTRY)
        self.begins = np.concatenate([[0], np.cumsum(self.seek["stored"], dtype=np.int64)])
        _, length = struct.unpack("<II", self._at(int(self.begins[-1]), 8))
        self.index = np.frombuffer(self._at(int(self.begins[-1]) + 8, length), INDEX)
        self.first = np.concatenate([[0], np.cumsum(self.index["n_frames"], dtype=np.int64)])

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, k: int, stored: bytes | None = None) -> bytes:
        """The k-th frame's content, checked against the seek table."""
        data = self.expand(stored if stored is not None else self._at(int(self.begins[k]), int(self.seek["stored"][k])))
        if len(data) != self.seek["content"][k] or self.digest(data) & 0xFFFFFFFF != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, d: int) -> bytes:
        """Ids of the d-th document as little-endian unsigned 32-bit integers."""
        return self.run(d, d + 1)[0]

    def run(self, first: int, last: int) -> list[bytes]:
        """Ids of the documents from first to before last, whose frames are read at once."""
        bounds = self.first[first : last + 1].tolist()
        begins = self.begins[bounds[0] : bounds[-1] + 1].tolist()
        span, out = self._at(begins[0], begins[-1] - begins[0]), []
        for a, b in zip(bounds, bounds[1:], strict=False):
            raw = b"".join([self.frame(k, span[begins[k - bounds[0]] - begins[0] : begins[k - bounds[0] + 1] - begins[0]]) for k in range(a, b)])
            out.append(raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
        return out

    def runs(self) -> Iterator[tuple[int, int]]:
        """All documents in runs of bounded size."""
        at, begins = 0, self.begins[self.first]
        while at < len(self.index):
            stop = int(np.searchsorted(begins, begins[at] + READ_BYTES, "right")) - 1
            stop = min(max(stop, at + 1), at + READ_ROWS, len(self.index))
            yield at, stop
            at = stop

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document by binary search in the index."""
        nulls = int(self.index["is_null"].sum())
        own = self.index["doc_id"][nulls:]
        return list(range(nulls + int(np.searchsorted(own, doc_id, "left")), nulls + int(np.searchsorted(own, doc_id, "right"))))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = FrameFile(row["path"], row["width"])
            start = row["start"]
            for at, stop in file.runs():
                part, ids = file.index[at:stop], file.run(at, stop)
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.concatenate([[0], np.cumsum(counts)])
                start = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["doc_id"].astype(np.int64), mask=part["is_null"].astype(bool)), pa.array(starts[:-1]), pa.array(counts), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def read_token_frames(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    The window runs over the manifest alone, which has one row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = files.repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def fetch_documents(manifest: DataFrame, spark: SparkSession, doc_ids: list[int]) -> DataFrame:
    """Only the documents asked for (a short list of ids): their frames are all that is decompressed."""
    wanted = sorted(set(doc_ids))

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = FrameFile(row["path"], row["width"])
                found = [(d, file.ids(k)) for d in wanted for k in file.find(d)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "ids"])

    return manifest.repartition(partitions(spark)).mapInArrow(pick, "doc_id long, ids binary")
