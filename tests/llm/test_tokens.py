import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracemill.llm import packing, queries, token_frames
from tracemill.llm.text_blocks import blocks
from tracemill.llm.token_units import UnitEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a ", "a \n b", "don't  'll\t\x1c　x", "x<|endoftext|> y", "é 日本 語", "a" * 5000 + " b" * 3000]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)  # as it is: its added token is found in texts
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", " ", "  ", "\t", "\n", "\u3000", "\x1c", "a", "word", "Éa", "ж", "日", "½", "Ა", "1", ".", ",)", "'s", "_", "<|endoftext|>", "<|", "|>"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=8))
@settings(max_examples=300, deadline=None)
def test_units_equal_whole_texts(texts):
    own = test_units_equal_whole_texts.__dict__
    enc, plain = own.setdefault("enc", UnitEncoder(PATH, keep=5)), own.setdefault("plain", Tokenizer.from_file(PATH))
    for text, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_blocks_are_bounded():
    texts = pa.array([None, "", "a" * 50, "b" * 500, "c", *["d" * 9] * 40])
    found = list(blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", rows=7, most=60))
    assert [t for b in found for t in b.column(0).to_pylist()] == texts.to_pylist()
    assert all(b.num_rows == 1 or b.num_rows <= 7 and sum(len(t or "") for t in b.column(0).to_pylist()) <= 60 for b in found)


def expected(rows, plain):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain(text), 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_frames_of_documents(spark, sf_dir, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op1_token_frames(spark, sf_dir).collect()]
    assert sorted(got) == expected(rows, plain)


def test_frames_of_odd_rows(spark, plain, monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_IDS", 100)
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, shard string, frames int").repartition(3)
    manifest = token_frames.write_token_frames(docs, PATH, shards=3)
    got = token_frames.read_token_frames(manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((d is not None, d or 0, np.array([*plain(t), 2], "<u4").tobytes()) for d, t in rows)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == [sum(x.n_tokens for x in in_order[:i]) for i in range(len(in_order))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in in_order]
    assert keys == sorted(keys)
    one = token_frames.fetch_documents(manifest, spark, [4, 99]).collect()
    assert sorted(bytes(r.ids) for r in one) == sorted(np.array([*plain(t), 2], "<u4").tobytes() for d, t in rows if d == 4)


def test_damage_is_seen(spark):
    manifest = token_frames.write_token_frames(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), PATH, shards=1)
    row = manifest.first()
    path = row.path.removeprefix("file:").replace("///", "/")
    data = bytearray(open(path, "rb").read())
    data[8] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        token_frames.FrameFile(row.path, row.width).ids(0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_frames.read_token_frames(token_frames.write_token_frames(docs, PATH)).count() == 0
    assert packing.pack(packing.cut_and_encode(docs, PATH)).count() == 0


def check_packing(rows, pieces, plain, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.start == 0 and p.piece == 0), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(zlib.crc32(np.array([*plain(t), 2], "<u4").tobytes()[: 4 * ((len(plain(t)) + 1) % capacity or capacity)]) for _, t in rows) == sorted(p.ids_crc32 for p in pieces if p.piece == 0)
    assert sum(p.length for p in pieces) == sum(len(plain(t)) + 1 for _, t in rows)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, sf_dir, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    pieces = queries.op6_min_slack_packing(spark, sf_dir).collect()
    n = check_packing(rows, pieces, plain, 1024)
    assert n <= -(-sum(p.length for p in pieces) // 1024) + 2
    for doc_id, text in rows:
        own = sorted((p.piece, p.start, p.length) for p in pieces if p.doc_id == doc_id)
        ids = len(plain(text)) + 1
        assert [x[0] for x in own] == list(range(len(own))) and sum(x[2] for x in own) == ids
        assert all(x[2] == 1024 for x in own[1:]) and own[0][1] == 0


def test_packing_odd_rows(spark, plain):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, k int").repartition(3)
    pieces = packing.pack(packing.cut_and_encode(docs, PATH, capacity=16), capacity=16)
    from pyspark.sql import functions as F

    check_packing(rows, pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), plain, 16)


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_every_piece(histogram):
    held = {}
    found = packing.patterns(histogram, 20)
    for bin_, times in found:
        assert sum(bin_) <= 20 and times > 0
        for x in bin_:
            held[x] = held.get(x, 0) + times
    assert held == histogram
    bins, numbers = {}, {}
    for length, low, last, times, first, at in packing.places(found):
        for rank in range(low, last):
            bins.setdefault(first + (rank - low) % times, []).append((at + (rank - low) // times * length, length))
            numbers.setdefault(length, []).append(rank)
    assert all(sorted(x) == list(range(histogram[k])) for k, x in numbers.items())
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=5), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_fullest_is_best(counts, room):
    got = packing.fullest(sorted(counts, reverse=True), counts, room)
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * i for s in sums for i in range(n + 1) if s + x * i <= room}
    assert sum(got) == max(sums) and all(got.count(x) <= counts.get(x, 0) for x in got)
