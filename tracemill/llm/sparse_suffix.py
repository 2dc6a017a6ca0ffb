"""Repeated passages found with a sparse suffix array over words.

A text is its sequence of words. Suffixes are kept only at minimiser positions: of every
LEAST - SEED + 1 neighbouring SEED-word grams the one with the least hash, the first of equals. A
passage of LEAST or more words that occurs twice holds such a gram at the same place both times.
Suffixes whose gram occurs once end there. The others carry the words to the right of the gram and
the windows of LEAST words around it that have it as their least gram, as far as any of them
reaches; equal surroundings meet in one entry with a count, by partial aggregation, so that copies in
any number are one entry. The entries are sorted as suffixes over all tasks and compared with their
neighbours: in a sorted list the longest match to the right of any other entry is that of a
neighbour, which bounds how far a match can reach. The windows within that bound, extended to the
left and right, meet the windows of other entries; each window belongs to its own least gram, so it
is looked at once. Of the places of a window the least (doc_id, position) stays. A word goes if a
window over it has an earlier place; that place is strictly earlier, so one copy of every word is left.

What decides that two windows are equal is 128 bits: a 64-bit hash of the gram and another of the
whole window, both of the words' 64-bit XXH3. Among 10^12 unlike windows the chance of any false match
is below 10^-14; of two windows that differ in a single word it is 2^-63. The sort only prunes. A row is
named by 128 bits of its doc_id and text (KEY). Which place of a window is the first is carried as a hash;
were another place of the same window to have it too, that place would only stay.

A text with fewer than LEAST words has no passage. Nulls: a null text is an empty one. Rows with the
same doc_id and text count as one row with one decision; a null doc_id is the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tracemill.llm.shared import discard, free_name, partitions, written
from tracemill.llm.text_blocks import blocks
from tracemill.llm.worker_cache import release

LEAST = 50
SEED = 25
SIDE = LEAST - SEED  # words of a window on the sides of its gram
BASE = 0x9E3779B97F4A7C15
KEY = ["dk", "dk2"]
ROWS, BYTES = 256, 2 << 20  # texts at once


def word_codes(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray, factor: int, shift: int) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= np.uint64(factor)
    return x ^ x >> np.uint64(shift)


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """The polynomial of every n neighbouring codes, put together of those of powers of two."""
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    out, size, part, k = np.zeros(len(codes) + 1, np.uint64), 0, codes, 1
    while True:
        if n & k:
            length = max(len(codes) - size - k + 1, 0)
            out, size = out[:length] * power(k) + part[size : size + length], size + k
        if 2 * k > n:
            return out
        length = max(len(part) - k, 0)
        part, k = part[:length] * power(k) + part[k:], 2 * k


def hashes_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every SEED-word gram and of every window of LEAST words."""
    grams = _rolled(codes, SEED)
    length = max(len(codes) - LEAST + 1, 0)
    windows = grams[:length] * np.uint64(pow(BASE, SIDE, 1 << 64)) + grams[SEED : SEED + length]
    return _mixed(grams, 0xFF51AFD7ED558CCD, 29), _mixed(windows, 0xC4CEB9FE1A85EC53, 31)


def owners(hashes: np.ndarray) -> np.ndarray:
    """For every window of LEAST words the position of its least gram; this never falls."""
    width = LEAST - SEED + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, len(hashes) - width + 1, 1 << 16):
        windows = sliding_window_view(hashes[at : at + (1 << 16) + width - 1], width)
        found.append(at + np.arange(len(windows)) + windows.argmin(axis=1))
    return np.concatenate(found)


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least gram of every window of LEAST words."""
    return np.unique(owners(hashes))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for part in blocks(batches, "text", ROWS, BYTES):
        n, pos, grams = [], [], []
        for raw in part.column("text").cast(pa.binary()).to_pylist():
            codes = word_codes(raw or b"")
            hashes = _mixed(_rolled(codes, SEED), 0xFF51AFD7ED558CCD, 29)
            own = minimisers(hashes)
            n.append(len(codes))
            pos.append(own.astype(np.int32))
            grams.append(hashes[own].view(np.int64))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *KEY)), pa.array(n, pa.int32()), pa.array(pos, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", *KEY, "n_words", "pos", "gram"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and KEY, 128 bits of both that name the row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(h.alias(k) for h, k in zip(row_key(F.col("doc_id"), text), KEY, strict=True)))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes of a row that differ in where they start."""
    return [F.xxhash64(doc_id.cast("long"), text), F.xxhash64(F.lit("row"), text, doc_id.cast("long"))]


def suffixes(rows: DataFrame) -> DataFrame:
    """One row a document: its minimiser positions and grams, as a table."""
    return written(rows.mapInArrow(_anchored, "doc_id long, dk long, dk2 long, n_words int, pos array<int>, gram array<long>"), "suffixes")


SURROUNDED = "doc_id long, dk long, dk2 long, pos int, gram long, least int, right binary, windows array<long>"


def _surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shared gram of a text with the windows that it is the least gram of. A window begins low
    words before its gram; windows[0] is that of low = least, the following begin farther left."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    for part in blocks(batches, "text", ROWS // 4, BYTES):
        out = []
        for doc_id, dk, dk2, raw, pos in zip(*(part.column(c).to_pylist() for c in ("doc_id", *KEY)), part.column("text").cast(pa.binary()).to_pylist(), part.column("pos").to_pylist(), strict=True):
            codes = word_codes(raw or b"")
            grams, windows = hashes_of(codes)
            flat = codes.astype(">u4").tobytes()
            owner, pos = owners(grams), np.array(pos)
            begin, end = np.searchsorted(owner, pos, "left"), np.searchsorted(owner, pos, "right")
            least, own = (pos + 1 - end).tolist(), grams[pos].view(np.int64).tolist()
            backward = windows[::-1].view(np.int64)
            for p, a, b, low, gram in zip(pos.tolist(), (len(windows) - end).tolist(), (len(windows) - begin).tolist(), least, own, strict=True):
                out.append((doc_id, dk, dk2, p, gram, low, flat[4 * (p + SEED) : 4 * (p + SEED + SIDE - low)], backward[a:b]))
        yield _batch(out, kinds, SURROUNDED)


def _alike(x: bytes, y: bytes) -> int:
    """Words that two sides have alike from their beginning."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // 4
    low = 0
    while x[low : low + 4] == y[low : low + 4]:
        low += 4
    return low // 4


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])


WINDOW = "gram long, window long, entry long, low int, n int, doc_id long, dk long, pos int"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of sorted entries that can occur again, by the bound of the neighbours' matches.

    The first and the last entry of a task have a neighbour in another task, so nothing bounds them.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = ["gram", "right", "windows", "entry", "least", "n", "doc_id", "dk", "pos"]

    def reaching(e: tuple, bound: int) -> list[tuple]:
        gram, _, windows, entry, least, n, *place = e
        n = min(n, 2)  # once, or more often
        first = 0 if n > 1 else max(0, SIDE - bound - least)
        return [(gram, w, entry, least + i, n, *place) for i, w in enumerate(windows[first:], first)]

    last, bound = None, SIDE
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            out = []
            for e in zip(*(batch.column(c).slice(at, 1024).to_pylist() for c in names), strict=True):
                if last is not None:
                    alike = _alike(last[1], e[1]) if last[0] == e[0] else -1
                    if max(bound, alike) >= 0 or last[5] > 1:
                        out += reaching(last, max(bound, alike))
                    bound = alike
                last = e
            yield _batch(out, kinds, WINDOW)
    if last is not None:
        yield _batch(reaching(last, SIDE), kinds, WINDOW)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lengths, candidate texts, repeats): lengths has n_words, repeats has KEY and spans, structs (pos, every, stays). Bit low
    of every is set if the window that begins low words before pos occurs more than once, and of stays
    if this is its first place."""
    rows = keyed(docs)
    own = suffixes(rows)
    each = own.select(*KEY, F.explode(F.arrays_zip("pos", "gram")).alias("a")).select(*KEY, F.col("a.pos").alias("pos"), F.col("a.gram").alias("gram"))
    # What is met below is written first: a join of two plain tables can be split where a key is hot.
    shared = written(own.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "shared-grams")
    positions = each.join(shared.hint("merge"), "gram").groupBy(*KEY).agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    texts = written(rows.join(positions.hint("merge"), KEY), "candidate-texts")  # one plan at every size
    # What is not needed any more goes at once: disk is what this operator is shortest of.
    lengths = written(own.select("doc_id", *KEY, "n_words"), "lengths")
    discard(own)
    around = written(texts.mapInArrow(_surrounded, SURROUNDED).select("*", F.xxhash64("right", "windows").alias("entry")), "surroundings")
    discard(shared)
    order = ["gram", "right", "entry"]
    entries = around.groupBy(*order, "windows", "least").agg(F.min(F.struct("doc_id", "dk", "pos")).alias("place"), F.count(F.lit(1)).alias("n"))
    entries = entries.select(*order, "windows", "least", "n", "place.*").repartitionByRange(partitions(docs.sparkSession), *order)
    windows = written(entries.sortWithinPartitions(*order).mapInArrow(_neighbours, WINDOW), "windows")
    places = written(around.select("gram", "entry", "doc_id", *KEY, "pos"), "places")
    discard(around)
    again = windows.groupBy("gram", "window").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "dk", "pos")).alias("s")).filter("n > 1").select("gram", "window", F.xxhash64("s.doc_id", "s.dk", "s.pos").alias("stays"))
    again = written(again, "windows-again")
    met = windows.select("gram", "window", "entry", "low").join(again.hint("merge"), ["gram", "window"])
    matched = written(met.groupBy("gram", "entry").agg(F.collect_list(F.struct("low", "stays")).alias("reach")), "reach")  # SIDE + 1 at most
    discard(windows)
    discard(again)
    at = places.select("gram", "entry", *KEY, "pos", F.xxhash64("doc_id", "dk", "pos").alias("place")).join(matched.hint("merge"), ["gram", "entry"])
    bits = lambda f: F.aggregate("reach", F.lit(0), lambda acc, m: acc.bitwiseOR(F.when(f(m), F.call_function("shiftleft", F.lit(1), m["low"])).otherwise(0)))
    spans = F.struct("pos", bits(lambda m: F.lit(True)).alias("every"), bits(lambda m: F.col("place") == m["stays"]).alias("stays"))
    found = at.select(*KEY, spans.alias("spans")).groupBy(*KEY).agg(F.collect_list("spans").alias("spans"))
    found = written(found, "repeats")
    discard(places)
    discard(matched)
    return lengths, texts, found


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """pos, every and stays of each row of a spans column."""
    cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    pos, every, stays = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield pos[a:b], every[a:b], stays[a:b]


def in_bytes(places: tuple[np.ndarray, np.ndarray], pos: np.ndarray, which: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Byte ranges under the windows whose bits are set in which, joined where they touch or overlap, and
    the number of their words. places: as of word_places."""
    low = np.arange(SIDE + 1)
    firsts = np.sort((pos[:, None] - low)[(which[:, None] >> low & 1).astype(bool)])
    if not len(firsts):
        return [], 0
    breaks = np.flatnonzero(firsts[1:] > firsts[:-1] + LEAST)
    begin, end = firsts[np.append(0, breaks + 1)], firsts[np.append(breaks, len(firsts) - 1)] + LEAST
    return list(zip(places[0][begin].tolist(), places[1][end - 1].tolist(), strict=True)), int((end - begin).sum())


def in_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Byte ranges as structs in code points."""
    if raw.isascii():
        return [{"start": a, "end": b} for a, b in ranges]
    before = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
    return [{"start": int(before[a]), "end": int(before[b])} for a, b in ranges]


SPANNED = "dk long, dk2 long, n_repeated_words int, spans array<struct<start:int,end:int>>, dropped array<struct<start:int,end:int>>"


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for part in blocks(batches, "text", ROWS, BYTES):
        every, gone, n_words = [], [], []
        for raw, (pos, repeated, stays) in zip(part.column("text").cast(pa.binary()).to_pylist(), spans_of(part.column("spans")), strict=True):
            raw = raw or b""
            places = word_places(raw)
            found, n = in_bytes(places, pos, repeated)
            every.append(in_characters(raw, found))
            gone.append(in_characters(raw, in_bytes(places, pos, repeated & ~stays)[0]))
            n_words.append(n)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.array(n_words, pa.int32()), pa.array(every, ranges), pa.array(gone, ranges)], names=[*KEY, "n_repeated_words", "spans", "dropped"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated_words, spans and dropped (structs start, end) for every row of docs."""
    lengths, texts, found = repeats(docs)
    spanned = texts.select(*KEY, "text").dropDuplicates(KEY).join(found, KEY).mapInArrow(_spanned, SPANNED)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return lengths.join(spanned, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_repeated_words", F.lit(0)).alias("n_repeated_words"), F.coalesce("spans", empty).alias("spans"), F.coalesce("dropped", empty).alias("dropped")
    )


def _cut(batches: Iterator[pa.RecordBatch], spans_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        raws = batch.column(k).cast(pa.binary()).to_pylist()
        for i, (raw, (pos, every, stays)) in enumerate(zip(raws, spans_of(batch.column(spans_name)), strict=True)):
            if len(pos):
                parts, at = [], 0
                for a, b in in_bytes(word_places(raw or b""), pos, every & ~stays)[0]:
                    parts.append(raw[at:a])
                    at = b
                raws[i] = b"".join([*parts, raw[at:]]) if at else raw
        out = batch.set_column(k, batch.schema.field(k), pa.array(raws, pa.binary()).cast(batch.schema.field(k).type))
        yield out.remove_column(out.schema.get_field_index(spans_name))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut but for its first place; rows with no word left go.

    docs needs doc_id and text; its other columns stay as they are.
    """
    key, spans = [free_name(docs, k) for k in KEY], free_name(docs, "repeat_spans")
    lengths, texts, found = repeats(docs)
    discard(lengths)
    discard(texts)
    cut = found.filter(F.exists("spans", lambda s: s["every"] != s["stays"])).select(*(F.col(k).alias(own_) for k, own_ in zip(KEY, key, strict=True)), F.col("spans").alias(spans))
    text = F.col("text").cast("string")
    rows = docs.withColumn("text", text).withColumns(dict(zip(key, row_key(F.col("doc_id"), text), strict=True)))
    joined = rows.join(cut.hint("merge"), key, "left").drop(*key)  # one plan at every size
    schema = T.StructType([f for f in joined.schema if f.name != spans])
    had_words = joined.mapInArrow(lambda it: _cut(it, spans), schema)
    return had_words.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
