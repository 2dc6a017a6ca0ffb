"""Packing documents into token sequences of a fixed length by minimum bin slack.

Only lengths matter for the packing, and there are at most as many lengths as tokens in a sequence.
So the search works on the histogram of lengths, whose size is bounded by the sequence length
whatever the corpus: per bin, the longest remaining piece is placed and a bitset subset-sum over the
available lengths finds the fullest feasible combination for the rest, which is removed as often as
the counts allow. Every such step uses up a length, so the number of distinct patterns stays near
the number of lengths. Spark then numbers the pieces of each length and looks their bin up.

Nulls: a null text is an empty one, whose only token is the end id. Repeated doc_ids, null doc_ids
and ties are separate pieces like any other. Documents longer than a sequence are cut into full
pieces, the first piece taking the remainder.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.shared import written

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, k long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document; k numbers the pieces of one length within the task."""
    from pyspark import TaskContext

    from tracemill.llm.text_blocks import blocks
    from tracemill.llm.token_units import encoder

    enc, end = encoder(tokenizer_path), struct.pack("<I", end_id)
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "part", "k"]
    for rows in blocks(batches, 1):
        out = []
        for doc_id, raw in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1)), strict=True):
            raw += end
            n = len(raw) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append((doc_id, piece, a, b - a, raw[4 * a : 4 * b], part, int(seen[b - a])))
                seen[b - a] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths with the largest sum up to room, by bitset subset sums.

    reach[i] has bit s set if the first i items can sum to s; going back over it gives the items.
    Multiples of a length are taken as items of doubling size.
    """
    mask = (1 << (room + 1)) - 1
    items, reach = [], [1]
    for length in lengths:
        left, take = min(counts[length], room // length), 1
        while left > 0:
            times = min(take, left)
            items.append((length, times))
            reach.append((reach[-1] | reach[-1] << (length * times)) & mask)
            left -= times
            take *= 2
        if reach[-1] >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    chosen: list[int] = []
    for i in range(len(items), 0, -1):
        if not reach[i - 1] >> best & 1:
            length, times = items[i - 1]
            chosen += [length] * times
            best -= length * times
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one bin, how many bins get them), which together hold every piece once."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = fullest(sorted((x for x in counts if counts[x] > 0), reverse=True), counts, capacity - longest)
        counts[longest] += 1
        bin_ = [longest, *rest]
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(counts[x] // c for x, c in need.items())
        for x, c in need.items():
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]
        out.append((bin_, times))
    return out


def places(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """One row a pattern and length in it: (length, low, last, times, first, at).

    Pieces of the length numbered low to before last go into the bins numbered first to before
    first + times, one after another from offset at on. After every pattern some length has fewer
    pieces left than one bin can hold of it, so there are at most capacity x (1 + ln capacity)
    patterns of at most sqrt(2 capacity) lengths each, whatever the number of pieces.
    """
    out, used, first = [], {}, 0
    for bin_, times in found:
        at = 0
        for length, n in sorted(Counter(bin_).items(), reverse=True):
            low = used.get(length, 0)
            used[length] = low + n * times
            out.append((length, low, used[length], times, first, at))
            at += n * length
        first += times
    return out


def cut_and_encode(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of docs(doc_id, text) as a table in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(lambda it: _pieces(it, tokenizer_path, end_id, capacity), PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; sequences are gapless from offset 0.

    A full piece is a sequence of its own, numbered from its task. For the rest, the number of a
    piece within its length is its number within its task plus the counts of the tasks before.
    """
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") == capacity)
    short = pieces.filter(F.col("length") < capacity)
    counts = written(short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most capacity - 1 rows come to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots = places(patterns(histogram, capacity))
    slot_table = spark.createDataFrame(slots, "length int, low long, last long, times long, first long, at long")
    by_length = slot_table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "last", "times", "first", "at"))).alias("slots"))

    ranked = short.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    found = ranked.join(F.broadcast(by_length), "length")  # bounded by the capacity alone, see places
    slot = F.element_at(F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["last"])), 1)
    placed = found.withColumn("slot", slot).withColumn("number", F.col("rank") - F.col("slot.low"))
    columns = [c for c in pieces.columns if c not in ("part", "k")]
    return placed.select(
        *columns,
        (F.col("slot.first") + F.col("number") % F.col("slot.times")).alias("sequence_id"),
        F.expr("slot.at + (number div slot.times) * length").alias("offset"),
    ).unionByName(
        full.select(*columns, (F.shiftleft(F.col("part").cast("long") + 1, 40) + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
