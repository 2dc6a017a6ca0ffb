"""Ranked lexical search by the Best Position Algorithm.

Documents become a forward index: for each its length in terms and, of the terms that some query asks
for, number and count. Statistics over all documents follow from it. A shard is as many documents of a
task as make up SHARD postings; in it every term has a list of postings by falling impact. A query reads
its lists side by side; each document it meets is scored at once by direct accesses, which mark the
places of all its postings. The best position of a list is the end of its seen beginning, whether those
places were read or marked; no unseen document can score above the sum of the impacts that stand after
the best positions. Reading ends when that sum is strictly below the k-th best score, so that no equal
score is missed. What the earlier shards of a task found counts for the later ones.

Shards give k documents for each query; those are merged in two rounds. Queries go by blocks of at most
BLOCK_TERMS terms, one pass over the index each; a task holds one block and one shard, no more.

Nulls and empty texts have no term and are never found; a null query text finds nothing. Documents of
equal score are ranked by doc_id, null first; repeated rows are ranked each. A query finds fewer than k
documents if fewer hold one of its terms. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.shared import written
from tracemill.llm.text_blocks import Words, blocks, texts_of

SHARD = 2_000_000
BLOCK_TERMS = 200_000
DEPTH = 64  # places read of each list at first

INDEX = "doc_id long, n_terms long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"

#: ASCII letters in lower case and digits stay, other ASCII characters end a term, the rest stays.
FOLD = np.array([c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array) -> Words:
    """The terms of each text; some words may be empty and are none."""
    texts = pc.cast(texts_of(texts), pa.large_string())
    texts = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts
    _, offsets, data = texts.buffers()
    data = np.frombuffer(data or b"", np.uint8)
    folded = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(FOLD[data]))
    return Words(pc.ascii_split_whitespace(folded))


def counted(words: Words, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of terms; then, by text, the number, the term and the count of those in the vocabulary."""
    n = len(words.bounds) - 1
    text = np.repeat(np.arange(n), np.diff(words.bounds))
    full = pc.greater(pc.binary_length(words.values), 0).to_numpy(zero_copy_only=False)[words.order] if len(words.values) else np.zeros(0, bool)
    lengths = np.bincount(text[full], minlength=n)
    number = pc.fill_null(pc.index_in(words.values, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    asked = number[words.order] if len(number) else np.zeros(0, np.int64)
    known = asked >= 0
    pairs, times = np.unique(text[known] * max(len(vocabulary), 1) + asked[known], return_counts=True)
    return lengths, pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1), times


def _index(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array(vocabulary, pa.large_string())
    for part in blocks(batches, 1):
        lengths, text, terms, times = counted(terms_of(part.column(1)), known)
        some = np.flatnonzero(lengths)
        at = pa.array(np.searchsorted(text, np.append(some, len(lengths))), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (terms, times)]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(lengths[some], pa.int64()), *lists], names=["doc_id", "n_terms", "terms", "counts"])


@dataclass
class Statistics:
    """Of all documents: how many have a term, how many terms they have, and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(statistics: Statistics, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of a document's score that each posting gives, in whole numbers."""
    longest = int(lengths.max(initial=0))
    wide = lengths.astype(object) if 75 * longest * statistics.documents >= 1 << 63 else lengths
    m = (25 + 75 * wide * statistics.documents // max(statistics.length, 1)).astype(np.int64)
    return statistics.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m))


class Shard:
    """Postings of some documents, by document for direct access and by term and falling impact for reading."""

    def __init__(self, doc_ids: list[int | None], bounds: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.doc_ids, self.bounds, self.terms, self.impact = doc_ids, bounds, terms, impact
        self.document = np.repeat(np.arange(len(doc_ids)), np.diff(bounds))
        self.by_list = np.lexsort((-impact, terms))  # postings as the lists have them
        self.place = np.empty_like(self.by_list)
        self.place[self.by_list] = np.arange(len(self.by_list))
        self.starts = np.searchsorted(terms[self.by_list], np.arange(n_terms + 1))
        self.seen = np.zeros(len(terms), bool)  # places of the lists
        self.scored = np.zeros(len(doc_ids), bool)
        self.times = np.zeros(n_terms, np.int64)  # how often the query asks for each term

    def direct(self, documents: np.ndarray) -> np.ndarray:
        """Scores of documents; marks the places of their postings as seen."""
        starts, sizes = self.bounds[documents], np.diff(self.bounds)[documents]
        ends = np.cumsum(sizes)
        own = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
        times = self.times[self.terms[own]]
        self.seen[self.place[own[times > 0]]] = True
        sums = np.concatenate([[0], np.cumsum(times * self.impact[own])])
        return sums[ends] - sums[ends - sizes]

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, best: list[tuple[int, int | None]]) -> tuple[list[tuple[int, int | None]], int]:
        """The k best (score, doc_id) of best and of this shard, and how many documents were scored."""
        self.times[terms] = times
        first, last = self.starts[terms], self.starts[terms + 1]
        front, depth, met = first.copy(), DEPTH, []
        while True:
            bound = sum(int(n * self.impact[self.by_list[p]]) for n, p, e in zip(times, front, last, strict=True) if p < e)
            if bound <= 0 or (len(best) == k and bound < best[-1][0]):
                break
            read = np.concatenate([np.arange(p, min(p + depth, e)) for p, e in zip(front, last, strict=True)])
            new = np.unique(self.document[self.by_list[read[~self.seen[read]]]])
            new = new[~self.scored[new]]
            self.scored[new] = True
            met.append(new)
            scores = self.direct(new)
            if len(best) == k:
                keep = scores >= best[-1][0]
                new, scores = new[keep], scores[keep]
            best = ranked([*best, *((s, self.doc_ids[d]) for s, d in zip(scores.tolist(), new.tolist(), strict=True) if s > 0)])[:k]
            for j, (p, e) in enumerate(zip(front, last, strict=True)):  # on to the first place not seen
                while p < e:
                    part = self.seen[p : min(p + 4 * depth, e)]
                    gap = int(np.argmin(part))
                    if not part[gap]:
                        p += gap
                        break
                    p += len(part)
                front[j] = p
            depth *= 2
        self.times[terms] = 0
        for p, e in zip(first, last, strict=True):
            self.seen[p:e] = False
        found = np.concatenate(met) if met else np.zeros(0, np.int64)
        self.scored[found] = False
        return best, len(found)


def ranked(found: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """By falling score, then rising doc_id, null first."""
    return sorted(found, key=lambda f: (-f[0], f[1] is not None, f[1] or 0))


def _search(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, np.ndarray, np.ndarray]], statistics: Statistics, k: int, most: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task for each query."""
    best: dict[int, list] = {item: [] for item, _, _ in queries}

    def look(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        terms, counts = (columns[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(columns["terms"]).to_numpy())]).astype(np.int64)
        lengths = np.repeat(columns["n_terms"].to_numpy(), np.diff(bounds))
        shard = Shard(columns["doc_id"].to_pylist(), bounds, terms, impacts(statistics, terms, counts, lengths), len(statistics.weights))
        for item, own, times in queries:
            best[item], _ = shard.search(own, times, k, best[item])

    held, postings = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            stop = max(int(np.searchsorted(sizes, before + most - postings, "right")), at + (not held))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                postings += int(sizes[stop - 1]) - before
                at = stop
            if at < batch.num_rows or postings >= most:
                look(held)
                held, postings = [], 0
    if held:
        look(held)
    out = [(item, doc_id, score) for item, found in best.items() for score, doc_id in found]
    if out:
        items, doc_ids, scores = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def query_blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list[tuple], list[str], list[tuple]]]:
    """Blocks of queries of at most so many terms, unless one has more: (number, id) of each, the vocabulary, and (number, terms, times) of each."""
    ids, numbers, asked, total, before = [], {}, [], 0, 0
    for row in items.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        words = terms_of(pa.array([row["text"]], pa.string()))
        names = [w for w in (words.distinct[k] for k in words.order) if w]
        if total and total + len(names) > most:
            yield list(enumerate(ids, before)), list(numbers), asked
            before += len(ids)
            ids, numbers, asked, total = [], {}, [], 0
        own, times = np.unique(np.array([numbers.setdefault(w, len(numbers)) for w in names], np.int64), return_counts=True)
        asked.append((before + len(ids), own, times))
        ids.append(row["item"])
        total += len(names)
    if ids:
        yield list(enumerate(ids, before)), list(numbers), asked


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, rank, doc_id, score: for each row of items the k documents of the highest scores above 0.

    items is the stated query set; its rows go through the driver, a block at a time.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = None
    for ids, vocabulary, asked in query_blocks(items, item, item_text, block_terms):
        index = written(rows.mapInArrow(lambda it, v=vocabulary: _index(it, v), INDEX), "index")
        whole = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("length")).first()
        holding = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
            holding[r["term"]] = r["count"]
        statistics = Statistics(whole["n"], whole["length"] or 0, np.array([weight(whole["n"], int(h)) for h in holding], np.int64))
        found = index.mapInArrow(lambda it, q=asked, s=statistics: _search(it, q, s, k, shard), FOUND)
        names = spark.createDataFrame(ids, f"item int, id {kind.simpleString()}")  # a row a query of the block
        found = written(found.join(F.broadcast(names), "item"), "found")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], f"item {kind.simpleString()}, rank int, doc_id long, score long")
    order = (F.desc("score"), F.col("doc_id").asc_nulls_first())
    some = Window.partitionBy("item", F.pmod(F.hash("doc_id"), F.lit(64))).orderBy(*order)
    first = parts.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias("item"), "rank", "doc_id", "score")
