"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: each bit is set if it is set in over half of the XXH64 values (seed 42) of the text's
three-word shingles, repeats included. Two fingerprints link at RADIUS = 2 or fewer differing bits.

Search: a fingerprint maps to the bit counts of its 32 segments of two bits. One flipped bit
changes one count by one, so Manhattan distance of the counts is a lower bound of the differing
bits. Two points of the integer grid within distance 2 have a common grid cell within distance 1 of
each; so every distinct fingerprint enters its own cell and its neighbours, and only cells with two
different fingerprints go on. There links are verified exactly, without pairs: within such a cell a
fingerprint lists the 64-bit values in that cell that differ from it in at most one bit. Two
fingerprints link exactly if they share such a value, and all that share one link to each other.
Fingerprints and shared values form a bipartite graph, linear in size, whose components are found.

Exact copies meet in one fingerprint before the search, by partial aggregation. Nulls: a null text
is an empty one; texts without words have fingerprint zero and link like any other. A null doc_id
takes no part in the choice of a component's smallest id, but gets the component of its text.

``without_near_duplicates`` searches by PASSES fingerprints of a text, whose values are mixed anew from the
same XXH64 values, since any one fingerprint misses near copies that differ in a bit too many: two texts
link if they do by one of them. It keeps one row of every component: that of the smallest doc_id, of
several rows with that id the one whose text has the least hash, of equal ones any; a null doc_id is
the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.components import components
from tracemill.llm.shared import discard, free_name, partitions, written
from tracemill.llm.text_blocks import blocks
from tracemill.llm.worker_cache import release

LOW = 0x5555555555555555
SEED = 42
PASSES = 4
STEP = 0x9E3779B97F4A7C15
FACTORS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB]


def simhashes(text: str, passes: int = 1) -> list[int]:
    """Fingerprints of one text as unsigned integers; the first is the one of the module's description."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if len(words) >= 3:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    elif words:
        shingles = [b" ".join(words)]
    else:
        return [0] * passes
    h = np.array([xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    found = []
    for k in range(passes):
        own = mixed(h, k) if k else h
        counts = np.zeros(64, np.int64)
        for at in range(0, len(own), 4096):
            counts += np.unpackbits(own[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")[0]))
    return found


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other values of the same shingles: two rounds of multiplication and shift after adding k times an odd number."""
    h = h + np.uint64(k * STEP & 0xFFFFFFFFFFFFFFFF)
    for factor in FACTORS:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def simhash(text: str) -> int:
    """The fingerprint of one text as an unsigned integer."""
    return simhashes(text)[0]


def _fingerprints(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    release()
    for part in blocks(batches, "text"):
        prints = np.array([simhashes(t or "", passes) for t in part.column("text").to_pylist()], np.uint64).view(np.int64).ravel()
        lists = pa.FixedSizeListArray.from_arrays(pa.array(prints), passes).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), lists], names=["doc_id", "key", "fps"])


def fingerprint_lists(docs: DataFrame, passes: int) -> DataFrame:
    """doc_id, key (a hash of the text) and fps, the signed 64-bit fingerprints of docs(doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, passes), "doc_id long, key long, fps array<long>")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and fp, the fingerprint of the module's description."""
    return fingerprint_lists(docs, 1).select("doc_id", "key", F.element_at("fps", 1).alias("fp"))


def bit_counts(fp: Column) -> Column:
    """The counts of the 32 two-bit segments, packed into two bits each."""
    even, odd = fp.bitwiseAND(F.lit(LOW)), F.shiftright(fp, 1).bitwiseAND(F.lit(LOW))
    return F.shiftleft(even.bitwiseAND(odd), 1).bitwiseOR(even.bitwiseXOR(odd))


def reach(fp: Column) -> Column:
    """Every value that differs from fp in at most one bit."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(fp), one)


def links(prints: DataFrame) -> DataFrame:
    """Edges(a, b) between fingerprints, and values that several of them share, of distinct prints(fp)."""
    cells = prints.select("fp", F.explode(F.array_distinct(F.transform(reach(F.col("fp")), bit_counts))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low != high").select("cell")
    near = cells.join(shared.hint("merge"), "cell")  # one plan at every size
    # exact verification within the cell
    values = near.select("fp", F.explode(F.filter(reach(F.col("fp")), lambda v: bit_counts(v) == F.col("cell"))).alias("value"))
    values = written(values, "values")
    common = values.groupBy("value").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low != high").select("value")
    return values.join(common.hint("merge"), "value").select(F.col("fp").alias("a"), F.col("value").alias("b"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key and fp of every row, component of every fp), both written. A component is told by its
    least fingerprint, root; first is its first row as a struct (is_null, doc_id, key), n the number of
    rows equal to that one."""
    of_docs = written(fingerprints(docs), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "key").alias("place")
    # Equal rows meet before anything else.
    rows = of_docs.groupBy("fp", place).agg(F.count(F.lit(1)).alias("n"))
    prints = written(rows.groupBy("fp").agg(F.min(F.struct("place", "n")).alias("first")), "distinct-fingerprints")
    roots = components(links(prints.select("fp").repartition(partitions(docs.sparkSession))))
    known = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    labels = written(known.drop("first").join(least, "root").select("fp", "root", "first.place", "first.n"), "labels")
    discard(prints)
    return of_docs, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable), one row a document."""
    of_docs, labels = labelled(docs)
    labels = labels.select("fp", F.col("place.doc_id").alias("component_id"))
    return of_docs.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_places(docs: DataFrame, passes: int) -> DataFrame:
    """doc_id and key of the first row of every component, and n, the number of rows equal to it, written.

    Nodes are (pass, value). A text's fingerprints hang together at that of the first pass, as far as
    there is something to link: a near one, or another text with the same.
    """
    of_docs = written(fingerprint_lists(docs, passes), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "key").alias("place")
    # Equal rows meet before anything else.
    rows = of_docs.groupBy("fps", place).agg(F.count(F.lit(1)).alias("n"))
    texts = written(rows.groupBy("fps").agg(F.min(F.struct("place", "n")).alias("first")), "distinct-fingerprints")
    discard(of_docs)
    node = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    edges = None
    for k in range(passes):
        own = texts.select(F.element_at("fps", 1).alias("first_fp"), F.element_at("fps", k + 1).alias("fp"))
        near = written(links(own.select("fp").distinct().repartition(partitions(docs.sparkSession))), f"links-{k}")
        found = near.select(node(k, "a").alias("a"), node(k, "b").alias("b"))
        if k:
            same = own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
            tied = own.join(near.select(F.col("a").alias("fp")).union(same).distinct().hint("merge"), "fp")
            found = found.union(tied.select(node(0, "first_fp").alias("a"), node(k, "fp").alias("b")))
        edges = found if edges is None else edges.union(found)
    roots = components(edges).filter("node.k = 0").select(F.col("node.v").alias("v"), "root")
    known = texts.join(roots, F.element_at("fps", 1) == roots["v"], "left").select("first", F.coalesce("root", F.struct(F.lit(0).alias("k"), F.element_at("fps", 1).alias("v"))).alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    kept = written(least.select("first.place.doc_id", "first.place.key", "first.n"), "kept")
    discard(texts)
    return kept


def without_near_duplicates(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each component, with the columns of docs."""
    first = kept_places(docs, passes)

    own_id, own_key = free_name(docs, "kept_id"), free_name(docs, "kept_key")
    rows = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_key, F.xxhash64(F.col("text").cast("string")))

    def rows_of(kept: DataFrame) -> DataFrame:
        return rows.join(kept, rows[own_id].eqNullSafe(kept["doc_id"]) & (rows[own_key] == kept["key"]), "left_semi")

    # Rows that are there more than once are few ids; of each one row stays.
    several = rows_of(first.filter("n > 1")).dropDuplicates([own_id, own_key])
    return rows_of(first.filter("n = 1")).unionByName(several).drop(own_id, own_key)
