"""A Merkle manifest of a dataset: a binary hash tree for each group of rows, and one over the groups.

H is the lowercase hexadecimal SHA-256 of its inputs, concatenated; digests go in as text. Leaves of a
group are numbered by order; every two consecutive nodes become their H, a last one alone too, until
one node is left, the group's. The groups' nodes, by name, likewise give the root.

Nodes are kept in blocks. A block is the aligned subtree over 2 ** HEIGHT consecutive nodes, one row,
whose digests lie in van Emde Boas order: a tree is split at half its height, the top comes first, each
bottom tree after it, all of them split again. address() computes a node's place from its depth and
number alone; it serves both the construction and the reading of siblings, so that a path of siblings
touches few stretches of memory whatever their size. The roots of a tier's blocks are the nodes of the
next tier, until a group has one block. A group's tree is as high as its number of leaves asks for.

Nulls: a null value is encoded as "-", apart from every value; a null group comes first and is a group of
its own; null orders come first. Rows that share their order are ordered by their leaves; equal rows are
equal leaves beside each other. An empty table has no root and no row. Only the named columns are read.
"""

from __future__ import annotations

import functools
from binascii import hexlify
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tracemill.llm.shared import discard, partitions, written

HEIGHT = 8
SIZE = 32
LEFT, RIGHT, ALONE = b"\0", b"\1", b"\2"  # where a sibling stands on a path

BLOCK = "grp string, block long, n long, height int, nodes binary, root binary"
DOWN = "grp string, block long, path binary, top string"


def encoded(column: Column | str) -> Column:
    """One value as text that no other sequence of values gives: its length in UTF-8 bytes, a colon, itself; null is "-"."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column | str) -> Column:
    """H of the values of a row."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of nodes of a complete tree of so many levels: index from the left, at a depth."""
    place = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = depth - top
        place += (1 << top) - 1 + (index >> below) * ((1 << levels - top) - 1)
        index = index & (1 << below) - 1
        depth, levels = below, levels - top
    return place


@functools.lru_cache
def places(height: int) -> list[np.ndarray]:
    """The places of a block's nodes by level, from the leaves up."""
    return [address(height + 1, height - k, np.arange(1 << height - k)) for k in range(height + 1)]


def parent(texts: list[bytes]) -> bytes:
    return sha256(b"".join(texts)).digest()


def lay(height: int, digests: list[bytes]) -> tuple[bytes, bytes]:
    """The nodes of a block over these digests in van Emde Boas order, zeros where there is no node, and its root."""
    nodes = np.zeros(((2 << height) - 1, SIZE), np.uint8)
    for level, at in enumerate(places(height)):
        nodes[at[: len(digests)]] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, SIZE)
        if level < height:
            texts = [hexlify(d) for d in digests]
            digests = [parent(texts[k : k + 2]) for k in range(0, len(texts), 2)]
    return nodes.tobytes(), digests[0]


def siblings(height: int, nodes: bytes, n: int) -> list[bytes]:
    """The path of siblings of each of a block's n leaves: for each level where it stands, then its digest."""
    steps = []
    for level, at in enumerate(places(height)[:-1]):
        here = -(-n >> level)  # nodes of this level
        own = [nodes[p * SIZE : (p + 1) * SIZE] for p in at[:here].tolist()]
        steps.append([LEFT + own[k - 1] if k & 1 else RIGHT + own[k + 1] if k + 1 < here else ALONE for k in range(here)])
    return [b"".join([s[k >> level] for level, s in enumerate(steps)]) for k in range(n)]


def path_steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        size = 0 if side == ALONE else SIZE
        yield side, hexlify(path[at + 1 : at + 1 + size])
        at += 1 + size


def climb(digest: str, path: bytes) -> tuple[str, str]:
    """(H of the siblings on the path, what the digest becomes with them)."""
    now, seen = digest.encode(), []
    for side, other in path_steps(path):
        now = sha256(other + now if side == LEFT else now + other).hexdigest().encode()
        seen.append(other)
    return sha256(b"".join(seen)).hexdigest(), now.decode()


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows(grp, order, digest, ...) with pos in their group and n, its size, as a written table.

    A range sort gives each task a stretch of one sequence; sizes of the groups' parts in each stretch,
    few for any group, give where a stretch begins. The last key deals equal rows to several tasks.
    """
    keys = [F.col("grp"), F.col(order).asc_nulls_first(), F.col("digest"), F.col("tie")]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(spread.drop("tie").withColumn("part", F.spark_partition_id()).withColumn("at", within), "sorted")
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    parts = parts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(own).alias("n"))
    found = written(placed.join(parts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"), "numbered")
    discard(placed)
    return found


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heights, laid = [], []
        for n, digests in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist(), strict=True):
            height = min(HEIGHT, (n - 1).bit_length())
            heights.append(height)
            laid.append(lay(height, digests))
        nodes, roots = zip(*laid, strict=True) if laid else ((), ())
        columns = [*(batch.column(c) for c in ("grp", "block", "n")), pa.array(heights, pa.int32()), pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["grp", "block", "n", "height", "nodes", "root"])


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The written blocks over nodes(grp, pos, n, digest), then those over their roots, and so on."""
    found = []
    while True:
        members = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        rows = nodes.groupBy("grp", F.shiftright("pos", HEIGHT).alias("block"), "n").agg(members.alias("m")).select("grp", "block", "n", F.col("m.digest").alias("digests"))
        blocks = written(rows.mapInArrow(_lay, BLOCK), "blocks")
        found.append(blocks)
        nodes = blocks.filter(F.col("n") > 1 << HEIGHT).select("grp", F.col("block").alias("pos"), F.shiftright(F.col("n") + (1 << HEIGHT) - 1, HEIGHT).alias("n"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return found


def finished(found: list[DataFrame]) -> DataFrame:
    """grp, digest: the node that each group's tree ends in."""
    whole = [t.filter(F.col("n") <= 1 << HEIGHT).select("grp", F.col("root").alias("digest")) for t in found]
    return functools.reduce(DataFrame.unionByName, whole)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of a block, with its siblings up to the root, and what the leaf carries."""
    for batch in batches:
        for row in range(batch.num_rows):
            part = batch.slice(row, 1)
            value = {c: part.column(c)[0] for c in part.schema.names}
            n = min(value["n"].as_py() - (value["block"].as_py() << HEIGHT), 1 << HEIGHT)
            above = value["path"].as_py()
            paths = [p + above for p in siblings(value["height"].as_py(), value["nodes"].as_py(), n)]
            first = value["block"].as_py() << HEIGHT
            columns = [pa.array([value["grp"].as_py()] * n), pa.array(range(first, first + n), pa.int64()), pa.array(paths, pa.binary()), pa.array([value["top"].as_py()] * n)]
            names = ["grp", "block", "path", "top"]
            if "carried" in value:
                columns.append(value["carried"].values)
                names.append("carried")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def handed_down(found: list[DataFrame], start: DataFrame, carried: DataFrame, kind: str) -> DataFrame:
    """Each leaf's path: from start(grp, path, top), the paths of whole trees, down the tiers to carried(grp, block, carried)."""
    paths = None
    for k in reversed(range(len(found))):
        ended = found[k].filter(F.col("n") <= 1 << HEIGHT).select("grp", "block").join(start, "grp")
        paths = ended if paths is None else ended.unionByName(paths)
        rows = found[k].drop("root").join(paths, ["grp", "block"])
        paths = rows.mapInArrow(_expand, DOWN) if k else rows.join(carried, ["grp", "block"]).mapInArrow(_expand, f"{DOWN}, carried {kind}")
    return paths


@dataclass
class Manifest:
    """leaves(grp, pos, n, digest, what the caller keeps); the tiers of the groups' trees, and of the tree over them; its root."""

    leaves: DataFrame
    groups: DataFrame
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    root: str | None


def manifest(rows: DataFrame, group: str, order: str, columns: list[str], kept: list[Column] = ()) -> Manifest:
    """The tree of a table: rows are grouped, ordered within their group, and hashed over columns. kept are columns to carry beside."""
    name = F.when(F.col(group).isNotNull(), F.concat(F.lit("="), F.col(group).cast("string"))).otherwise("")
    hashed = rows.select(name.alias("grp"), F.col(order).alias("place"), F.unhex(leaf(*columns)).alias("digest"), F.struct(F.col(order), *kept).alias("kept"))
    leaves = numbered(written(hashed, "leaves"), "place")
    own = tiers(leaves.select("grp", "pos", "n", "digest"))
    groups = numbered(finished(own).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name")
    top = tiers(groups.select("grp", "pos", "n", "digest"))
    last = finished(top).first()
    return Manifest(leaves, groups, own, top, last and last["digest"].hex())


def proofs(tree: Manifest) -> DataFrame:
    """A row for each leaf: kept, leaf, subroot and path, its siblings up to the root, which climb() folds."""
    spark = tree.leaves.sparkSession
    gathered = lambda rows, carried: rows.groupBy("grp", F.shiftright("pos", HEIGHT).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", carried.alias("row")))).alias("m")).select("grp", "block", F.col("m.row").alias("carried"))
    start = spark.createDataFrame([("", b"", "")], "grp string, path binary, top string")
    named = handed_down(tree.top_tiers, start, gathered(tree.groups, F.struct("name", "digest")), "struct<name:string,digest:binary>")
    subroots = written(named.select(F.col("carried.name").alias("grp"), "path", F.lower(F.hex("carried.digest")).alias("top")), "subroots")
    kept = tree.leaves.schema["kept"].dataType.simpleString()
    found = handed_down(tree.tiers, subroots, gathered(tree.leaves, F.struct("kept", "digest")), f"struct<kept:{kept},digest:binary>")
    return found.select("carried.kept", F.lower(F.hex("carried.digest")).alias("leaf"), F.col("top").alias("subroot"), "path")


@F.pandas_udf(StructType([StructField("proof_sha256", StringType()), StructField("folded_root", StringType())]))
def folded(digest: pd.Series, path: pd.Series) -> pd.DataFrame:
    """climb() of a column of leaves and their paths."""
    return pd.DataFrame([climb(d, p) for d, p in zip(digest, path, strict=True)], columns=["proof_sha256", "folded_root"])
