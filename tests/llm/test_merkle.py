import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def path(levels, pos):
    for k, level in enumerate(levels[:-1]):
        p = pos >> k
        other = p ^ 1
        yield (level[other] if other < len(level) else "", p & 1)


def brute(docs):
    """docs as dicts -> rows of the query."""
    leaf = lambda d, more=0: h(*map(value, (d["doc_id"], d["source"], d["lang"], None if d["n_chars"] is None else d["n_chars"] + more, d["text"])))
    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d), leaf(d, 1)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([m[2] for m in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for pos, (known, doc_id, own, changed) in enumerate(sorted(groups[g])):
            steps = [*path(trees[g], pos), *path(top, place)]
            now = changed if known and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for other, right in steps:
                now = h(other, now) if right else h(now, other)
            root = top[-1][0]
            out.append((doc_id if known else None, own, trees[g][-1][0], root, h(*(s for s, _ in steps)), now, now == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_documents(spark, sf_dir):
    got = queries.op11_merkle_manifest(spark, sf_dir)
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(queries.OP11_SQL)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(found.fetchall(), key=repr) == rows


def test_several_tiers_and_odd_rows(spark, tmp_path):
    made = random.Random(3)
    rows = [(k, "t" * made.randrange(9), "en", None, made.choice([None, k])) for k in range((1 << merkle.HEIGHT) * 3 + 5)]
    rows += [(k, "é\0" * k, f"l{k}", "s", k) for k in range(70)]  # many groups of one
    rows += [(None, None, None, None, None)] * 3 + [(7, "x", None, "s", 1), (7, "y", "", "s", 1), (7, "z", "", "s", 1)] + [(5, "same", "de", "s", 4)] * 300
    columns = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert run(spark, rows, tmp_path) == brute([dict(zip(columns, r, strict=True)) for r in rows])


def test_sizes_around_powers_of_two(spark, tmp_path):
    size = 1 << merkle.HEIGHT
    rows = [(k, "x", f"g{n:04d}", "s", k) for n in (1, 2, 3, 4, 5, size - 1, size, size + 1, 2 * size, 2 * size + 1) for k in range(n)]
    columns = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert run(spark, rows, tmp_path) == brute([dict(zip(columns, r, strict=True)) for r in rows])


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_extra_columns_with_names_used_inside(spark):
    rows = spark.range(20).select(F.col("id").alias("pos"), F.lit("a").alias("grp"), (F.col("id") % 3).alias("digest"), F.lit(1).alias("n"))
    tree_ = merkle.manifest(rows, "digest", "pos", ["grp", "pos"], [F.col("n")])
    found = merkle.proofs(tree_).select("kept.*", "leaf", merkle.folded("leaf", "path").alias("f")).collect()
    assert sorted(r.pos for r in found) == list(range(20)) and {r.f.folded_root for r in found} == {tree_.root}


@given(st.integers(1, 9))
@settings(deadline=None)
def test_addresses_are_a_permutation_with_whole_subtrees_together(levels):
    at = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range((1 << levels) - 1))
    if levels > 1:
        top = levels // 2
        assert sorted(np.concatenate(at[:top]).tolist()) == list(range((1 << top) - 1))
        for k in range(1 << top):  # each bottom tree is one stretch
            own = np.sort(np.concatenate([a[k << d : (k + 1) << d] for d, a in enumerate(at[top:])]))
            assert (np.diff(own) == 1).all()


def test_stored_nodes_are_in_van_emde_boas_order():
    digests = [sha256(bytes([k])).digest() for k in range(16)]
    nodes, root = merkle.lay(4, digests)
    levels = tree([d.hex() for d in digests])
    assert root.hex() == levels[-1][0]
    # the public order of a tree of 5 levels: 2 on top, then four trees of 3
    order = [(4, 0), (3, 0), (3, 1)]
    for k in range(4):
        order += [(2, k), (1, 2 * k), (0, 4 * k), (0, 4 * k + 1), (1, 2 * k + 1), (0, 4 * k + 2), (0, 4 * k + 3)]
    assert [nodes[32 * p : 32 * p + 32].hex() for p in range(31)] == [levels[v][k] for v, k in order]
