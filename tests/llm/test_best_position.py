import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import best_position, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(docs, items, k=10):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item", "rank", "doc_id", "score").collect()), key=repr)


def test_documents(spark, sf_dir):
    got = queries.op13_best_position(spark, sf_dir)
    read = lambda name, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(c, "text").collect()]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(queries.OP13_SQL)
    assert [d[0] for d in result.description] == got.columns
    assert sorted(result.fetchall(), key=repr) == found


DOCS = "doc_id long, text string"


@pytest.mark.parametrize(("shard", "block_terms"), [(50, 7), (2_000_000, 200_000)])
def test_ties_odd_rows_blocks_and_small_shards(spark, shard, block_terms):
    made = random.Random(9)
    words = [f"w{int(made.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(k, " ".join(made.choices(words, k=made.randrange(1, 40)))) for k in range(400)]
    docs += [(1000 + k, "W1 w2-w3 Éa éA") for k in range(60)] + [(None, "w1 w2 w3")] * 3 + [(5, "w1"), (5, None), (6, ""), (7, "  .,\n")] + [(8, "w9 " * 50_000)]
    items = [(k, " ".join(made.choices(words, k=9))) for k in range(12)] + [(50, None), (51, ""), (52, "absent"), (53, "w1 w1 W1 w2"), (54, "éA Éa"), (54, "w3"), (None, "w2")]
    df = spark.createDataFrame(docs, DOCS).withColumn("terms", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    found = rows(best_position.search(df, spark.createDataFrame(items, "item_id int, text string"), shard=shard, block_terms=block_terms))
    assert found == brute(docs, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert best_position.search(none, items).collect() == []
    assert best_position.search(some, items.limit(0)).collect() == []
    assert rows(best_position.search(some, items)) == brute([(1, "a b")], [(1, "a")])


def test_reading_stops_early_and_misses_no_tie():
    """One list falls steeply: few documents are scored; with equal impacts everywhere all are."""
    n = 5000
    bounds = np.arange(n + 1)
    steep = best_position.Shard(list(range(n)), bounds, np.zeros(n, np.int64), np.arange(n, 0, -1), 1)
    best, scored = steep.search(np.array([0]), np.array([1]), 10, [])
    assert best == [(n - d, d) for d in range(10)] and scored <= 2 * best_position.DEPTH
    flat = best_position.Shard(list(range(n)), bounds, np.zeros(n, np.int64), np.full(n, 3), 1)
    for _ in range(2):  # nothing is left of a search
        best, scored = flat.search(np.array([0]), np.array([2]), 10, [(6, 3)])
        assert best == [(6, d) for d in (0, 1, 2, 3, 3, 4, 5, 6, 7, 8)] and scored == n
    best, scored = steep.search(np.array([0]), np.array([1]), 1, [(n + 1, 0)])
    assert scored == 0 and best == [(n + 1, 0)]
