import re

import pytest
import xxhash

from tracemill.llm import components, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{id: smallest reachable id} by comparing all pairs."""
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d, _ in prints}


def test_documents_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    want = plain_components(prints)
    got = queries.op2_simhash_popcount(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{p:016x}", want[d]) for d, p in prints)
    assert len(set(want.values())) < len(want)


def test_planted_bits(spark, monkeypatch):
    import random

    random.seed(3)
    values = []
    for _ in range(40):
        x = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):
            values.append(x)
            for _ in range(random.randint(0, 3)):
                x ^= 1 << random.randrange(64)
    values += [0, 1, 3, 7, (1 << 64) - 1, (1 << 63)]
    prints = list(enumerate(values))
    want = plain_components(prints)
    frame = spark.createDataFrame([(d, v - (1 << 64) if v >> 63 else v) for d, v in prints], "doc_id long, fp long").selectExpr("doc_id", "doc_id key", "fp")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: frame)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == want


def test_odd_rows(spark):
    long = "word " * 30000
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "oNE  TWO"), (6, long), (7, long), (None, long), (8, "É a b")]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == got[(3, "0" * 16)] == 1
    key = f"{plain_print('one two'):016x}"
    assert got[(4, key)] == got[(5, key)] == 4
    key = f"{plain_print(long):016x}"
    assert got[(7, key)] == got[(None, key)] == 6
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Of repeated rows one stays, of other texts with that id none; null ids come last."""
    other = "some other words that are long enough to have a fingerprint of their own"
    rows = [(2, "One two"), (2, "one two"), (2, "one  two"), (2, "one  two"), (5, "one two"), (None, other), (None, other), (7, "x y z"), (7, "x y z"), (None, "x y z"), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "s", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, kept_key string, n int").repartition(3)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert len(got) == 4 and got.count((7, "x y z")) == 1 and got.count((8, None)) == 1 and got.count((None, other)) == 1
    assert sum(d == 2 for d, _ in got) == 1
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 60])
def test_components_of_paths_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(100, 100 + n)] + [(500, 500 + i) for i in range(1, n)] + [(7, 7), (9, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {7: 7} | ({i: 100 for i in range(100, 101 + n)} | {i: 500 for i in range(500, 500 + n)} if n else {})
    assert got == want


def test_more_fingerprints_find_more_near_copies(spark):
    import random

    from tracemill.llm.simhash import simhashes

    made = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows, pairs = [], []
    for k in range(60):
        own = made.choices(words, k=made.randrange(150, 500))
        other = list(own)
        other[made.randrange(len(other))] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        pairs.append((rows[-2][1], rows[-1][1]))
    far = lambda a, b: bin(a ^ b).count("1")
    near = [[far(x, y) <= 2 for x, y in zip(simhashes(a, 4), simhashes(b, 4), strict=True)] for a, b in pairs]
    assert all(simhashes(a, 4)[0] == simhash.simhash(a) for a, _ in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for passes in (1, 4):
        kept = sorted(r.doc_id for r in simhash.without_near_duplicates(docs, passes).collect())
        gone = {2 * k + 1 for k, found in enumerate(near) if any(found[:passes])}
        assert kept == sorted(set(range(120)) - gone)
    assert sum(any(n) for n in near) > sum(n[0] for n in near)
