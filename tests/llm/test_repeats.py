import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tracemill.llm import queries, sparse_suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(rows):
    """{row: merged (start, end) of all 50-word windows that occur more than once}."""
    places = defaultdict(list)
    words = [list(WORD.finditer(t or "")) for _, t in rows]
    for k, own in enumerate(words):
        for i in range(len(own) - 49):
            places[tuple(m[0] for m in own[i : i + 50])].append((k, i))
    spans = defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                spans[k].append((i, i + 50))
    return {k: [(words[k][a].start(), words[k][b - 1].end()) for a, b in merged(spans[k])] for k in range(len(rows))}


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_documents_against_all_windows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_repeats(rows)
    got = {r.doc_id: r for r in queries.op9_sparse_suffix(spark, sf_dir).collect()}
    assert len(got) == len(rows) and any(want.values())
    for k, (d, t) in enumerate(rows):
        assert got[d].spans == ",".join(f"{a}:{b}" for a, b in want[k]), d
        assert got[d].n_words == len(WORD.findall(t))


def make(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_planted_passages(spark):
    r = random.Random(2)
    passages = [make(r, n) for n in (51, 60, 80, 300)]
    short = make(r, 49)
    rows = []
    for i in range(60):
        p, q = r.sample([*passages, short], 2)
        body = make(r, r.randint(0, 80)) + p + make(r, r.randint(0, 80)) + q + make(r, r.randint(0, 80))
        rows.append((i, r.choice([" ", "\n", " \t"]).join(body)))
    rows += [(100, " ".join(make(r, 120))), (101, None), (102, ""), (103, "a"), (None, rows[0][1]), (104, rows[3][1]), (104, rows[3][1]), (105, "same " * 500)]
    for i in range(200, 240):  # passages put inside each other
        body = make(r, r.randint(0, 200))
        for p in r.sample([*passages, short], 2):
            at = r.randint(0, len(body))
            body[at:at] = p
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, dk int").repartition(5)
    got = defaultdict(list)
    for x in sparse_suffix.repeated_passages(docs).collect():
        got[x.doc_id].append([(s.start, s.end) for s in x.spans])
    want = plain_repeats(rows)
    for k, (d, _) in enumerate(rows):
        if d != 104:
            assert got[d] == [want[k]], d
    assert len(got[104]) == 2
    # After the cut every passage is there once, and what does not repeat stays.
    left = {x.doc_id: x.text for x in sparse_suffix.without_repeats(docs.filter("doc_id < 104").withColumn("repeat_spans", F.lit(7))).collect()}
    assert left[100] == rows[60][1]
    for p in passages:
        assert sum(" ".join(p) in " ".join((t or "").split()) for t in left.values()) == 1
    for d, t in rows[:60]:
        free = [w for w in t.split() if not any(w in p for p in passages)]
        assert [w for w in left.get(d, "").split() if not any(w in p for p in passages)] == free
    assert sparse_suffix.repeated_passages(docs.limit(0)).count() == 0 and sparse_suffix.without_repeats(docs.limit(0)).count() == 0
    kept = sparse_suffix.without_repeats(docs.filter("doc_id < 3").withColumn("repeat_spans", F.lit(7)))
    assert kept.columns == ["doc_id", "text", "spans", "dk", "repeat_spans"] and {(r.spans, r.dk, r.repeat_spans) for r in kept.collect()} == {("x", 1, 7)}


def test_hashes_are_those_of_the_words():
    r = random.Random(3)
    words = [r.choice("abcdef") * r.randint(1, 2) for _ in range(400)]
    codes = sparse_suffix.word_codes(" ".join(words).encode())
    grams, windows = sparse_suffix.hashes_of(codes)
    for found, n in ((grams, sparse_suffix.SEED), (windows, sparse_suffix.LEAST)):
        assert len(found) == len(words) - n + 1
        by_hash = {}
        for i, h in enumerate(found.tolist()):
            by_hash.setdefault(h, set()).add(tuple(words[i : i + n]))
        assert all(len(x) == 1 for x in by_hash.values())
        again = sparse_suffix.hashes_of(sparse_suffix.word_codes((" ".join(["x", *words[7:]])).encode()))[n == sparse_suffix.LEAST]
        assert again[1:].tolist() == found[7:].tolist()


def test_words_of_equal_crc_are_unlike(spark):
    """Two passages that differ in one word of the same CRC-32 do not repeat."""
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    around = make(random.Random(8), 60)
    rows = [(i, " ".join([*around[:30], w, *around[30:]])) for i, w in enumerate(["plumless", "buckeroo"])]
    assert all(not r.spans for r in sparse_suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
