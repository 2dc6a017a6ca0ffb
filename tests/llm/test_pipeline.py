import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_pieces_and_quality import plain_base
from test_pseudonyms import plain as plain_pseudonym
from test_repeats import WORD, plain_repeats
from xxhash import xxh64_intdigest
from tracemill.llm import pseudonyms


def plain_cut(rows):
    """Texts without windows of 50 words that have an earlier place."""
    places = defaultdict(list)
    words = {d: list(WORD.finditer(t)) for d, t in rows}
    for d, own in words.items():
        for i in range(len(own) - 49):
            places[tuple(m[0] for m in own[i : i + 50])].append((d, i))
    gone = defaultdict(set)
    for found in places.values():
        for d, i in sorted(found)[1:]:
            gone[d].update(range(i, i + 50))
    out = {}
    for d, t in rows:
        at, parts = 0, []
        cut = sorted(gone[d])
        runs = [k for k in cut if k - 1 not in gone[d]]
        for a in runs:
            b = a
            while b + 1 in gone[d]:
                b += 1
            parts.append(t[at : words[d][a].start()])
            at = words[d][b].end()
        out[d] = "".join([*parts, t[at:]])
    return {d: t for d, t in out.items() if WORD.search(t)}


def plain_prints(text, passes=4):
    """Majorities of the bits of the shingles' hashes, and of those mixed anew, in Python's integers."""
    mask = (1 << 64) - 1
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    out = []
    for k in range(passes):
        votes = [0] * 64
        for s in shingles:
            h = xxh64_intdigest(s.encode(), 42)
            if k:
                h = h + k * 0x9E3779B97F4A7C15 & mask
                for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                    h = (h ^ h >> 31) * factor & mask
                h ^= h >> 32
            for b in range(64):
                votes[b] += h >> b & 1
        out.append(sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles)))
    return out


def plain_first(texts):
    """The least id that each text is linked to, through others, by any of its fingerprints."""
    prints = {d: plain_prints(t) for d, t in texts.items()}
    first = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            for b, y in prints.items():
                if first[a] < first[b] and any((p ^ q).bit_count() <= 2 for p, q in zip(x, y, strict=True)):
                    first[b], changed = first[a], True
    return first


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name == "quality":
            failed = {d for d, t in texts.items() if (b := plain_base(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
            kept = {r.doc_id for r in rows}
            assert not kept & failed and len(kept) >= 0.9 * (len(texts) - len(failed))
            texts = {d: t for d, t in texts.items() if d in kept}
        elif name == "near_duplicates":
            first = plain_first(texts)
            texts = {d: t for d, t in texts.items() if first[d] == d}
        elif name == "repeats":
            texts = plain_cut(sorted(texts.items()))
            assert not any(plain_repeats(list(texts.items())).values())
        elif name == "personal_data":
            pattern = re.compile(pseudonyms.ANY, re.A)
            texts = {d: pattern.sub(lambda m: plain_pseudonym(m[0]), t) for d, t in texts.items()}
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in rows} == texts and all(r.n_chars == len(r.text) for r in rows), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for d, own in by_doc.items():
        ids = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.piece))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2]
    for places in by_sequence.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, None, "s", 0), (None, "", "en", None, 0), (None, "word " * 60 + "a b c d e f", "en", "s", None), (2, "x" * 100000, "en", "s", 1), (2, "x" * 100000, "en", "s", 1)]
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    sample = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en' and n_chars between 1000 and 3000").join(good, "doc_id", "left_semi").orderBy("doc_id").limit(3).collect()
    rows += [(10 + i, sample[i // 2].text, "en", "s", 1) for i in range(6)] * 2  # every row twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        out = part
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "")
            if name == "near_duplicates" and part is docs:  # of (10, 11), (12, 13) and (14, 15) one row at most
                kept = sorted(r.doc_id for r in out.collect() if (r.doc_id or 0) >= 10)
                assert kept and kept == sorted({*kept} & {10, 12, 14})
        assert (out.count() > 0) == (part is docs)
