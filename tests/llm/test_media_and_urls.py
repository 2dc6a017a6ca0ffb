import hashlib
import random
import struct
import zlib

from tracemill.llm import iso_media, queries, url_filter


def test_media_of_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op7_iso_media(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = r.text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        g, media = got[r.doc_id], iso_media.wrap(payload)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        codec, duration, n, ranges = g.feature.split(";")
        assert codec == "raw" and int(n) == len(payload) // 64 and float(duration) == round(len(payload) / 64 / 25, 3)
        first = media.index(b"mdat") + 4
        assert ranges.split(",") == [f"{first + k * 64}+64" for k in range(0, len(payload) // 64, 16)]


def test_media_round_trip_over_chunk_sizes():
    for n in (1, 15, 16, 17, 127, 128, 129, 256, 300):
        payload = random.Random(n).randbytes(n * 64)
        media = iso_media.wrap(payload)
        found = iso_media.probe(media)
        assert iso_media.samples(media, found) == payload and found["n_samples"] == n


def merged_tracks(a, b):
    """A file of the tracks of two, the samples of the first; chunk offsets are moved by what was put before them."""
    moov = lambda m: m.index(b"moov") - 4
    size = lambda m, at: struct.unpack_from(">I", m, at)[0]
    at, other = moov(a), moov(b)
    track = b[b.index(b"trak") - 4 : other + size(b, other)]
    grown = bytearray(a[: at + size(a, at)] + track + a[at + size(a, at) :])
    struct.pack_into(">I", grown, at, size(a, at) + len(track))
    places = grown.index(b"stco") + 12
    for k in range(struct.unpack_from(">I", grown, places - 4)[0]):
        struct.pack_into(">I", grown, places + 4 * k, struct.unpack_from(">I", grown, places + 4 * k)[0] + len(track))
    return bytes(grown)


def test_tracks_are_not_mixed():
    payload = random.Random(4).randbytes(40 * 64)
    first = bytearray(iso_media.wrap(payload))
    first[first.index(b"stss") : first.index(b"stss") + 4] = b"free"  # every sample is a key sample
    media = merged_tracks(bytes(first), iso_media.wrap(bytes(48 * 64)))
    found = iso_media.probe(media)
    assert len(iso_media.tracks(media)) == 2 and found["n_samples"] == len(found["keyframes"]) == 40
    assert iso_media.samples(media, found) == payload


def test_compact_sizes_and_fragments(spark):
    for bits, raw in ((4, b"\x12\x30"), (8, b"\x01\x02\x03"), (16, b"\x00\x01\x00\x02\x00\x03")):
        data = struct.pack(">III", 0, bits, 3) + raw
        assert iso_media.sample_sizes(memoryview(data), {b"stz2": (0, len(data))}).tolist() == [1, 2, 3]
    media = iso_media.wrap(bytes(64)) + iso_media.box(b"moof")
    rows = spark.createDataFrame([(1, 0, media)], "doc_id long, n_bytes long, media binary")
    assert "fragmented" in iso_media.probe_media(rows).first().problem


def test_bad_media(spark):
    good = iso_media.wrap(bytes(64))
    bad = [None, b"", b"abc", good[:60], good.replace(b"stsd", b"stsx"), b"\x00\x00\x00\x04mdat"]
    rows = spark.createDataFrame([(i, 0, m) for i, m in enumerate([*bad, good])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in iso_media.probe_media(rows).collect()}
    assert all(got[i].problem and got[i].codec is None for i in range(len(bad))) and got[len(bad)].problem is None
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "a" * 200000, "x")], "doc_id long, text string, media string")
    assert [r.n_bytes for r in iso_media.probe_media(iso_media.store_texts(odd)).orderBy("n_bytes").collect()] == [0, 0, 200000]
    assert iso_media.probe_media(iso_media.store_texts(odd.limit(0))).count() == 0


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for what, rule in queries.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best


def test_urls_of_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op10_url_logreg(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        host, path, best = plain_url(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, best and best[1])
        assert g.verdict in ("allow", "block") and (best is None or g.verdict == best[0])


def test_odd_urls(spark):
    urls = [None, "", "nope", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b?c/d", "x://com/", "x://xcom/", "x://a.net/es/", "x://net/fr/1", "x://É.com/ü", "x://a.com:80/", "://h/p", "x://example.com/en", "x://u@a.com#f"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[4], "h")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, best = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_model_on_held_out_urls(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(600):
        bad = r.random() < 0.5
        host = f"{r.choice(['casino', 'win', 'spam'])}-{word()}.org" if bad else f"{r.choice(['news', 'lib', 'edu'])}.{word()}.org"
        rows.append((f"http://{host}/{word()}", int(bad)))
    train = spark.createDataFrame(rows[:400], "url string, label int")
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {x.page_id: x.verdict for x in url_filter.judge(test, [], train).collect()}
    assert sum((got[i] == "block") == bool(b) for i, (_, b) in enumerate(rows[400:])) >= 190


def test_hostile_boxes_are_named_and_end_nothing(spark):
    deep = b"".join(struct.pack(">I4s", 8 * (1500 - k), b"moov") for k in range(1500))
    media = iso_media.wrap(random.Random(1).randbytes(300 * 64))

    def changed(kind, at, value):
        out = bytearray(media)
        struct.pack_into(">I", out, out.index(kind) + 4 + at, value)
        return bytes(out)

    cases = [
        deep, changed(b"stsz", 8, 0xFFFFFFFF), changed(b"stsz", 4, 0), changed(b"stsc", 12, 0xFFFFFFFF), changed(b"stsc", 8, 0xFFFFFFFF), changed(b"stts", 4, 0xFFFFFFFF),
        changed(b"stco", 4, 0xFFFFFFFF), changed(b"stss", 8, 0), changed(b"stss", 8, 0xFFFFFFFF), changed(b"mdhd", 12, 0),
    ]
    rows = spark.createDataFrame([(k, 0, m) for k, m in enumerate([*cases, media])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in iso_media.probe_media(rows).collect()}
    assert len(got) == len(cases) + 1 and got[len(cases)].problem is None and got[len(cases)].n_samples == 300
    assert "nested deeper" in got[0].problem and all(got[k].problem for k in range(len(cases)) if k != 3)  # a chunk may claim more samples than there are
