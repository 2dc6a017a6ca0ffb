import datetime
import hashlib
import re

from tracemill.llm import pseudonyms, queries

KEY = queries.KEY


def feistel(left, right, a, b, tweak):
    for i in range(pseudonyms.ROUNDS):
        half = right if i % 2 == 0 else left
        noise = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:14], 16)
        if i % 2 == 0:
            left = (left + noise) % a
        else:
            right = (right + noise) % b
    return left, right


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def refill(shape, digits):
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def permuted(d, tweak):
    h = len(d) // 2
    left, right = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), tweak)
    return f"{left:0{h}d}{right:0{len(d) - h}d}"


def plain(m):
    kind = next((k for k in pseudonyms.KINDS if re.fullmatch(pseudonyms.PATTERNS[k], m)), None)
    if kind is None:  # two different separators
        return m
    d = re.sub(r"[^0-9]", "", m)
    if kind == "mail":
        return f"user-{hashlib.sha256(f'{KEY}|mail|{m.lower()}'.encode()).hexdigest()[:16]}@mail.invalid"
    if kind == "phone":
        head = d[:-10]
        return refill(m, head + permuted(d[-10:], "phone"))
    if kind == "card":
        if luhn(d):
            return m
        body = permuted(d[:-1], "card")
        return refill(m, body + str(-luhn(body + "0") % 10))
    if kind == "address":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "address")
        return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        left, right = feistel(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn")
        return f"{left + 1 + (left >= 665):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    y, mo, da = (d[:4], d[4:6], d[6:]) if m[4] == "-" else (d[4:], d[2:4], d[:2])
    month_first = m[4] != "-" and mo > "12"
    if month_first:
        mo, da = da, mo
    try:
        datetime.date(int(y), int(mo), int(da))
    except ValueError:
        return m
    if not 1900 <= int(y) <= 2099:
        return m
    if (mo, da) == ("02", "29"):
        left, right = feistel((int(y) - 1904) // 4 // 7, (int(y) - 1904) // 4 % 7, 7, 7, "leap")
        new = datetime.date(1904 + 4 * (left * 7 + right), 2, 29)
    elif month_first:
        late = [x for x in (datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(365)) if x.day > 12]
        left, right = feistel(int(y) - 1900, late.index(datetime.date(1999, int(mo), int(da))), 200, len(late), "late")
        new = late[right].replace(year=left + 1900)
    else:
        left, right = feistel(int(y) - 1900, (datetime.date(1999, int(mo), int(da)) - datetime.date(1999, 1, 1)).days, 200, 365, "date")
        new = (datetime.date(1999, 1, 1) + datetime.timedelta(right)).replace(year=left + 1900)
    return refill(m, new.strftime("%Y%m%d" if m[4] == "-" else "%m%d%Y" if month_first else "%d%m%Y"))


def test_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op8_feistel_pii(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    pattern = re.compile(pseudonyms.ANY, re.A)
    assert all(got[d].text == pattern.sub(lambda m: plain(m[0]), t) for d, t in rows.items())
    assert sum(r.n_personal for r in got.values()) > 30


def test_formats(spark):
    texts = [
        None, "", "none here", "a@b.co, A@B.co x.y+z@mail.example.org.", "call +1 (323) 555-9830 or 323-555-9830, not 1323-555-98301", "born 1988-02-29 or 29.02.2000 or 29/02/1904, not 2001-02-29, 31.04.1999, 01.02/2003, 1899-01-01",
        "1987-06-05 05.06.1987 05/06/1987", "at 10.0.0.1. and 256.1.1.1 and 1.2.3.4.5", "078-05-1120 000-12-3456 666-12-3456 123-00-4567", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111", "é𝒳 4222222222222 " + "x" * 50000 + " 10.1.2.3",
        "key 4111111111111111a a4111111111111111",
    ]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, texts[6], 7)], "doc_id long, text string, n_personal int")
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, KEY).collect()}
    pattern = re.compile(pseudonyms.ANY, re.A)
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else pattern.sub(lambda m: plain(m[0]), t)), t
    assert got[None].text == got[6].text and got[6].n_personal == 3
    assert got[9].personal_kinds == "card,card" and "1112" in got[9].text
    assert got[11].text == texts[11] and got[11].n_personal == 0
    assert got[5].text.endswith("not 2001-02-29, 31.04.1999, 01.02/2003, 1899-01-01") and got[5].n_personal == 3
    assert pseudonyms.pseudonymised(docs.limit(0), KEY).count() == 0


def test_month_first_dates(spark):
    texts = ["12/31/2024", "02/29/2000", "01.13.1950 and 13.01.1950", "13/13/2000 02/30/1999 02/29/1999", "03/04/2024"]
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    pattern = re.compile(pseudonyms.ANY, re.A)
    assert [got[i].text for i in range(5)] == [pattern.sub(lambda m: plain(m[0]), t) for t in texts]
    assert [got[i].n_personal for i in range(5)] == [1, 1, 2, 0, 1]
    assert len({plain(f"{m:02d}/{d}/19{y:02d}") for m in range(1, 13) for d in range(13, 29) for y in range(100)}) == 12 * 16 * 100


def test_key_is_in_no_plan(spark):
    df = pseudonyms.pseudonymised(spark.createDataFrame([(1, "a@b.co 10.1.2.3", "k")], "doc_id long, text string, personal_key string"), "a-very-secret-key")
    assert "a-very-secret-key" not in df._jdf.queryExecution().toString() and df.columns[:3] == ["doc_id", "text", "personal_key"]


def test_texts_that_drive_matchers(spark):
    """A megabyte for every pattern that could recurse, look back or try again and again."""
    mega = 1 << 20
    units = ["a@b" + ".c" * (mega // 2), "a" * mega + "@", "a.b@" * (mega // 4), "1" * mega, "1 " * (mega // 2), "4111 1111 1111 1111 " * (mega // 20), "1.2.3." * (mega // 6), "01.02." * (mega // 6), "555-" * (mega // 4), "1-2-" * (mega // 4), "@" * mega, "(323) " * (mega // 6)]
    docs = spark.createDataFrame([(i, t + " 10.1.2.3") for i, t in enumerate(units)], "doc_id long, text string").repartition(len(units))
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, KEY).collect()}
    assert len(got) == len(units) and all(r.text.endswith(plain("10.1.2.3")) for r in got.values())
    assert got[0].personal_kinds == "mail,address" and got[5].n_personal == mega // 20 + 1


def test_cards_next_to_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [
        "4111111111111111 123", f"{card} 12/27", "card 4111111111111111 7 items", f"12 {card}", f"12345 {card}", f"9 {card} 12 4222222222222 9999999",
        f"{card} 323-555-9830", "1234567 323-555-9830", f"{card} 10.1.2.3 {card}", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "12345 " * 4000 + card,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, KEY).collect()}
    for old in (card, "4111111111111111", "4222222222222"):
        for i, t in enumerate(texts[:9]):
            texts[i] = t.replace(old, plain(old))
    texts = [t.replace("323-555-9830", plain("323-555-9830")).replace("10.1.2.3", plain("10.1.2.3")) for t in texts]
    assert [got[i].text for i in range(10)] == texts[:10]
    assert [got[i].personal_kinds for i in range(9)] == ["card"] * 5 + ["card,card", "card,phone", "phone", "card,address,card"]
    assert got[9].n_personal == 0 and card not in got[10].text


def test_bijection():
    assert len({feistel(x, y, 7, 7, "leap") for x in range(7) for y in range(7)}) == 49
    assert len({plain(f"10.0.{a}.{b}") for a in range(20) for b in range(200)}) == 4000


def test_columns_of_the_caller_named_as_inside(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "call 555-123-4567 or a@b.org")], "doc_id long, text string").withColumn("personal_pieces", F.lit("mine")).withColumn("personal_key", F.lit(3))
    got = pseudonyms.pseudonymised(rows, "k").first()
    assert (got.personal_pieces, got.personal_key, got.n_personal) == ("mine", 3, 2) and "4567" not in str(got) and "a@b.org" not in str(got)
