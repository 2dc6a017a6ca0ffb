"""Personal data replaced by format-preserving pseudonyms, keyed, equal for equal values.

Numbers and dates are validated (Luhn check digit, octets, calendar) and then permuted within their
own format by an alternating Feistel network on Z_a x Z_b, a bijection for any a and b: round
functions are SHA-256 of key, kind, round and the other half. So equal values stay linked across
documents, different values stay different, and only who has the key can tell which. Separators stay
in place. Mail addresses become a keyed digest at a reserved domain.

Kinds: mail; phone (three, three and four digits, with or without a country code, which stays);
date (ISO, or with dots or slashes day first, or month first where that alone is a date, 1900 to
2099); address (dotted quad); ssn
(three, two and four digits); card (13 to 19 digits that pass the Luhn check, as the pseudonym does).
What fails validation stays as it is. Cards are looked for from every group of digits to every later
end of a group, so one next to another number is found, and what is no card hides nothing behind it.
Only from the first group of a run on may groups but the last have less than three digits: otherwise
most tables of small numbers would hold some valid run. Replacement is one pass of leftmost matches,
all in column expressions.

The key is a column of a one-row table, so no plan, page of the web interface or event log shows it.
Every pattern is linear in the text: groups that repeat without bound are possessive, since Java's
matcher would otherwise recurse once a repetition.

Nulls: a null text stays null; empty texts, repeated rows and null ids are rows like any other.
Columns beside text are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.shared import free_name

ROUNDS = 10
KINDS = ["mail", "phone", "date", "address", "ssn", "card"]
#: By kind, tried in this order at each place.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![A-Za-z0-9])",
    "address": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
#: The longest candidate for a card from each group of digits, or from the first of each run, as group 1.
CARD_AT_GROUP = r"(?<![A-Za-z0-9])(?=([0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])))"
CARD_AT_RUN = r"(?<![A-Za-z0-9])(?<![0-9][ -])(?=([0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])))"
ANY = "|".join(p.replace(r"([./])[0-9]{2}\1", r"[./][0-9]{2}[./]") for p in PATTERNS.values())
OTHERS = ANY.removesuffix("|" + PATTERNS["card"])
HINT = r"[0-9@]"


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, tweak: str, key: Column) -> Column:
    """struct(l, r): the pair permuted on Z_a x Z_b."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def noise(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, F.lit(tweak), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + noise(i, acc["r"]), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + noise(i, acc["l"]), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def with_value(x: Column, f) -> Column:
    """f of x, computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    place = lambda i: F.length(only_digits(F.substr(shape, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substr(shape, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, place(i), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1)))), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn scheme; a number is valid if ten divides it."""
    back = F.reverse(digits)
    places = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(F.pmod(F.substr(back, i, F.lit(1)).cast("int") * 2, F.lit(10)) + F.floor(F.substr(back, i, F.lit(1)).cast("int") / 5).cast("int")))
    return F.aggregate(places, F.lit(0), lambda acc, v: acc + v)


def padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), F.lit(width) if isinstance(width, int) else width, F.lit("0"))


def _permuted(digits: Column, tweak: str, key: Column) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k.cast("double")).cast("long")
    pair = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n - half), ten(half), ten(n - half), tweak, key)
    return with_value(pair, lambda p: F.concat(padded(p["l"], half), padded(p["r"], n - half)))


def _card(m: Column, key: Column) -> Column:
    def valid(d: Column) -> Column:
        body = _permuted(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
        return with_value(body, lambda x: refilled(m, F.concat(x, F.pmod(10 - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))))

    return with_value(only_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, valid(d)).otherwise(m))


def card_texts(text: Column) -> Column:
    """The distinct valid cards of a text as written there, the longest first."""
    whole = F.regexp_extract_all(text, F.lit(CARD_AT_RUN), F.lit(1))
    begun = lambda c: F.transform(F.sequence(F.lit(12), F.lit(18)), lambda n: F.regexp_extract_all(c, F.concat(F.lit("^[0-9](?:[ -]?[0-9]){"), n.cast("string"), F.lit("}(?![0-9])")), F.lit(0)))
    parts = F.flatten(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CARD_AT_GROUP), F.lit(1)), begun)))
    found = F.array_distinct(F.concat(whole, F.filter(parts, lambda c: c.rlike("^(?:[0-9]{3,}[ -])*[0-9]+$"))))
    valid = F.filter(found, lambda c: luhn_sum(only_digits(c)) % 10 == 0)
    return F.array_sort(valid, lambda a, b: F.length(b) - F.length(a))


def pattern_of(text: Column) -> Column:
    """The text's own pattern: that of the other kinds, and its valid cards."""
    either = lambda cards: F.concat(F.lit(OTHERS + "|(?<![A-Za-z0-9])(?:"), F.array_join(cards, "|"), F.lit(")(?![A-Za-z0-9])"))
    with_cards = with_value(card_texts(text), lambda cards: F.when(F.size(cards) > 0, either(cards)).otherwise(F.lit(OTHERS)))
    return F.when(text.rlike(PATTERNS["card"]), with_cards).otherwise(F.lit(OTHERS))


def _phone(m: Column, key: Column) -> Column:
    national = F.regexp_extract(m, r"((?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})$", 1)
    country = F.substr(m, F.lit(1), F.length(m) - F.length(national))
    return F.concat(country, refilled(national, _permuted(only_digits(national), "phone", key)))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    fine = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - (area > 666).cast("long")
    new = feistel(rank, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
    back = lambda r: r + 1 + (r >= 665).cast("long")
    text = with_value(new, lambda p: F.concat_ws("-", padded(back(p["l"]), 3), padded(F.floor(p["r"] / 9999) + 1, 2), padded(F.pmod(p["r"], F.lit(9999)) + 1, 4)))
    return F.when(fine, text).otherwise(m)


def _address(m: Column, key: Column) -> Column:
    def text(o: Column) -> Column:
        new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "address", key)
        return with_value(new, lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), F.pmod(p[h], F.lit(256))))))

    return with_value(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), lambda o: F.when(F.array_max(o) < 256, text(o)).otherwise(m))


#: Days of a year's months beyond the twelfth, counted before each month; dates of these can be told from day-first ones.
LATE_DAYS = [0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202]


def _date(m: Column, key: Column) -> Column:
    iso = F.substring(m, 5, 1) == "-"
    year, first, second = (F.when(iso, F.substring(m, *a)).otherwise(F.substring(m, *b)) for a, b in (((1, 4), (7, 4)), ((6, 2), (4, 2)), ((9, 2), (1, 2))))
    # month first only where the day is beyond 12, so that no other reading is a date
    us = ~iso & (first > "12")
    month, day = F.when(us, second).otherwise(first), F.when(us, first).otherwise(second)
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")))
    y = year.cast("long")
    same_separators = iso | (F.substring(m, 3, 1) == F.substring(m, 6, 1))
    leap_day = (month == "02") & (day == "29")
    in_1999 = lambda d: F.struct(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), d.cast("int")), "MM").alias("m"), F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), d.cast("int")), "dd").alias("d"))
    dated = lambda y, md: F.struct(y.alias("y"), md["m"].alias("m"), md["d"].alias("d"))
    # 365 days of any year, those beyond the twelfth of a month where it comes first; the 49 leap days of the span among themselves.
    in_common = F.dayofyear(F.make_date(F.lit(1999), month.cast("int"), F.when(leap_day, 28).otherwise(day.cast("int")))).cast("long") - 1
    common = with_value(feistel(y - 1900, in_common, 200, 365, "date", key), lambda p: dated(p["l"] + 1900, in_1999(p["r"])))
    late = with_value(feistel(y - 1900, in_common - 12 * month.cast("long"), 200, 221, "late", key), lambda p: dated(p["l"] + 1900, in_1999(p["r"] + 12 * F.size(F.filter(F.array(*map(F.lit, LATE_DAYS)), lambda c: c <= p["r"])))))
    rank = F.floor((y - 1904) / 4).cast("long")
    leap = with_value(feistel(F.floor(rank / 7).cast("long"), F.pmod(rank, F.lit(7)), 7, 7, "leap", key), lambda p: F.struct((1904 + 4 * (p["l"] * 7 + p["r"])).alias("y"), F.lit("02").alias("m"), F.lit("29").alias("d")))
    digits = lambda p: F.when(iso, F.concat(padded(p["y"], 4), p["m"], p["d"])).when(us, F.concat(p["m"], p["d"], padded(p["y"], 4))).otherwise(F.concat(p["d"], p["m"], padded(p["y"], 4)))
    new = with_value(F.when(leap_day, leap).when(us, late).otherwise(common), lambda p: refilled(m, digits(p)))
    return F.when(date.isNotNull() & (y >= 1900) & (y <= 2099) & same_separators, new).otherwise(m)


def _mail(m: Column, key: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(key, F.lit("|mail|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def kind_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        # the whole match, whose surroundings were already looked at
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def replacement(match: Column, key: Column) -> Column:
    makers = {"mail": _mail, "phone": _phone, "date": _date, "address": _address, "ssn": _ssn, "card": _card}
    kind = kind_of(match)
    out = match
    for name, make in makers.items():
        out = F.when(kind == name, make(match, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs(text, ...) with pseudonyms in text and two more columns: n_personal (values replaced) and
    personal_kinds (kind of each, in order). Columns of these names are replaced."""
    text = F.col("text").cast("string")
    name = free_name(docs, "personal_key")
    cut = free_name(docs, "personal_pieces")
    secret = docs.sparkSession.createDataFrame([(key,)], f"{name} string")

    def pieces(pattern: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(m.alias("old"), replacement(m, F.col(name)).alias("new"), kind_of(m).alias("kind")))
        return F.struct(F.split(text, pattern, -1).alias("between"), found.alias("found"))

    rows = docs.crossJoin(F.broadcast(secret)).withColumn("text", text).withColumn(cut, F.when(text.rlike(HINT) & text.rlike(ANY), with_value(pattern_of(text), pieces)))
    tail = F.concat(F.transform(f"{cut}.found", lambda f: f["new"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(f"{cut}.between", tail, lambda b, n: F.concat(b, n)), "")
    changed = F.filter(f"{cut}.found", lambda f: f["old"] != f["new"])
    return rows.select(
        *(F.coalesce(F.when(F.col(cut).isNotNull(), whole), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_personal", "personal_kinds")),
        F.coalesce(F.size(changed), F.lit(0)).cast("long").alias("n_personal"),
        F.coalesce(F.array_join(F.transform(changed, lambda f: f["kind"]), ","), F.lit("")).alias("personal_kinds"),
    )
