"""Regular-expression matches of a text column with their places, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 128
SPANS = "array<struct<start:int,end:int,text:string>>"


def cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """(what lies between the leftmost non-overlapping matches, the matches); the first is one longer.

    The pattern must not match the empty string.
    """
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_value(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(numbers: Column, f: Callable[[Column, Column], Column], start: int) -> Column:
    """f, which is associative and leaves x if the other is start, over an array of integers up to each
    place, by parts of PART, so that no long array grows by one."""
    add = lambda acc, x: F.concat(acc, F.array(f(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(start)), x)))
    each = lambda a: F.aggregate(a, F.array().cast("array<int>"), add)
    parts = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int")), lambda k: each(F.slice(a, k * PART + 1, F.lit(PART))))

    def whole(inner: Column) -> Column:
        ends = each(F.transform(inner, lambda p: F.element_at(p, -1)))
        before = F.concat(F.array(F.lit(start)), ends)
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda p, b: F.transform(p, lambda x: f(x, b))))

    return with_value(numbers, lambda a: F.when(F.size(a) > 0, with_value(parts(a), whole)).otherwise(F.array().cast("array<int>")))


def running_sums(numbers: Column) -> Column:
    return running(numbers, lambda a, b: a + b, 0)


def apart(spans_: Column, others: Column) -> Column:
    """The spans (structs with start and end) that overlap none of the others, by one sort of both.

    In the order of starts, the farthest end of the others so far and the nearest start of the others
    to come decide.
    """
    far = (1 << 31) - 1
    place = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    def decided(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(-1)), F.greatest, -1)
        starts = F.reverse(running(F.reverse(F.transform(m, lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(far))), F.least, far))
        sides = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("before"), s.alias("after")))
        clear = F.zip_with(m, sides, lambda x, o: F.when((x["kind"] == 1) & (o["before"] <= x["start"]) & (o["after"] >= x["end"]), F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.filter(clear, lambda x: x.isNotNull())

    return with_value(F.array_sort(F.concat(F.transform(others, place(0)), F.transform(spans_, place(1)))), decided)


def spans(text: Column, pattern: str) -> Column:
    """Matches as structs (start, end, text) in code points, end exclusive; empty for no match or null."""
    between, matches = cut(text, pattern)

    def placed(x: Column) -> Column:
        # two sizes a match: what lies before it, and its own
        sizes = F.flatten(F.zip_with(F.slice(x["between"], 1, F.size(x["matches"])), x["matches"], lambda b, m: F.array(F.length(b), F.length(m))))
        ends = running_sums(sizes)
        return with_value(ends, lambda e: F.transform(x["matches"], lambda m, i: F.struct(e[i * 2].alias("start"), e[i * 2 + 1].alias("end"), m.alias("text"))))

    found = with_value(F.struct(between.alias("between"), matches.alias("matches")), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))
