"""Secrets in text: fixed shapes, and random strings found by a battery of randomness tests.

Base kinds are assignments to secret names, access keys and long hexadecimal runs. The method looks
at every other run of at least MIN_LENGTH token characters. Its encoding (decimal, hexadecimal, base
32, base 36 or base 64) is inferred from the characters it uses. A run's p-value is against the
hypothesis of an ordinary identifier, a Markov chain over letters, digits and separators (COSTS, fitted
once on words of the documents of sf0.1 and of Python's library, and CLASS_COSTS, assumed): the
likelihood of the run under that chain over its likelihood as uniformly random characters of the
inferred alphabet, which by Markov's inequality bounds the p-value. Three tests of randomness, chi-squared
over the characters, runs of characters above and below the alphabet's middle, and lag-one serial
correlation, enter the same p-value: it is divided by their least p-value times three, so that what is
repetitive or in order is no finding either. Benjamini-Hochberg bounds the false discovery rate at FDR
within each class of length and encoding, since the power of all tests, and so the mix of findings,
depends on both. The ranks come from a histogram of p-values whose size is fixed, so no candidate list
is ever gathered. Runs of digits alone are tested too; since an ordinary number's digits are as random as
a key's, only their length speaks against an identifier.

Nulls: a null text is an empty one; repeated rows and null ids are judged row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.numbers import normal_tail
from tracemill.llm.shared import written
from tracemill.llm.text_spans import apart, spans, with_value

#: The patterns of the base kinds.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same spans as AKIA[A-Z0-9]+ of 16 or more characters
HEX = r"[0-9a-f]{32,}"  # likewise, since runs are maximal
MIN_VALUE = 8
KINDS = ["assign", "access", "hex", "random"]

MIN_LENGTH = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
FDR = 0.01
LENGTH_CLASSES = [20, 28, 40, 64, 128]
BINS = 400  # of minus the decimal logarithm of p, in steps of 0.05

#: Tenths of bits of a letter (a to z) at the start of a word, then after each letter (a to z).
COSTS = "".join([
    "3155515025676454448677476045286068454826586763939678",
    "5061434944997262418394536218497579403926358572979199",
    "6279809015939999648099119693338799697090689999996099",
    "5499758856949906339960658790319499657656689899998199",
    "3755717523868544299999539547209199454335689456999899",
    "3362613940887459369384527025517377213348607572859962",
    "3154657624556845409970539461276899344926597171998570",
    "2551689114986544449973508248436999504241637061999971",
    "2350689916997044429971529546396999544237707056999971",
    "5370417227837172649199606214267476605031917384959983",
    "0199768751919991659577859195578199877391569995999199",
    "5878667203767070499990628667697392685072778969998199",
    "3885747213968799329199317895548689797269729999992099",
    "3663797509889184209986736280474699795869629999997999",
    "4052583030903047449274527549396978524324696859999977",
    "6075646863327691518295686213657683284463269179999999",
    "1884717438158665529989458780425595395752619178996199",
    "9099869694999999999999879994969673847196019999999999",
    "3351607712966647438970536950406885424339666960998873",
    "4462306737976923487188605965477069525516589972998599",
    "4261739930998116219984629160427699475248757968998548",
    "4251588918746855499972506225455673504741726470319974",
    "4483849708918399179999838889438599818386999993999999",
    "4198848462929902449999839969679399696889999994939999",
    "3173416825558973419997454884303848416929804685667391",
    "3748757824859638389999467136315399443531948448999191",
    "4048486734965559516760555999636171615048106099999961",
])
#: Bits of a letter, a digit and a separator as the next character, after each of them; one of ten digits and of four separators.
CLASS_COSTS = [[0.2, 4.1, 3.6], [2.3, 0.7, 2.3], [0.4, 2.3, 4.3]]
SWITCH_COSTS = [0.2, 2.7]  # of the same and the other case of two letters in a row, in a run of both cases

#: Alphabets by encoding, in order of their digits.
ALPHABETS = {
    10: "0123456789",
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "0123456789abcdefghijklmnopqrstuvwxyz",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def encoding(token: Column) -> Column:
    """Size of the inferred alphabet."""
    return (
        F.when(token.rlike("^[0-9]+$"), 10)
        .when(token.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 16)
        .when(token.rlike("^[A-Z2-7]+$"), 32)
        .when(token.rlike("^[0-9a-z]+$|^[0-9A-Z]+$"), 36)
        .otherwise(64)
    )


def characters(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def digits(token: Column, size: Column) -> Column:
    """The token's characters as numbers below size; url-safe characters count as their base-64 twins."""
    folded = F.when(size == 32, token).when(size < 64, F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    alphabet = F.when(size <= 16, ALPHABETS[16]).when(size == 32, ALPHABETS[32]).when(size == 36, ALPHABETS[36]).otherwise(ALPHABETS[64])
    return with_value(F.struct(characters(folded).alias("c"), alphabet.alias("a")), lambda x: F.transform(x["c"], lambda c: (F.call_function("instr", x["a"], c) - 1).cast("double")))


def identifier_bits(token: Column, size: Column) -> Column:
    """Minus the binary logarithm of the token's likelihood as an ordinary identifier."""
    # letter: 1 to 26, or 0; kind: letter, digit or separator
    letter = lambda c: F.call_function("instr", F.lit("abcdefghijklmnopqrstuvwxyz"), F.lower(c))
    seen = F.transform(characters(token), lambda c: with_value(F.struct(letter(c).alias("n"), c.alias("c")), lambda x: F.struct(x["n"].alias("letter"), F.when(x["n"] > 0, 0).when(x["c"].between("0", "9"), 1).otherwise(2).alias("kind"), ((x["n"] > 0) & x["c"].between("A", "Z")).alias("upper"))))
    bigrams = F.array(*(F.lit(int(COSTS[i : i + 2]) / 10) for i in range(0, len(COSTS), 2)))
    classes = F.array(*(F.lit(c) for row in CLASS_COSTS for c in row))

    def bits(a: Column, b: Column, size: Column) -> Column:
        within = F.when(b["kind"] == 0, bigrams[a["letter"] * 26 + b["letter"] - 1]).when(b["kind"] == 1, math.log2(10)).otherwise(2.0)
        case = F.when((size != 64) | (b["kind"] != 0), 0.0).when(a["kind"] != 0, 1.0).when(a["upper"] == b["upper"], SWITCH_COSTS[0]).otherwise(SWITCH_COSTS[1])
        return classes[a["kind"] * 3 + b["kind"]] + within + case

    def total(x: Column) -> Column:
        before = F.concat(F.array(F.struct(F.lit(0).alias("letter"), F.lit(2).alias("kind"), F.lit(False).alias("upper"))), F.slice(x["seen"], 1, F.size(x["seen"]) - 1))
        return F.aggregate(F.zip_with(before, x["seen"], lambda a, b: bits(a, b, x["size"])), F.lit(0.0), lambda acc, v: acc + v)

    return with_value(F.struct(seen.alias("seen"), size.alias("size")), total)


def squared_counts(numbers: Column) -> Column:
    """Sum over distinct numbers of their squared counts, by the runs of the sorted array."""
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(acc: Column, v: Column) -> Column:
        run = F.when(acc["last"] == v, acc["run"] + 1).otherwise(F.lit(1.0))
        return F.struct(v.alias("last"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total"))  # n squared is the sum of the first n odd numbers

    return F.aggregate(F.sort_array(numbers), start, step, lambda acc: acc["total"])


def battery(token: Column) -> Column:
    """struct(size, score): the alphabet, and minus the decimal logarithm of the p-value against an identifier."""
    def prepared(x: Column) -> Column:
        d = digits(x["token"], x["size"])
        pairs = lambda d: F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return with_value(d, lambda d: F.struct(x["size"].cast("double").alias("k"), F.length(x["token"]).cast("double").alias("n"), squared_counts(d).alias("squares"), pairs(d).alias("pairs"), identifier_bits(x["token"], x["size"]).alias("bits")))

    def tests(x: Column) -> Column:
        k, n, pairs = x["k"], x["n"], x["pairs"]
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
        chi = k / n * x["squares"] - n
        df = k - 1
        # Wilson-Hilferty: the cube root of chi-squared over its mean is nearly normal.
        z_chi = (F.pow(F.greatest(chi / df, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 < k) != (p["b"] * 2 < k))).cast("double")
        z_runs = F.abs(turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        mean, var = (k - 1) / 2, (k * k - 1) / 12
        serial = total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))) / var
        z_serial = F.abs(serial) / F.sqrt(n - 1)
        least = F.least(normal_tail(z_chi), 2 * normal_tail(z_runs), 2 * normal_tail(z_serial))
        uniform = F.greatest(F.least(3 * least, F.lit(1.0)), F.lit(1e-300))
        ratio = x["bits"] - n * F.log2(k) - math.log2(len(ALPHABETS))  # the alphabet was chosen by its characters
        return F.struct(k.cast("int").alias("size"), F.greatest(ratio * math.log10(2) + F.log10(uniform), F.lit(0.0)).alias("score"))

    return with_value(with_value(F.struct(token.alias("token"), encoding(token).alias("size")), prepared), tests)


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, found and candidates: base spans and tested spans, as a table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    of_kind = lambda k, c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    assign = F.filter(spans(F.col("text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], "^" + ASSIGN, 1)) >= MIN_VALUE)
    tested = F.transform(spans(F.col("text"), CANDIDATE), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), battery(s["text"]).alias("test"),
        sum(((F.length(s["text"]) >= c).cast("int") for c in LENGTH_CLASSES), F.lit(0)).alias("length_class"),
    ))
    return written(rows.select(
        "doc_id",
        F.concat(of_kind(0, assign), of_kind(1, spans(F.col("text"), ACCESS)), of_kind(2, spans(F.col("text"), HEX))).alias("found"),
        tested.alias("candidates"),
    ), "secret-candidates")


def thresholds(scanned: DataFrame) -> dict[tuple[int, int], int]:
    """The least bin of -log10(p) that Benjamini-Hochberg accepts, by class of length and encoding."""
    keys = ["length_class", "size"]
    one = scanned.select(F.explode("candidates").alias("c")).select(F.col("c.length_class").alias("length_class"), F.col("c.test.size").alias("size"), _bin(F.col("c.test.score")).alias("bin"))
    counts = one.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))  # at most classes x alphabets x BINS rows
    down = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    ranked = counts.withColumn("above", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy(*keys)))
    # A bin's largest p must be at most FDR x rank / m.
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 20) <= FDR * F.col("above") / F.col("m"))
    return {(r["length_class"], r["size"]): r["bin"] for r in passed.groupBy(*keys).agg(F.min("bin").alias("bin")).collect()}


def _bin(score: Column) -> Column:
    return F.least(F.floor(score * 20), F.lit(BINS - 1)).cast("int")


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id and spans: structs (start, kind, end), kind an index of KINDS, in order."""
    scanned = scan(docs)
    found = thresholds(scanned)
    accepted = F.filter("candidates", lambda c: F.coalesce(_bin(c["test"]["score"]) >= _least(c, found), F.lit(False)))
    new = F.when(F.size(accepted) > 0, apart(accepted, F.col("found"))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    as_spans = F.transform(new, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort("found").alias("base"), F.array_sort(F.concat("found", as_spans)).alias("spans"))


def _least(c: Column, found: dict[tuple[int, int], int]) -> Column:
    out = F.lit(None).cast("int")
    for (length_class, size), bin_ in found.items():
        out = F.when((c["length_class"] == length_class) & (c["test"]["size"] == size), F.lit(bin_)).otherwise(out)
    return out


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
