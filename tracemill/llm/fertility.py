"""Quality rules on word statistics and on how public vocabularies cut a text.

Base rules need only the text. The method adds tokeniser fertility: characters per token under a
byte-level vocabulary, share of byte-fallback tokens and entropy of the tokens under a vocabulary
with byte fallback. Each measure is compared with a band: middle plus or minus WIDTH spreads, wider
by sqrt(1 + SHORT / n_tokens), since the measures of short texts spread more. Bands are fixed
parameters, so a row's verdict depends on the row alone, and every text gets one. Those of languages
are the caller's: ``fit_bands`` takes them from rows that are known to be good. BANDS are for corpora
like the documents of sf0.1, whose prose is invented; ordinary writing has more characters a token.
For scripts, and texts of no given or no known language or without letters, there are no labels: their
bands are wide, assumed from the bytes of a letter, and reject what no writing in that script gives.

Nulls: a null text is an empty one and fails the base rules; a null doc_id is kept as it is;
repeated rows are judged alike. The result carries every column of the input in the struct ``doc``,
so no name can clash.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.text_blocks import blocks, split_at_white_space, texts_of
from tracemill.llm.token_units import MARKS, UnitEncoder
from tracemill.llm.worker_cache import hold

WIDTH = 4.0
SHORT = 300.0
FLOOR = {"chars_per_token": 0.03, "byte_share": 0.02, "entropy": 0.1}
#: By language and measure: middle, its slope over log2(n_tokens), spread; of the good documents of sf0.1.
BANDS = {
    "de": {"chars_per_token": (2.035, 0.0, 0.033), "byte_share": (0.0, 0.0, 0.02), "entropy": (4.914, 0.162, 0.1)},
    "en": {"chars_per_token": (2.243, 0.0, 0.036), "byte_share": (0.0, 0.0, 0.02), "entropy": (4.693, 0.202, 0.1)},
    "es": {"chars_per_token": (1.768, 0.0, 0.034), "byte_share": (0.0, 0.0, 0.02), "entropy": (4.826, 0.174, 0.107)},
    "fr": {"chars_per_token": (1.851, 0.0, 0.036), "byte_share": (0.0, 0.0, 0.02), "entropy": (5.023, 0.145, 0.1)},
}
#: Likewise for scripts, assumed, by the UTF-8 bytes of a letter: from a token a byte to whole words; any byte share but for Latin.
SCRIPT_BANDS = {
    1: {"chars_per_token": (3.2, 0.0, 0.5), "byte_share": (0.0, 0.0, 0.03), "entropy": (6.0, 0.0, 0.75)},
    2: {"chars_per_token": (1.5, 0.0, 0.28), "byte_share": (0.5, 0.0, 0.125), "entropy": (6.0, 0.0, 0.6)},
    3: {"chars_per_token": (1.1, 0.0, 0.21), "byte_share": (0.5, 0.0, 0.125), "entropy": (6.0, 0.0, 0.6)},
}
TWO_BYTES = ["greek", "cyrillic", "armenian", "hebrew", "arabic"]
KEEP_WORDS = 700_000
KEEP_CHARS = 64
SYMBOLS = b"#*$%&|<>"
LETTERS = re.compile(r"[^\W\d_]")
#: First code point of a block, by script; Latin is what comes before them.
BLOCKS = [(0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2C00, "other"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens"]
MEASURES = ["chars_per_token", "byte_share", "entropy"]


def letters_of(text: str) -> Counter:
    """Number of letters by script."""
    found: Counter = Counter()
    for c, n in Counter(LETTERS.findall(text)).items():
        name = "latin"
        for low, script in BLOCKS:
            if ord(c) < low:
                break
            name = script
        found[name] += n
    return found


def main_script(found: Counter) -> str:
    """The script of most letters; "none" without letters."""
    return max(found, key=lambda s: (found[s], s), default="none")


def repeated_words(windows: np.ndarray) -> int:
    """Words of a text in three-word windows that occur twice or more, of the windows' codes in order."""
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows) + 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice[2:] |= twice[1:-1] | twice[:-2]
    twice[1] |= twice[0]
    return int(twice.sum())


def window_codes(order: np.ndarray, distinct: int) -> np.ndarray:
    """A code of every three neighbouring words, of numbers below distinct."""
    order = order.astype(np.int64)
    if distinct < 1 << 21:
        return (order[:-2] * distinct + order[1:-1]) * distinct + order[2:]
    pairs = np.unique(order[:-1] * distinct + order[1:], return_inverse=True)[1]
    return pairs[:-1] * distinct + order[2:]


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class Fertility:
    """What both vocabularies make of words, each distinct word encoded once per worker."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.units = UnitEncoder(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        size = self.pieces.get_piece_size()
        self.kind = "H" if size <= 1 << 16 else "I"
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(size)])
        #: By word: tokens of the byte-level vocabulary, Latin letters, ids of pieces.
        self.known: dict[str, tuple[int, int, bytes]] = {"": (0, 0, b"")}
        self.others: dict[str, Counter] = {}  # letters by script of words that hold others

    def _learn(self, words: list[str]) -> dict[str, tuple]:
        found = {}
        for word, n, ids in zip(words, self.units.sizes(words), self.pieces.encode(words, num_threads=1), strict=True):
            bare = word.rstrip(MARKS)
            if not bare or bare.isalpha() and (bare.isascii() or max(bare) < "\u0370"):
                latin = len(bare)
            else:
                letters = letters_of(word)
                latin = letters.pop("latin", 0)
                if letters:
                    self.others[word] = letters
            found[word] = (n, latin, array(self.kind, ids).tobytes())
        return found

    def measure(self, texts: pa.Array) -> list[tuple]:
        """Per text the values of COUNTS and MEASURES, and the script."""
        words = split_at_white_space(texts)
        distinct = words.distinct
        if len(self.known) + len(distinct) > KEEP_WORDS:
            self.known, self.others = {"": self.known[""]}, {}
        own = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(own) if x is None]
        new = self._learn([distinct[i] for i in missing])
        for i in missing:
            own[i] = new[distinct[i]]
        other = {i: self.others[w] for i, w in enumerate(distinct) if w in self.others} if self.others else {}
        self.known.update(new)
        for w in new:
            if len(w) > KEEP_CHARS:
                del self.known[w]
                self.others.pop(w, None)

        # Empty words at the ends of texts are left out of all counts.
        full = (words.lengths > 0)[words.order]
        order = words.order[full]
        bounds = np.concatenate([[0], np.cumsum(full)])[words.bounds]
        n_bpe = np.fromiter((x[0] for x in own), np.int64, len(own))
        n_chars = words.lengths
        latin = np.fromiter((x[1] for x in own), np.int64, len(own))
        mixed = np.isin(np.arange(len(own)), list(other))
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[order])])[bounds]).tolist()
        sums = list(zip(total(n_bpe), total(n_chars), total(latin), total(mixed), strict=True))
        windows = window_codes(order, len(distinct)) if len(order) > 2 else order[:0]
        numbers, bounds, ids_of, out = order.tolist(), bounds.tolist(), [x[2] for x in own].__getitem__, []
        for raw, a, b, (bpe, chars, of_latin, of_mixed) in zip(texts.cast(pa.binary()).to_pylist(), bounds, bounds[1:], sums, strict=False):
            ids = np.frombuffer(b"".join(map(ids_of, numbers[a:b])), self.kind)
            n, n_bytes = len(ids), int(np.count_nonzero(self.is_byte[ids]))
            ordered = np.sort(ids)
            ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), n - 1) if n else ordered
            p = np.diff(ends, prepend=-1) / max(n, 1)
            letters = Counter({"latin": of_latin} if of_latin else {})
            if of_mixed:
                for k, times in Counter(k for k in numbers[a:b] if k in other).items():
                    letters.update({s: c * times for s, c in other[k].items()})
            out.append((
                b - a, chars, len(raw) - len(raw.translate(None, SYMBOLS)), repeated_lines(raw), repeated_words(windows[a : b - 2]) if b - a > 2 else 0, n, n_bytes,
                chars / bpe if bpe else 0.0, n_bytes / n if n else 0.0, float(-(p * np.log2(p)).sum()) + 0.0, main_script(letters),
            ))
        return out


def _measure(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str) -> Iterator[pa.RecordBatch]:
    fertility = hold(("fertility", byte_path, piece_path), lambda: Fertility(byte_path, piece_path))
    text = lambda batch: texts_of(pc.struct_field(batch.column(0), "text"))
    kinds = [*[pa.int64()] * len(COUNTS), *[pa.float64()] * len(MEASURES), pa.string()]
    for part in blocks(batches, text):
        columns = zip(*fertility.measure(text(part)), strict=True)
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", *COUNTS, *MEASURES, "script"])


def measured(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Each row of docs(text, ...) as ``doc`` with its counts, measures and script."""
    source = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("doc"))
    schema = T.StructType([source.schema["doc"], *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in MEASURES), T.StructField("script", T.StringType())])
    return source.mapInArrow(lambda it: _measure(it, byte_path, piece_path), schema)


def fit_bands(rows: DataFrame) -> dict[str, dict[str, tuple[float, float, float]]]:
    """Bands by language of measured rows that are known to be good; one row a language comes to the driver.

    A measure's middle is its median and its spread half the distance between the 16th and the 84th
    percentile, FLOOR at least; the entropy's middle is a line over log2(n_tokens).
    """
    good = rows.filter(~failed() & F.col("doc.lang").isNotNull()).select(F.col("doc.lang").alias("lang"), "n_tokens", *MEASURES).withColumn("n_log", F.log2("n_tokens"))
    slopes = good.groupBy("lang").agg(F.coalesce(F.regr_slope("entropy", "n_log"), F.lit(0.0)).alias("slope"))
    rest = good.join(slopes, "lang").withColumn("entropy", F.col("entropy") - F.col("slope") * F.col("n_log"))
    found = rest.groupBy("lang").agg(F.first("slope").alias("slope"), *(F.percentile_approx(m, [0.16, 0.5, 0.84], 10_000).alias(m) for m in MEASURES)).collect()
    return {r["lang"]: {m: (r[m][1], r["slope"] if m == "entropy" else 0.0, max((r[m][2] - r[m][0]) / 2, FLOOR[m])) for m in MEASURES} for r in found}


def _inside(band: dict[str, tuple[float, float, float]]) -> Column:
    """Whether a row lies in a band."""
    n = F.greatest("n_tokens", F.lit(1))
    width = WIDTH * F.sqrt(1 + SHORT / n)
    inside = F.lit(True)
    for m, (middle, slope, spread) in band.items():
        inside &= F.abs(F.col(m) - (middle + slope * F.log2(n))) <= width * spread
    return inside


def failed() -> Column:
    """Whether a measured row fails the base rules."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(rows: DataFrame, bands: dict[str, dict[str, tuple[float, float, float]]]) -> DataFrame:
    """measured rows with base_failed and kept. bands: by language, as of fit_bands; other texts go by their script."""
    lang = F.col("doc.lang").cast("string") if "lang" in rows.schema["doc"].dataType.names else F.lit(None).cast("string")
    inside = F.when(F.col("script") == "latin", _inside(SCRIPT_BANDS[1])).when(F.col("script").isin(*TWO_BYTES), _inside(SCRIPT_BANDS[2])).otherwise(_inside(SCRIPT_BANDS[3]))
    for name, band in bands.items():
        inside = F.when(lang == name, _inside(band)).otherwise(inside)
    return rows.withColumn("base_failed", failed()).withColumn("kept", ~failed() & inside)
