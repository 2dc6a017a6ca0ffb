"""SentencePiece models run by the tokenizers library.

The model file is a protocol buffer; the few fields that matter are read here and the tokenizer is
rebuilt from them: normaliser, metaspace marker, unigram scores or the merges that a BPE model
implies, and byte fallback. What it gives is checked against the sentencepiece library itself.

Where no piece holds the marker after another character, nothing is merged over a space that stands
alone under a BPE model, and each distinct word is encoded once per worker; other texts are encoded
whole. Only normal
and user-defined pieces are found in a text: in a unigram model the others keep their ids under
names that no normalised text can hold, and what no piece covers falls back to bytes afterwards. Ids
are decoded by a table of the pieces' bytes; where these are no text, the tokenizers library decides.

Nulls: a null text is an empty one; rows with null or repeated ids are separate rows. Decoding
gives the normalised text; a null list of ids decodes to null.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.text_blocks import blocks, split_at_spaces, texts_of
from tracemill.llm.worker_cache import hold

MARK = "▁"
NO_TEXT = "\uffff"  # no character
BYTE_NAME = re.compile(r"<0x([0-9A-Fa-f]{2})>")
LINES = 100  # words in one call's text
ROWS, BYTES = 512, 2 << 20  # texts at once: encoding and decoding have a worker each
KEEP_UNITS = 250_000
KEEP_CHARS = 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

ENCODED = "doc_id long, ids binary, n_tokens long, n_byte_tokens long, parity boolean"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers for varints, bytes for everything else."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, kind), and the settings that encoding depends on."""
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            model |= {"model_type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "unk_id": spec.get(40, 0)}
        elif number == 3:
            spec = dict(fields(value))
            model |= {"charsmap": spec.get(2, b""), "add_dummy_prefix": bool(spec.get(3, 1)), "remove_extra_whitespaces": bool(spec.get(4, 1)), "escape_whitespaces": bool(spec.get(5, 1))}
    return model


def implied_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """A BPE model joins the pair whose joined piece scores best, so every split of a piece into two
    pieces is a merge, in order of the joined piece's score."""
    known = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for text, i in known.items():
        for cut in range(1, len(text)):
            left, right = known.get(text[:cut]), known.get(text[cut:])
            if left is not None and right is not None:
                found.append((-pieces[i][1], i, left, right))
    found.sort()
    return [(pieces[left][0], pieces[right][0]) for _, _, left, right in found]


def rebuild(model: dict):
    """The tokenizers-library Tokenizer of a parsed model, and whether words may be encoded alone."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if model["model_type"] == BPE:
        core = models.BPE(vocab={text: i for i, (text, _, _) in enumerate(pieces)}, merges=implied_merges(pieces), unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    elif model["model_type"] == UNIGRAM:
        found = [score for _, score, kind in pieces if kind in (NORMAL, USER_DEFINED)]
        hide = (" " if model["escape_whitespaces"] else "") + NO_TEXT  # a normalised text has no space of its own
        core = models.Unigram([(text, score) if kind in (NORMAL, USER_DEFINED) else (hide + text, min(found, default=0.0)) for text, score, kind in pieces], unk_id=model["unk_id"], byte_fallback=False)
    else:
        raise ValueError("only unigram and BPE models are read")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["remove_extra_whitespaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    plain = not steps
    steps += [normalizers.Prepend(MARK)] if model["add_dummy_prefix"] else []
    steps += [normalizers.Replace(" ", MARK)] if model["escape_whitespaces"] else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    crossing = any(MARK in text.lstrip(MARK) for text, _, kind in pieces if kind == NORMAL)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["add_dummy_prefix"] else [])])
    own = [text for text, _, kind in pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens([AddedToken(text, normalized=False) for text in own])
    # A unigram model weighs whole texts: rounding over a long one can decide between cuts that score alike.
    by_word = model["model_type"] == BPE and plain and not crossing and not own and model["add_dummy_prefix"] and model["escape_whitespaces"]
    return tokenizer, by_word


def piece_bytes(pieces: list[tuple[str, float, int]]) -> list[bytes]:
    """What each id stands for in a decoded text, the marker as a space."""
    return [bytes([int(m[1], 16)]) if (m := BYTE_NAME.fullmatch(text)) else text.replace(MARK, " ").encode() for text, _, _ in pieces]


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes, with parity against the sentencepiece library."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self._tokenizer, self.by_word = None, False
        pieces = self.model["pieces"]
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.table = piece_bytes(pieces)
        # Unigram: the byte ids of what no piece covers
        self.fallback = {int(m[1], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE and (m := BYTE_NAME.fullmatch(text))} if self.model["model_type"] == UNIGRAM and self.model["byte_fallback"] else {}
        self.path, self.line, self.theirs = path, None, None
        self.units: dict[str, bytes] = {}
        self.unlike: set[str] = set()  # held words that the sentencepiece library cuts in another way

    @property
    def tokenizer(self):
        """Made when it is first wanted: most decoding does without."""
        if self._tokenizer is None:
            self._load()
        return self._tokenizer

    def _load(self) -> None:
        self._tokenizer, self.by_word = rebuild(self.model)
        pieces = self.model["pieces"]
        # BPE: the id of a line break that no piece holds, which parts the ids of words
        if self.by_word and self.model["model_type"] == BPE and self.model["byte_fallback"] and not any("\n" in text for text, _, _ in pieces):
            self.line = next((i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE and text == "<0x0A>"), None)
        if hasattr(self._tokenizer.model, "_resize_cache"):
            self._tokenizer.model._resize_cache(0)  # words are held here

    def verifying(self) -> PieceEncoder:
        """self, with the sentencepiece library at hand."""
        if self.theirs is None:
            import sentencepiece

            self.theirs = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self.units, self.unlike = {}, set()
        return self

    def _call(self, texts: list[str]) -> list[bytes]:
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = e.ids
            if self.fallback and self.model["unk_id"] in ids:
                e = self.tokenizer.encode(text, add_special_tokens=False)  # the fast call does not tell the characters
                ids = list(chain.from_iterable([self.fallback[b] for b in t.encode()] if i == self.model["unk_id"] else [i] for i, t in zip(e.ids, e.tokens, strict=True)))
            out.append(array("I", ids).tobytes())
        return out

    def _ours(self, texts: list[str]) -> list[bytes]:
        if self.line is None:
            return self._call(texts)
        own = [t for t in texts if "\n" not in t and " " not in t]
        groups = [own[i : i + LINES] for i in range(0, len(own), LINES)]
        found = {}
        for group, raw in zip(groups, self._call(["\n ".join(g) for g in groups]), strict=True):
            cuts = (np.flatnonzero(np.frombuffer(raw, np.uint32) == self.line) * 4).tolist()
            found.update(zip(group, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True)], strict=True))
        others = [t for t in texts if t not in found]
        found.update(zip(others, self._call(others), strict=True))
        return [found[t] for t in texts]

    def _encode(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each text, and whether the sentencepiece library gives the same."""
        ours = self._ours(texts)
        same = np.ones(len(texts), bool)
        if self.theirs and texts:
            theirs = self.theirs.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
            same = sizes * 4 == np.fromiter(map(len, ours), np.int64, len(ours))
            a, b = np.frombuffer(b"".join(ours), np.uint32), np.fromiter(chain.from_iterable(theirs), np.uint32, int(sizes.sum()))
            if not same.all() or not np.array_equal(a, b):
                same = np.array([x == array("I", y).tobytes() for x, y in zip(ours, theirs, strict=True)])
        return ours, same

    def encode(self, texts: list[str] | pa.Array) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and parity."""
        texts = texts_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(texts):
            return [], []
        if not (self.tokenizer and self.by_word):
            ours, same = self._encode(texts.to_pylist())
            return ours, same.tolist()
        words = split_at_spaces(texts)
        distinct = words.distinct
        if len(self.units) + len(distinct) > KEEP_UNITS:
            self.units, self.unlike = {}, set()
        ids = list(map(self.units.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None and distinct[i]]
        found, same = self._encode([distinct[i] for i in missing])
        unlike = set(self.unlike) if self.unlike else set()
        for i, raw, fine in zip(missing, found, same.tolist(), strict=True):
            ids[i] = raw
            if not fine:
                unlike.add(distinct[i])
            if len(distinct[i]) <= KEEP_CHARS:
                self.units[distinct[i]] = raw
                if not fine:
                    self.unlike.add(distinct[i])
        odd = words.texts_with(np.fromiter((w in unlike for w in distinct), bool, len(distinct))) if unlike else []
        parity = np.ones(len(texts), bool)
        parity[odd] = False
        of_number, order, bounds = ids.__getitem__, words.order.tolist(), words.bounds.tolist()
        # Spaces side by side, or at an end, are no spaces between words.
        whole = {i: texts[i].as_py() for i in words.texts_with(np.fromiter((not w for w in distinct), bool, len(distinct))).tolist()}
        out = [b"" if i in whole else b"".join(map(of_number, order[a:b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
        apart = [i for i, t in whole.items() if t]
        for i, raw, fine in zip(apart, *self._encode([whole[i] for i in apart]), strict=True):
            out[i], parity[i] = raw, fine
        return out, parity.tolist()

    def n_bytes(self, raw: bytes) -> int:
        return int(np.count_nonzero(self.is_byte[np.frombuffer(raw, np.uint32)]))

    def decode(self, rows: list[bytes]) -> list[str]:
        out, of_id = [], self.table.__getitem__
        for raw in rows:
            whole = b"".join(map(of_id, memoryview(raw).cast("I").tolist()))
            try:
                text = whole.decode()
                out.append(text[1:] if self.model["add_dummy_prefix"] and text[:1] == " " else text)
            except UnicodeDecodeError:  # bytes that are no text
                out.append(self.tokenizer.decode(memoryview(raw).cast("I").tolist(), skip_special_tokens=False))
        return out


def piece_encoder(path: str, threads: int) -> PieceEncoder:
    """The worker's encoder for this file; encoding and decoding share it."""
    return hold(("pieces", path, threads), lambda: PieceEncoder(path, threads))


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, verify: bool, threads: int) -> Iterator[pa.RecordBatch]:
    enc = piece_encoder(path, threads)
    if verify:
        enc.verifying()
    for rows in blocks(batches, 1, ROWS, BYTES):
        found, parity = enc.encode(rows.column(1))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(list(map(enc.n_bytes, found)), pa.int64()), pa.array(parity)],
            names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "parity"],
        )


def encode_pieces(docs: DataFrame, model_path: str, verify: bool = True, threads: int = 2) -> DataFrame:
    """docs(doc_id, text) as doc_id, ids (little-endian unsigned 32-bit), n_tokens, n_byte_tokens and
    parity: whether the sentencepiece library gives the same ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode_batches(it, model_path, verify, threads), ENCODED)


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, threads: int) -> Iterator[pa.RecordBatch]:
    enc = piece_encoder(path, threads)
    for rows in blocks(batches, "ids", ROWS, 4 * BYTES):
        ids = rows.column("ids").to_pylist()
        texts = enc.decode([x or b"" for x in ids])
        yield rows.append_column("text", pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string()))


def decode_pieces(encoded: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """encoded rows with one more column, text; any text column there was is replaced."""
    rows = encoded.drop("text")
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    return rows.mapInArrow(lambda it: _decode_batches(it, model_path, threads), schema)
