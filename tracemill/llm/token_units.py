"""Encoding whole texts with the tokenizers library, one white-space unit at a time.

A byte-level BPE file splits a text into pre-tokens before it merges anything, and with the usual
pattern no pre-token spans a single space between two non-space characters: the space belongs to
what follows. So a text is the concatenation of such units, and each distinct unit needs to be
encoded once per worker. Marks after a word's letters are pre-tokens of their own, so a word is
encoded apart from them. A word of letters is one pre-token; many of them reach the library at once,
in the file's byte alphabet, where only the space before each word is left to split at. For files
with another normaliser or pre-tokeniser, or added tokens that reach over spaces, whole texts go to
the library. Added tokens in a text are found as the library finds them.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from tracemill.llm.text_blocks import split_at_spaces, texts_of
from tracemill.llm.worker_cache import hold

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
STABLE = "԰"  # letters below are the same in every version of Unicode
WORDS = 500  # in one call's text
KEEP_UNITS = 1_000_000  # units held per worker, about 200 MB; when full, the cache starts again
KEEP_CHARS = 64  # longer units are encoded but not held


def splittable(spec: dict) -> bool:
    """Whether the file's pre-tokeniser lets texts be cut before single spaces."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and (spec.get("model") or {}).get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and bool(pre.get("use_regex", True))
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t["content"].isalpha() or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


def byte_alphabet() -> dict[int, str]:
    """By byte its character in byte-level files: itself if it is visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to encoding each whole text."""

    def __init__(self, path: str, keep: int = KEEP_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.has_added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.alphabet = byte_alphabet()
        self.by_unit = splittable(spec)
        if self.by_unit:
            self.of_letters = Tokenizer.from_file(path)
            self.of_letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of tokens that begin with a space
            self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(self.alphabet[0x20])]] = True
            for t in (self.tokenizer, self.of_letters):
                if hasattr(t.model, "_resize_cache"):
                    t.model._resize_cache(0)  # units are held here
        self.keep = keep
        self.after_space: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _in_alphabet(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)

    def _encode_letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of " " + word for distinct words of letters."""
        space, found = self.alphabet[0x20], {}
        groups = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
        texts = [" ".join([space + self._in_alphabet(w) for w in g]) for g in groups]
        for group, raw in zip(groups, self.of_letters.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(raw.ids, np.uint32)
            cuts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            raw = ids.tobytes()
            found.update(zip(group, [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))
        return found

    def _encode_units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of " " + unit for distinct units; words with marks are put together of both."""
        known, cut, others, words = self.after_space, [], [], set()
        for u in units:
            word = u.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or max(word) < STABLE) and (word == u or not self.has_added(u)):
                if word != u:
                    cut.append((u, word, u[len(word) :]))
                if word not in known:
                    words.add(word)
            else:
                others.append(u)
        found = self._encode_letters(list(words))
        found.update(zip(others, self._encode([" " + u for u in others]), strict=True))
        marks = list({m for _, _, m in cut} - self.marks.keys())
        self.marks.update(zip(marks, self._encode(marks), strict=True))
        for u, word, mark in cut:
            found[u] = (found.get(word) or known[word]) + self.marks[mark]
        return found

    def sizes(self, units: list[str]) -> list[int]:
        """Number of ids of " " + unit for distinct units without spaces; nothing is held."""
        found = self._encode_units(units) if self.by_unit else dict(zip(units, self._encode([" " + u for u in units]), strict=True))
        return [len(found[u]) // 4 for u in units]

    def _lookup(self, units: list[str]) -> list[bytes]:
        """Ids of " " + unit for distinct units, from what is held where that is possible."""
        if len(self.after_space) + len(units) > self.keep:
            self.after_space, self.marks = {}, {}
        found = list(map(self.after_space.get, units))
        missing = [i for i, x in enumerate(found) if x is None]
        new = self._encode_units([units[i] for i in missing])
        for i in missing:
            found[i] = new[units[i]]
        self.after_space.update(new)
        for unit in new:
            if len(unit) > KEEP_CHARS:
                del self.after_space[unit]
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text. Words become numbers of distinct words, whose ids are then put together."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = texts_of(texts)
        if not len(texts):
            return []
        if not self.by_unit:
            return self._encode(texts.to_pylist())
        words = split_at_spaces(texts)
        distinct, order, bounds = words.distinct, words.order.tolist(), words.bounds.tolist()
        # A space next to white space may belong to what comes before it.
        apart = words.texts_with(words.edged)
        parts = {i: BOUNDARY.split(texts[i].as_py()) for i in apart.tolist()}
        firsts = [parts[i][0] if i in parts else distinct[order[a]] for i, a in enumerate(bounds[:-1])]  # no space before it
        more = list({u for c in parts.values() for u in c[1:]}.difference(distinct))
        ids = self._lookup(distinct + more)
        place = {u: i for i, u in enumerate(distinct + more)} if parts else {}
        of_number, out = ids.__getitem__, []
        for i, first in enumerate(self._encode(firsts)):
            rest = [place[u] for u in parts[i][1:]] if i in parts else order[bounds[i] + 1 : bounds[i + 1]]
            out.append(first + b"".join(map(of_number, rest)))
        return out


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for this file."""
    return hold(("units", path), lambda: UnitEncoder(path))
