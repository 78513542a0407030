"""Token ids of texts by the tokenizers library, each distinct unit encoded once as long as it is kept.

A unit is a run of characters that the tokenizer encodes alike wherever it stands: a word between ASCII blanks, with the blanks before it
where the tokenizer keeps blanks. Units are cut and numbered over a whole slice of texts with Arrow; only units not met before reach
the library. Up to CACHE units are kept; beyond that those met in the fewest slices go.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from vestigia.llm import automata
from vestigia.llm.words import _BLANK, _LOWER, text_bytes

CACHE, PRETOKENS = 400_000, 300_000
KEPT_BYTES = 64
Fresh = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
# White space beyond ASCII (by UTF-8 bytes), and the control characters that some libraries count as white space.
WIDE_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def with_wide_blanks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold white space beyond ASCII. Their runs of blanks may not be cut before an ASCII blank."""
    out = np.zeros(len(offsets) - 1, bool)
    by_size: dict[int, set[bytes]] = {}
    for c in WIDE_BLANKS:
        by_size.setdefault(len(c.encode()), set()).add(c.encode())
    for size, marks in by_size.items():
        at = np.flatnonzero(np.isin(data, sorted({m[0] for m in marks})) if size > 1 else (data >= 0x1C) & (data <= 0x1F))
        hits = [p for p in at.tolist() if data[p:p + size].tobytes() in marks] if size > 1 else at
        out[np.searchsorted(offsets, hits, "right") - 1] = True
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words between blanks, and the index of each text's first (n + 1 entries)."""
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = solid[inner]
    at = np.flatnonzero(begins)
    places = np.concatenate([[0], np.cumsum(solid)])
    return _strings(data[solid], np.append(places[at], places[-1])), np.searchsorted(at, offsets)


def blank_led_words(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words with the blanks before them; texts marked in `whole` are one unit each."""
    blank = _BLANK[data]
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[:1] = False
    for i in np.flatnonzero(whole):
        begins[offsets[i]:offsets[i + 1]] = False
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(begins)
    return _strings(data, np.append(at, len(data))), np.searchsorted(at, offsets)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data.tobytes()))


class UnitIds:
    """Ids of slices of texts. `fresh` gives the ids of new units, one after the other, and the number of each."""

    # Tokenizers that drop blanks here also lower-case; ASCII letters are lowered before units are compared, unless an added token, which
    # is matched before that, may be in the slice.
    def __init__(self, fresh: Fresh, keeps_blanks: bool):
        self.fresh, self.keeps_blanks = fresh, keeps_blanks
        self.number: dict[str, int] = {}
        self.flat, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slices = np.zeros(0, np.int64)  # in how many each unit was met, halved whenever units are forgotten

    def _forget(self) -> None:
        keep = np.sort(np.argpartition(-self.slices, 2 * CACHE // 3)[:2 * CACHE // 3])
        new = np.full(len(self.slices), -1)
        new[keep] = np.arange(len(keep))
        self.number = {w: k for w, k in zip(self.number, new[np.fromiter(self.number.values(), np.int64, len(self.number))].tolist()) if k >= 0}
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.starts[keep] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.sizes, self.starts, self.slices = sizes, ends - sizes, self.slices[keep] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text's ids."""
        data, offsets = text_bytes(texts)
        if self.keeps_blanks:
            units, first = blank_led_words(data, offsets, with_wide_blanks(data, offsets))
        else:
            units, first = words_of(data if b"<|" in data.tobytes() else _LOWER[data], offsets)
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > CACHE:
            self._forget()
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            flat, sizes = self.fresh([words[k] for k in new])
            # Long units are kept for this slice only: they get numbers, but no entry.
            base = len(self.sizes)
            self.number.update((words[k], base + j) for j, k in enumerate(new) if len(words[k]) <= KEPT_BYTES)
            numbers[new] = np.arange(base, base + len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            self.slices = np.concatenate([self.slices, np.zeros(len(new), np.int64)])
        self.slices[numbers] += 1
        index = numbers[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        sizes = self.sizes[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[index] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[first[1:]] - ends[first[:-1]]


class _Pretokens:
    """Ids of pretokens by the library's model, kept as bytes. Two generations are kept: when the younger is full, it becomes the older one."""

    def __init__(self, tokenizer, fixed: dict[str, list[int]] | None = None):
        self.tokenize, self.fixed = tokenizer.model.tokenize, {w: array("I", x).tobytes() for w, x in (fixed or {}).items()}
        self.young, self.old = dict(self.fixed), {}

    def __call__(self, words: list[str], shown: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.young) > PRETOKENS:
            self.young, self.old = dict(self.fixed), self.young
        known, old, tokenize = self.young, self.old, self.tokenize
        for w in set(words) - known.keys():
            known[w] = old.get(w) or array("I", [t.id for t in tokenize(shown(w))]).tobytes()
        parts = list(map(known.__getitem__, words))
        return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _grouped(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ends[first[1:]] - ends[first[:-1]]


def _library(data: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data)


def byte_level(data: str, classes: np.ndarray) -> UnitIds:
    """For a byte-level tokenizer: new units are split by its finite-state splitter, new pretokens encoded by its model."""
    tokenizer = _library(data)
    special = automata.special_tokens(data)
    pattern = automata.special_pattern(special)
    characters = {b: c for c, b in automata._byte_characters().items()}
    ids = _Pretokens(tokenizer, {w: [i] for w, i in special.items()})

    def shown(word: str) -> str:
        if word.isascii() and word.isprintable():  # of these only the blank has another character
            return word.replace(" ", characters[0x20])
        return word.encode().decode("latin-1").translate(characters)

    def fresh(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if pattern and pattern.search("\n".join(units)):
            words, first = automata.split_texts(units, classes, pattern)
        else:
            words, first = automata.pretokens(units, classes)
        flat, sizes = ids(words, shown)
        return flat, _grouped(sizes, first)

    return UnitIds(fresh, True)


def _simple_letters() -> str:
    """Letters beyond ASCII, up to U+017F, that composition leaves alone and whose lower case is one letter."""
    letters = map(chr, range(0xC0, 0x180))
    return "".join(c for c in letters if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1)


def word_level(data: str) -> UnitIds:
    """For a tokenizer that drops blanks. New units of ASCII and Latin letters are split by the tokenizer's own pattern read over those letters
    and encoded by its model; all others are encoded by the whole tokenizer."""
    tokenizer, parts = _library(data), json.loads(data)
    pattern = automata.special_pattern(automata.special_tokens(data))
    rule = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if [n["type"] for n in parts["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [
            p["type"] for p in parts["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
        raise ValueError("a tokenizer of another make")
    letters = _simple_letters()
    split = re.compile(rule.replace(r"\p{L}", "a-z" + letters).replace(r"\p{N}", "0-9"), re.ASCII)
    is_plain = re.compile(f"[\x21-\x7e{letters}]+").fullmatch
    characters = {b: c for c, b in automata._byte_characters().items()}

    def shown(word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(characters)
    ids = _Pretokens(tokenizer)

    def fresh(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple = np.fromiter((is_plain(u) is not None for u in units), bool, len(units))
        if pattern and pattern.search("\n".join(units)):
            simple &= np.fromiter((pattern.search(u) is None for u in units), bool, len(units))
        easy = [u.lower() for u, s in zip(units, simple.tolist()) if s]
        words = split.findall("\n".join(easy))
        # Words of a unit, counted by their characters: units hold no blanks and the pattern takes every other character.
        ends = np.cumsum([len(u) for u in easy])
        first = np.concatenate([[0], np.searchsorted(np.cumsum([len(w) for w in words]), ends) + 1]) if easy else np.zeros(1, np.int64)
        flat, sizes = ids(words, shown)
        own = [e.ids for e in tokenizer.encode_batch_fast([u for u, s in zip(units, simple.tolist()) if not s], add_special_tokens=False)]
        out = np.zeros(len(units), np.int64)
        out[simple], out[~simple] = _grouped(sizes, first), [len(x) for x in own]
        ends = np.cumsum(out)
        total = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        total[np.repeat(simple, out)] = flat
        total[np.repeat(~simple, out)] = np.fromiter(chain.from_iterable(own), np.uint32)
        return total, out

    return UnitIds(fresh, False)
