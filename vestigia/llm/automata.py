"""Finite-state form of a byte-level BPE tokenizer.

Two deterministic machines are compiled from the tokenizer's file:

* the splitter reads character classes (with one or two characters of lookahead folded into the symbol) and says before which
  character a pretoken begins. Chunks of CHUNK characters are run from all states at once; the resulting state maps are composed by a
  parallel prefix scan, which gives the true state at each chunk's start;
* the counter reads the bytes of a pretoken along the trie of the vocabulary and keeps, for each byte, the last token of the encoding
  up to there and its count. Which token may follow depends on the one before it, so the counts are a dynamic program and no emission
  of single transitions; chunk maps are scanned for the splitter only. Short pretokens of a batch are read in step, long ones
  one by one; both take time linear in the bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

from vestigia.llm.pieces import double_array

CHUNK = 64
SHORT = 48
NEIGHBOURS = 500_000  # remembered pairs of tokens of one long pretoken
# Character classes and input symbols of the splitter.
LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
SHORT_SUFFIX, LONG_SUFFIX, LAST_SPACE, LAST_BLANK, INNER_BLANK, END = 3, 4, 5, 6, 7, 8
N_SYMBOLS = 9
# States: fresh, in letters, in numbers, in others, after a joined space, in blanks, two or one letters of a suffix to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, TWO_LEFT, ONE_LEFT = range(8)
N_STATES = 8


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """`next, begins` by state * N_SYMBOLS + symbol, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks(?!non-blank)|blanks."""
    follow = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    begins = np.ones((N_STATES, N_SYMBOLS), np.uint8)
    for q in range(N_STATES):
        for symbol, home in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            follow[q, symbol], begins[q, symbol] = home, q not in (home, AFTER_SPACE)
        inside = q in (IN_OTHERS, AFTER_SPACE)
        for symbol, to in ((SHORT_SUFFIX, ONE_LEFT), (LONG_SUFFIX, TWO_LEFT)):
            follow[q, symbol], begins[q, symbol] = (IN_OTHERS, 0) if inside else (to, 1)
        follow[q, LAST_SPACE], follow[q, LAST_BLANK], follow[q, INNER_BLANK] = AFTER_SPACE, IN_BLANKS, IN_BLANKS
        begins[q, INNER_BLANK] = q != IN_BLANKS
        follow[q, END] = FRESH
    follow[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, 0
    follow[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = FRESH, 0
    return follow.ravel(), begins.ravel()


FOLLOW, BEGINS = _splitter()
_JUMP = bytes((FOLLOW * np.uint8(N_SYMBOLS)).tolist()).ljust(256, b"\0")  # states as row offsets
# States that go on alike are one row of a chunk's map: a state's class, and a state of each class.
_, _SAMPLES, CLASS = np.unique(FOLLOW.reshape(N_STATES, N_SYMBOLS), axis=0, return_index=True, return_inverse=True)
CLASS = CLASS.ravel().astype(np.uint8)
_BEGINS = bytes(BEGINS.tolist()).ljust(256, b"\0")


def _jumped(at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(_JUMP), np.uint8).reshape(at.shape)


@lru_cache(maxsize=2)
def char_classes(data: str) -> np.ndarray:
    """Class of each code point as the tokenizer itself splits it; read on the driver."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(data).pre_tokenizer.pre_tokenize_str
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in (0x20, 0x27)]
    classes = np.full(0x110000, BLANK, np.uint8)
    classes[0x27] = OTHER
    at = np.array(codes)
    # Without spaces and suffix marks each pretoken has one class, so its first character is asked about.
    text = "".join(map(chr, codes))
    for _, (a, b) in split(text):
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(split(probe + text[a])) == 1:
                classes[at[a:b]] = kind
                break
    return classes


def symbols(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Input symbols of texts whose code points lie one after the other, each followed by one filler at `ends`."""
    kind = classes[codes]
    blank = kind == BLANK
    blank[ends] = True
    solid_next = np.zeros(len(codes), bool)
    solid_next[:-1] = ~blank[1:]
    out = kind.copy()
    out[blank] = INNER_BLANK
    out[blank & solid_next] = LAST_BLANK
    out[blank & solid_next & (codes == 0x20)] = LAST_SPACE
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[marks[short]], out[marks[long]] = SHORT_SUFFIX, LONG_SUFFIX
    out[ends] = END
    return out


def split_points(symbol: np.ndarray) -> np.ndarray:
    """Places where a pretoken (or a filler) begins."""
    n = len(symbol)
    chunks = -(-n // CHUNK)
    steps = np.full(chunks * CHUNK, END, np.uint8)
    steps[:n] = symbol
    steps = np.ascontiguousarray(steps.reshape(chunks, CHUNK).T)
    state = np.repeat(_SAMPLES.astype(np.uint8)[:, None] * np.uint8(N_SYMBOLS), chunks, 1)
    for row in steps:
        state = _jumped(state + row)
    ends = state.T // N_SYMBOLS  # chunk by class: the state where each ends
    maps = CLASS[ends]
    reach = 1
    while reach < chunks:  # after this round, row i composes the maps of the last 2 * reach chunks
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    begin = np.full(chunks, CLASS[FRESH])  # class of each chunk's first state
    begin[1:] = maps[:-1, CLASS[FRESH]]
    state = np.zeros(chunks, np.uint8)
    state[1:] = ends[np.arange(chunks - 1), begin[:-1]] * np.uint8(N_SYMBOLS)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for j, row in enumerate(steps):
        at = state + row
        marks[j] = np.frombuffer(at.tobytes().translate(_BEGINS), np.uint8)
        state = _jumped(at)
    return np.flatnonzero(marks.T.ravel()[:n])


def pretokens(texts: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The pretokens of all texts, and the index of each text's first (n + 1 entries)."""
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbol = symbols(codes, ends, classes)
    points = split_points(symbol)
    real = symbol[points] != END
    stops = np.append(points[1:], len(codes))[real]
    starts = points[real]
    words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    return words, np.concatenate([[0], np.searchsorted(starts, ends)])


def special_tokens(data: str) -> dict[str, int]:
    """Added tokens that are matched in the text before anything else."""
    added = json.loads(data).get("added_tokens", [])
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added):
        raise ValueError("added tokens with conditions are not supported")
    return {t["content"]: t["id"] for t in added}


def split_texts(texts: list[str], classes: np.ndarray, special: re.Pattern | None) -> tuple[list[str], np.ndarray]:
    """Like `pretokens`; special tokens found in a text are entries of their own."""
    if special is None or not any(special.search(t) for t in texts):
        return pretokens(texts, classes)
    parts = [special.split(t) for t in texts]  # at odd places the special tokens
    words, first = pretokens([p for part in parts for p in part[::2]], classes)
    out, starts, k = [], [0], 0
    for part in parts:
        for i, p in enumerate(part):
            if i % 2:
                out.append(p)
            else:
                out += words[first[k]:first[k + 1]]
                k += 1
        starts.append(len(out))
    return out, np.array(starts)


def special_pattern(tokens: dict[str, int]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")") if tokens else None


class Counter:
    """Token counts of pretokens."""

    def __init__(self, data: str):
        model = json.loads(data)["model"]
        vocab = model["vocab"]
        shown = _byte_characters()
        raw = {t: bytes(shown[c] for c in t) for t in vocab}
        if any(len(raw[t]) == 1 and i > 255 or len(raw[t]) > 1 and i < 256 for t, i in vocab.items()):
            raise ValueError("ids 0 to 255 must be the single bytes")
        self.left, self.right = np.arange(len(vocab), dtype=np.int64), np.arange(len(vocab), dtype=np.int64)
        codes = np.empty(len(model["merges"]), np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if vocab[a + b] != 256 + rank:
                raise ValueError("ids must follow the order of the merges")
            self.left[256 + rank], self.right[256 + rank] = vocab[a], vocab[b]
            codes[rank] = vocab[a] << 32 | vocab[b]
        slot = self._slot(codes)
        order = np.argsort(slot, kind="stable")
        self.pairs, self.merged = codes[order], 256 + order
        self.first = np.searchsorted(slot[order], np.arange(1 << 20))
        self.depth = int(np.bincount(slot).max())
        self.trie = double_array({raw[t]: i for t, i in vocab.items()})
        self.longest = max(map(len, raw.values()))

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a pair merges to, or a number above all tokens."""
        code = a << 32 | b
        at = self.first[self._slot(code)]
        out = np.full(len(code), 1 << 41)
        for k in range(self.depth):
            where = np.minimum(at + k, len(self.pairs) - 1)
            hit = self.pairs[where] == code
            out[hit] = self.merged[where[hit]]
        return out

    def _adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token a stays beside token b: their merges are undone from the latest on, and no pair met at the border may
        have been due before."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            due = self._merge(a, b) < limit
            good[at[due]] = False
            go = ~due & (np.maximum(a, b) > 255)
            a, b, at, limit = a[go], b[go], at[go], limit[go]
            newer = a > b
            limit = np.where(newer, a, b + 1)
            a, b = np.where(newer, self.right[a], a), np.where(newer, b, self.left[b])
        return good

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Token counts of pretokens, read in step."""
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        data = np.zeros((n, width), np.uint8)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        base, check, value = self.trie
        last = np.zeros((n, width + 1), np.int64)
        count = np.zeros((n, width + 1), np.int64)
        node = np.full((n, width), -1, np.int32)  # by start of a token
        lanes = np.arange(n)
        for i in range(1, width + 1):
            lanes = lanes[sizes[lanes] >= i]
            node[lanes, i - 1] = 0
            low = max(0, i - self.longest)
            part = node[lanes, low:i]
            row, start = np.nonzero(part >= 0)
            t = base[part[row, start]] + data[lanes[row], i - 1] + 1
            ok = check[t] == part[row, start]
            part[row, start] = np.where(ok, t, -1)
            node[lanes, low:i] = part
            row, start, token = lanes[row[ok]], start[ok] + low, value[t[ok]].astype(np.int64)
            hit = token >= 0
            row, start, token = row[hit], start[hit], token[hit]
            fits = start == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self._adjacent(last[row[inner], start[inner]], token[inner])
            row, start, token = row[fits], start[fits], token[fits]
            last[row, i], count[row, i] = token, count[row, start] + 1
        return count[np.arange(n), sizes]

    def _beside(self, a: int, b: int) -> bool:
        """`_adjacent` for one pair."""
        limit = 1 << 40
        while self.rank.get(a << 32 | b, limit) >= limit:
            if a <= 255 and b <= 255:
                return True
            if a > b:
                limit, a = a, self.right.item(a)
            else:
                limit, b = b + 1, self.left.item(b)
        return False

    @cached_property
    def rank(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.merged.tolist()))

    def count_long(self, word: bytes) -> int:
        """The same for one long pretoken: every byte's tokens are followed once, and whether two tokens may be neighbours is
        remembered."""
        base, check, value = map(memoryview, self.trie)
        n, size = len(word), len(check)
        last, count = array("i", [-1]) * (n + 1), array("q", [0]) * (n + 1)
        beside: dict[int, bool] = {}
        for start in range(n):
            before, at, node = last[start], start, 0
            while at < n:
                to = base[node] + word[at] + 1
                if to >= size or check[to] != node:
                    break
                node, at = to, at + 1
                token = value[node]
                if token >= 0 and last[at] < 0:
                    pair = before << 32 | token
                    fits = start == 0 or beside.get(pair)
                    if fits is None:
                        if len(beside) > NEIGHBOURS:
                            beside.clear()
                        fits = beside[pair] = self._beside(before, token)
                    if fits:
                        last[at], count[at] = token, count[start] + 1
        return count[n]


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table
