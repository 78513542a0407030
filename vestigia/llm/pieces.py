"""SentencePiece files: encoding by Viterbi search over a double-array trie of pieces with log scores, with byte fallback, and
decoding with white-space markers.

The best path is searched once for each distinct segment of a batch. No piece holds a marker after another character, nor one
of the isolated characters (found when the model is compiled) beside others, so the best paths of the segments between such places
make up the best path of the text. Segments of up to SHORT bytes are searched in step, as arrays; longer ones one by one, in time
linear in their length. Scores are added as 32-bit floats and the first of equal paths wins: the longer last piece.

A file of another kind than unigram has ranks instead of log scores; a rank r becomes -ln(r + 2.7).

Rows: null and empty texts have no pieces and decode to an empty text. The marker U+2581 within a text decodes to a space, like the
library does. Equal rows get equal results; columns other than doc_id and text are ignored by `encoded` and kept by `with_pieces`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vestigia.llm.common import table
from vestigia.llm.words import slices

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
SHORT, TOGETHER, CACHE = 64, 8_192, 100_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, value)."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else varint(i)
            value, i = data[i:i + n], i + n
        yield key >> 3, value


def double_array(entries: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`base, check, value`: from node s the byte b leads to t = base[s] + b + 1 if check[t] == s; value -1: no entry."""
    words = sorted(entries)
    base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
    used = bytearray(1024)
    used[0] = 1
    free = 1
    todo = [(0, 0, len(words), 0)]  # node, range of words, depth
    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(words[lo]) == depth:
            value[node] = entries[words[lo]]
            lo += 1
        if lo == hi:
            continue
        kids, start = [], lo
        for i in range(lo + 1, hi + 1):
            if i == hi or words[i][depth] != words[start][depth]:
                kids.append((words[start][depth] + 1, start, i))
                start = i
        free = used.find(0, free) if used.find(0, free) >= 0 else len(used)
        at = max(free, kids[0][0])
        while True:
            while at + 512 > len(used):
                used += bytes(len(used))
                base += [0] * len(base)
                check += [-1] * len(check)
                value += [-1] * len(value)
            at = used.find(0, at)
            if at >= 0 and at + 512 <= len(used):
                if not any(used[at - kids[0][0] + c] for c, _, _ in kids):
                    break
                at += 1
            else:
                at = len(used) - 511
        base[node] = at - kids[0][0]
        for c, a, b in kids:
            t = base[node] + c
            used[t], check[t] = 1, node
            todo.append((t, a, b, depth + 1))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class Model:
    pieces: list[bytes]  # what each id decodes to
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int
    unknown_score: float
    segment: str  # pattern of the segments
    prefix: bool
    squeeze: bool

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)


@lru_cache(maxsize=4)
def compiled(path: str) -> Model:
    """The model of a SentencePiece file, read on the driver."""
    with open(path, "rb") as f:
        return compile_model(f.read())


def compile_model(data: bytes) -> Model:
    texts, scores, kinds = [], [], []
    kind, fallback, prefix, squeeze, charsmap = UNIGRAM, False, True, True, b""
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            charsmap, prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if charsmap or not fallback or set(kinds) - {NORMAL, UNKNOWN, 3, 5, BYTE}:
        raise ValueError("only models with byte fallback, without a character map and user-defined pieces")
    score = np.array(scores)
    if kind != UNIGRAM:
        score = -np.log(np.maximum(-score, 0) + 2.7)
    score = score.astype(np.float32)
    normal = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == NORMAL}
    if any(MARK in t.lstrip(MARK) for t in normal):
        raise ValueError("a piece holds a marker after another character")
    byte_ids = np.full(256, -1, np.int32)
    for i, (t, k) in enumerate(zip(texts, kinds)):
        if k == BYTE:
            byte_ids[int(t[3:5], 16)] = i
    beside = {c for t in normal if len(t) > 1 for c in t}
    isolated = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in beside)
    pattern = f"{MARK}+[^{MARK}{isolated}]*|[^{MARK}{isolated}]+" + (f"|[{isolated}]" if isolated else "")
    base, check, value = double_array({t.encode(): i for t, i in normal.items()})
    decoded = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() if k == NORMAL else b"" for t, k in zip(texts, kinds)]
    return Model(decoded, score, byte_ids, kinds.index(UNKNOWN), base, check, value, max(len(t.encode()) for t in normal),
                 float(min(score[i] for i in normal.values())) - UNKNOWN_PENALTY, pattern, prefix, squeeze)


_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


def best_paths(model: Model, segments: list[bytes]) -> list[np.ndarray]:
    """Ids of the best path of each segment, all searched in step."""
    n = len(segments)
    sizes = np.array([len(s) for s in segments])
    width = int(sizes.max())
    data = np.zeros((n, width), np.uint8)
    data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(segments), np.uint8)
    best = np.full((n, width + 1), -np.inf, np.float32)
    best[:, 0] = 0
    came = np.zeros((n, width + 1), np.int32)
    piece = np.full((n, width + 1), -1, np.int32)
    unknown = np.float32(model.unknown_score)
    for s in range(width):
        lanes = np.flatnonzero((sizes > s) & ((data[:, s] & 0xC0) != 0x80))
        if not len(lanes):
            continue
        chars = _WIDTH[data[lanes, s]]
        alone = np.zeros(n, bool)
        alive, node = lanes, np.zeros(len(lanes), np.int32)
        for d in range(min(model.depth, width - s)):
            t = model.base[node] + data[alive, s + d] + 1
            ok = model.check[t] == node
            alive, node = alive[ok], t[ok]
            if not len(alive):
                break
            ids = model.value[node]
            hit = ids >= 0
            rows, ids = alive[hit], ids[hit]
            score = best[rows, s] + model.scores[ids]
            better = score > best[rows, s + d + 1]
            rows, ids = rows[better], ids[better]
            best[rows, s + d + 1], came[rows, s + d + 1], piece[rows, s + d + 1] = score[better], s, ids
            alone[alive[hit]] |= _WIDTH[data[alive[hit], s]] == d + 1
            more = sizes[alive] > s + d + 1
            alive, node = alive[more], node[more]
        rest = ~alone[lanes]
        rows, to = lanes[rest], s + chars[rest]
        score = best[rows, s] + unknown
        better = score > best[rows, to]
        rows, to = rows[better], to[better]
        best[rows, to], came[rows, to], piece[rows, to] = score[better], s, -1
    out: list[list] = [[] for _ in range(n)]
    lanes, at = np.arange(n), sizes.copy()
    while len(lanes):
        for i, a, b, p in zip(lanes.tolist(), came[lanes, at].tolist(), at.tolist(), piece[lanes, at].tolist()):
            if p >= 0:
                out[i].append(p)
            else:
                out[i].extend(model.byte_ids[np.frombuffer(segments[i][a:b][::-1], np.uint8)].tolist())
        at = came[lanes, at]
        lanes, at = lanes[at > 0], at[at > 0]
    return [np.array(p[::-1], np.int32) for p in out]


def best_path(model: Model, segment: bytes, lists: tuple[list, list, list]) -> np.ndarray:
    """The same for one long segment."""
    base, check, value = lists
    n, scores = len(segment), model.scores
    best = np.full(n + 1, -np.inf, np.float32)
    best[0] = 0
    came, piece = [0] * (n + 1), [-1] * (n + 1)
    s = 0
    while s < n:
        width, here, node, alone = int(_WIDTH[segment[s]]), best[s], 0, False
        for e in range(s, min(n, s + model.depth)):
            t = base[node] + segment[e] + 1
            if check[t] != node:
                break
            node = t
            if value[t] >= 0:
                alone |= e + 1 - s == width
                score = here + scores[value[t]]
                if score > best[e + 1]:
                    best[e + 1], came[e + 1], piece[e + 1] = score, s, value[t]
        if not alone and here + np.float32(model.unknown_score) > best[s + width]:
            best[s + width], came[s + width], piece[s + width] = here + np.float32(model.unknown_score), s, -1
        s += width
    out: list[int] = []
    while n:
        out += [piece[n]] if piece[n] >= 0 else model.byte_ids[np.frombuffer(segment[came[n]:n][::-1], np.uint8)].tolist()
        n = came[n]
    return np.array(out[::-1], np.int32)


class Encoder:
    """Encodes texts one after the other; keeps the paths of up to CACHE segments."""

    def __init__(self, model: Model):
        self.model, self.find = model, re.compile(model.segment).findall
        self.lists = (model.base.tolist(), model.check.tolist(), model.value.tolist())
        self.known: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self.find(self.model.normalised(t)) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = sorted({s for segments in split for s in segments} - self.known.keys(), key=len)
        short = [(s, raw) for s in new if len(raw := s.encode()) <= SHORT]
        for i in range(0, len(short), TOGETHER):
            part = short[i:i + TOGETHER]
            self.known.update(zip((s for s, _ in part), best_paths(self.model, [raw for _, raw in part])))
        for s in new:
            if s not in self.known:
                self.known[s] = best_path(self.model, s.encode(), self.lists)
        for segments in split:
            yield np.concatenate([self.known[s] for s in segments]) if segments else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.model.pieces
        text = b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


TOGETHER_BYTES = 1_000_000


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    for a, b in slices(texts, TOGETHER_BYTES):
        yield [t or "" for t in texts[a:b].to_pylist()]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip` for each row: ids are encoded and decoded again."""
    model = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        is_byte = np.zeros(len(model.value.pieces), bool)
        is_byte[model.value.byte_ids] = True
        for batch in batches:
            rows = []
            for texts in _parts(batch["text"]):
                for text, ids in zip(texts, encoder.encode(texts)):
                    back = encoder.decode(ids)
                    rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()),
                                 hashlib.sha256(back.encode()).hexdigest(), back == text))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
            yield pa.record_batch([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                  ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def with_pieces(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `piece_ids` and the `decoded` text; columns of these names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(compiled(path))
    docs = docs.drop("piece_ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            sizes, flat, back = [0], [np.zeros(0, np.int32)], []
            for texts in _parts(batch["text"]):
                for ids in encoder.encode(texts):
                    sizes.append(len(ids))
                    flat.append(ids)
                    back.append(encoder.decode(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.record_batch([*batch.columns, lists, pa.array(back, pa.string())], [*batch.schema.names, "piece_ids", "decoded"])

    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))
