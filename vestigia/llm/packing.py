"""Packing of token sequences as vector bin packing under simultaneous limits on tokens, segments and loss-bearing tokens.

Every task packs the examples of its own partition while it reads them; nothing is shuffled. An example longer than the limits is cut
into pieces that fill a sequence; what is left over waits in a pool of at most POOL pieces. A sequence is filled by the dot-product
heuristic: of the pieces that fit in all three dimensions the one comes next whose demand, weighted by the pool's mean
demand, has the largest dot product with the room left. What room remains is filled with a cut from the longest piece. A sequence that
cannot be filled (another limit is met, or the partition ends) is cut back to a power of two, so no sequence is padded.

Rows: a null or empty text has only the end id. A null id and repeated rows are packed like any other. An empty table gives no
sequences. Columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm import unit_ids
from vestigia.llm.common import stored, table, worker_state
from vestigia.llm.pieces import vocabulary

TOGETHER_BYTES = 4_000_000
POOL = 2048
END_ID = 2


class Limits(NamedTuple):
    """Of one sequence. Segments are the pieces of examples in it."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096


class Example:
    """Ids of one example, and how many loss-bearing ones lie before each place (None: all are)."""

    __slots__ = ("key", "ids", "before", "base", "total")

    def __init__(self, key, ids: np.ndarray, before: np.ndarray | None):
        self.key, self.ids, self.before, self.base, self.total = key, ids, before, 0, len(ids)

    def tail(self, start: int) -> Example:
        """The same without the ids before `start`."""
        out = Example(self.key, self.ids[start - self.base:].copy(), None if self.before is None else self.before[start - self.base:].copy())
        out.base, out.total = start, self.total
        return out

    def loss(self, start: int, size: int) -> int:
        return size if self.before is None else int(self.before[start + size - self.base] - self.before[start - self.base])

    def longest(self, start: int, size: int, loss: int) -> int:
        """How many ids from `start` on, at most `size`, hold at most `loss` loss-bearing ones."""
        if self.before is None:
            return min(size, loss)
        rest = self.before[start - self.base:start - self.base + size + 1]
        return int(np.searchsorted(rest, rest[0] + loss, "right")) - 1


class Packer:
    """Sequences, each a list of `(example, start, size)`, from examples that come one by one."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        if min(limits) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.most = limits, pool
        self.owner: list[Example] = []
        self.start: list[int] = []
        self.tokens, self.loss = np.zeros(2 * pool, np.int64), np.zeros(2 * pool, np.int64)

    def add(self, example: Example) -> Iterator[list]:
        at = 0
        while example.total - at > self.limits.tokens or example.loss(at, example.total - at) > self.limits.loss:
            size = example.longest(at, self.limits.tokens, self.limits.loss)
            if size == self.limits.tokens:
                yield [(example, at, size)]
            else:
                yield from self._wait(example, at, size)
            at += size
        if at < example.total:
            yield from self._wait(example.tail(at) if at else example, at, example.total - at)

    def finish(self) -> Iterator[list]:
        yield from self._pack(0)

    def _wait(self, example: Example, start: int, size: int) -> Iterator[list]:
        k = len(self.owner)
        self.owner.append(example)
        self.start.append(start)
        self.tokens[k], self.loss[k] = size, example.loss(start, size)
        if k + 1 == self.most:
            yield from self._pack(self.most // 2)

    def _pack(self, leave: int) -> Iterator[list]:
        """Fills sequences until no more than `leave` pieces wait, or all are gone."""
        n = len(self.owner)
        tokens, loss = self.tokens[:n], self.loss[:n]
        alive = n
        while alive > leave:
            chosen, room_t, room_s, room_l = [], self.limits.tokens, self.limits.segments, self.limits.loss
            # Weights: mean demand of what waits, in shares of the limits. The segments count one for each, so they weigh all alike.
            weight_t = tokens.sum() / self.limits.tokens ** 2
            weight_l = loss.sum() / self.limits.loss ** 2
            while room_s and room_t:
                fits = (tokens <= room_t) & (loss <= room_l) & (tokens > 0)
                score = np.where(fits, tokens * (weight_t * room_t / self.limits.tokens) + loss * (weight_l * room_l / self.limits.loss), -1.0)
                k = int(score.argmax())
                if score[k] < 0:
                    break
                chosen.append((k, self.start[k], int(tokens[k])))
                room_t, room_s, room_l = room_t - int(tokens[k]), room_s - 1, room_l - int(loss[k])
                tokens[k] = loss[k] = 0
                alive -= 1
            if room_t and room_s and alive:
                k = int(tokens.argmax())
                size = self.owner[k].longest(self.start[k], min(room_t, int(tokens[k])), room_l)
                if size:
                    chosen.append((k, self.start[k], size))
                    room_t -= size
                    self._put_back(k, self.start[k] + size, int(tokens[k]) - size)
                    alive -= not tokens[k]
            used = self.limits.tokens - room_t
            if room_t and not alive and leave:
                for k, start, size in chosen:  # more is to come: wait for it
                    alive += not tokens[k]
                    self._put_back(k, min(start, self.start[k]) if tokens[k] else start, int(tokens[k]) + size)
                break
            keep = used if not room_t else 1 << (used.bit_length() - 1)
            sequence, at = [], 0
            for k, start, size in chosen:
                part = min(size, keep - at)
                if part:
                    sequence.append((self.owner[k], start, part))
                if part < size:
                    alive += not tokens[k]
                    self._put_back(k, start + part, int(tokens[k]) + size - part)
                at += part
            yield sequence
        left = np.flatnonzero(tokens).tolist()
        self.owner, self.start = [self.owner[k] for k in left], [self.start[k] for k in left]
        self.tokens[:len(left)], self.loss[:len(left)] = tokens[left], loss[left]

    def _put_back(self, k: int, start: int, size: int) -> None:
        self.start[k], self.tokens[k], self.loss[k] = start, size, self.owner[k].loss(start, size) if size else 0


PIECE = "doc_id bigint, start bigint, length bigint, offset bigint, loss bigint, doc_tokens bigint"
SEQUENCE = f"sequence_id long, n_tokens long, n_loss long, ids binary, loss_bits binary, pieces array<struct<{PIECE.replace(' bigint', ': bigint')}>>"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("n_loss", pa.int64()), ("ids", pa.binary()), ("loss_bits", pa.binary()),
                    ("pieces", pa.list_(pa.struct([(f.split()[0], pa.int64()) for f in PIECE.split(", ")])))])


def _row(number: int, sequence: list) -> dict:
    ids, masks, pieces, at = [], [], [], 0
    for example, start, size in sequence:
        lo = start - example.base
        ids.append(example.ids[lo:lo + size])
        masks.append(np.ones(size, bool) if example.before is None else np.diff(example.before[lo:lo + size + 1]) > 0)
        pieces.append({"doc_id": example.key, "start": start, "length": size, "offset": at, "loss": int(masks[-1].sum()), "doc_tokens": example.total})
        at += size
    mask = np.concatenate(masks)
    return {"sequence_id": number, "n_tokens": at, "n_loss": int(mask.sum()), "ids": np.concatenate(ids).astype("<u4").tobytes(),
            "loss_bits": np.packbits(mask).tobytes(), "pieces": pieces}


def _slices(parts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about TOGETHER_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(pc.struct_field(pc.list_flatten(parts), 0)), 0), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)]
    start = 0
    while start < len(parts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOGETHER_BYTES, "right")) - 1)
        yield start, stop
        start = stop


def packed(examples: DataFrame, path: str, end_id: int = END_ID, limits: Limits = Limits()) -> DataFrame:
    """Sequences of the rows of `examples(doc_id, parts)`. `parts` is an array of structs `(text, loss)`: the texts of an example in order
    and whether their tokens bear loss; the end id does. A null flag counts as true, null parts as no text."""
    with open(path, encoding="utf-8") as f:
        data = f.read()
    shared = examples.sparkSession.sparkContext.broadcast(data)

    def made(encoder, keys: list, parts: pa.Array) -> Iterator[Example]:
        flat = pc.list_flatten(parts)
        counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts, flags = pc.struct_field(flat, 0), pc.fill_null(pc.struct_field(flat, 1), True).to_numpy(zero_copy_only=False).astype(bool)
        ids, n = encoder.encode(texts)
        id_ends, part_ends = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(counts)])
        for i, key in enumerate(keys):
            a, b = int(part_ends[i]), int(part_ends[i + 1])
            own = np.append(ids[id_ends[a]:id_ends[b]], np.uint32(end_id))
            before = None
            if not flags[a:b].all():
                before = np.concatenate([[0], np.cumsum(np.append(np.repeat(flags[a:b], n[a:b]), True))])
            yield Example(key, own, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        encoder = worker_state(("units", zlib.crc32(data.encode())), lambda: unit_ids.word_level(data))
        packer, number = Packer(limits), TaskContext.get().partitionId() << 32
        rows = []
        for batch in batches:
            for a, b in _slices(batch["parts"]):
                for example in made(encoder, batch["doc_id"][a:b].to_pylist(), batch["parts"][a:b]):
                    for sequence in packer.add(example):
                        rows.append(_row(number, sequence))
                        number += 1
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
        for sequence in packer.finish():
            rows.append(_row(number, sequence))
            number += 1
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    flat = examples.select(F.col("doc_id").cast("long"), F.col("parts").cast("array<struct<text: string, loss: boolean>>"))
    return flat.mapInArrow(run, SEQUENCE)


def documents_as_examples(docs: DataFrame) -> DataFrame:
    """One example a document; all its tokens bear loss."""
    return docs.select("doc_id", F.array(F.struct(F.col("text").cast("string").alias("text"), F.lit(True).alias("loss"))).alias("parts"))


def pieces(sequences: DataFrame) -> DataFrame:
    """One row a piece, with the checksum of its ids."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select("sequence_id", "ids", "p.*")
    own = F.expr("substring(ids, CAST(4 * offset + 1 AS INT), CAST(4 * length AS INT))")
    return each.select("doc_id", "start", "length", F.crc32(own).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss")


def op11_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    examples = documents_as_examples(table(spark, folder, "documents"))
    return pieces(stored(packed(examples, vocabulary("word_bpe_49k.json")), "sequences"))
