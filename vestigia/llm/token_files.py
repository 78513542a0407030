"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its lowest four bits and 60 bits of ids. Selector 0 is the escape: the next word holds one id as it
is. Blocks hold BLOCK ids (the last of a segment fewer); the word offset of each block is stored, so all blocks of a
segment are decoded in step. A file row is a segment: documents in ascending id order, their sizes, block offsets and words.
Files are ranges of doc_id, written and read by Spark as Parquet in the shared folder, so lost tasks are written again.

Rows: a null or empty text has only the end id. A null id comes first; rows that repeat an id follow one another in the
order of their texts. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vestigia.llm import automata, unit_ids
from vestigia.llm.common import new_folder, table, worker_state
from vestigia.llm.pieces import vocabulary
from vestigia.llm.words import slices

BLOCK = 256
TOGETHER_BYTES, SEGMENT_BYTES = 8_000_000, 4_000_000
END_ID = 0
ESCAPE = 0
# Ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SMALL = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)  # bits of an id


def _best_selectors(ids: np.ndarray) -> np.ndarray:
    """For each place of `ids` (blocks by row) the selector that takes most ids from there; places after the end take anything."""
    rows, width = ids.shape
    bits = np.zeros((rows, width + 128), np.uint8)
    bits[:, :width] = _SMALL[ids] if not ids.size or ids.max() < len(_SMALL) else np.searchsorted(_POWERS, ids, "right")
    windows = {1: bits}
    reach = 1
    while reach < 64:
        last = windows[reach]
        wide = last.copy()
        wide[:, :-reach] = np.maximum(last[:, :-reach], last[:, reach:])
        windows[2 * reach] = wide
        reach *= 2
    out = np.full((rows, width), ESCAPE, np.uint8)
    for selector in range(15, 0, -1):
        count = int(COUNTS[selector])
        part = 1 << (count.bit_length() - 1)
        largest = np.maximum(windows[part][:, :width], windows[part][:, count - part:count - part + width])
        np.putmask(out, largest <= BITS[selector], selector)
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`words, offsets`: the words of all blocks and where each block starts. Blocks are packed in step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.zeros((blocks, BLOCK + 128), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    data[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = _best_selectors(data[:, :BLOCK])
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - BLOCK * (blocks - 1)
    # First where each word starts, a word of every block at a time; then all words of a selector at once.
    row = data.shape[1]
    at, live, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        starts.append(live * row + at[live])
        at[live] += COUNTS[best[live, at[live]]]
        live = live[at[live] < sizes[live]]
    start = np.sort(np.concatenate(starts))
    block, within = np.divmod(start, row)
    selector = best[block, within]
    flat, word = data.ravel(), selector.astype(np.uint64)
    for s in np.unique(selector).tolist():
        if s != ESCAPE and BITS[s]:
            own = np.flatnonzero(selector == s)
            from_, packed = start[own], word[own]
            for k in range(COUNTS[s]):
                packed |= flat[from_ + k] << np.uint64(4 + k * BITS[s])
            word[own] = packed
    # An escape is two words: itself and the id.
    raw = selector == ESCAPE
    place = np.arange(len(start)) + np.cumsum(raw) - raw
    words = np.zeros(len(start) + int(raw.sum()), np.uint64)
    words[place] = word
    words[place[raw] + 1] = flat[start[raw]]
    return words, place[np.searchsorted(block, np.arange(blocks))]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids: all blocks in step, one word each."""
    blocks = len(offsets)
    out = np.zeros((blocks, BLOCK + 128), np.uint64)
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = n - BLOCK * (blocks - 1)
    row = out.shape[1]
    at, word_at, live = np.zeros(blocks, np.int64), offsets.astype(np.int64), np.arange(blocks)
    starts, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    chosen = (words & np.uint64(15)).astype(np.uint8)
    while len(live):
        here = word_at[live]
        starts.append(live * row + at[live])
        places.append(here)
        selector = chosen[here]
        at[live] += COUNTS[selector]
        word_at[live] = here + 1 + (selector == ESCAPE)
        live = live[at[live] < sizes[live]]
    start, place = np.concatenate(starts), np.concatenate(places)
    selector, flat = chosen[place], out.ravel()
    for s in np.unique(selector).tolist():
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            flat[start[own]] = words[place[own] + 1]
        elif BITS[s]:
            word, to = words[place[own]], start[own]
            for k in range(COUNTS[s]):
                flat[to + k] = (word >> np.uint64(4 + k * BITS[s])) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:, :BLOCK].ravel()[:n]


SEGMENT = "part long, first_start long, doc_ids array<long>, sizes array<int>, block_offsets array<int>, words binary"


def write_ids(docs: DataFrame, path: str, folder: str) -> None:
    """Writes the ids of `docs(doc_id, text)` to `folder`: files are ranges of doc_id, in ascending order."""
    with open(path, encoding="utf-8") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((data, automata.char_classes(data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, classes = shared.value
        encoder = worker_state(("byte units", zlib.crc32(data.encode())), lambda: unit_ids.byte_level(data, classes))
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            for a, b in slices(texts, TOGETHER_BYTES):
                ids, sizes = encoder.encode(texts[a:b])
                ids, sizes = np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for c, d in slices(texts[a:b], SEGMENT_BYTES):
                    words, offsets = pack(ids[ends[c]:ends[d]])
                    row = {"part": part, "first_start": start, "doc_ids": batch["doc_id"][a + c:a + d].to_pylist(), "sizes": sizes[c:d].tolist(),
                           "block_offsets": offsets.tolist(), "words": words.astype("<u8").tobytes()}
                    start += int(ends[d] - ends[c])
                    yield pa.RecordBatch.from_pylist([row], pa.schema([
                        ("part", pa.int64()), ("first_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int32())), ("block_offsets", pa.list_(pa.int32())), ("words", pa.binary())]))

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENT).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of each document in the files."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # One row a file: where its first id stands among all ids.
    totals = segments.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")) \
        .groupBy("part").agg(F.sum("n").alias("n"))
    firsts = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = np.array(batch["sizes"][row].as_py(), np.int64)
                words = np.frombuffer(batch["words"][row].as_py(), "<u8")
                ids = unpack(words, np.array(batch["block_offsets"][row].as_py(), np.int64), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                base = batch["part_start"][row].as_py() + batch["first_start"][row].as_py()
                yield pa.record_batch([pa.array(batch["doc_ids"][row].as_py(), pa.int64()), pa.array(base + starts), pa.array(sizes),
                                       pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(F.broadcast(firsts), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_simple8b_files(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "token-ids")
    write_ids(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), out)
    return read_ids(spark, out)
