"""Token counts of whole texts from the finite-state form of a tokenizer (see automata), without building the tokens.

Texts of a batch are cut into chunks, the splitter's state maps are composed by a prefix scan over the chunks, and the
counter's emissions are added up per text. Counts of up to CACHE pretokens are kept for the rest of the task.

Rows: a null or empty text has 0 bytes and 0 tokens. Rows that repeat an id are counted each. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm import automata
from vestigia.llm.common import table
from vestigia.llm.pieces import vocabulary
from vestigia.llm.words import slices

LIMIT = 512
CACHE, TOGETHER = 400_000, 8192


class TextCounter:
    def __init__(self, counter: automata.Counter, classes: np.ndarray, special: dict[str, int]):
        self.counter, self.classes = counter, classes
        self.special, self.pattern = special, automata.special_pattern(special)
        self.known: dict[str, int] = dict.fromkeys(special, 1)

    def counts(self, texts: list[str]) -> np.ndarray:
        words, first = automata.split_texts(texts, self.classes, self.pattern)
        if len(self.known) > CACHE:
            self.known = dict.fromkeys(self.special, 1)
        new = sorted(((w, w.encode("utf-8", "surrogatepass")) for w in set(words) - self.known.keys()), key=lambda x: len(x[1]))
        short = [x for x in new if len(x[1]) <= automata.SHORT]
        for i in range(0, len(short), TOGETHER):
            part = short[i:i + TOGETHER]
            self.known.update(zip((w for w, _ in part), self.counter.counts([raw for _, raw in part]).tolist()))
        for w, raw in new[len(short):]:
            self.known[w] = self.counter.count_long(raw)
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))])
        return sums[first[1:]] - sums[first[:-1]]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for each row of `docs(doc_id, text)`."""
    with open(path, encoding="utf-8") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(
        (automata.Counter(data), automata.char_classes(data), automata.special_tokens(data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(*shared.value)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            counts = [counter.counts(texts[a:b].to_pylist()) for a, b in slices(texts)]
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.record_batch([batch["doc_id"], pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                                  ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
