"""Benchmark decontamination: token windows of the documents against a broadcast hash set of the benchmark's n-grams.

Words are runs of digits, a-z (A-Z lower-cased) and characters above U+007F. Benchmark items give windows of 13 consecutive
words; an item of fewer words is one window. Every window of a document is hashed in place (one long per word), looked up in the
broadcast set, and each match is verified word by word before it counts. The set is bounded: a benchmark of more than
SET_ROWS window entries is searched in blocks, each a broadcast of its own. Only hits are shuffled; a document's hits
are bounded by its words.

Rows: null, empty or wordless texts have no words and are clean; null items are ignored, null ids are kept. Rows that repeat an
id are judged by their own text. Columns other than doc_id and text (item_id and text) pass through `clean_documents`
untouched and are ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import lower_ascii, set_apart, stored, table

WINDOW = 13
SET_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """`hash, size, window, items`: each distinct window with the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")) \
        .filter("item IS NOT NULL AND size(ws) > 0")
    n = F.size("ws")
    windows = F.when(n <= WINDOW, F.array("ws")).otherwise(
        F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.slice("ws", i, WINDOW)))
    return items.select("item", F.explode(windows).alias("window")).groupBy("window").agg(
        F.collect_set("item").alias("items")).select(
        F.xxhash64("window").alias("hash"), F.size("window").alias("size"), "window", "items")


def text_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("_text")]


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """`doc_id, _text, at, size, items`: verified windows; `at` counts words from 0."""
    sizes = sorted((r[0] for r in windows.select("size").distinct().collect()), reverse=True)  # at most WINDOW values
    if not sizes:
        return docs.select(*text_key(), F.lit(0).alias("at"), F.lit(0).alias("size"), F.array(F.lit("")).alias("items")).limit(0)
    ws, n = F.col("ws"), F.size("ws")
    counts = [F.greatest(n - size + 1, F.lit(0)) for size in sizes]

    def rolled(size: int) -> Column:
        starts = F.sequence(F.lit(1), n - size + 1)
        return F.when(n >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, size)))).otherwise(
            F.array().cast("array<bigint>"))

    hashed = F.concat(*[rolled(size) for size in sizes])
    # The outer form keeps Spark from inferring a filter on the hashes, which would split the text again for every word.
    places = docs.select(*text_key(), words(F.col("text")).alias("ws")).select("*", hashed.alias("_hashes")) \
        .select("doc_id", "_text", "ws", F.posexplode_outer("_hashes").alias("_i", "hash"))
    before = F.lit(0)
    at = F.lit(None).cast("int")
    for size, count in zip(sizes, counts):
        at = F.when(F.col("size") == size, F.col("_i") - before).otherwise(at)
        before = before + count
    entries = windows.agg(F.sum(F.size("items"))).first()[0]
    blocks = -(-entries // SET_ROWS)
    found = []
    for b in range(blocks):
        block = windows.filter(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else windows
        found.append(places.join(F.broadcast(block), "hash").withColumn("at", at).filter(
            (F.col("at") >= 0) & (F.slice(ws, F.col("at") + 1, F.col("size")) == F.col("window")))
            .select("doc_id", "_text", "at", "size", "items"))
    return reduce(DataFrame.unionByName, found)


def _covered(spans: Column) -> Column:
    """Words in the union of the sorted spans `(at, size)`."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    end = lambda s: s["at"] + s["size"]
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), end(s) - F.greatest(s["at"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], end(s)).alias("to"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, _text, n_words, n_hit, n_items, items_sha256, spans, contaminated` for each row; `spans` are the hit windows
    `(at, size)` in words, for callers that cut passages instead of documents."""
    docs = docs.select("doc_id", "text")
    windows = stored(benchmark_windows(benchmark), "windows")
    per_doc = stored(hits(docs, windows).groupBy("doc_id", "_text").agg(
        F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")), "hits")
    judged = per_doc.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "spans", "items",
                            _covered(F.col("spans")).alias("_hit"))
    sized = docs.select(*text_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return sized.join(judged, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left").select(
        "doc_id", "_text", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), "spans",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns kept."""
    bad = stored(contamination(docs.select("doc_id", "text"), benchmark).filter("contaminated").select(
        F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).distinct(), "contaminated")
    rows, columns = set_apart(docs)
    same = F.col("_in_doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("_in_text") == F.col("_t"))
    return rows.join(bad, same, "left_anti").select(*columns)


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("_text", "spans")


_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) <= {WINDOW} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i:i+{WINDOW - 1}], ' ')) END) AS win,
    least(len(ws), {WINDOW}) AS size FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS p0, ws FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size),
hit AS (SELECT doc_id, item_id, p0, dw.size FROM dw JOIN bw ON dw.size = bw.size AND array_to_string(ws[p0:p0+dw.size-1], ' ') = win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + size)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hit GROUP BY 1)
SELECT d.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
