"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures, confirmed on whole shingle sets.

At a share of 85 a signature has 50 slots of 16 bits in 10 chunks of five. Two signatures that differ in at most 19 slots have a chunk with
at most one wrong slot (pigeonhole), and then agree on one of the five keys that leave a slot of that chunk out. So the join
on 50 keys a document finds every pair within distance 19, and most beyond. At similarity 0.85 a pair is missed only
if each of the ten chunks has two wrong slots: 1.5e-8. Lower shares take more chunks for the same chance (`layout`).

Groups are never expanded into pairs:
 1. documents with equal shingle sets become one representative (smallest id);
 2. each key links its holders to its smallest holder; components of these links are loose clusters;
 3. clusters are cut into blocks of bounded size. A task compares one block, with the cluster's hub, and returns a spanning
    forest of the true links;
 4. only clusters of several blocks go on: what is not linked to the hub meets every block of its cluster, two blocks a
    task, again returning forests. Documents that are linked to the hub need not meet one another;
 5. components of all forests.

Rows: a null, empty or blank text has no shingles and is linked with nothing. A null id keeps its row with a null component.
Rows that repeat an id with the same text get the same result; with other texts, each row is judged by its own text.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import components, set_apart, stored, table
from vestigia.llm.words import mix64, shingle_sets

CHUNKS, SLOTS = 10, 5
K = CHUNKS * SLOTS
RADIUS = 2 * CHUNKS - 1
SHARE = 85  # a link needs 100 * intersection >= share * union; this is the share of op9
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
_MULTIPLIERS = mix64(np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def layout(share: int) -> tuple[int, int]:
    """`(chunks, far)`: as many chunks as leave a chance of 1.6e-8 at most that a pair at the share has two wrong slots in each, and the
    number of slots that such a pair exceeds with a chance of 1e-8 at most. 10 and 24 at 85, 14 and 35 at 80."""
    p = 1 - share / 100
    two = 1 - (1 - p) ** SLOTS - SLOTS * p * (1 - p) ** (SLOTS - 1)
    chunks = next(c for c in range(CHUNKS, len(_MULTIPLIERS) // SLOTS + 1) if two ** c <= 1.6e-8)
    n = chunks * SLOTS
    chance = lambda far: sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(far + 1, n + 1))
    return chunks, next(far for far in range(n + 1) if chance(far) <= 1e-8)


def signature(shingles: np.ndarray, slots: int = K) -> np.ndarray:
    """Slots of 16 bits: low bits of the mixed minimum of each hash function."""
    least = np.full(slots, ~np.uint64(0))
    for i in range(0, len(shingles), 8192):
        least = np.minimum(least, (shingles[i:i + 8192, None] * _MULTIPLIERS[:slots]).min(0))
    return mix64(least).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature as many keys as slots: per chunk, the four slots left when one is taken out."""
    n, slots = signatures.shape
    chunks = signatures.reshape(n, slots // SLOTS, SLOTS).astype(np.uint64)
    out = np.empty((n, slots // SLOTS, SLOTS), np.uint64)
    for drop in range(SLOTS):
        packed = np.zeros((n, slots // SLOTS), np.uint64)
        for s in range(SLOTS):
            if s != drop:
                packed = (packed << np.uint64(16)) | chunks[:, :, s]
        seed = mix64(np.arange(slots // SLOTS, dtype=np.uint64) * np.uint64(SLOTS) + np.uint64(drop + 1))
        out[:, :, drop] = mix64(packed ^ seed)
    return out.reshape(n, slots).view(np.int64)


def _signed(slots: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for s in shingle_sets(batch["text"]):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s, slots).tobytes() if len(s) else bytes(2 * slots))
            found = keys(np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, slots)) if sizes else np.zeros((0, slots), np.int64)
            ends = pa.array(np.arange(0, slots * len(sizes) + 1, slots, dtype=np.int32))
            yield pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                   pa.ListArray.from_arrays(ends, pa.array(found.ravel()))],
                                  ["doc_id", "n_shingles", "digest", "keys"])
    return signed


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch["text"])]
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*[batch[n] for n in rest], pa.array(sets, pa.binary())], [*rest, "shingles"])


def forest(ids: list[int], sets: list[np.ndarray], settled: list[bool], sides: list[int] | None = None,
           share: int = SHARE) -> list[tuple[int, int]]:
    """`(document, root)` for each document that is linked with an earlier one of the list, directly or through others.
    Settled documents are linked to the same hub already. With two sides, only pairs across them are compared."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    chunks, far = layout(share)
    marks = np.array([signature(s, chunks * SLOTS) for s in sets])
    side = np.array(sides if sides is not None and len(set(sides)) > 1 else range(n))
    first = settled.index(True) if True in settled else 0
    parent = [first if settled[i] else i for i in range(n)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[(100 * np.minimum(size[i], size[rest]) >= share * np.maximum(size[i], size[rest])) & (side[rest] != side[i])]
        rest = rest[(marks[rest] != marks[i]).sum(1) <= far]
        rest = np.array([j for j in rest if root(j) != root(i)], dtype=int)
        if len(rest) == 0:
            continue
        joined = np.concatenate([sets[j] for j in rest])
        at = np.searchsorted(sets[i], joined)
        hit = (sets[i][np.minimum(at, len(sets[i]) - 1)] == joined).astype(np.int64)
        shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[rest])[:-1]]))
        for j in rest[100 * shared >= share * (size[i] + size[rest] - shared)]:
            low, high = sorted((root(i), root(int(j))))
            parent[high] = low
    return [(ids[i], ids[root(i)]) for i in range(n) if root(i) != i]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Groups of equal `(cluster, part)` from rows sorted by these: lists of `(doc_id, mark, side, shingles)`."""
    now, rows = None, []
    for batch in batches:
        names = ("cluster", "part", "doc_id", "mark", "side", "shingles")
        for cluster, part, *row in zip(*(batch[n].to_pylist() for n in names)):
            if (cluster, part) != now:
                if rows:
                    yield rows
                now, rows = (cluster, part), []
            rows.append(row)
    if rows:
        yield rows


def _judge(settle: bool, share: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            rows.sort(key=lambda r: (-r[1], r[0]))
            ids, marks, sides, sets = zip(*rows)
            edges = forest(list(ids), [np.frombuffer(s, np.uint64) for s in sets],
                           [settle and m == 1 for m in marks], list(sides) if settle else None, share)
            columns = list(zip(*edges)) or [(), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b"])
    return judge


def _links(rows: DataFrame, settle: bool, share: int) -> DataFrame:
    """Forest edges of the groups `(cluster, part)`; a task holds one group at a time. With `settle`, rows of mark 1 count
    as linked to one another; without, mark 1 is the hub."""
    return stored(rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
                  .select("cluster", "part", "doc_id", "mark", "side", "shingles").mapInArrow(_judge(settle, share), "a long, b long"), "links")


def _across_blocks(sets: DataFrame, clusters: DataFrame, first: DataFrame, share: int) -> DataFrame:
    """Links across the blocks of the clusters that have several. Documents that reached the hub within their own block
    (mark 1) meet only those that did not."""
    many = clusters.filter("n_blocks > 1").select("cluster", "hub", "n_blocks")
    reached = first.join(many.select("hub"), F.col("b") == F.col("hub")).select(F.col("a").alias("doc_id")).union(
        many.select("hub")).distinct().withColumn("_hit", F.lit(1))
    rows = sets.filter("n_blocks > 1").select("cluster", "doc_id", "shingles").join(reached, "doc_id", "left").withColumn(
        "mark", F.coalesce("_hit", F.lit(0))).drop("_hit")
    count = lambda m: F.ceil(F.count(F.when(F.col("mark") == m, 1)) / (BLOCK_ROWS // 2))
    rounds = rows.drop("shingles").groupBy("cluster").agg(count(0).alias("n0"), count(1).alias("n1")).filter("n0 > 0")
    rounds = stored(rounds.join(many, "cluster").select(
        "cluster", F.greatest("n0", "n_blocks").alias("n0"), F.greatest("n1", "n_blocks").alias("n1")), "rounds")
    code = lambda i, j: i * (F.col("n0") + F.col("n1")) + j
    own = F.col("side")
    open_blocks = F.sequence(F.lit(0), F.col("n0") - 1)
    free = F.concat(F.transform(open_blocks, lambda j: code(F.least(j, own), F.greatest(j, own))),
                    F.transform(F.sequence(F.col("n0"), F.col("n0") + F.col("n1") - 1), lambda j: code(own, j)))
    bound = F.transform(open_blocks, lambda i: code(i, own))
    rows = rows.join(rounds, "cluster").withColumn("side", F.when(
        F.col("mark") == 1, F.col("n0") + F.pmod(F.xxhash64("doc_id"), "n1")).otherwise(F.pmod(F.xxhash64("doc_id"), "n0")))
    return _links(rows.withColumn("part", F.explode(F.when(F.col("mark") == 1, bound).otherwise(free))), settle=True, share=share)


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for each row of `docs(doc_id, text)`. Documents are linked from a similarity of `share`
    hundredths on."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(docs.mapInArrow(_signed(SLOTS * layout(share)[0]), "doc_id long, n_shingles long, digest binary, keys array<long>"), "signatures")
    whole = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    copies = stored(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("digest", "rep"), "copies")
    own = whole.join(copies.hint("merge"), "digest", "left").filter("rep IS NULL OR rep = doc_id")
    holders = own.select("doc_id", F.explode("keys").alias("key"))
    shared = stored(holders.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                               F.count(F.lit(1)).alias("n"))
                    .filter("first < last").select("key", "first", "n"), "shared-keys")
    held = stored(holders.join(shared.hint("merge"), "key").groupBy("doc_id", "first").agg(F.sum("n").alias("weight")), "held")
    # A document joins its first holders (one a key at most) as a star around the smallest of them, so large clusters give few edges.
    stars = held.groupBy("doc_id").agg(F.min("first").alias("a"), F.collect_set("first").alias("firsts")).select(
        "a", F.explode(F.array_union("firsts", F.array("doc_id"))).alias("b"))
    loose = components(stars)
    weights = held.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    sizes = signed.join(loose, signed.doc_id == loose.node).groupBy("node", "component").agg(F.sum("n_shingles").alias("size"))
    members = stored(sizes.join(weights, F.col("node") == weights.doc_id).select("doc_id", F.col("component").alias("cluster"), "weight", "size"),
                     "members")
    clusters = members.groupBy("cluster").agg(
        F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub"),
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("n_blocks"))
    clusters = stored(clusters, "clusters")
    placed = stored(members.join(clusters, "cluster").select(
        "doc_id", "cluster", "n_blocks", F.pmod(F.xxhash64("doc_id"), "n_blocks").alias("side"),
        (F.col("doc_id") == F.col("hub")).cast("int").alias("mark")), "placed")
    sets = stored(docs.join(placed.hint("merge"), "doc_id").select("doc_id", "cluster", "n_blocks", "side", "mark", "text").mapInArrow(
        _with_sets, "doc_id long, cluster long, n_blocks long, side long, mark int, shingles binary"), "sets")
    everywhere = F.when(F.col("mark") == 1, F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("side"))
    first = _links(sets.withColumn("part", F.explode(everywhere)), settle=False, share=share)
    group = components(first.union(_across_blocks(sets, clusters, first, share)))

    groups = group.select(F.col("node").alias("rep"), "component")
    named = signed.select("doc_id", "n_shingles", "digest").join(copies, "digest", "left").withColumn(
        "rep", F.coalesce("rep", "doc_id")).join(groups, "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row of each group of near duplicates, all columns kept: the one of the smallest id. Rows that repeat this id with
    equal text are one document, so one of them stays."""
    judged = near_duplicates(docs, share).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    judged = stored(judged.select(F.col("doc_id").alias("_kept"), "_rows"), "kept")
    rows, columns = set_apart(docs)
    rows = rows.join(judged.hint("merge"), F.col("_in_doc_id").eqNullSafe(F.col("_kept")))
    once = rows.filter("_rows = 1 OR _kept IS NULL")
    again = rows.filter("_rows > 1 AND _kept IS NOT NULL").dropDuplicates(["_in_doc_id", "_in_text"])
    return once.union(again).select(*columns)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    ELSE [array_to_string(ws, ' ')] END) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {SHARE} * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
