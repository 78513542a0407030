"""Fingerprints per document and their comparison inside comparison sets.

Digests are computed row by row from the whole text. Documents are compared only inside comparison sets,
as the corpus-wide search for equal values is the business of the matching operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators import compare

# Weight of each fingerprint dimension.
DIMENSION_WEIGHTS = {"structural": 0.2, "font": 0.25, "metadata": 0.2, "style": 0.15, "content": 0.2}
SHINGLE_WORDS = 3
MIN_SHINGLES = 5


def canonical_hash(**features: Column) -> Column:
    """MD5 of the features as JSON with sorted keys."""
    fields = [features[name].alias(name) for name in sorted(features)]
    return F.md5(F.to_json(F.struct(*fields)))


def fingerprint_similarity(members: DataFrame) -> DataFrame:
    """Weighted share of equal dimensions per pair; a missing dimension counts neither way."""
    dims = list(DIMENSION_WEIGHTS)
    found = compare.pairs(members, dims)
    score = F.lit(0.0)
    equal, unequal = [], []
    for d, weight in DIMENSION_WEIGHTS.items():
        a, b = F.col(f"a.{d}"), F.col(f"b.{d}")
        score = score + F.when(a == b, F.lit(weight)).otherwise(F.lit(0.0))
        equal.append(F.when(a == b, d))
        unequal.append(F.when(a != b, d))
    return found.select(
        "comparison_id", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.round(score, 4).alias("similarity"),
        F.concat_ws(",", *equal).alias("identical"), F.concat_ws(",", *unequal).alias("different"))


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """Distinct runs of three words of the whole text. The words become a column first, so that the text is
    split once and not once per run."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\W+"), lambda t: t != "")
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_words") - SHINGLE_WORDS),
        lambda i: F.concat_ws(" ", *[F.get(F.col("_words"), i + k) for k in range(SHINGLE_WORDS)]))
    listed = F.when(F.size("_words") >= SHINGLE_WORDS, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_words", words).withColumn(out, listed).drop("_words")


def sign_digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fixed-length similarity digest: the majority of each of 64 bits of the MD5 over the shingles of a document. Null
    for texts that are too small or too uniform. Shingles are reduced by partial aggregation."""
    hashed = with_shingles(df.select(key, text), text, "_s").select(key, F.explode_outer("_s").alias("_s")).select(
        key, F.md5("_s").alias("_m")).select(
        key, *[F.conv(F.substring("_m", 1 + 8 * half, 8), 16, 10).cast("long").alias(f"_h{1 - half}") for half in (0, 1)])
    bits = [F.sum(F.when(F.shiftright(f"_h{i // 32}", i % 32).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"_b{i}") for i in range(64)]
    signed = hashed.groupBy(key).agg(F.count("_h0").alias("n_shingles"), *bits)
    digest = F.concat(*[F.when(F.col(f"_b{i}") > 0, "1").otherwise("0") for i in reversed(range(64))])
    enough = F.col("n_shingles") >= MIN_SHINGLES
    return signed.select(key, "n_shingles", F.when(enough, F.lower(F.lpad(F.conv(digest, 2, 16), 16, "0"))).alias("signature"))


def exact_resemblance(members: DataFrame, text: str) -> DataFrame:
    """Exact share of common shingles for the pairs inside comparison sets. Shingles travel as hashes of eight bytes."""
    hashed = with_shingles(members, text, "_sh").withColumn("_sh", F.transform("_sh", lambda s: F.xxhash64(s)))
    found = compare.pairs(hashed, ["_sh"])
    common = F.size(F.array_intersect(F.col("a._sh"), F.col("b._sh")))
    union = F.size("a._sh") + F.size("b._sh") - common
    return found.select("comparison_id", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"),
                        F.round(common / F.greatest(union, F.lit(1)), 6).alias("resemblance"))


def grid_clusters(points: DataFrame, keys: list[str], x: str, y: str, cell: float = 10, min_size: int = 3) -> DataFrame:
    """Points grouped by grid cell with their centroid. Unlike a greedy walk the result does not depend on
    the order of the points."""
    cells = points.groupBy(*keys, F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("center_x"), F.avg(y).alias("center_y"))
    return cells.filter(F.col("n") >= min_size)
