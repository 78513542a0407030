"""Statistics over fonts, images, scans, engines and histograms. All grouped work is partial-then-final."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.functions.numbers import snap
from vestigia.functions.text import subset_name, subset_prefix
from vestigia.operators.common import computed_once

# Font families per vendor, generator words and sizes, thresholds.
FONT_ORIGINS = [
    ("Microsoft", ["arial", "times new roman", "calibri", "cambria", "segoe", "consolas", "courier new", "verdana", "tahoma",
                   "comic sans", "trebuchet", "georgia", "impact", "palatino"]),
    ("Apple/macOS", ["helvetica", "san francisco", "sf pro", "menlo", "avenir", "optima", "gill sans"]),
    ("Adobe", ["minionpro", "myriadpro", "adobegaramond", "sourcesan", "sourcecode", "sourceserif", "acaslonpro", "kozuka",
               "kozgopr", "ryo"]),
    ("Google Fonts", ["roboto", "open sans", "lato", "montserrat", "noto", "poppins", "raleway", "ubuntu", "playfair", "inter"]),
    ("LaTeX/TeX", ["cmbx", "cmr", "cmti", "cmsy", "cmex", "lm", "libertinus", "txsy", "rsfs", "eufm"]),
    ("Open Source/Linux", ["liberation", "dejavu", "freesans", "freeserif", "freemono", "nimbus"]),
]
SPACED_ORIGINS = ("Microsoft", "Apple/macOS", "Google Fonts")
PREFIX_ORIGINS = ("LaTeX/TeX",)
GENERATOR_WORDS = [
    "stable diffusion", "diffusion", "midjourney", "dall-e", "dalle", "comfyui", "automatic1111", "novelai", "adobe firefly",
    "firefly", "ideogram", "flux", "sdxl", "sd ", "diffusers", "hugging face", "invoke", "a1111", "fooocus",
]
GENERATOR_SIZES = [
    (512, 512), (768, 768), (1024, 1024), (1024, 768), (768, 1024), (1280, 720), (1920, 1080), (2048, 2048), (1024, 576),
    (576, 1024), (896, 1152), (1152, 896), (832, 1216), (1216, 832), (1344, 768),
]
SCAN_DPI = [200, 300, 400, 600]


def font_origin(name: Column) -> Column:
    low = F.lower(name)
    packed = F.replace(low, F.lit(" "), F.lit(""))
    result = F.lit("Unknown")
    for origin, families in reversed(FONT_ORIGINS):
        if origin in PREFIX_ORIGINS:
            tests = [low.startswith(f) for f in families]
        elif origin in SPACED_ORIGINS:
            tests = [packed.contains(f.replace(" ", "")) for f in families]
        else:
            tests = [low.contains(f) for f in families]
        result = F.when(reduce(lambda a, c: a | c, tests), origin).otherwise(result)
    return result


def distinct_fonts(fonts: DataFrame, first: Sequence[str]) -> DataFrame:
    """One row per document and font name; the first use decides type and embedding."""
    kept = F.min_by(F.struct("subtype", "embedded"), F.struct(*first))
    return fonts.groupBy("doc_id", "base_font").agg(kept.alias("k")).select("doc_id", "base_font", "k.*")


def font_stats(fonts: DataFrame) -> DataFrame:
    kind = F.col("subtype")
    typed = (F.when(kind.contains("Type1"), "type1").when(kind.contains("TrueType"), "truetype")
             .when(kind.contains("Type3"), "type3").when(kind.contains("CIDFont"), "cid"))
    marked = fonts.withColumns({"_kind": typed, "_prefix": subset_prefix(F.col("base_font"))})
    stats = marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_fonts"),
        *[F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in ("type1", "truetype", "type3", "cid")],
        F.count_if("embedded").alias("n_embedded"), F.count_if(~F.col("embedded")).alias("n_system"),
        F.count("_prefix").alias("n_subset"), F.countDistinct("_prefix").alias("n_prefixes"))
    return stats.withColumns({
        "type3_severity": F.when(F.col("n_type3") > 0, "MEDIUM"),
        "embedding_severity": F.when((F.col("n_system") > 0) & (F.col("n_embedded") == 0), "LOW"),
        "prefix_severity": F.when(F.col("n_prefixes") > 1, "INFO")})


def origin_histogram(fonts: DataFrame) -> DataFrame:
    named = computed_once(fonts, "_name", F.lower(subset_name(F.col("base_font"))))
    return named.groupBy("doc_id", font_origin(F.col("_name")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def engine_verdicts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only engines that scanned count; no engine at all means clean."""
    on = F.col("scanned")
    return rows.groupBy(key).agg(
        F.coalesce(F.sum(F.when(on, F.col("detections"))), F.lit(0)).cast("long").alias("total_detections"),
        F.coalesce(F.bool_and(F.when(on, F.col("clean"))), F.lit(True)).alias("is_clean"),
        F.count_if(on & ~F.col("clean")).alias("n_dirty"),
        F.count_if(on & (F.col("category") == "malicious")).alias("malicious"),
        F.count_if(on & (F.col("category") == "suspicious")).alias("suspicious"), F.count_if(on).alias("n_scanned"))


def failure_ratio(rows: DataFrame, failed: Column, key: str = "doc_id") -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))
    bad = (F.col("failed") > F.col("total") * 0.3) & (F.col("total") > 5)
    return counts.withColumn("severity", F.when(bad, "MEDIUM"))


def scan_confidence(images: DataFrame, order: Sequence[str]) -> DataFrame:
    """Points per image, summed per document; the device type follows halftone, bilevel, scan."""
    dpi = (F.col("img_w") / (F.col("page_w") / 72) + F.col("img_h") / (F.col("page_h") / 72)) / 2
    area = (F.col("page_w") / 72 * F.col("_dpi")) * (F.col("page_h") / 72 * F.col("_dpi"))
    fill = F.when(F.col("_dpi") > 50, F.col("img_w") * F.col("img_h") / F.greatest(area, F.lit(1.0))).otherwise(0.0)
    bilevel = F.col("bits") == 1
    measured = images.withColumn("_dpi", dpi).withColumns({"_fill": fill, "_snap": snap(F.col("_dpi"))}).withColumn(
        "_points",
        F.when(F.col("_fill") > 0.8, 30).otherwise(0) + F.when(F.col("_snap").isin(SCAN_DPI), 15).otherwise(0)
        + F.when(bilevel, 20).otherwise(0) + F.when(F.col("filter").rlike("CCITT|JBIG2"), 20).otherwise(0)
        + F.when(F.col("halftone"), 15).otherwise(0) + F.when(F.col("banding"), 10).otherwise(0))
    per_doc = measured.groupBy("doc_id").agg(
        F.sum("_points").alias("points"), F.bool_or("halftone").alias("_halftone"), F.bool_or(bilevel).alias("_bilevel"),
        F.min_by("_snap", F.when(F.col("_snap").isNotNull(), F.struct(*order))).alias("dpi"))
    confidence = F.least(F.col("points") / 100.0, F.lit(1.0))
    scanned = F.col("confidence") > 0.5
    return per_doc.withColumn("confidence", confidence).select(
        "doc_id", "points", "confidence", scanned.alias("is_scanned"), "dpi",
        F.when(F.col("_halftone"), "Laser/LED").when(F.col("_bilevel"), "Fax/Bilevel Scanner")
        .when(scanned, "Flatbed/ADF Scanner").alias("device"))


def synthetic_score(images: DataFrame) -> DataFrame:
    """Additive signals from image metadata with verdict and confidence. Row-local."""
    software = F.lower(F.coalesce("software", F.lit("")))
    word = F.coalesce(*[F.when(software.contains(w), w) for w in GENERATOR_WORDS])
    camera, lens, iso = (F.coalesce(F.col(c), F.lit(False)) for c in ("has_camera", "has_lens", "has_iso"))
    known_size = reduce(lambda a, c: a | c, [(F.col("width") == w) & (F.col("height") == h) for w, h in GENERATOR_SIZES])
    bare = ~F.coalesce("has_gps", F.lit(False)) & ~F.coalesce("has_date", F.lit(False)) & ~camera
    signals = [
        (F.col("_word").isNotNull(), 40, "software"), (~camera & ~lens & ~iso, 15, "no_camera_data"),
        (~camera & (lens | iso), 8, "no_camera_model"), (F.col("hf_ratio") < 0.001, 15, "smooth"), (known_size, 10, "size"),
        (bare, 10, "no_place_no_date"),
    ]
    score = F.when(F.col("hf_ratio") > 0.05, -10).otherwise(0)
    for test, points, _ in signals:
        score = score + F.when(test, points).otherwise(0)
    fired = F.filter(F.array(*[F.when(t, n) for t, _, n in signals]), lambda s: s.isNotNull())
    s = F.col("score")
    verdict = F.when(s >= 50, "LIKELY_AI").when(s >= 25, "POSSIBLY_AI").when(s >= 10, "UNCERTAIN").otherwise("LIKELY_REAL")
    confidence = (F.when(s >= 50, F.least(F.lit(95), s)).when(s >= 25, F.least(F.lit(70), s)).when(s >= 10, s)
                  .otherwise(F.greatest(F.lit(0), 100 - s * 5)))
    scored = images.withColumn("_word", word).withColumn("score", score).withColumn("signals", F.array_join(fired, ","))
    return scored.withColumns({"verdict": verdict, "confidence": confidence}).drop("_word")


def value_pair_chi_square(values: DataFrame, group: str, value: str) -> DataFrame:
    """Chi-square over the value pairs (2k, 2k+1), k < 127, from counts: one aggregate per pair, then one
    per group; the rows themselves are only counted."""
    pair = F.floor(F.col(value) / 2)
    counts = values.groupBy(group, pair.alias("_pair")).agg(
        F.count_if(F.col(value) % 2 == 0).alias("_n0"), F.count_if(F.col(value) % 2 != 0).alias("_n1"))
    expected = (F.col("_n0") + F.col("_n1")) / 2
    inside = F.col("_pair").between(0, 126)
    part = (F.pow(F.col("_n0") - expected, 2) + F.pow(F.col("_n1") - expected, 2)) / expected
    total = counts.groupBy(group).agg(
        F.sum(F.col("_n0") + F.col("_n1")).alias("n_values"), F.sum(F.when(inside, part)).alias("_chi"), F.count_if(inside).alias("_pairs"))
    norm = F.coalesce(F.col("_chi") / (2 * F.col("_pairs")), F.lit(0.0))
    return total.withColumn("_norm", norm).select(
        group, "n_values", F.round("_norm", 6).alias("chi_norm"), ((F.col("_norm") < 0.5) & (F.col("n_values") > 10000)).alias("suspected"))


def histogram_parity(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean count of the bins −24, −22 … 4 against the bins −25, −23 … 3."""
    v = F.col(value)
    first = v.between(-25, 3) & (v % 2 != 0)
    second = v.between(-24, 4) & (v % 2 == 0)
    means = values.groupBy(group).agg((F.count_if(first) / 15).alias("even_mean"), (F.count_if(second) / 15).alias("odd_mean"))
    ratio = F.when(F.col("even_mean") > 0, F.col("odd_mean") / (F.col("even_mean") + 1)).otherwise(F.lit(1.0))
    return means.withColumn("_ratio", ratio).select(
        group, F.round("_ratio", 6).alias("ratio"), ((F.col("_ratio") > 1.4) & (F.col("even_mean") > 10)).alias("double_compressed"))


def dispersion_inhomogeneity(values: DataFrame, key: str, region: str, value: str) -> DataFrame:
    per_region = values.groupBy(key, region).agg(F.stddev_pop(value).alias("_sd"))
    spread = per_region.groupBy(key).agg(F.max("_sd").alias("_max"), F.min("_sd").alias("_min"))
    inhom = (F.col("_max") - F.col("_min")) / (F.col("_max") + F.lit(1e-10))
    return spread.select(key, F.round(inhom, 4).alias("inhomogeneity"),
                         F.when(inhom > 0.4, "INHOMOGENEOUS").otherwise("NORMAL").alias("verdict"))


def duplicate_blocks(blocks: DataFrame, key: str, digest: str, spread: str) -> DataFrame:
    """Repeated blocks: all (flagged above 5), and those that are not uniform (flagged above 8)."""
    groups = blocks.groupBy(key, digest).agg(F.count(F.lit(1)).alias("_n"), F.max(spread).alias("_spread"))
    extra = F.col("_n") - 1
    sums = groups.groupBy(key).agg(
        F.sum(extra).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("_spread") > 5, extra)), F.lit(0)).alias("textured_duplicates"))
    return sums.withColumns({"copied": F.col("duplicates") > 5, "textured_copied": F.col("textured_duplicates") > 8})


def distinct_creators(profiles: DataFrame) -> DataFrame:
    unique = profiles.groupBy("doc_id", "profile_id").agg(F.min("creator").alias("creator"))
    counts = unique.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_profiles"), F.countDistinct(F.when(F.col("creator") != "", F.col("creator"))).alias("n_creators"))
    return counts.withColumn("severity", F.when((F.col("n_profiles") > 1) & (F.col("n_creators") > 1), "MEDIUM"))


def change_authors(log: DataFrame, approx: bool = False) -> DataFrame:
    """Entries and distinct authors per document; the approximate count keeps constant state per document."""
    authors = F.approx_count_distinct("author") if approx else F.countDistinct("author")
    return log.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_changes"), authors.alias("n_authors"))


def blank_parts(parts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Parts whose share of blank characters is above 0.99."""
    n = F.length(text)
    ratio = F.regexp_count(F.col(text), F.lit(r"\s")) / F.greatest(n, F.lit(1))
    return parts.select(*keys, F.round(ratio, 4).alias("ratio"), (ratio > 0.99).alias("_blank")).filter("_blank").drop("_blank")


def argmin_quality(df: DataFrame, qualities: list[int], diffs: str, keys: Sequence[str]) -> DataFrame:
    """Candidate with the smallest difference; marked if that is clearly below the mean."""
    pairs = F.array(*[F.struct(F.get(F.col(diffs), F.lit(i)).alias("d"), F.lit(q).alias("q")) for i, q in enumerate(qualities)])
    best = F.array_min("_p")
    mean = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["d"]) / len(qualities)
    return df.withColumn("_p", pairs).select(
        *keys, best["q"].alias("best_quality"), F.round(best["d"], 3).alias("min_diff"), (best["d"] < mean * 0.7).alias("ghost"))
