"""Numbers, vectors and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.functions import numbers as nm
from vestigia.operators import measures as ms
from vestigia.plans import bindings as b
from vestigia.plans.bindings import EV
from vestigia.plans.registry import query
from vestigia.plans.sequence_plans import ALPHA_SQL, LINES, ROMAN_SQL
from vestigia.sources.tables import table


@query("four_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def four_digests(spark, folder):
    """All digests from one pass; SHA-512 has no counterpart on the SQL side and is tested on its own."""
    return digests(table(spark, folder, "documents"), "text").drop("sha512")


def digests(df, content: str, key: str = "doc_id"):
    return df.select(key, F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"),
                     F.sha2(content, 512).alias("sha512"), F.octet_length(content).cast("long").alias("size"))


MASK = "event_id, CAST(event_id * 7 % 4096 AS BIGINT) AS mask"


@query("permission_bits", f"WITH m AS (SELECT {MASK} FROM events) SELECT event_id, " + ", ".join(
    f"(mask // {1 << bit}) % 2 = 1 AS {name}" for name, bit in nm.PERMISSION_BITS.items()) + " FROM m")
def permission_bits(spark, folder):
    masks = b.derived(spark, folder, "events", MASK)
    return masks.select("event_id", *[c.alias(n) for n, c in nm.permission_bits(F.col("mask")).items()])


@query("roman", f"""SELECT o_orderkey AS doc_id, {ROMAN_SQL.format(n='(o_custkey % 999 + 1)')} AS roman, {ALPHA_SQL.format(n='(o_custkey % 700 + 1)')} AS alpha FROM orders""")
def roman(spark, folder):
    n = F.col("o_custkey")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), nm.roman(n % 999 + 1).alias("roman"), nm.alpha_label(n % 700 + 1).alias("alpha"))


GPS = ("event_id, CAST(user_id AS DOUBLE) AS deg, CAST(event_id % 60 AS DOUBLE) AS mi, value / 3 AS sec, "
       + b.pick(["N", "S", "E", "W"], "(event_id % 4)") + " AS ref")


@query("dms_to_decimal", f"WITH g AS (SELECT {GPS} FROM events) SELECT event_id, round(CASE WHEN ref IN ('S', 'W') THEN -1 ELSE 1 END * (deg + mi / 60 + sec / 3600), 7) AS dec FROM g")
def dms_to_decimal(spark, folder):
    g = b.derived(spark, folder, "events", GPS)
    return g.select("event_id", nm.dms_to_decimal(F.col("deg"), F.col("mi"), F.col("sec"), F.col("ref")).alias("dec"))


REFTAB = "[" + ", ".join(str(v) for v in nm.REFERENCE_TABLE) + "]"
# Tables like those of images: the reference table, with entries moved where the vector is large.
DUCK_TAB = f"list_transform(range(1, 65), lambda i: CASE WHEN abs(embedding[i]) > 0.02 * (1 + vec_id % 12) THEN {REFTAB}[i] + 1 ELSE {REFTAB}[i] END)"


def quant_tables(spark, folder):
    ref = F.array(*[F.lit(v) for v in nm.REFERENCE_TABLE])
    limit = F.lit(0.02) * (1 + F.col("vec_id") % 12)
    moved = F.zip_with("embedding", ref, lambda e, r: F.when(F.abs(e.cast("double")) > limit, r + 1).otherwise(r))
    return table(spark, folder, "embeddings").select("vec_id", moved.alias("values"))


@query("vector_match_score", f"""WITH q AS (SELECT vec_id, {DUCK_TAB.replace('abs(embedding[i])', 'abs(CAST(embedding[i] AS DOUBLE))')} AS v FROM embeddings),
s AS (SELECT vec_id, len(list_filter(range(1, 65), lambda i: v[i] = {REFTAB}[i])) / 64 AS score FROM q)
SELECT vec_id, round(score, 3) AS score, score >= 0.9 AS matched, CASE WHEN score >= 0.9 THEN 'MEDIUM' END AS severity FROM s""")
def vector_match_score(spark, folder):
    scored = quant_tables(spark, folder).select("vec_id", nm.match_score(F.col("values")).alias("s"))
    return scored.select("vec_id", F.round("s", 3).alias("score"), (F.col("s") >= 0.9).alias("matched"),
                         F.when(F.col("s") >= 0.9, "MEDIUM").alias("severity"))


DC = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 3 * (1 + vec_id % 40)) AS INT))"


@query("quality_from_dc", f"""WITH q AS (SELECT vec_id, {DC} AS v FROM embeddings)
SELECT vec_id, CASE WHEN v[1] <= 0 THEN 0 WHEN v[1] <= 2 THEN 95 WHEN v[1] <= 8 THEN 85 WHEN v[1] <= 16 THEN 75 WHEN v[1] <= 32 THEN 50 ELSE 30 END AS quality,
 round(len(list_distinct(v[33:64])) / 32, 4) AS tail_ratio, len(list_distinct(v[33:64])) / 32 < 0.15 AND list_max(v) > 1 AS suspicious FROM q""")
def quality_from_dc(spark, folder):
    scale = 3 * (1 + F.col("vec_id") % 40)
    q = table(spark, folder, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: F.floor(F.abs(x.cast("double")) * scale).cast("int")).alias("v"))
    ratio = nm.tail_distinct_ratio(F.col("v"))
    return q.select("vec_id", nm.quality_from_first(F.element_at("v", 1)).alias("quality"), F.round(ratio, 4).alias("tail_ratio"),
                    ((ratio < 0.15) & (F.array_max("v") > 1)).alias("suspicious"))


ASPECT = ("event_id, CAST(400 + event_id % 300 AS DOUBLE) AS w1, CAST(300 + user_id % 100 AS DOUBLE) AS h1, CAST(160 AS DOUBLE) AS w2, CAST(100 + event_id % 30 AS DOUBLE) AS h2")


@query("aspect_consistency", f"""WITH a AS (SELECT {ASPECT} FROM events) SELECT event_id, round(abs(w1 / h1 - w2 / h2) / (w1 / h1 + 1e-10) * 100, 6) AS difference_pct,
 abs(w1 / h1 - w2 / h2) / (w1 / h1 + 1e-10) < 0.05 AS consistent, abs(w1 / h1 - w2 / h2) > 0.1 AS mismatch FROM a""")
def aspect_consistency(spark, folder):
    sides = [F.col(c) for c in ("w1", "h1", "w2", "h2")]
    diff = nm.aspect_difference(*sides)
    return b.derived(spark, folder, "events", ASPECT).select(
        "event_id", F.round(diff * 100, 6).alias("difference_pct"), (diff < 0.05).alias("consistent"), (nm.aspect_gap(*sides) > 0.1).alias("mismatch"))


@query("vector_diff_ratio", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 100) AS v FROM embeddings)
SELECT a.vec_id AS vec_id, round(len(list_filter(range(1, 65), lambda i: abs(a.v[i] - b.v[i]) > 10)) / 64, 4) AS ratio FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_diff_ratio(spark, folder):
    """Each vector against the next one."""
    scaled = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("v"))
    following = scaled.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return scaled.join(following, "vec_id").select("vec_id", nm.diff_ratio(F.col("v"), F.col("w"), 10).alias("ratio"))


@query("snap_to_standard", """WITH d AS (SELECT l_orderkey AS doc_id, l_linenumber AS image, l_quantity * 13 AS dpi FROM lineitem),
s AS (SELECT doc_id, image, dpi, (SELECT min_by(s, abs(dpi - s) * 10000 + s) FROM (VALUES (72), (96), (150), (200), (300), (400), (600), (1200)) t(s)) AS best FROM d)
SELECT doc_id, image, dpi, CASE WHEN abs(dpi - best) < 5 THEN best END AS standard FROM s""")
def snap_to_standard(spark, folder):
    d = b.derived(spark, folder, "lineitem", "l_orderkey AS doc_id, l_linenumber AS image, l_quantity * 13 AS dpi")
    return d.withColumn("standard", nm.snap(F.col("dpi")))


QUALITIES = [50, 55, 60, 65, 70, 75, 80, 85, 90, 95]


@query("argmin_quality", f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE)) * 10) AS d FROM embeddings)
SELECT vec_id, ({QUALITIES})[list_position(d, list_min(d))] AS best_quality, round(list_min(d), 3) AS min_diff, list_min(d) < list_avg(d) * 0.7 AS ghost FROM e""")
def argmin_quality(spark, folder):
    diffs = table(spark, folder, "embeddings").select("vec_id", F.transform(
        F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")) * 10).alias("d"))
    return ms.argmin_quality(diffs, QUALITIES, "d", ["vec_id"])


FONTS = ["ABCDEF+ArialMT", "Times New Roman", "GHIJKL+Helvetica", "MinionPro-Regular", "Roboto-Bold", "CMR10", "DejaVuSans", "Fancy", "ABCDEF+Calibri",
         "MNOPQR+OpenSans", "SFPro-Text", "XLMono", "Nimbus Sans", "ABCDEF+SourceSansPro", "LMRoman10", "Comic Sans MS"]
ORIGIN = ["Microsoft", "Microsoft", "Apple/macOS", "Adobe", "Google Fonts", "LaTeX/TeX", "Open Source/Linux", "Unknown", "Microsoft", "Google Fonts",
          "Apple/macOS", "Unknown", "Open Source/Linux", "Adobe", "LaTeX/TeX", "Microsoft"]
TYPES = ["TrueType", "Type1", "Type3", "CIDFontType2", "Type0"]
FT = (f"l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS part, {b.pick(FONTS, '(l_partkey % 16)')} AS base_font, {b.pick(TYPES, '(l_partkey % 5)')} AS subtype, l_suppkey % 3 > 0 AS embedded")
FD = f"""fr AS (SELECT {FT} FROM lineitem), ff AS (SELECT doc_id, base_font, arg_min(subtype, page * 1000000 + part) AS subtype,
 arg_min(embedded, page * 10000000000 + part * 10000 + ascii(subtype) * 10 + length(subtype)) AS emb FROM fr GROUP BY ALL)"""


def _fonts(spark, folder):
    return ms.distinct_fonts(b.derived(spark, folder, "lineitem", FT), ["page", "part", "subtype", "embedded"])


@query("font_stats", f"""WITH fr AS (SELECT {FT} FROM lineitem), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base_font ORDER BY page, part, subtype, embedded) AS rn FROM fr),
c AS (SELECT doc_id, count(*) AS n_fonts, count(*) FILTER (contains(subtype, 'Type1')) AS n_type1, count(*) FILTER (contains(subtype, 'TrueType')) AS n_truetype,
 count(*) FILTER (contains(subtype, 'Type3')) AS n_type3, count(*) FILTER (contains(subtype, 'CIDFont')) AS n_cid, count(*) FILTER (embedded) AS n_embedded,
 count(*) FILTER (NOT embedded) AS n_system, count(*) FILTER (contains(base_font, '+')) AS n_subset, count(DISTINCT CASE WHEN contains(base_font, '+') THEN base_font[1:6] END) AS n_prefixes
 FROM rk WHERE rn = 1 GROUP BY 1)
SELECT *, CASE WHEN n_type3 > 0 THEN 'MEDIUM' END AS type3_severity, CASE WHEN n_system > 0 AND n_embedded = 0 THEN 'LOW' END AS embedding_severity,
 CASE WHEN n_prefixes > 1 THEN 'INFO' END AS prefix_severity FROM c""")
def font_stats(spark, folder):
    return ms.font_stats(_fonts(spark, folder))


@query("origin_histogram", f"""WITH fr AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 16 AS i FROM lineitem)
SELECT doc_id, {b.pick(ORIGIN, 'i')} AS origin, count(*) AS n FROM fr GROUP BY ALL""")
def origin_histogram(spark, folder):
    return ms.origin_histogram(_fonts(spark, folder))


ENGINE = ("user_id AS doc_id, event_type AS engine, event_id % 5 > 0 AS scanned, event_id % 3 > 0 AS clean, CAST(event_id % 4 AS BIGINT) AS detections, "
          + b.pick(["harmless", "malicious", "suspicious"], "(event_id % 3)") + " AS category")


@query("engine_verdicts", f"""WITH e AS (SELECT {ENGINE} FROM events)
SELECT doc_id, CAST(coalesce(sum(detections) FILTER (scanned), 0) AS BIGINT) AS total_detections, coalesce(bool_and(clean) FILTER (scanned), true) AS is_clean,
 count(*) FILTER (scanned AND NOT clean) AS n_dirty, count(*) FILTER (scanned AND category = 'malicious') AS malicious,
 count(*) FILTER (scanned AND category = 'suspicious') AS suspicious, count(*) FILTER (scanned) AS n_scanned FROM e GROUP BY 1""")
def engine_verdicts(spark, folder):
    return ms.engine_verdicts(b.derived(spark, folder, "events", ENGINE))


@query("failure_ratio", f"""WITH {EV} SELECT doc_id, count(*) AS total, count(*) FILTER (severity = 'HIGH') AS failed,
 CASE WHEN count(*) FILTER (severity = 'HIGH') > count(*) * 0.3 AND count(*) > 5 THEN 'MEDIUM' END AS severity FROM ev GROUP BY 1""")
def failure_ratio(spark, folder):
    return ms.failure_ratio(b.findings(spark, folder), F.col("severity") == "HIGH")


IMG = ("l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS part, CAST(595.28 AS DOUBLE) AS page_w, CAST(841.89 AS DOUBLE) AS page_h, "
       "595.28 / 72 * (CASE l_partkey % 6 WHEN 0 THEN 72 WHEN 1 THEN 150 WHEN 2 THEN 203 WHEN 3 THEN 300 WHEN 4 THEN 310 ELSE 30 END) AS img_w, "
       "841.89 / 72 * (CASE l_partkey % 6 WHEN 0 THEN 72 WHEN 1 THEN 150 WHEN 2 THEN 203 WHEN 3 THEN 300 WHEN 4 THEN 20 ELSE 30 END) AS img_h, "
       "CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 8 END AS bits, " + b.pick(["DCTDecode", "CCITTFaxDecode", "JBIG2Decode", "FlateDecode"], "(l_suppkey % 4)") + " AS filter, "
       "l_partkey % 10 = 3 AS halftone, l_partkey % 8 = 2 AS banding")


@query("scan_confidence", f"""WITH i AS (SELECT {IMG.replace('AS filter', 'AS flt')} FROM lineitem), d AS (SELECT *, CASE part % 6 WHEN 0 THEN 72 WHEN 1 THEN 150 WHEN 2 THEN 200 WHEN 3 THEN 300 END AS snap FROM i),
p AS (SELECT *, CASE WHEN part % 6 < 4 THEN 30 WHEN part % 6 = 4 THEN 0 ELSE 0 END + CASE WHEN snap IN (200, 300) THEN 15 ELSE 0 END + CASE WHEN bits = 1 THEN 20 ELSE 0 END
 + CASE WHEN flt IN ('CCITTFaxDecode', 'JBIG2Decode') THEN 20 ELSE 0 END + CASE WHEN halftone THEN 15 ELSE 0 END + CASE WHEN banding THEN 10 ELSE 0 END AS pts FROM d),
g AS (SELECT doc_id, CAST(sum(pts) AS BIGINT) AS points, bool_or(halftone) AS h, bool_or(bits = 1) AS bl, arg_min(snap, page * 1000000 + part) FILTER (snap IS NOT NULL) AS dpi FROM p GROUP BY 1)
SELECT doc_id, points, least(points / 100.0, 1.0)::DOUBLE AS confidence, least(points / 100.0, 1.0) > 0.5 AS is_scanned, dpi, CASE WHEN h THEN 'Laser/LED' WHEN bl THEN 'Fax/Bilevel Scanner'
 WHEN points > 50 THEN 'Flatbed/ADF Scanner' END AS device FROM g""")
def scan_confidence(spark, folder):
    images = b.derived(spark, folder, "lineitem", IMG)
    typed = images.withColumns({c: F.col(c).cast("double") for c in ("img_w", "img_h")})
    return ms.scan_confidence(typed, ["page", "part"])


SYN = ("o_orderkey AS doc_id, " + b.pick(["Adobe Firefly 2", "Photoshop", None, "SD 1.5", "Midjourney v6"], "(o_custkey % 5)") + " AS software, o_custkey % 3 = 0 AS has_camera, "
       "o_custkey % 4 = 0 AS has_lens, o_orderkey % 4 = 0 AS has_iso, CASE o_custkey % 3 WHEN 0 THEN 0.0005 WHEN 1 THEN 0.01 ELSE 0.06 END AS hf_ratio, "
       "CASE WHEN o_orderkey % 3 = 0 THEN 1024 ELSE 1000 END AS width, CASE WHEN o_orderkey % 2 = 0 THEN 768 ELSE 1024 END AS height, o_orderkey % 5 = 0 AS has_gps, o_orderkey % 7 = 0 AS has_date")


@query("signal_score", f"""WITH s AS (SELECT {SYN} FROM orders), p AS (SELECT *, software IS NOT NULL AND software <> 'Photoshop' AS a1, NOT has_camera AND NOT has_lens AND NOT has_iso AS a2,
 NOT has_camera AND (has_lens OR has_iso) AS a3, hf_ratio < 0.001 AS a4, width = 1024 AS a5, NOT has_gps AND NOT has_date AND NOT has_camera AS a6 FROM s),
q AS (SELECT doc_id, concat_ws(',', CASE WHEN a1 THEN 'software' END, CASE WHEN a2 THEN 'no_camera_data' END, CASE WHEN a3 THEN 'no_camera_model' END, CASE WHEN a4 THEN 'smooth' END,
 CASE WHEN a5 THEN 'size' END, CASE WHEN a6 THEN 'no_place_no_date' END) AS signals, CAST(40 * CAST(a1 AS INT) + 15 * CAST(a2 AS INT) + 8 * CAST(a3 AS INT) + 15 * CAST(a4 AS INT) + 10 * CAST(a5 AS INT)
 + 10 * CAST(a6 AS INT) - CASE WHEN hf_ratio > 0.05 THEN 10 ELSE 0 END AS INT) AS score FROM p)
SELECT doc_id, score, signals, CASE WHEN score >= 50 THEN 'LIKELY_AI' WHEN score >= 25 THEN 'POSSIBLY_AI' WHEN score >= 10 THEN 'UNCERTAIN' ELSE 'LIKELY_REAL' END AS verdict,
 CASE WHEN score >= 50 THEN least(95, score) WHEN score >= 25 THEN least(70, score) WHEN score >= 10 THEN score ELSE greatest(0, 100 - score * 5) END AS confidence FROM q""")
def signal_score(spark, folder):
    return ms.synthetic_score(b.derived(spark, folder, "orders", SYN)).select("doc_id", "score", "signals", "verdict", "confidence")


@query("value_pair_chi_square", """WITH v AS (SELECT l_returnflag AS grp, CAST(l_quantity AS INT) * 5 + l_linenumber % 2 AS v FROM lineitem), h AS (SELECT grp, v // 2 AS p, count(*) FILTER (v % 2 = 0) AS n0,
 count(*) FILTER (v % 2 = 1) AS n1 FROM v GROUP BY ALL), c AS (SELECT grp, CAST(sum(n0 + n1) AS BIGINT) AS n_values, sum(((n0 - (n0 + n1) / 2) ** 2 + (n1 - (n0 + n1) / 2) ** 2) / ((n0 + n1) / 2)) FILTER (p < 127)
 / (2 * count(*) FILTER (p < 127)) AS x FROM h GROUP BY 1) SELECT grp, n_values, round(x, 6) AS chi_norm, x < 0.5 AND n_values > 10000 AS suspected FROM c""")
def value_pair_chi_square(spark, folder):
    v = b.derived(spark, folder, "lineitem", "l_returnflag AS grp, CAST(l_quantity AS INT) * 5 + l_linenumber % 2 AS v")
    return ms.value_pair_chi_square(v, "grp", "v")


@query("histogram_parity", """WITH v AS (SELECT l_suppkey AS grp, CAST(l_quantity AS INT) - 30 AS v FROM lineitem), m AS (SELECT grp, count(*) FILTER (v BETWEEN -25 AND 3 AND v % 2 <> 0) / 15 AS e,
 count(*) FILTER (v BETWEEN -24 AND 4 AND v % 2 = 0) / 15 AS o FROM v GROUP BY 1), r AS (SELECT grp, e, CASE WHEN e > 0 THEN o / (e + 1) ELSE 1 END AS r FROM m)
SELECT grp, round(r, 6) AS ratio, r > 1.4 AND e > 10 AS double_compressed FROM r""")
def histogram_parity(spark, folder):
    v = b.derived(spark, folder, "lineitem", "l_suppkey AS grp, CAST(l_quantity AS INT) - 30 AS v")
    return ms.histogram_parity(v, "grp", "v")


@query("dispersion_inhomogeneity", f"""WITH {EV}, r AS (SELECT doc_id, k % 4 AS region, stddev_pop(score) AS sd FROM ev GROUP BY ALL), m AS (SELECT doc_id, (max(sd) - min(sd)) / (max(sd) + 1e-10) AS x FROM r GROUP BY 1)
SELECT doc_id, round(x, 4) AS inhomogeneity, CASE WHEN x > 0.4 THEN 'INHOMOGENEOUS' ELSE 'NORMAL' END AS verdict FROM m""")
def dispersion_inhomogeneity(spark, folder):
    found = b.findings(spark, folder).select("doc_id", (F.col("k") % 4).alias("region"), "score")
    return ms.dispersion_inhomogeneity(found, "doc_id", "region", "score")


@query("duplicate_blocks", f"""WITH {LINES}, g AS (SELECT doc_id, md5(line) AS h, count(*) AS n, max(len(list_distinct(string_split(line, '')))) AS s FROM ln GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(coalesce(sum(n - 1) FILTER (s > 5), 0) AS BIGINT) AS textured_duplicates FROM g GROUP BY 1)
SELECT *, duplicates > 5 AS copied, textured_duplicates > 8 AS textured_copied FROM s""")
def duplicate_blocks(spark, folder):
    """Lines stand for image blocks, their number of distinct characters for the spread of a block."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    spread = F.size(F.array_distinct(F.split("line", "")))
    blocks = lines.select("doc_id", F.md5("line").alias("digest"), spread.alias("spread"))
    return ms.duplicate_blocks(blocks, "doc_id", "digest", "spread")


PROF = "l_orderkey AS doc_id, l_partkey % 50 AS profile_id, CASE WHEN (l_partkey % 50) % 7 = 0 THEN '' ELSE 'c' || CAST((l_partkey % 50) % 7 AS STRING) END AS creator"


@query("distinct_creators", f"""WITH p AS (SELECT DISTINCT {PROF} FROM lineitem), c AS (SELECT doc_id, count(*) AS n_profiles, count(DISTINCT nullif(creator, '')) AS n_creators FROM p GROUP BY 1)
SELECT *, CASE WHEN n_profiles > 1 AND n_creators > 1 THEN 'MEDIUM' END AS severity FROM c""")
def distinct_creators(spark, folder):
    return ms.distinct_creators(b.derived(spark, folder, "lineitem", PROF))


@query("change_authors", "SELECT conv_id AS doc_id, count(*) AS n_changes, count(DISTINCT role) AS n_authors FROM conversations GROUP BY 1")
def change_authors(spark, folder):
    log = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("author"))
    return ms.change_authors(log)


BLANK = "conv_id AS doc_id, turn, CASE WHEN turn % 4 = 3 THEN repeat(' ', 300) || 'x' WHEN turn % 4 = 2 THEN repeat(' ', 99) || 'y' ELSE text END AS part"


@query("blank_parts", f"""WITH p AS (SELECT {BLANK} FROM conversations), r AS (SELECT doc_id, turn, len(regexp_extract_all(part, '\\s')) / greatest(length(part), 1) AS r FROM p)
SELECT doc_id, turn, round(r, 4) AS ratio, 'LOW' AS severity FROM r WHERE r > 0.99""")
def blank_parts(spark, folder):
    parts = b.derived(spark, folder, "conversations", BLANK)
    return ms.blank_parts(parts, "part", ["doc_id", "turn"]).withColumn("severity", F.lit("LOW"))


@query("corpus_counts", "SELECT count(*) AS n FROM documents")
def corpus_counts(spark, folder):
    return table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n"))
