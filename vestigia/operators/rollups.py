"""Counts, levels and scores over findings. Every aggregate is partial-then-final, so a hot document
or category is reduced before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators.common import computed_once, count_where, rank_to_risk, rule, severity_rank


def severity_aggs() -> list[Column]:
    sev = F.col("severity")
    return [
        count_where(sev == "HIGH").alias("high"),
        count_where(sev == "MEDIUM").alias("medium"),
        count_where(sev == "LOW").alias("low"),
    ]


def severity_counts(findings: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return findings.groupBy(*keys).agg(*severity_aggs())


def risk_levels(evidence: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Risk per document, also for documents without findings. Findings are reduced to one row per
    document before they meet the evidence."""
    worst = findings.groupBy(key).agg(F.max(severity_rank(F.col("severity"))).alias("_rank"))
    return (
        evidence.select(key).join(worst, key, "left")
        .select(key, rank_to_risk(F.coalesce("_rank", F.lit(-1))).alias("risk_level"))
    )


def local_severity_counts(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Counts and risk straight from the rules of one row: no explode, no shuffle."""
    fired = F.filter(F.array(*rules), lambda f: f.isNotNull())
    counted = df.withColumn("_fired", fired)

    def how_many(level: str) -> Column:
        return F.size(F.filter("_fired", lambda f: f["severity"] == level)).cast("long")

    counted = counted.withColumns({s.lower(): how_many(s) for s in ("HIGH", "MEDIUM", "LOW")})
    rank = F.when(F.col("high") > 0, 3).when(F.col("medium") > 0, 2).when(F.col("low") > 0, 1).otherwise(0)
    return counted.withColumn("risk_level", rank_to_risk(rank)).drop("_fired")


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )


def category_severity(findings: DataFrame) -> DataFrame:
    """high / medium / low per category, where low takes every other severity too."""
    sev = F.upper(F.coalesce("severity", F.lit("")))
    return findings.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(
        count_where(sev == "HIGH").alias("high"),
        count_where(sev == "MEDIUM").alias("medium"),
        count_where(~sev.isin("HIGH", "MEDIUM")).alias("low"),
    )


# Weights of the two scores.
MANIPULATION_WEIGHTS = {
    "high": 8, "medium": 3, "low": 1, "corr_high": 15, "corr_medium": 10, "corr_other": 5,
    "script": 10, "hidden_text": 5, "shadow": 15,
}
SECURITY_WEIGHTS = {
    "high": -15, "medium": -5, "low": -1, "script": -10, "malware": -30, "valid_signature": 5, "encrypted": -5,
}
CATEGORY_WEIGHTS = {"high": 10, "medium": 3, "low": 1}


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight × column; a boolean column counts as 0 or 1, a missing value as 0."""
    total = F.lit(0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name).cast("int"), F.lit(0)) * F.lit(weight)
    return total


def manipulation_score(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    score = F.least(F.lit(100), weighted(weights or MANIPULATION_WEIGHTS)).cast("long")
    return counts.withColumn("score", score).withColumn(
        "band", F.when(F.col("score") <= 20, "safe").when(F.col("score") <= 50, "note").otherwise("warn")
    )


def manipulation_rules() -> list[Column]:
    s = F.col("score")
    return [
        rule(s > 60, "HIGH", "cross_analyzer", "manipulation_score_high", s),
        rule((s > 30) & (s <= 60), "MEDIUM", "cross_analyzer", "manipulation_score_medium", s),
    ]


def security_score(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    raw = F.lit(100) + weighted(weights or SECURITY_WEIGHTS)
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")
    return counts.withColumn("score", score).withColumn(
        "band",
        F.when(F.col("score") >= 80, "safe").when(F.col("score") >= 60, "ok")
        .when(F.col("score") >= 35, "warning").otherwise("critical"),
    )


# Words that assign a finding to a phase, and the sections of each phase.
PHASE_KEYWORDS = {
    "basis": ["metadata", "hash", "software", "uuid", "signature", "geometry", "page"],
    "structure": ["encrypt", "incremental", "javascript", "embedded", "object", "residual", "stream"],
    "image": ["image", "steganograph", "ela", "jpeg", "photo", "copy.move"],
    "ioc_text": ["ioc", "hidden", "yellow", "text", "url", "ip"],
    "deep": ["xref", "deep", "redact", "content", "fuzzy", "decomp"],
    "extended": ["yara", "font", "pdfa", "pdfx", "linear", "printer", "icc", "compliance"],
}
PHASE_SECTIONS = {
    "P1": ["metadata", "software_id", "incremental_saves", "signature", "uuid_decode", "timezone", "encryption"],
    "P2": ["jpeg_analysis", "hidden_text", "javascript_actions", "ioc_scanner", "embedded_files"],
    "P3": ["ela_analysis", "image_forensics", "steganography", "deep_jpeg"],
    "P4": ["object_streams", "page_geometry", "xref_validation", "content_stream", "yara_scan", "residual_data",
           "shadow_analysis"],
    "P5": ["font_forensics", "pdfa_compliance", "linearization", "printer_forensics", "fuzzy_hash",
           "redaction_detection", "yellow_dots"],
    "P6": ["virus_scan"],
}


def phase_counts(findings: DataFrame) -> DataFrame:
    """Findings per phase; one finding counts once per phase and may belong to several."""
    text = F.concat_ws("\n", F.lower("category"), F.lower("message"))
    flags = []
    for phase, words in PHASE_KEYWORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        flags.append(F.when(hit, F.lit(phase)))
    phases = F.filter(F.array(*flags), lambda p: p.isNotNull())
    counted = findings.select(F.explode(phases).alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    return counted


def section_outcome(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fail / warn / pass per section from its worst severity."""
    sev = F.upper("severity")
    worst = F.max(F.when(sev.isin("HIGH", "CRITICAL"), 2).when(sev == "MEDIUM", 1).otherwise(0))
    return findings.groupBy(*keys, "section").agg(worst.alias("_worst")).select(
        *keys, "section",
        F.when(F.col("_worst") == 2, "fail").when(F.col("_worst") == 1, "warn").otherwise("pass").alias("outcome"),
    )


def phase_of_section(section: Column) -> Column:
    phase = F.lit(None).cast("string")
    for name, sections in PHASE_SECTIONS.items():
        phase = F.when(section.isin(sections), name).otherwise(phase)
    return phase


def analyzer_coverage(findings: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    # The test of the phase is not moved below the roll-up, where it would build the section again for every name.
    outcome = computed_once(section_outcome(findings, keys), "phase", phase_of_section(F.col("section")))
    return outcome.filter(F.col("phase").isNotNull()).groupBy(*keys, "phase").agg(
        count_where(F.col("outcome") == "pass").alias("n_pass"),
        count_where(F.col("outcome") == "warn").alias("n_warn"),
        count_where(F.col("outcome") == "fail").alias("n_fail"),
    )


def analyzer_status(findings: DataFrame, keys: Sequence[str] = ("doc_id", "section")) -> DataFrame:
    """Worst severity with its count per analyzer, else OK; and the number of all findings."""
    counts = findings.groupBy(*keys).agg(*severity_aggs(), F.count(F.lit(1)).alias("total"))
    status = (
        F.when(F.col("high") > 0, F.format_string("HIGH (%d)", "high"))
        .when(F.col("medium") > 0, F.format_string("MEDIUM (%d)", "medium"))
        .when(F.col("low") > 0, F.format_string("LOW (%d)", "low"))
        .otherwise("OK")
    )
    return counts.select(*keys, status.alias("status"), "total")


def severity_share(findings: DataFrame) -> DataFrame:
    """Share of HIGH, MEDIUM and LOW in their sum; a single CLEAN row if there are none."""
    one = findings.agg(*severity_aggs()).withColumn("total", F.expr("high + medium + low"))
    slices = F.when(
        F.col("total") > 0,
        F.array(*[
            F.struct(F.lit(s).alias("label"), F.col(s.lower()).alias("n"),
                     F.round(F.col(s.lower()) / F.col("total"), 6).alias("share"))
            for s in ("HIGH", "MEDIUM", "LOW")
        ]),
    ).otherwise(F.array(F.struct(F.lit("CLEAN").alias("label"), F.lit(0).cast("long").alias("n"),
                                 F.lit(1.0).alias("share"))))
    return one.select(F.explode(slices).alias("s")).select("s.*")


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Severity counts per category, per source and in total, in one pass."""
    c, s = F.col("category"), F.col("source")
    return findings.groupingSets([[c], [s], []], c, s).agg(F.grouping_id().cast("long").alias("level"), *severity_aggs())
