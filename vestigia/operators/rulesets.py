"""Rule sets over one row of facts per document. Each returns rules for `emit`: a projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators.common import rule

# File types and content types that count as dangerous attachments.
DANGEROUS_EXTENSIONS = [
    ".exe", ".dll", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".jar",
    ".scr", ".com", ".pif", ".lnk", ".reg", ".msi", ".sh", ".py",
]
SUSPICIOUS_MIME = [
    "application/x-msdownload", "application/x-executable", "application/x-sh", "application/javascript",
]


def attachment_rules(name: str = "name", mime: str = "mime") -> list[Column]:
    """Dangerous extension, otherwise a suspicious content type."""
    low = F.lower(F.col(name))
    ext = F.when(low.contains("."), F.concat(F.lit("."), F.substring_index(low, ".", -1))).otherwise("")
    bad_ext = ext.isin(DANGEROUS_EXTENSIONS)
    bad_mime = F.lit(False)
    for m in SUSPICIOUS_MIME:
        bad_mime = bad_mime | F.coalesce(F.lower(F.col(mime)).contains(m), F.lit(False))
    return [
        rule(bad_ext, "HIGH", "embedded_files", "dangerous_extension", ext),
        rule(~bad_ext & bad_mime, "HIGH", "embedded_files", "suspicious_mime", F.lower(F.col(mime))),
    ]


def hidden_flag(flags: Column) -> Column:
    """Hidden (bit 2 set) or not viewable (bit 32 set)."""
    return (flags.bitwiseAND(F.lit(0x02)) != 0) | (flags.bitwiseAND(F.lit(0x20)) != 0)


def certificate_rules(as_of: str) -> list[Column]:
    return [rule(F.col("not_after") < F.to_timestamp_ntz(F.lit(as_of)), "HIGH", "signature", "certificate_expired",
                 F.date_format("not_after", "yyyy-MM-dd"))]


def date_rules(as_of: str) -> list[Column]:
    """created / modified against each other, against the reference time and against the second source."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    return [
        rule("modified < created", "HIGH", "metadata", "modified_before_created"),
        rule(F.col("created") > now, "HIGH", "metadata", "created_in_future"),
        rule(F.col("modified") > now, "MEDIUM", "metadata", "modified_in_future"),
        rule("to_date(xmp_created) <> to_date(created)", "MEDIUM", "metadata", "created_day_differs"),
        rule("to_date(xmp_modified) <> to_date(modified)", "MEDIUM", "metadata", "modified_day_differs"),
    ]


def edit_gap() -> Column:
    """Distance of creation and modification: before, under a minute, later."""
    gap = F.unix_micros(F.col("modified").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))
    return F.when(gap < 0, "before").when(gap < 60_000_000, "under_1_min").when(gap >= 60_000_000, "later")


def office_date_rules(category: str) -> list[Column]:
    return [rule("modified < created", "HIGH", category, "modified_before_created")]


def signature_rules() -> list[Column]:
    return [
        rule("has_sig_field AND NOT has_form", "HIGH", "signature", "field_without_form"),
        rule("has_certification AND NOT has_sig_field", "MEDIUM", "signature", "certification_without_field"),
        rule("has_sig_field", "INFO", "signature", "field_present", F.col("n_sig_fields")),
    ]


def office_rules() -> list[Column]:
    return [
        rule("author <> last_author", "INFO", "ooxml", "author_changed", F.col("last_author")),
        rule("has_macros", "HIGH", "ooxml", "macros"),
        rule("n_external > 0", "MEDIUM", "ooxml", "external_links", F.col("n_external")),
        rule("n_change_authors > 0", "INFO", "ooxml", "change_authors", F.col("n_change_authors")),
        rule("n_sessions > 50", "INFO", "ooxml", "many_sessions", F.col("n_sessions")),
        rule("revision > 100", "INFO", "ooxml", "high_revision", F.col("revision")),
        rule("modified < created", "HIGH", "ooxml", "modified_before_created"),
    ]


def with_claims(df: DataFrame, xmp: str) -> DataFrame:
    """Profile claims found in the metadata text."""
    text = F.col(xmp)
    part = F.regexp_extract(text, r'(?i)pdfaid:part["\s>]*(\d+)', 1)
    level = F.regexp_extract(text, r'(?i)pdfaid:conformance["\s>]*([ABUabu])', 1)
    claim_x = F.regexp_extract(text, r'(?i)GTS_PDFX\w*["\s>]*(PDF/X[^<"]*)', 1)
    return df.withColumns({
        "pdfa_claimed": F.coalesce(part != "", F.lit(False)),
        "pdfa_version": F.when(part != "", F.concat(F.lit("PDF/A-"), part)),
        "pdfa_level": F.when(part != "", F.when(level == "", "?").otherwise(F.upper(level))),
        "pdfx_claimed": F.coalesce(claim_x != "", F.lit(False)),
        "pdfx_version": F.when(claim_x != "", F.trim(claim_x)),
    })


def _check(name: str, applies: str, broken: str, severity: str = "CRITICAL", has_pass: bool = True) -> Column:
    """One checklist line: an issue, a pass, or nothing where the check does not apply."""
    state = F.when(F.expr(broken), F.lit("issue"))
    state = state.otherwise("pass") if has_pass else state
    return F.when(
        F.expr(applies) & state.isNotNull(),
        F.struct(F.lit(name).alias("check"), state.alias("state"), F.lit(severity).alias("severity")),
    )


def compliance_checks() -> list[Column]:
    """Lines are evaluated only for rows that claim the profile; the last two for every row."""
    return [
        _check("XMP Metadata", "pdfa_claimed", "NOT has_xmp"),
        _check("JavaScript", "pdfa_claimed", "has_script"),
        _check("Forbidden Action", "pdfa_claimed", "has_forbidden_action", has_pass=False),
        _check("Encryption", "pdfa_claimed", "encrypted"),
        _check("Font Embedding", "pdfa_claimed", "has_unembedded_font"),
        _check("Transparency", "pdfa_claimed AND pdfa_version = 'PDF/A-1'", "has_transparency", has_pass=False),
        _check("OutputIntent", "pdfx_claimed", "NOT has_output_intent"),
        _check("Trapped Key", "pdfx_claimed", "NOT coalesce(trapped IN ('/True', '/False', 'True', 'False'), false)",
               severity="MEDIUM"),
        _check("Version", "true", "false"),
        _check("Pages", "true", "false"),
    ]


def compliance(df: DataFrame, key: str) -> DataFrame:
    """Issues, critical issues and passes per row, with the two findings. Row-local, no explode."""
    lines = F.filter(F.array(*compliance_checks()), lambda c: c.isNotNull())
    issues = F.filter("_lines", lambda c: c["state"] == "issue")
    counted = df.withColumn("_lines", lines).withColumns({
        "total_issues": F.size(issues).cast("long"),
        "critical_issues": F.size(F.filter(issues, lambda c: c["severity"] == "CRITICAL")).cast("long"),
        "passes": F.size(F.filter("_lines", lambda c: c["state"] == "pass")).cast("long"),
        "issue_names": F.array_join(F.transform(issues, lambda c: c["check"]), "; "),
    })
    return counted.withColumns({
        "claim_broken": F.col("pdfa_claimed") & (F.col("total_issues") > 0),
        "intent_missing": F.expr("pdfx_claimed AND NOT has_output_intent"),
    }).drop("_lines")


def embedded_image_rules() -> list[Column]:
    return [
        rule("gps IS NOT NULL", "MEDIUM", "jpeg_analyzer", "location", F.col("gps")),
        rule("coalesce(camera, '') <> ''", "INFO", "jpeg_analyzer", "camera", F.col("camera")),
        rule("unreadable", "LOW", "jpeg_analyzer", "unreadable"),
    ]


def direct_image_rules() -> list[Column]:
    return [
        rule("gps IS NOT NULL", "HIGH", "image_forensics", "location", F.col("gps")),
        rule("error_level = 'SUSPICIOUS'", "HIGH", "image_forensics", "error_level"),
        rule("copy_blocks > 8", "HIGH", "image_forensics", "copy_move", F.col("copy_blocks")),
        rule("noise = 'SUSPICIOUS'", "MEDIUM", "image_forensics", "noise"),
        rule("double_compressed", "MEDIUM", "image_forensics", "double_compression"),
        rule("thumb_aspect_diff >= 0.05", "HIGH", "image_forensics", "thumbnail_mismatch"),
        rule("synthetic = 'LIKELY_AI'", "HIGH", "image_forensics", "likely_synthetic"),
        rule("synthetic = 'POSSIBLY_AI'", "MEDIUM", "image_forensics", "possibly_synthetic"),
    ]


def hidden_data_rules() -> list[Column]:
    return [
        rule("chi_suspected", "HIGH", "steganography", "chi_square"),
        rule("rs_suspected", "HIGH", "steganography", "rs"),
        rule("unknown_chunks > 0", "MEDIUM", "steganography", "unknown_chunks", F.col("unknown_chunks")),
        rule("trailing_bytes > 0", "HIGH", "steganography", "trailing_bytes", F.col("trailing_bytes")),
        rule("text_chunk_length > 100", "INFO", "steganography", "text_chunk", F.col("text_chunk_length")),
    ]


def deep_image_rules() -> list[Column]:
    return [
        rule("table_double_compression", "HIGH", "deep_jpeg", "double_compression"),
        rule("custom_code_tables", "INFO", "deep_jpeg", "custom_tables"),
        rule("abs(main_ratio - thumb_ratio) > 0.1", "HIGH", "deep_jpeg", "thumbnail_mismatch"),
        rule("ghost", "MEDIUM", "deep_jpeg", "ghost"),
    ]


METADATA_COLUMNS = ["doc_id", "title", "author", "subject", "keywords", "creator", "producer", "created", "modified",
                    "pages"]


def unify_metadata(sources: list[tuple[DataFrame, dict[str, list[str]]]]) -> DataFrame:
    """One metadata schema from differently named properties; the first filled property wins, a page
    count must be a number."""
    result: DataFrame | None = None
    for df, names in sources:
        columns = []
        for target in METADATA_COLUMNS:
            options = [F.col(c).cast("string") for c in names.get(target, []) if c in df.columns]
            value = F.coalesce(*options) if options else F.lit(None).cast("string")
            if target == "pages":
                value = F.when(value.rlike(r"^\d+$"), value.cast("long")).otherwise(F.lit(0)).cast("long")
            columns.append(value.alias(target))
        part = df.select(*columns)
        result = part if result is None else result.unionByName(part)
    return result
