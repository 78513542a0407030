"""Facts of several detectors put together: correlations, creator profile, artefacts, case digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestigia.operators.common import count_where, first_k, rank_to_risk, rule, severity_rank

ID_GAP_SECONDS = 3600
CREATION_GAP_HOURS = 48


def id_time_facts(documents: DataFrame, ids: DataFrame, *more: Column) -> DataFrame:
    """Largest distance between a document's creation and its id times. The ids of a document are reduced to their first and
    last time, and to `more` aggregates, before they meet the document."""
    span = ids.groupBy("doc_id").agg(F.min("id_time").alias("_first"), F.max("id_time").alias("_last"), *more)
    joined = documents.join(span, "doc_id", "left")
    created = F.unix_micros(F.col("created").cast("timestamp"))
    first = F.unix_micros(F.col("_first").cast("timestamp"))
    last = F.unix_micros(F.col("_last").cast("timestamp"))
    gap = F.greatest(F.abs(last - created), F.abs(first - created)) / 1_000_000
    return joined.withColumn("max_gap_s", gap).drop("_first", "_last")


def correlation_rules() -> list[Column]:
    """Eight rules over one row of flags per document; the detail carries the evidence."""
    gap_h = F.floor(F.col("max_gap_s") / 3600).cast("string")

    def evidence(*columns: str) -> Column:
        return F.concat_ws("; ", *[F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in columns])

    c = "cross_analyzer"
    return [
        rule(f"creator <> '' AND producer <> '' AND creator <> producer AND max_gap_s > {ID_GAP_SECONDS}", "HIGH", c,
             "tool_change_with_id_gap", F.concat_ws("; ", evidence("creator", "producer"), F.concat(F.lit("gap_h="), gap_h))),
        rule(F.col("max_gap_s") / 3600 > CREATION_GAP_HOURS, "HIGH", c, "creation_vs_id_time", F.concat(F.lit("gap_h="), gap_h)),
        rule("n_offsets > 1 AND n_authors > 1", "MEDIUM", c, "authors_in_several_zones", evidence("n_offsets", "n_authors")),
        rule("encrypted AND has_script", "HIGH", c, "encrypted_with_script", F.lit(None)),
        rule("revisions > 1 AND has_sig_field", "HIGH", c, "signed_with_updates", evidence("revisions")),
        rule("hidden_blocks > 0 AND insecure_redactions > 0", "HIGH", c, "hidden_text_and_redaction",
             evidence("hidden_blocks", "insecure_redactions")),
        rule("suspicious_indicators > 0 AND embedded_files > 0", "HIGH", c, "indicators_and_attachments",
             evidence("suspicious_indicators", "embedded_files")),
        rule("image_findings > 0 AND compression_findings > 0", "HIGH", c, "image_and_compression",
             evidence("image_findings", "compression_findings")),
    ]


def creator_profile(documents: DataFrame, authors: DataFrame, prefixes: DataFrame, devices: DataFrame,
                    zones: DataFrame) -> DataFrame:
    """Who made a document: tool, author, the first three further authors, five prefixes and three devices with the number of
    all of them, region and offsets, with a confidence from the number of known facts. The lists are one long table, made
    distinct, limited and gathered once."""
    shown = {"further_authors": (authors, "author_name", 3), "prefixes": (prefixes, "prefix", 5), "devices": (devices, "device", 3)}
    parts = [df.select("doc_id", F.lit(out).alias("_kind"), F.col(c).cast("string").alias("_text"),
                       (F.lit(None) if dict(df.dtypes)[c] == "string" else F.col(c)).cast("long").alias("_number"))
             .filter(F.col(c).isNotNull()) for out, (df, c, _) in shown.items()]
    distinct = reduce(DataFrame.unionByName, parts).distinct()
    w = W.partitionBy("doc_id", "_kind").orderBy("_number", "_text")
    most = max(k for _, _, k in shown.values())
    first = distinct.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    of = lambda out: F.col("_kind") == out
    lists = first.groupBy("doc_id").agg(*[F.transform(F.array_sort(F.collect_list(
        F.when(of(out) & (F.col("_rn") <= k), F.struct("_rn", "_text")))), lambda s: s["_text"]).alias(out) for out, (_, _, k) in shown.items()])
    counts = distinct.groupBy("doc_id").agg(*[count_where(of(out)).alias(f"n_{out}") for out in shown])
    joined = documents.join(lists, "doc_id", "left").join(counts, "doc_id", "left").join(zones, "doc_id", "left")
    joined = joined.withColumns({f"n_{out}": F.coalesce(f"n_{out}", F.lit(0)) for out in shown} | {
        out: F.when(F.size(out) > 0, F.col(out)) for out in shown})

    def known(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)

    facts = (known(F.col("tool") != "") + known(F.col("author").isNotNull()) + known(F.col("region").isNotNull())
             + known(F.size("prefixes") > 0))
    return joined.withColumn("known_facts", facts).withColumn(
        "confidence", F.when(F.col("known_facts") >= 3, "high").when(F.col("known_facts") >= 2, "medium").otherwise("low"))


def artifact_findings(artifacts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and findings over the united artefact list `(doc_id, source, value)`."""
    kind = F.col("source")
    counts = artifacts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_artifacts"), count_where(kind == "font_prefix").alias("n_prefixes"),
        count_where(kind.contains("[path]")).alias("n_paths"), count_where(kind.contains("[email]")).alias("n_emails"),
        count_where(kind == "annotation_author").alias("n_annotation_authors"))
    return counts.withColumns({
        "prefix_severity": F.when(F.col("n_prefixes") > 0, "INFO"), "path_severity": F.when(F.col("n_paths") > 0, "MEDIUM"),
        "email_severity": F.when(F.col("n_emails") > 0, "MEDIUM"),
        "author_severity": F.when(F.col("n_annotation_authors") > 0, "INFO")})


def case_digest(documents: DataFrame, findings: DataFrame, lists: dict[str, tuple[DataFrame, int]], shown: int = 50) -> DataFrame:
    """Nested digest per document: counts, the worst findings and bounded lists; a section is present only
    if it has entries. Lists are cut before they are gathered; `n_findings` and `n_<list>` count all their entries."""
    counts = findings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_findings"), F.max(severity_rank(F.col("severity"))).alias("_rank"),
        *[count_where(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])
    entry = findings.withColumn("_entry", F.struct("severity", "category", "message", "finding_id"))
    worst = first_k(entry, ["doc_id"], [severity_rank(F.col("severity")).desc(), F.col("finding_id")], "_entry", shown, "findings")
    joined = documents.join(counts, "doc_id", "left").join(worst, "doc_id", "left")
    for name, (df, k) in lists.items():
        values = df.select("doc_id", "value").distinct()
        part = first_k(values, ["doc_id"], [F.col("value")], "value", k, name)
        total = values.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        joined = joined.join(part, "doc_id", "left").join(total, "doc_id", "left")
    zero = {s: F.coalesce(s, F.lit(0)) for s in ("high", "medium", "low")}
    return joined.withColumns({**zero, "risk_level": rank_to_risk(F.coalesce("_rank", F.lit(-1)))}).drop("_rank")


def digest_json(digest: DataFrame) -> DataFrame:
    """The digest as JSON text; empty sections are left out."""
    return digest.select("doc_id", F.to_json(F.struct("*")).alias("digest"))


def context_text(digest: DataFrame, shown: int = 10) -> DataFrame:
    """Short plain-text form of a digest."""
    lines = F.transform(F.slice("findings", 1, shown), lambda f: F.concat(
        F.lit("["), f["severity"], F.lit("] "), f["category"], F.lit(": "), f["message"]))
    head = F.format_string("risk %s: high=%d medium=%d low=%d", "risk_level", "high", "medium", "low")
    return digest.select("doc_id", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("context"))
