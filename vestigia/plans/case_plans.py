"""Correlations, profiles, artefacts, digests and user detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.functions import dates as dt
from vestigia.functions import network as net
from vestigia.functions import text as tx
from vestigia.operators import correlate as co
from vestigia.operators.common import emit, joined, rule
from vestigia.operators.detectors import Detector, run_detectors
from vestigia.operators.matching import known_tool
from vestigia.plans import bindings as b
from vestigia.plans.bindings import EV, META, OBJ
from vestigia.plans.compare_plans import TOOL
from vestigia.plans.network_plans import d_mails
from vestigia.plans.registry import query
from vestigia.plans.text_plans import PATHS, FONT
from vestigia.sources.tables import table

FLAGS = ("count(*) FILTER (WHERE type = 'A' AND state = 'F') AS hidden_blocks, count(*) FILTER (WHERE type = 'R' AND part % 5 = 0) AS insecure_redactions, "
         "count(*) FILTER (WHERE part % 7 = 0) AS suspicious_indicators, count(*) FILTER (WHERE device % 9 = 0) AS embedded_files, "
         "count(*) FILTER (WHERE part % 11 = 0) AS image_findings, count(*) FILTER (WHERE part % 6 = 0) AS compression_findings, count(DISTINCT device) AS n_authors")


def correlation_flags(spark, folder):
    items = b.objects(spark, folder).withColumn("id_time", F.col("modified"))
    docs = co.id_time_facts(b.doc_meta(spark, folder), items, *[F.expr(e) for e in FLAGS.split(", ")])
    return docs.withColumns(
        {"n_offsets": F.col("author") % 3, "has_sig_field": F.col("doc_id") % 2 == 0})


CORR = f"""WITH {META}, {OBJ}, fl AS (SELECT doc_id, {FLAGS}, min(modified) AS fm, max(modified) AS lm FROM obj GROUP BY 1),
x AS (SELECT meta.*, fl.* EXCLUDE (doc_id), author % 3 AS n_offsets, doc_id % 2 = 0 AS has_sig_field,
 greatest(abs(epoch(lm) - epoch(created)), abs(epoch(fm) - epoch(created))) AS g FROM meta LEFT JOIN fl USING (doc_id)),
y AS (SELECT *, CAST(floor(g / 3600) AS BIGINT) AS gh FROM x),
cr AS (SELECT doc_id, 'HIGH' AS severity, 'tool_change_with_id_gap' AS code, 'creator=' || creator || '; producer=' || producer || '; gap_h=' || gh AS detail FROM y
  WHERE creator <> '' AND producer <> '' AND creator <> producer AND g > 3600
 UNION ALL SELECT doc_id, 'HIGH', 'creation_vs_id_time', 'gap_h=' || gh FROM y WHERE g / 3600 > 48
 UNION ALL SELECT doc_id, 'MEDIUM', 'authors_in_several_zones', 'n_offsets=' || n_offsets || '; n_authors=' || n_authors FROM y WHERE n_offsets > 1 AND n_authors > 1
 UNION ALL SELECT doc_id, 'HIGH', 'encrypted_with_script', NULL FROM y WHERE encrypted AND has_script
 UNION ALL SELECT doc_id, 'HIGH', 'signed_with_updates', 'revisions=' || revisions FROM y WHERE revisions > 1 AND has_sig_field
 UNION ALL SELECT doc_id, 'HIGH', 'hidden_text_and_redaction', 'hidden_blocks=' || hidden_blocks || '; insecure_redactions=' || insecure_redactions FROM y
  WHERE hidden_blocks > 0 AND insecure_redactions > 0
 UNION ALL SELECT doc_id, 'HIGH', 'indicators_and_attachments', 'suspicious_indicators=' || suspicious_indicators || '; embedded_files=' || embedded_files FROM y
  WHERE suspicious_indicators > 0 AND embedded_files > 0
 UNION ALL SELECT doc_id, 'HIGH', 'image_and_compression', 'image_findings=' || image_findings || '; compression_findings=' || compression_findings FROM y
  WHERE image_findings > 0 AND compression_findings > 0)"""


@query("correlate_findings", CORR + " SELECT * FROM cr")
def correlate_findings(spark, folder):
    return emit(correlation_flags(spark, folder), ["doc_id"], co.correlation_rules()).drop("category")


ZONE_MIN = "CASE author % 6 WHEN 0 THEN NULL WHEN 1 THEN 60 WHEN 2 THEN -300 WHEN 3 THEN 330 WHEN 4 THEN 999 ELSE 0 END"


@query("creator_profile", f"""WITH {META}, {OBJ}, {b.values_table(list(dt.OFFSET_REGIONS.items()), 'o, region', 'rg')},
a AS (SELECT doc_id, string_agg(v, ',' ORDER BY v) AS further_authors FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS rn FROM (SELECT DISTINCT doc_id, 'dev' || device AS v FROM obj WHERE type = 'A')) WHERE rn <= 3 GROUP BY 1),
p AS (SELECT doc_id, string_agg(v, ',' ORDER BY v) AS prefixes FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS rn FROM (SELECT DISTINCT doc_id, part AS v FROM obj WHERE type = 'R')) WHERE rn <= 5 GROUP BY 1),
d AS (SELECT doc_id, string_agg(v, ',' ORDER BY v) AS devices FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS rn FROM (SELECT DISTINCT doc_id, device AS v FROM obj)) WHERE rn <= 3 GROUP BY 1),
nl AS (SELECT doc_id, count(DISTINCT device) FILTER (type = 'A') AS n_further_authors, count(DISTINCT part) FILTER (type = 'R') AS n_prefixes, count(DISTINCT device) AS n_devices FROM obj GROUP BY 1),
m AS (SELECT doc_id, {TOOL} AS tool, CASE WHEN author % 4 > 0 THEN author END AS author, {ZONE_MIN} AS o FROM meta),
j AS (SELECT doc_id, tool, author, further_authors, prefixes, devices, region, o AS offset_min, coalesce(n_further_authors, 0) AS n_further_authors, coalesce(n_prefixes, 0) AS n_prefixes, coalesce(n_devices, 0) AS n_devices FROM m LEFT JOIN nl USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN rg USING (o)),
k AS (SELECT *, CAST(tool IS NOT NULL AS INT) + CAST(author IS NOT NULL AS INT) + CAST(region IS NOT NULL AS INT) + CAST(prefixes IS NOT NULL AS INT) AS known_facts FROM j)
SELECT *, CASE WHEN known_facts >= 3 THEN 'high' WHEN known_facts >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM k""")
def creator_profile(spark, folder):
    meta = b.doc_meta(spark, folder)
    items = b.objects(spark, folder)
    regions = spark.createDataFrame(list(dt.OFFSET_REGIONS.items()), "offset_min int, region string")
    zones = meta.select("doc_id", F.expr(ZONE_MIN).alias("offset_min")).join(F.broadcast(regions), "offset_min", "left")
    docs = known_tool(meta).select("doc_id", "tool", F.expr("CASE WHEN author % 4 > 0 THEN author END AS author"))
    profile = co.creator_profile(
        docs, items.filter("type = 'A'").select("doc_id", F.expr("'dev' || CAST(device AS STRING)").alias("author_name")),
        items.filter("type = 'R'").select("doc_id", F.col("part").alias("prefix")), items.select("doc_id", "device"), zones)
    lists = {c: joined(F.col(c)) for c in ("further_authors", "prefixes", "devices")}
    return profile.withColumns(lists).select("doc_id", "tool", "author", "further_authors", "prefixes", "devices", "region",
                                             "offset_min", "n_further_authors", "n_prefixes", "n_devices", "known_facts", "confidence")


def artifacts(spark, folder):
    """Five artefact lists with the source they came from."""
    def listed(df, doc: str, value, source: str):
        return df.select(F.col(doc).cast("long").alias("doc_id"), F.lit(source).alias("source"), value.cast("string").alias("value"))

    fonts = b.derived(spark, folder, "part", FONT).withColumn("v", tx.subset_prefix(F.col("font"))).filter("v IS NOT NULL")
    docs = table(spark, folder, "documents").select("doc_id", F.explode(net.emails(F.col("text"))).alias("v"))
    paths = b.derived(spark, folder, "events", PATHS).select("event_id", F.explode(tx.paths(F.col("text"))).alias("v"))
    turns = table(spark, folder, "conversations")
    printers = table(spark, folder, "supplier")
    return (
        listed(fonts, "p_partkey", F.col("v"), "font_prefix").unionByName(listed(docs, "doc_id", F.col("v"), "XMP[email]"))
        .unionByName(listed(paths, "event_id", F.col("v"), "XMP[path]")).unionByName(listed(turns, "conv_id", F.col("role"), "annotation_author"))
        .unionByName(listed(printers, "s_suppkey", F.col("s_name"), "printer")))


ART = f"""ar AS (SELECT p_partkey AS doc_id, 'font_prefix' AS source FROM (SELECT {FONT} FROM part) WHERE contains(font, '+')
 UNION ALL SELECT doc_id, 'XMP[email]' FROM (SELECT doc_id, unnest({d_mails('text')}) FROM documents)
 UNION ALL SELECT event_id, 'XMP[path]' FROM (SELECT event_id, unnest(regexp_extract_all(text, {b.sql_text(tx.PATH_PATTERN)})) FROM (SELECT {PATHS.replace(chr(92) * 2, chr(92))} FROM events))
 UNION ALL SELECT conv_id, 'annotation_author' FROM conversations UNION ALL SELECT s_suppkey, 'printer' FROM supplier)"""


@query("union_artifacts", f"""WITH {ART}, c AS (SELECT doc_id, count(*) AS n_artifacts, count(*) FILTER (source = 'font_prefix') AS n_prefixes, count(*) FILTER (source = 'XMP[path]') AS n_paths,
 count(*) FILTER (source = 'XMP[email]') AS n_emails, count(*) FILTER (source = 'annotation_author') AS n_annotation_authors FROM ar GROUP BY 1)
SELECT *, CASE WHEN n_prefixes > 0 THEN 'INFO' END AS prefix_severity, CASE WHEN n_paths > 0 THEN 'MEDIUM' END AS path_severity,
 CASE WHEN n_emails > 0 THEN 'MEDIUM' END AS email_severity, CASE WHEN n_annotation_authors > 0 THEN 'INFO' END AS author_severity FROM c""")
def union_artifacts(spark, folder):
    return co.artifact_findings(artifacts(spark, folder))


@query("distinct_authors", "SELECT DISTINCT conv_id AS doc_id, role AS author FROM conversations")
def distinct_authors(spark, folder):
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("author")).distinct()


def digest(spark, folder):
    found = b.findings(spark, folder)
    docs = table(spark, folder, "customer").selectExpr("c_custkey AS doc_id", "c_name AS name", "c_mktsegment AS author")
    tools = b.doc_meta(spark, folder).select(F.col("author").alias("doc_id"), F.col("producer").alias("value")).filter("value <> ''")
    sections = found.select("doc_id", F.col("section").alias("value"))
    return co.case_digest(docs, found, {"tools": (tools, 10), "sections": (sections, 15)})


@query("evidence_digest", f"""WITH {EV}, {META}, c AS (SELECT doc_id, count(*) AS n_findings, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM ev GROUP BY 1),
f AS (SELECT doc_id, string_agg(finding_id, ',' ORDER BY rn) AS ids FROM (SELECT doc_id, finding_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1
 WHEN 'LOW' THEN 2 ELSE 3 END, finding_id) AS rn FROM ev) WHERE rn <= 50 GROUP BY 1),
t AS (SELECT author AS doc_id, string_agg(producer, '|' ORDER BY producer) AS tools, count(*) AS n_tools FROM (SELECT DISTINCT author, producer FROM meta WHERE producer <> '') GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_sections FROM (SELECT DISTINCT doc_id, section FROM ev) GROUP BY 1)
SELECT c_custkey AS doc_id, coalesce(n_findings, 0) AS n_findings, coalesce(n_tools, 0) AS n_tools, coalesce(n_sections, 0) AS n_sections, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, CASE WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk_level,
 ids AS finding_ids, tools FROM customer LEFT JOIN c ON c.doc_id = c_custkey LEFT JOIN f ON f.doc_id = c_custkey LEFT JOIN t ON t.doc_id = c_custkey LEFT JOIN s ON s.doc_id = c_custkey""")
def evidence_digest(spark, folder):
    """The digest as JSON, read back into columns."""
    schema = ("risk_level STRING, high BIGINT, medium BIGINT, low BIGINT, findings ARRAY<STRUCT<finding_id: BIGINT>>, tools ARRAY<STRING>, "
              "n_findings BIGINT, n_tools BIGINT, n_sections BIGINT")
    text = co.digest_json(digest(spark, folder)).withColumn("d", F.from_json("digest", schema))
    totals = [F.coalesce(f"d.{n}", F.lit(0)).alias(n) for n in ("n_findings", "n_tools", "n_sections")]
    return text.select("doc_id", *totals, "d.high", "d.medium", "d.low", "d.risk_level", F.array_join(F.transform(
        "d.findings", lambda f: f["finding_id"].cast("string")), ",").alias("finding_ids"), F.array_join("d.tools", "|").alias("tools"))


@query("context_text", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, finding_id) AS rn FROM ev),
g AS (SELECT doc_id, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l,
 string_agg('[' || severity || '] ' || category || ': ' || message, chr(10) ORDER BY rn) FILTER (rn <= 10) AS lines FROM r GROUP BY 1)
SELECT c_custkey AS doc_id, concat_ws(chr(10), 'risk ' || CASE WHEN h > 0 THEN 'HIGH' WHEN m > 0 THEN 'MEDIUM' WHEN l > 0 THEN 'LOW' ELSE 'CLEAN' END || ': high=' || coalesce(h, 0) || ' medium=' || coalesce(m, 0) || ' low='
 || coalesce(l, 0), lines) AS context FROM customer LEFT JOIN g ON doc_id = c_custkey""")
def context_text(spark, folder):
    return co.context_text(digest(spark, folder))


@query("register_detector", """SELECT 'long' AS analyzer, 'ok' AS status, count(*) AS n_findings FROM documents WHERE n_chars > 1000 UNION ALL SELECT 'broken', 'error', 0
UNION ALL SELECT 'unlabelled', 'ok', count(*) FROM documents WHERE lang IS NULL UNION ALL SELECT 'incomplete', 'error', 0""")
def register_detector(spark, folder):
    """Own detectors; one that cannot be planned and one without the finding columns become error rows."""
    docs = table(spark, folder, "documents")
    run = run_detectors(spark, [
        Detector("long", lambda: emit(docs, ["doc_id"], [rule("n_chars > 1000", "LOW", "size", "long_text")])),
        Detector("broken", lambda: docs.select("no_such_column")),
        Detector("unlabelled", lambda: emit(docs, ["doc_id"], [rule("lang IS NULL", "INFO", "lang", "no_language")])),
        Detector("incomplete", lambda: docs.select("doc_id")),
    ])
    counts = run.findings.groupBy("analyzer").agg(F.count(F.lit(1)).alias("n_findings"))
    status = spark.createDataFrame([(n, s) for n, s, _ in run.status], "analyzer string, status string")
    return status.join(counts, "analyzer", "left").select("analyzer", "status", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
