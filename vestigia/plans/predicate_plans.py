"""Searches, filters and rule sets on document facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigia.operators import rulesets as rs
from vestigia.operators.common import emit, first_k, joined
from vestigia.plans import bindings as b
from vestigia.plans.bindings import META, OBJ
from vestigia.plans.registry import query
from vestigia.plans.source_plans import NAME
from vestigia.sources.tables import table


def union_rules(source: str, key: str, rules: list[tuple[str, str, str]]) -> str:
    """SQL side of a rule set: one SELECT per rule."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{sev}' AS severity, '{code}' AS code FROM {source} WHERE {cond}" for cond, sev, code in rules
    )


def search(df: DataFrame, text: str | None = None, date_from: str | None = None, date_to: str | None = None,
           columns: tuple[str, ...] = ("name", "md5", "sha256"), when: str = "created", limit: int = 200, offset: int = 0) -> DataFrame:
    """Literal, case-insensitive substring in any of the columns and an inclusive date range; newest first.
    Only the given conditions become filters, so date bounds reach the scan."""
    if date_from:
        df = df.filter(F.col(when) >= F.to_timestamp_ntz(F.lit(date_from)))
    if date_to:
        df = df.filter(F.col(when) < F.to_timestamp_ntz(F.date_add(F.lit(date_to).cast("date"), 1).cast("string")))
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(F.col(c)).contains(text.lower())
        df = df.filter(hit)
    return df.orderBy(F.desc(when), "doc_id").offset(offset).limit(limit)


@query("history_search", f"""WITH {META}, m AS (SELECT doc_id, name, md5(name) AS md5, sha256(name) AS sha256, created,
 risk_level FROM meta) SELECT doc_id, name, md5, strftime(created, '%Y-%m-%d') AS created, risk_level FROM m
 WHERE created >= '1996-02-01' AND created < TIMESTAMP '1998-07-02' AND (contains(lower(name), '7f')
 OR contains(md5, '7f') OR contains(sha256, '7f')) ORDER BY m.created DESC, doc_id LIMIT 200""")
def history_search(spark, folder):
    meta = b.doc_meta(spark, folder).withColumns({"md5": F.md5("name"), "sha256": F.sha2("name", 256)})
    found = search(meta, "7F", "1996-02-01", "1998-07-01")
    return found.select("doc_id", "name", "md5", F.date_format("created", "yyyy-MM-dd").alias("created"), "risk_level")


@query("end_of_day_bound", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events "
       "WHERE ts <= TIMESTAMP '2024-01-09 23:59:59.999999' GROUP BY 1")
def end_of_day_bound(spark, folder):
    """Everything up to and including a day, to its last microsecond."""
    bound = F.to_timestamp_ntz(F.date_add(F.lit("2024-01-09").cast("date"), 1).cast("string"))
    return table(spark, folder, "events").filter(F.col("ts") < bound).groupBy(
        F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("history_page", f"""WITH {META} SELECT doc_id, name, strftime(created, '%Y-%m-%d') AS created FROM meta
 ORDER BY meta.created DESC, doc_id LIMIT 50 OFFSET 100""")
def history_page(spark, folder):
    """One page of the history, newest first."""
    page = b.doc_meta(spark, folder).orderBy(F.desc("created"), "doc_id").offset(100).limit(50)
    return page.select("doc_id", "name", F.date_format("created", "yyyy-MM-dd").alias("created"))


def with_object_facts(spark, folder):
    """Document metadata joined with one row of object aggregates per document."""
    facts = b.objects(spark, folder).groupBy("doc_id").agg(
        F.max("modified").alias("modified"), F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("type") == "A").alias("image_count"),
        F.max("device").alias("last_device"), F.countDistinct("device").alias("n_devices"),
    )
    return b.doc_meta(spark, folder).join(facts, "doc_id", "left")


FACTS = f"""{META}, {OBJ}, facts AS (SELECT doc_id, max(modified) AS modified, count(*) AS page_count,
 count(*) FILTER (type = 'A') AS image_count, max(device) AS last_device, count(DISTINCT device) AS n_devices
 FROM obj GROUP BY doc_id), doc AS (SELECT meta.*, facts.* EXCLUDE (doc_id) FROM meta LEFT JOIN facts USING (doc_id))"""


@query("doc_card", f"""WITH {FACTS}, ids AS (SELECT doc_id, string_agg(part, ',' ORDER BY part) AS ids FROM
 (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS rn FROM (SELECT DISTINCT doc_id, part
 FROM obj)) WHERE rn <= 10 GROUP BY doc_id), n_ids AS (SELECT doc_id, count(DISTINCT part) AS n_ids FROM obj GROUP BY 1)
SELECT doc_id, name, sha256(name) AS sha256, risk_level, producer, creator, strftime(created, '%Y-%m-%d') AS created,
 strftime(modified, '%Y-%m-%d') AS modified, coalesce(page_count, 0) AS page_count,
 coalesce(image_count, 0) AS image_count, n_high, n_medium, has_script, encrypted, revisions, coalesce(ids, '') AS ids,
 coalesce(n_ids, 0) AS n_ids, CAST(CAST(doc.created AS DATE) + CAST(doc_id % 30 AS INT) AS VARCHAR) AS analyzed_at
 FROM doc LEFT JOIN ids USING (doc_id) LEFT JOIN n_ids USING (doc_id)""")
def doc_card(spark, folder):
    items = b.objects(spark, folder).select("doc_id", "part").distinct()
    ids = first_k(items, ["doc_id"], [F.col("part")], "part", 10, "ids")
    n_ids = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_ids"))
    card = with_object_facts(spark, folder).join(ids, "doc_id", "left").join(n_ids, "doc_id", "left")
    return card.select(
        "doc_id", "name", F.sha2("name", 256).alias("sha256"), "risk_level", "producer", "creator",
        F.date_format("created", "yyyy-MM-dd").alias("created"),
        F.date_format("modified", "yyyy-MM-dd").alias("modified"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"),
        "n_high", "n_medium", "has_script", "encrypted", "revisions",
        F.coalesce(joined(F.col("ids")), F.lit("")).alias("ids"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"),
        F.date_add(F.to_date("created"), (F.col("doc_id") % 30).cast("int")).cast("string").alias("analyzed_at"),
    )


@query("preview_fields", "SELECT doc_id, substr(text, 1, 100) AS text_preview, substr(text, 1, 200) AS snippet, "
       "substr(text, 1, 60) AS sample, substr(text, 1, 250) AS detail FROM documents")
def preview_fields(spark, folder):
    lengths = {"text_preview": 100, "snippet": 200, "sample": 60, "detail": 250}
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", *[F.substring("text", 1, n).alias(c) for c, n in lengths.items()])


@query("picker_filter", f"""WITH {META} SELECT doc_id, name FROM meta WHERE contains(lower(name), 'pdf')
 AND doc_id NOT IN (SELECT doc_id FROM meta WHERE author % 8 = 0)""")
def picker_filter(spark, folder):
    """Names containing the typed text, without the documents already chosen."""
    meta = b.doc_meta(spark, folder)
    chosen = meta.filter("author % 8 = 0").select("doc_id")
    hits = meta.filter(F.lower("name").contains("pdf")).select("doc_id", "name")
    return hits.join(chosen, "doc_id", "left_anti")


@query("hidden_flag_filter", """SELECT l_orderkey AS doc_id, count(*) AS n_annotations, count(*) FILTER
 (((l_partkey + l_linenumber) & 2) <> 0 OR ((l_partkey + l_linenumber) & 32) <> 0) AS n_hidden
 FROM lineitem GROUP BY 1""")
def hidden_flag_filter(spark, folder):
    flags = b.derived(spark, folder, "lineitem", "l_orderkey AS doc_id, l_partkey + l_linenumber AS flags")
    return flags.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_annotations"), F.count_if(rs.hidden_flag(F.col("flags"))).alias("n_hidden")
    )


MIME = b.pick(["text/html", "Application/JavaScript; v=1", "application/x-sh", "image/png"], "(page_id % 4)")
IN_EXT = ", ".join(b.sql_text(e[1:]) for e in rs.DANGEROUS_EXTENSIONS)


@query("dangerous_items", f"""WITH p AS (SELECT page_id, lower({NAME}) AS name, lower({MIME}) AS mime FROM pages),
x AS (SELECT *, CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] ELSE '' END AS e FROM p)
SELECT page_id, 'HIGH' AS severity, 'dangerous_extension' AS code, '.' || e AS detail FROM x WHERE e IN ({IN_EXT})
UNION ALL SELECT page_id, 'HIGH', 'suspicious_mime', mime FROM x WHERE e NOT IN ({IN_EXT}) AND
 (contains(mime, 'application/x-msdownload') OR contains(mime, 'application/x-executable') OR
  contains(mime, 'application/x-sh') OR contains(mime, 'application/javascript'))""")
def dangerous_items(spark, folder):
    items = b.derived(spark, folder, "pages", f"page_id, {NAME} AS name, {MIME} AS mime")
    return emit(items, ["page_id"], rs.attachment_rules()).drop("category")


@query("certificate_expired", """SELECT o_orderkey AS doc_id, strftime(o_orderdate + INTERVAL 3 YEAR, '%Y-%m-%d') AS detail
 FROM orders WHERE o_orderdate + INTERVAL 3 YEAR < TIMESTAMP '2000-06-01'""")
def certificate_expired(spark, folder):
    certs = b.derived(spark, folder, "orders", "o_orderkey AS doc_id, o_orderdate + INTERVAL 3 YEAR AS not_after")
    return emit(certs, ["doc_id"], rs.certificate_rules("2000-06-01")).select("doc_id", "detail")


XMP = "created + INTERVAL 1 DAY * CAST(author % 3 AS INT)"
XMP_MOD = "modified + INTERVAL 1 DAY * CAST(author % 2 AS INT)"


@query("metadata_date_rules", f"""WITH {FACTS}, x AS (SELECT *, {XMP} AS xc, {XMP_MOD} AS xm, TIMESTAMP '2000-01-01' AS now
 FROM doc), r AS ({union_rules('x', 'doc_id', [
    ('modified < created', 'HIGH', 'modified_before_created'),
    ('created > now', 'HIGH', 'created_in_future'),
    ('modified > now', 'MEDIUM', 'modified_in_future'),
    ('CAST(xc AS DATE) <> CAST(created AS DATE)', 'MEDIUM', 'created_day_differs'),
    ('CAST(xm AS DATE) <> CAST(modified AS DATE)', 'MEDIUM', 'modified_day_differs')])})
SELECT r.*, CASE WHEN modified < created THEN 'before' WHEN modified < created + INTERVAL 1 MINUTE THEN 'under_1_min'
 WHEN modified IS NOT NULL THEN 'later' END AS gap FROM r JOIN x USING (doc_id)""")
def metadata_date_rules(spark, folder):
    facts = with_object_facts(spark, folder).withColumns({"xmp_created": F.expr(XMP), "xmp_modified": F.expr(XMP_MOD)})
    found = facts.withColumn("gap", rs.edit_gap())
    return emit(found, ["doc_id", "gap"], rs.date_rules("2000-01-01")).select("doc_id", "severity", "code", "gap")


SIG = ("o_orderkey AS doc_id, o_custkey % 3 > 0 AS has_form, o_orderkey % 2 = 0 AS has_sig_field, "
       "o_custkey % 5 = 0 AS has_certification, o_custkey % 4 AS n_sig_fields")


@query("signature_state_rules", f"WITH s AS (SELECT {SIG} FROM orders) " + union_rules("s", "doc_id", [
    ("has_sig_field AND NOT has_form", "HIGH", "field_without_form"),
    ("has_certification AND NOT has_sig_field", "MEDIUM", "certification_without_field"),
    ("has_sig_field", "INFO", "field_present")]))
def signature_state_rules(spark, folder):
    return emit(b.derived(spark, folder, "orders", SIG), ["doc_id"], rs.signature_rules()).select(
        "doc_id", "severity", "code")


COMP = ("o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN '<pdfaid:part>' || CAST(1 + o_custkey % 3 AS STRING) "
        "|| '</pdfaid:part><pdfaid:conformance>b' WHEN o_orderstatus = 'P' THEN '<y>GTS_PDFXVersion>PDF/X-4 <' ELSE '' END AS xmp, "
        "o_custkey % 4 > 0 AS has_xmp, o_custkey % 11 = 0 AS has_script, o_custkey % 17 = 0 AS has_forbidden_action, "
        "o_custkey % 13 = 0 AS encrypted, o_orderkey % 6 = 0 AS has_unembedded_font, o_orderkey % 7 = 0 AS has_transparency, "
        "o_custkey % 5 > 0 AS has_output_intent, CASE o_custkey % 3 WHEN 0 THEN '/True' WHEN 1 THEN 'maybe' END AS trapped")


@query("compliance_checklist", f"""WITH c AS (SELECT {COMP} FROM orders),
p AS (SELECT *, contains(xmp, 'pdfaid:part') AS a, contains(xmp, 'GTS_PDFX') AS x,
  contains(xmp, 'part>1') AS a1, trapped IS NOT NULL AND trapped = '/True' AS t FROM c),
n AS (SELECT *, CAST(a AND NOT has_xmp AS INT) + CAST(a AND has_script AS INT) + CAST(a AND has_forbidden_action AS INT)
  + CAST(a AND encrypted AS INT) + CAST(a AND has_unembedded_font AS INT) + CAST(a1 AND has_transparency AS INT)
  + CAST(x AND NOT has_output_intent AS INT) AS crit, CAST(x AND NOT t AS INT) AS minor,
  CAST(a AND has_xmp AS INT) + CAST(a AND NOT has_script AS INT) + CAST(a AND NOT encrypted AS INT)
  + CAST(a AND NOT has_unembedded_font AS INT) + CAST(x AND has_output_intent AS INT) + CAST(x AND t AS INT) + 2 AS ok FROM p)
SELECT doc_id, CASE WHEN a THEN 'PDF/A-' || regexp_extract(xmp, 'part>(\\d)', 1) END AS pdfa_version,
 CASE WHEN a THEN 'B' END AS pdfa_level, CASE WHEN x THEN 'PDF/X-4' END AS pdfx_version,
 CAST(crit + minor AS BIGINT) AS total_issues, CAST(crit AS BIGINT) AS critical_issues, CAST(ok AS BIGINT) AS passes,
 a AND crit + minor > 0 AS claim_broken, x AND NOT has_output_intent AS intent_missing FROM n""")
def compliance_checklist(spark, folder):
    claimed = rs.with_claims(b.derived(spark, folder, "orders", COMP), "xmp")
    return rs.compliance(claimed, "doc_id").select(
        "doc_id", "pdfa_version", "pdfa_level", "pdfx_version", "total_issues", "critical_issues", "passes",
        "claim_broken", "intent_missing",
    )


OFFICE = ("doc_id, author, last_device AS last_author, has_script AS has_macros, image_count AS n_external, "
          "n_devices AS n_change_authors, page_count * 12 AS n_sessions, author % 140 AS revision, created, modified")


@query("office_rules", f"WITH {FACTS}, o AS (SELECT {OFFICE} FROM doc) " + union_rules("o", "doc_id", [
    ("author <> last_author", "INFO", "author_changed"), ("has_macros", "HIGH", "macros"),
    ("n_external > 0", "MEDIUM", "external_links"), ("n_change_authors > 0", "INFO", "change_authors"),
    ("n_sessions > 50", "INFO", "many_sessions"), ("revision > 100", "INFO", "high_revision"),
    ("modified < created", "HIGH", "modified_before_created")]))
def office_rules(spark, folder):
    facts = with_object_facts(spark, folder).selectExpr(*[c.strip() for c in OFFICE.split(",")])
    return emit(facts, ["doc_id"], rs.office_rules()).select("doc_id", "severity", "code")


@query("chat_context_filter", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') "
       "AND text <> ''")
def chat_context_filter(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.filter(F.col("role").isin("user", "assistant") & (F.col("text") != "")).select(
        "conv_id", "turn", "role", "text")


MEASURE = (
    "o_orderkey AS doc_id, CASE WHEN o_custkey % 9 = 0 THEN '48.1,11.5' END AS gps, "
    "CASE o_custkey % 4 WHEN 0 THEN 'Canon X' WHEN 1 THEN '' END AS camera, o_orderkey % 31 = 0 AS unreadable, "
    "CASE WHEN o_custkey % 8 = 1 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS error_level, o_custkey % 12 AS copy_blocks, "
    "CASE WHEN o_custkey % 15 = 2 THEN 'SUSPICIOUS' END AS noise, o_orderkey % 6 = 5 AS double_compressed, "
    "CAST(o_orderkey % 10 AS DOUBLE) / 100 AS thumb_aspect_diff, "
    "CASE o_custkey % 6 WHEN 0 THEN 'LIKELY_AI' WHEN 1 THEN 'POSSIBLY_AI' ELSE 'LIKELY_REAL' END AS synthetic, "
    "o_orderkey % 40 = 3 AS chi_suspected, o_orderkey % 41 = 3 AS rs_suspected, o_custkey % 5 AS unknown_chunks, "
    "o_custkey % 50 AS trailing_bytes, o_custkey % 130 AS text_chunk_length, o_orderkey % 8 = 1 AS table_double_compression, "
    "o_orderkey % 16 = 2 AS custom_code_tables, CAST(1.5 AS DOUBLE) AS main_ratio, "
    "1.0 + CAST(o_orderkey % 8 AS DOUBLE) / 8 AS thumb_ratio, o_orderkey % 22 = 4 AS ghost"
)
MEASURE_RULES = [
    ("gps IS NOT NULL", "MEDIUM", "location"), ("camera IS NOT NULL AND camera <> ''", "INFO", "camera"),
    ("unreadable", "LOW", "unreadable"), ("gps IS NOT NULL", "HIGH", "location"),
    ("error_level = 'SUSPICIOUS'", "HIGH", "error_level"), ("copy_blocks > 8", "HIGH", "copy_move"),
    ("noise = 'SUSPICIOUS'", "MEDIUM", "noise"), ("double_compressed", "MEDIUM", "double_compression"),
    ("thumb_aspect_diff >= 0.05", "HIGH", "thumbnail_mismatch"), ("synthetic = 'LIKELY_AI'", "HIGH", "likely_synthetic"),
    ("synthetic = 'POSSIBLY_AI'", "MEDIUM", "possibly_synthetic"), ("chi_suspected", "HIGH", "chi_square"),
    ("rs_suspected", "HIGH", "rs"), ("unknown_chunks > 0", "MEDIUM", "unknown_chunks"),
    ("trailing_bytes > 0", "HIGH", "trailing_bytes"), ("text_chunk_length > 100", "INFO", "text_chunk"),
    ("table_double_compression", "HIGH", "double_compression"), ("custom_code_tables", "INFO", "custom_tables"),
    ("thumb_ratio < 1.4 OR thumb_ratio > 1.6", "HIGH", "thumbnail_mismatch"), ("ghost", "MEDIUM", "ghost"),
]


@query("measurement_findings", f"WITH m AS (SELECT {MEASURE} FROM orders) " + union_rules("m", "doc_id", MEASURE_RULES))
def measurement_findings(spark, folder):
    """Findings from measured image values, all four rule groups in one projection."""
    rules = rs.embedded_image_rules() + rs.direct_image_rules() + rs.hidden_data_rules() + rs.deep_image_rules()
    return emit(b.derived(spark, folder, "orders", MEASURE), ["doc_id"], rules).select("doc_id", "severity", "code")


@query("unify_metadata", f"""WITH {META} SELECT doc_id, name AS title, CAST(author AS VARCHAR) AS author,
 coalesce(creator, producer) AS creator, producer, CAST(revisions AS BIGINT) AS pages FROM meta
UNION ALL SELECT doc_id, NULL, source, lang, NULL, CASE WHEN lang IN ('en', 'de') THEN n_chars ELSE 0 END FROM documents""")
def unify_metadata(spark, folder):
    meta = b.doc_meta(spark, folder)
    docs = table(spark, folder, "documents").withColumn(
        "page_text", F.when(F.col("lang").isin("en", "de"), F.col("n_chars").cast("string")).otherwise("many"))
    unified = rs.unify_metadata([
        (meta, {"doc_id": ["doc_id"], "title": ["name"], "author": ["author"], "creator": ["creator", "producer"],
                "producer": ["producer"], "pages": ["revisions"]}),
        (docs, {"doc_id": ["doc_id"], "author": ["source"], "creator": ["lang"], "pages": ["page_text"]}),
    ])
    return unified.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "author", "creator", "producer", "pages")
