"""Probe lookups and table lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.operators import matching as mt
from vestigia.operators import overlap
from vestigia.operators.common import emit, join_reduced, joined
from vestigia.plans import bindings as b
from vestigia.plans.bindings import META, OBJ
from vestigia.plans.compare_plans import TOOL
from vestigia.plans.registry import query
from vestigia.sources.tables import table


@query("prefix_cross_match", f"""WITH {META}, {OBJ}, pr AS (SELECT doc_id FROM meta WHERE doc_id IN (SELECT doc_id FROM obj)
 ORDER BY meta.created DESC, doc_id LIMIT 1), w AS (SELECT DISTINCT device FROM obj WHERE doc_id = (SELECT doc_id FROM pr)),
h AS (SELECT DISTINCT doc_id, device FROM obj JOIN w USING (device) WHERE doc_id <> (SELECT doc_id FROM pr)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY device) AS rn FROM h)
SELECT doc_id, count(*) AS n_shared, string_agg(device, ',' ORDER BY device) FILTER (rn <= 10) AS shared,
 strftime(max(meta.created), '%Y-%m-%d') AS created FROM r JOIN meta USING (doc_id) GROUP BY doc_id""")
def prefix_cross_match(spark, folder):
    """All documents that share a device with the newest document, without a limit on candidates."""
    meta = b.doc_meta(spark, folder).select("doc_id", "created")
    items = b.objects(spark, folder).select("doc_id", F.col("device").alias("value"))
    newest = meta.join(items.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.desc("created"), "doc_id").limit(1)
    probe = items.join(F.broadcast(newest.select("doc_id")), "doc_id", "left_semi")
    found = mt.shared_with_probe(items, probe).join(meta, "doc_id")
    return found.select("doc_id", "n_shared", joined(F.col("shared")).alias("shared"),
                        F.date_format("created", "yyyy-MM-dd").alias("created"))


@query("prefix_cross_matches", f"""WITH {OBJ}, d AS (SELECT DISTINCT doc_id, device FROM obj),
m AS (SELECT p.doc_id AS probe_id, d.doc_id, count(*) AS n_shared FROM d p JOIN d USING (device) WHERE p.doc_id % 100 = 0 AND d.doc_id <> p.doc_id GROUP BY ALL)
SELECT probe_id, count(*) AS n_matches, max(n_shared) AS most_shared FROM m GROUP BY 1""")
def prefix_cross_matches(spark, folder):
    """For each document whose id is divisible by 100: all documents that share a device with it, counted, and the closest of them."""
    items = b.objects(spark, folder).select("doc_id", F.col("device").alias("value"))
    return overlap.match_counts(*overlap.shared_values(items, F.col("doc_id") % 100 == 0))


SIGNED = "list_transform(embedding[1:3], lambda x: CAST(floor(x * 4) AS INT))"


@query("signature_cross_match", f"""WITH s AS (SELECT vec_id AS doc_id, label, {SIGNED} AS sig FROM embeddings),
p AS (SELECT * FROM s ORDER BY doc_id DESC LIMIT 1)
SELECT s.doc_id, s.label, array_to_string(s.sig, ',') AS signature, count(*) OVER () AS n_matches
 FROM s JOIN p ON s.sig = p.sig AND s.doc_id <> p.doc_id""")
def signature_cross_match(spark, folder):
    """All other items with the signature of the newest item, and their number."""
    vectors = table(spark, folder, "embeddings")
    coarse = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x.cast("double") * 4).cast("int"))
    signed = vectors.select(F.col("vec_id").alias("doc_id"), "label", coarse.alias("signature"))
    probe = signed.orderBy(F.desc("doc_id")).limit(1).select("doc_id", "signature")
    found = mt.same_signature(signed, probe)
    counts = found.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_matches"))
    return join_reduced(found, counts, "probe_id").select("doc_id", "label", "n_matches", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")
                        .alias("signature"))


@query("signature_cross_matches", f"""WITH s AS (SELECT vec_id AS doc_id, label, {SIGNED} AS sig FROM embeddings),
p AS (SELECT * FROM s WHERE doc_id % 100 = 0),
m AS (SELECT s.doc_id, s.label, s.sig, min(p.doc_id) AS probe_id, count(*) AS n_probes FROM s JOIN p USING (sig) WHERE len(s.sig) > 0 GROUP BY ALL)
SELECT m.doc_id, label, array_to_string(sig, ',') AS signature, probe_id, n_probes, doc_id % 100 = 0 AS is_probe,
 (SELECT count(*) FROM s x WHERE x.sig = m.sig AND x.doc_id <> m.probe_id) AS n_matches FROM m""")
def signature_cross_matches(spark, folder):
    """All items with the signature of a probe; every item whose id is divisible by 100 is one. Probes of equal signature are one group,
    named by the first: each of them has the same `n_matches`, namely all rows of the group but its own."""
    vectors = table(spark, folder, "embeddings")
    coarse = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x.cast("double") * 4).cast("int"))
    signed = vectors.select(F.col("vec_id").alias("doc_id"), "label", coarse.alias("signature")).withColumn("is_probe", F.col("doc_id") % 100 == 0)
    found = mt.probe_groups(signed, "is_probe")
    return found.withColumn("signature", F.array_join(F.transform("signature", lambda x: x.cast("string")), ","))


def _known(col: str) -> str:
    return f"(SELECT min_by(name, i) FROM tools WHERE contains(lower({col}), lower(key)))"


def _known_last(col: str) -> str:
    return f"(SELECT max_by(name, i) FROM tools WHERE contains(lower({col}), lower(key)))"


TOOLS = b.values_table([(k, v, i) for i, (k, v) in enumerate(mt.KNOWN_PRODUCERS.items())], "key, name, i", "tools")
CATEGORY = """CASE WHEN regexp_matches(lower({t}), 'online|smallpdf|ilovepdf|sejda|pdf2go|pdfforge|pdf24') THEN 'Online-Dienst'
 WHEN regexp_matches(lower({t}), 'abbyy|omnipage|tesseract|ocr') THEN 'OCR-Software'
 WHEN regexp_matches(lower({t}), 'fpdf|itext|pdfsharp|reportlab|pikepdf|pdfium|pypdf') THEN 'Programm-Bibliothek'
 WHEN regexp_matches(lower({t}), 'word|libreoffice|openoffice|indesign') THEN 'Desktop-Anwendung'
 WHEN regexp_matches(lower({t}), 'ghostscript|distiller|latex') THEN 'Konverter/Renderer' ELSE 'PDF-Software' END"""


@query("known_tool_lookup", f"""WITH {META}, {TOOLS}, v AS (SELECT DISTINCT producer, creator FROM meta),
k AS (SELECT *, {_known('producer')} AS tp, {_known('creator')} AS tc FROM v),
t AS (SELECT producer, creator, coalesce(tp, tc, nullif(producer, ''), nullif(creator, '')) AS tool, CASE WHEN tp IS NOT NULL
 OR tc IS NOT NULL THEN {CATEGORY.format(t='coalesce(tp, tc)')} WHEN coalesce(nullif(producer, ''), nullif(creator, ''))
 IS NOT NULL THEN 'Unbekannt' END AS tool_category,
 nullif(regexp_extract(CASE WHEN tp IS NOT NULL THEN producer WHEN tc IS NOT NULL THEN creator END, '(\\d+[.\\d]+)', 1), '')
 AS version, CASE WHEN tp IS NULL AND tc IS NULL THEN CASE WHEN coalesce(nullif(producer, ''), nullif(creator, '')) IS NULL
 THEN 'LOW' ELSE 'INFO' END END AS tool_severity FROM k)
SELECT doc_id, tool, tool_category, version, tool_severity FROM meta JOIN t ON meta.producer IS NOT DISTINCT FROM t.producer
 AND meta.creator IS NOT DISTINCT FROM t.creator""")
def known_tool_lookup(spark, folder):
    return mt.known_tool(b.doc_meta(spark, folder)).select("doc_id", "tool", "tool_category", "version", "tool_severity")


@query("tool_mismatch", f"""WITH {META}, {TOOLS}, v AS (SELECT DISTINCT producer, creator FROM meta
 WHERE producer <> '' AND creator <> '' AND producer <> creator),
k AS (SELECT *, {_known_last('producer')} AS tp, {_known_last('creator')} AS tc FROM v)
SELECT doc_id, 'INFO' AS severity, tc || ' > ' || tp AS detail FROM meta JOIN k USING (producer, creator) WHERE tp <> tc""")
def tool_mismatch(spark, folder):
    return emit(b.doc_meta(spark, folder), ["doc_id"], [mt.tool_mismatch_rule()]).select("doc_id", "severity", "detail")


@query("version_hint", f"WITH {META} SELECT producer, nullif(regexp_extract(producer, '(\\d+[.\\d]+)', 1), '') AS version, "
       "count(*) AS n FROM meta GROUP BY ALL")
def version_hint(spark, folder):
    return b.doc_meta(spark, folder).groupBy("producer", mt.version_hint(F.col("producer")).alias("version")).agg(
        F.count(F.lit(1)).alias("n"))


@query("tool_category", f"""WITH {META}, t AS (SELECT {TOOL} AS tool FROM meta)
SELECT CASE WHEN tool IS NOT NULL THEN {CATEGORY.format(t='tool')} END AS tool_category, count(*) AS n FROM t GROUP BY 1""")
def tool_category(spark, folder):
    tools = mt.known_tool(b.doc_meta(spark, folder)).select("tool")
    return tools.groupBy(mt.tool_category(F.col("tool")).alias("tool_category")).agg(F.count(F.lit(1)).alias("n"))


# Action types and cipher names.
ACTIONS = {
    "/Launch": "HIGH", "/JS": "HIGH", "/JavaScript": "HIGH", "/SubmitForm": "MEDIUM", "/ImportData": "MEDIUM",
    "/RichMedia": "MEDIUM", "/Sound": "LOW", "/Movie": "LOW", "/GoToR": "LOW", "/URI": "INFO",
}
CIPHERS = [
    (1, 2, "RC4 40-bit (PDF 1.1)"), (1, 3, "RC4 40-bit (PDF 1.2–1.3)"), (2, 2, "RC4 variabel (PDF 1.3)"),
    (2, 3, "RC4 128-bit (PDF 1.4)"), (3, 3, "RC4 128-bit + Permissions (PDF 1.4)"), (4, 4, "AES 128-bit (PDF 1.5)"),
    (5, 5, "AES 256-bit (PDF 1.7 Ext. 3)"), (5, 6, "AES 256-bit (PDF 2.0)"),
]
STRENGTHS = {"RC4 40-bit": "SCHWACH", "RC4 128-bit": "MITTEL", "AES 128-bit": "STARK", "AES 256-bit": "SEHR STARK"}
ACTION_NAMES = [*ACTIONS, "unbekannt", "/Named"]
LOCATIONS = ["open_action", "catalog_aa", "page_aa", "annotation", "annotation"]
ACTION = ("event_id, user_id AS doc_id, " + b.pick(ACTION_NAMES, f"(event_id % {len(ACTION_NAMES)})") + " AS type, "
          + b.pick(LOCATIONS, f"(event_id % {len(LOCATIONS)})") + " AS location")


def actions(spark, folder):
    listed = b.derived(spark, folder, "events", ACTION)
    known = spark.createDataFrame(list(ACTIONS.items()), "type string, severity string")
    return mt.lookup(listed, "type", F.broadcast(known.withColumn("listed", F.lit(True))),
                     {"severity": F.lit("LOW"), "listed": F.lit(False)})


ACT = (f"act AS (SELECT {ACTION} FROM events), {b.values_table(list(ACTIONS.items()), 'type, severity', 'known')}, "
       "found AS (SELECT act.*, coalesce(severity, 'LOW') AS severity, severity IS NOT NULL AS listed FROM act "
       "LEFT JOIN known USING (type))")


@query("action_severity_lookup", f"""WITH {ACT} SELECT event_id, type, severity FROM found
 WHERE type NOT IN ('/URI', '/GoToR')""")
def action_severity_lookup(spark, folder):
    """Severity per action; plain links produce no finding."""
    found = actions(spark, folder).filter(~F.col("type").isin("/URI", "/GoToR"))
    return found.select("event_id", "type", "severity")


@query("script_actions", f"""WITH {ACT}, f AS (SELECT doc_id,
 location <> 'annotation' AS auto, location <> 'page_aa' AND type IN ('/JS', '/JavaScript') AS script,
 CASE location WHEN 'open_action' THEN severity WHEN 'catalog_aa' THEN 'MEDIUM' WHEN 'page_aa' THEN 'LOW'
 ELSE CASE WHEN listed AND type NOT IN ('/URI', '/GoToR') THEN severity END END AS sev FROM found
 WHERE location <> 'annotation' OR listed)
SELECT doc_id, bool_or(script) AS has_script, bool_or(auto) AS has_auto_execute, count(sev) AS n_findings,
 bool_or(script) AND NOT coalesce(bool_or(sev = 'HIGH'), false) AS extra_high FROM f GROUP BY 1""")
def script_actions(spark, folder):
    """Actions by location: an open action has its listed severity, document triggers are MEDIUM, page
    triggers LOW, annotations count only listed types. Scripts without any HIGH finding add one."""
    where, kind = F.col("location"), F.col("type")
    seen = actions(spark, folder).filter((where != "annotation") | F.col("listed"))
    link = kind.isin("/URI", "/GoToR")
    severity = (
        F.when(where == "open_action", F.col("severity")).when(where == "catalog_aa", "MEDIUM")
        .when(where == "page_aa", "LOW").when(~link, F.col("severity"))
    )
    marked = seen.withColumns({
        "_severity": severity, "_script": (where != "page_aa") & kind.isin("/JS", "/JavaScript")})
    per_doc = marked.groupBy("doc_id").agg(
        F.bool_or("_script").alias("has_script"), F.bool_or(where != "annotation").alias("has_auto_execute"),
        F.count("_severity").alias("n_findings"),
        F.coalesce(F.bool_or(F.col("_severity") == "HIGH"), F.lit(False)).alias("_high"))
    return per_doc.withColumn("extra_high", F.col("has_script") & ~F.col("_high")).drop("_high")


CIPHER = "o_orderkey AS doc_id, CAST(1 + o_custkey % 5 AS INT) AS v, CAST(2 + o_orderkey % 5 AS INT) AS r"


@query("cipher_lookup", f"""WITH {b.values_table(CIPHERS, 'v, r, name', 'ciphers')}, e AS (SELECT {CIPHER} FROM orders),
a AS (SELECT doc_id, v, r, coalesce(name, 'Unbekannt (V=' || v || ', R=' || r || ')') AS algorithm FROM e LEFT JOIN ciphers
 USING (v, r))
SELECT doc_id, algorithm, CASE WHEN contains(algorithm, 'RC4 40-bit') THEN 'SCHWACH' WHEN contains(algorithm, 'RC4 128-bit')
 THEN 'MITTEL' WHEN contains(algorithm, 'AES 128-bit') THEN 'STARK' WHEN contains(algorithm, 'AES 256-bit') THEN 'SEHR STARK'
 ELSE 'UNBEKANNT' END AS strength, CASE WHEN contains(algorithm, 'RC4') THEN CASE WHEN contains(algorithm, '40-bit')
 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity FROM a""")
def cipher_lookup(spark, folder):
    ciphers = spark.createDataFrame(CIPHERS, "v int, r int, algorithm string")
    unknown = F.format_string("Unbekannt (V=%d, R=%d)", "v", "r")
    found = mt.lookup(b.derived(spark, folder, "orders", CIPHER), ["v", "r"], F.broadcast(ciphers), {"algorithm": unknown})
    name = F.col("algorithm")
    return found.select(
        "doc_id", "algorithm", F.coalesce(mt.first_match(name, STRENGTHS), F.lit("UNBEKANNT")).alias("strength"),
        F.when(name.contains("RC4"), F.when(name.contains("40-bit"), "HIGH").otherwise("MEDIUM")).alias("severity"))


@query("digest_reputation", """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents),
v AS (SELECT h, max(toxic) AS detections FROM d JOIN labels USING (doc_id) GROUP BY h)
SELECT 'hit' AS outcome, doc_id, h AS sha256, detections, CASE WHEN detections > 0 THEN 'malicious' ELSE 'clean' END AS verdict
 FROM d JOIN v USING (h)
UNION ALL SELECT DISTINCT 'miss', NULL::BIGINT, h, NULL, NULL FROM d WHERE h NOT IN (SELECT h FROM v)""")
def digest_reputation(spark, folder):
    """Verdicts for known digests; unknown digests are listed once for submission."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    verdicts = docs.join(labels, "doc_id").groupBy("sha256").agg(F.max("toxic").alias("detections"))
    hits, misses = mt.digest_reputation(docs, verdicts, "sha256")
    verdict = F.when(F.col("detections") > 0, "malicious").otherwise("clean")
    return hits.select(F.lit("hit").alias("outcome"), "doc_id", "sha256", "detections", verdict.alias("verdict")).unionByName(
        misses.select(F.lit("miss").alias("outcome"), "sha256"), allowMissingColumns=True)
