"""Roll-ups over findings: counts, levels, scores, charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vestigia.operators import rollups
from vestigia.operators.common import emit, severity_rank
from vestigia.plans import bindings as b
from vestigia.plans.bindings import EV, META
from vestigia.plans.registry import query
from vestigia.sources.tables import table

SEV = ("count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, "
       "count(*) FILTER (severity = 'LOW') AS low")
RANK = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 WHEN 'INFO' THEN 0 ELSE -1 END"


@query("severity_counts", f"WITH {EV} SELECT doc_id, {SEV} FROM ev GROUP BY doc_id")
def severity_counts(spark, folder):
    return rollups.severity_counts(b.findings(spark, folder))


@query("risk_level", f"""WITH {EV}, w AS (SELECT doc_id, max({RANK}) AS r FROM ev GROUP BY doc_id)
SELECT c_custkey AS doc_id, CASE r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'CLEAN' END
 AS risk_level FROM customer LEFT JOIN w ON w.doc_id = c_custkey""")
def risk_level(spark, folder):
    evidence = table(spark, folder, "customer").selectExpr("c_custkey AS doc_id")
    return rollups.risk_levels(evidence, b.findings(spark, folder))


MANIP = f"""WITH {EV}, base AS (SELECT doc_id, {SEV}, count(*) FILTER (k = 7 AND severity = 'HIGH') AS corr_high,
 count(*) FILTER (k = 7 AND severity = 'MEDIUM') AS corr_medium,
 count(*) FILTER (k = 7 AND severity IN ('LOW', 'INFO')) AS corr_other, bool_or(section = 'javascript_actions' AND k > 90)
 AS script, bool_or(section = 'hidden_text' AND k > 90) AS hidden_text, bool_or(k = 96) AS shadow
 FROM ev GROUP BY doc_id, CAST(ts AS DATE)), s AS (SELECT doc_id, high, medium, low, CAST(least(100, 8*high + 3*medium
 + low + 15*corr_high + 10*corr_medium + 5*corr_other + CASE WHEN script THEN 10 ELSE 0 END
 + CASE WHEN hidden_text THEN 5 ELSE 0 END + CASE WHEN shadow THEN 15 ELSE 0 END) AS BIGINT) AS score FROM base)"""


def manipulation_input(spark, folder):
    """One row per document and day, so that scores spread over the whole range."""
    sev = F.col("severity")
    return b.findings(spark, folder).groupBy("doc_id", F.to_date("ts").alias("day")).agg(
        *rollups.severity_aggs(),
        F.count_if((F.col("k") == 7) & (sev == "HIGH")).alias("corr_high"),
        F.count_if((F.col("k") == 7) & (sev == "MEDIUM")).alias("corr_medium"),
        F.count_if((F.col("k") == 7) & sev.isin("LOW", "INFO")).alias("corr_other"),
        F.bool_or((F.col("section") == "javascript_actions") & (F.col("k") > 90)).alias("script"),
        F.bool_or((F.col("section") == "hidden_text") & (F.col("k") > 90)).alias("hidden_text"),
        F.bool_or(F.col("k") == 96).alias("shadow"),
    )


@query("manipulation_score", MANIP + """ SELECT doc_id, score, CASE WHEN score <= 20 THEN 'safe' WHEN score <= 50
 THEN 'note' ELSE 'warn' END AS band, CASE WHEN score > 60 THEN 'HIGH' WHEN score > 30 THEN 'MEDIUM' END AS severity
 FROM s""")
def manipulation_score(spark, folder):
    scored = rollups.manipulation_score(manipulation_input(spark, folder))
    fired = F.filter(F.array(*rollups.manipulation_rules()), lambda f: f.isNotNull())
    return scored.select("doc_id", "score", "band", F.get(fired, F.lit(0))["severity"].alias("severity"))


@query("custom_score", MANIP + " SELECT doc_id, CAST(least(100, 20*high + 2*medium) AS BIGINT) AS score FROM s")
def custom_score(spark, folder):
    """Caller-supplied weights in place of the built-in ones."""
    return rollups.manipulation_score(manipulation_input(spark, folder), {"high": 20, "medium": 2}).select(
        "doc_id", "score"
    )


@query("security_score", f"""WITH {META}, s AS (SELECT doc_id, CAST(greatest(0, least(100, 100 - 15*n_high - 5*n_medium
 - n_low - CASE WHEN has_script THEN 10 ELSE 0 END - CASE WHEN n_high > 4 THEN 30 ELSE 0 END
 + CASE WHEN status = 'O' THEN 5 ELSE 0 END - CASE WHEN encrypted THEN 5 ELSE 0 END)) AS BIGINT) AS score FROM meta)
SELECT *, CASE WHEN score >= 80 THEN 'safe' WHEN score >= 60 THEN 'ok' WHEN score >= 35 THEN 'warning'
 ELSE 'critical' END AS band FROM s""")
def security_score(spark, folder):
    counts = b.doc_meta(spark, folder).selectExpr(
        "doc_id", "n_high AS high", "n_medium AS medium", "n_low AS low", "has_script AS script",
        "n_high > 4 AS malware", "status = 'O' AS valid_signature", "encrypted",
    )
    return rollups.security_score(counts).select("doc_id", "score", "band")


NULLED = "CASE WHEN k < 10 THEN NULL ELSE category END AS category"


@query("category_counts", f"WITH {EV} SELECT coalesce(CASE WHEN k < 10 THEN NULL ELSE category END, 'other') "
       "AS category, count(*) AS n FROM ev GROUP BY 1")
def category_counts(spark, folder):
    return rollups.category_counts(b.findings(spark, folder).selectExpr(NULLED))


CATSEV = ("SELECT coalesce(category, 'other') AS category, count(*) FILTER (severity = 'HIGH') AS high, "
          "count(*) FILTER (severity = 'MEDIUM') AS medium, "
          "count(*) FILTER (severity NOT IN ('HIGH', 'MEDIUM')) AS low FROM ")
MIXED = "CASE WHEN k % 4 = 0 THEN section ELSE category END AS category, severity"


@query("category_severity_pivot", f"WITH {EV} {CATSEV} (SELECT {MIXED} FROM ev) GROUP BY 1")
def category_severity_pivot(spark, folder):
    return rollups.category_severity(b.findings(spark, folder).selectExpr(*MIXED.split(", ")))


@query("top_categories", f"""WITH {EV}, c AS (SELECT category, count(*) AS n FROM (SELECT {MIXED} FROM ev) GROUP BY 1)
SELECT category, n FROM c WHERE (SELECT count(*) FROM c) >= 3 ORDER BY n DESC, category LIMIT 8""")
def top_categories(spark, folder):
    """The eight largest categories; empty if there are fewer than three. The guard counts the eight rows."""
    counts = rollups.category_counts(b.findings(spark, folder).selectExpr(*MIXED.split(", ")))
    top = counts.orderBy(F.desc("n"), "category").limit(8)
    sized = top.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    return sized.filter("_rows >= 3").drop("_rows")


@query("top_weighted_categories", f"""WITH {EV}, c AS ({CATSEV} (SELECT {MIXED} FROM ev) GROUP BY 1)
SELECT category, CAST(10*high + 3*medium + low AS BIGINT) AS weight FROM c ORDER BY weight DESC, category LIMIT 10""")
def top_weighted_categories(spark, folder):
    counts = rollups.category_severity(b.findings(spark, folder).selectExpr(*MIXED.split(", ")))
    weight = rollups.weighted(rollups.CATEGORY_WEIGHTS).cast("long")
    return counts.select("category", weight.alias("weight")).orderBy(F.desc("weight"), "category").limit(10)


def _phase_sql() -> str:
    parts = []
    for phase, words in rollups.PHASE_KEYWORDS.items():
        test = " OR ".join(f"contains(lower(category), '{w}') OR contains(lower(message), '{w}')" for w in words)
        parts.append(f"SELECT '{phase}' AS phase, count(*) AS n FROM f WHERE {test} HAVING count(*) > 0")
    return f"WITH {EV}, f AS (SELECT section AS category, message FROM ev) " + " UNION ALL ".join(parts)


@query("phase_counts", _phase_sql())
def phase_counts(spark, folder):
    return rollups.phase_counts(b.findings(spark, folder).selectExpr("section AS category", "message"))


def _phase_of(column: str) -> str:
    arms = " ".join(f"WHEN {column} IN ({', '.join(b.sql_text(s) for s in names)}) THEN '{phase}'"
                    for phase, names in rollups.PHASE_SECTIONS.items())
    return f"CASE {arms} END"


@query("analyzer_coverage", f"""WITH {EV}, s AS (SELECT doc_id, section, max(CASE severity WHEN 'HIGH' THEN 2
 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS w FROM ev GROUP BY ALL)
SELECT doc_id, {_phase_of('section')} AS phase, count(*) FILTER (w = 0) AS n_pass, count(*) FILTER (w = 1) AS n_warn,
 count(*) FILTER (w = 2) AS n_fail FROM s GROUP BY 1, 2""")
def analyzer_coverage(spark, folder):
    return rollups.analyzer_coverage(b.findings(spark, folder))


@query("analyzer_status", f"""WITH {EV}, s AS (SELECT doc_id, section, {SEV}, count(*) AS total FROM ev GROUP BY ALL)
SELECT doc_id, section, total, CASE WHEN high > 0 THEN 'HIGH (' || high || ')' WHEN medium > 0 THEN 'MEDIUM (' || medium
 || ')' WHEN low > 0 THEN 'LOW (' || low || ')' ELSE 'OK' END AS status FROM s""")
def analyzer_status(spark, folder):
    return rollups.analyzer_status(b.findings(spark, folder))


@query("severity_share", f"""WITH {EV}, c AS (SELECT {SEV} FROM ev), t AS (SELECT *, high + medium + low AS total FROM c)
SELECT 'HIGH' AS label, high AS n, round(high / total, 6) AS share FROM t WHERE total > 0
UNION ALL SELECT 'MEDIUM', medium, round(medium / total, 6) FROM t WHERE total > 0
UNION ALL SELECT 'LOW', low, round(low / total, 6) FROM t WHERE total > 0
UNION ALL SELECT 'CLEAN', 0, 1.0 FROM t WHERE total = 0""")
def severity_share(spark, folder):
    return rollups.severity_share(b.findings(spark, folder))


@query("severity_rollup", f"""WITH {EV} SELECT category, source, CAST(grouping(category, source) AS BIGINT) AS level, {SEV}
 FROM ev GROUP BY GROUPING SETS ((category), (source), ())""")
def severity_rollup(spark, folder):
    return rollups.severity_rollup(b.findings(spark, folder))


@query("significant_findings", f"WITH {EV} SELECT finding_id, doc_id, severity FROM ev WHERE severity <> 'INFO'")
def significant_findings(spark, folder):
    found = b.findings(spark, folder)
    return found.filter(F.col("severity") != "INFO").select("finding_id", "doc_id", "severity")


GAPPED = ("CASE WHEN k = 3 THEN NULL ELSE finding_id END AS finding_id, doc_id, "
          "CASE WHEN k = 4 THEN NULL ELSE severity END AS severity")


@query("clean_findings", f"WITH {EV}, g AS (SELECT {GAPPED} FROM ev) SELECT * FROM g WHERE finding_id IS NOT NULL "
       "AND severity IS NOT NULL")
def clean_findings(spark, folder):
    """Findings that are null or lack a severity are dropped."""
    found = b.findings(spark, folder).selectExpr(*[f"{p}" for p in GAPPED.split(", ")])
    return found.filter(F.col("finding_id").isNotNull() & F.col("severity").isNotNull())


@query("severity_order", f"""WITH {EV}, r AS (SELECT finding_id, doc_id, severity, {RANK} AS rk FROM ev)
SELECT finding_id, doc_id, severity, row_number() OVER (PARTITION BY doc_id ORDER BY rk DESC, finding_id) AS place
 FROM r""")
def severity_order(spark, folder):
    """Place of each finding within its document, worst first. Severity is the chunk of the order, and
    finding-id blocks below it, so that even a hot document is numbered in parallel."""
    from vestigia.operators import ordered

    ranked = b.findings(spark, folder).withColumn("_rank", severity_rank(F.col("severity")))
    chunked = ranked.withColumn(
        ordered.CHUNK, F.struct((-F.col("_rank")).alias("r"), F.floor(F.col("finding_id") / 1_000_000).alias("b"))
    )
    return ordered.row_numbers(chunked, ["doc_id"], [F.col("finding_id")], "place").select(
        "finding_id", "doc_id", "severity", "place"
    )


@query("union_findings", f"""WITH {EV} SELECT analyzer, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
 SELECT doc_id, 'events' AS analyzer, severity FROM ev
 UNION ALL SELECT doc_id, 'size', 'LOW' FROM documents WHERE n_chars > 5000
 UNION ALL SELECT doc_id, 'labels', 'HIGH' FROM labels WHERE toxic = 1) GROUP BY ALL""")
def union_findings(spark, folder):
    """Findings of several detectors in one table, then counted."""
    from vestigia.operators.common import rule
    from vestigia.operators.detectors import Detector, run_detectors

    detectors = [
        Detector("events", lambda: b.findings(spark, folder).selectExpr(
            "doc_id", "severity", "category", "'event' AS code", "message AS detail")),
        Detector("size", lambda: emit(table(spark, folder, "documents"), ["doc_id"], [
            rule(F.col("n_chars") > 5000, "LOW", "size", "large_text", F.col("n_chars"))])),
        Detector("labels", lambda: emit(table(spark, folder, "labels"), ["doc_id"], [
            rule(F.col("toxic") == 1, "HIGH", "verdict", "toxic")])),
    ]
    found = run_detectors(spark, detectors).findings
    return found.groupBy("analyzer", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")
    )
