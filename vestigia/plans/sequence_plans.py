"""Ordered queries: first occurrences, segments, labels, timelines, gaps, hidden text."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.operators import sequences as sq
from vestigia.operators import tokens as tk
from vestigia.plans import bindings as b
from vestigia.plans.bindings import EV, META, OBJ
from vestigia.plans.registry import query
from vestigia.sources.tables import table


def _docs(spark, folder):
    return table(spark, folder, "documents")


@query("first_occurrence", """SELECT doc_id, w AS val, min(i) AS pos FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
 unnest(range(len(string_split(text, ' ')))) AS i FROM documents) GROUP BY ALL""")
def first_occurrence(spark, folder):
    """The texts are dealt by document before they are taken apart, so no word is shuffled."""
    words = _docs(spark, folder).select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "val"))
    return sq.first_occurrence(words, ["doc_id", "val"], "pos").withColumn("pos", F.col("pos").cast("long"))


LINES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
 len(string_split(text, chr(10))) AS n FROM documents)"""


@query("revision_segments", f"""WITH {LINES}, s AS (SELECT doc_id, i + 1 AS revision, CAST(length(line) + 1 AS BIGINT) AS size FROM ln WHERE i < n - 1),
e AS (SELECT *, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY revision) AS BIGINT) AS e FROM s)
SELECT doc_id, CAST(revision AS INT) AS revision, e - size AS start, e AS "end", size FROM e""")
def revision_segments(spark, folder):
    """Line ends stand for the end-of-revision marker."""
    return sq.revision_segments(_docs(spark, folder), "text", "\n")


@query("revision_summary", f"""WITH {LINES}, c AS (SELECT doc_id, max(n) - 1 AS revisions, CAST(max(length(line) + 1) FILTER (i = n - 2) AS BIGINT) AS last_size,
 CASE WHEN max(n) > 1 THEN CAST(max(length(line)) FILTER (i = n - 1) AS BIGINT) ELSE 0 END AS trailing_size FROM ln GROUP BY 1)
SELECT *, CASE WHEN revisions > 1 THEN 'HIGH' END AS several, CASE WHEN revisions > 1 AND last_size < 1024 THEN 'MEDIUM' END AS small_last,
 CASE WHEN trailing_size > 20 THEN 'MEDIUM' END AS trailing_severity FROM c""")
def revision_summary(spark, folder):
    return sq.revision_summary(_docs(spark, folder), "text", "\n")


RANGES = ("l_orderkey AS doc_id, CAST(l_linenumber * 3 - 3 AS BIGINT) AS start, "
          + b.pick(["/D", "/R", "/r", "/A", "/a", "/X"], "(l_linenumber % 6)") + " AS style, CAST(1 + l_linenumber % 40 AS BIGINT) "
          "AS first, CASE l_linenumber % 3 WHEN 0 THEN 'p-' ELSE '' END AS prefix")
PAGES = "o_orderkey AS doc_id, CAST(o_orderkey % 25 AS BIGINT) AS page_count"
SPANS = f"""rg AS (SELECT DISTINCT {RANGES} FROM lineitem), sp AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), page_count) AS e
 FROM rg JOIN (SELECT {PAGES} FROM orders) USING (doc_id))"""


def _spans(spark, folder):
    return sq.label_spans(b.derived(spark, folder, "lineitem", RANGES).distinct(), b.derived(spark, folder, "orders", PAGES))


@query("label_ranges", f"""WITH {SPANS}, d AS (SELECT doc_id, any_value(page_count) AS page_count, CAST(sum(greatest(0, e - start)) AS BIGINT) AS declared,
 count(*) AS n_ranges, bool_or(start >= page_count) AS past, min_by(first, start) AS f FROM sp GROUP BY 1)
SELECT doc_id, page_count, declared, n_ranges, CASE WHEN declared <> page_count THEN 'HIGH' END AS count_severity,
 CASE WHEN past THEN 'HIGH' END AS past_end_severity, CASE WHEN n_ranges > page_count THEN 'HIGH' END AS too_many_severity,
 CASE WHEN f <> 1 THEN 'LOW' END AS first_severity FROM d""")
def label_ranges(spark, folder):
    return sq.label_checks(_spans(spark, folder))


ROMAN_SQL = """(['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[1 + ({n} // 100) % 10] ||
 (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[1 + ({n} // 10) % 10] ||
 (['','I','II','III','IV','V','VI','VII','VIII','IX'])[1 + {n} % 10]"""
ALPHA_SQL = "CASE WHEN {n} > 26 THEN chr(CAST(96 + ({n} - 1) // 26 AS INT)) ELSE '' END || chr(CAST(97 + ({n} - 1) % 26 AS INT))"


@query("page_labels", f"""WITH {SPANS}, x AS (SELECT doc_id, style, prefix, first, start, unnest(range(start, greatest(start, e))) AS page FROM sp),
n AS (SELECT *, first + page - start AS n FROM x)
SELECT doc_id, page, prefix || CASE style WHEN '/R' THEN {ROMAN_SQL.format(n='n')} WHEN '/r' THEN lower({ROMAN_SQL.format(n='n')})
 WHEN '/A' THEN upper({ALPHA_SQL.format(n='n')}) WHEN '/a' THEN {ALPHA_SQL.format(n='n')} ELSE CAST(n AS VARCHAR) END AS label FROM n""")
def page_labels(spark, folder):
    return sq.page_labels(_spans(spark, folder))


@query("duplicate_to_earliest", f"""WITH {LINES}, p AS (SELECT doc_id, i AS pos, md5(line) AS digest FROM ln WHERE trim(line) <> ''),
f AS (SELECT doc_id, digest, min(pos) AS first_pos FROM p GROUP BY ALL) SELECT doc_id, digest, pos, first_pos FROM p JOIN f USING (doc_id, digest)
 WHERE pos > first_pos""")
def duplicate_to_earliest(spark, folder):
    """Lines stand for pages; blank ones never count as duplicates."""
    lines = _docs(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    pages = lines.filter(F.trim("line") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("digest"))
    return sq.duplicate_to_earliest(pages, ["doc_id"], "pos", "digest")


TIMELINE = f"""WITH {META}, {OBJ}, tl AS (SELECT doc_id, 'metadata' AS source, 'created' AS detail, CASE WHEN doc_id % 50 > 0 THEN created END AS ts FROM meta
 UNION ALL SELECT doc_id, 'metadata', 'modified', max(modified) FROM obj GROUP BY doc_id
 UNION ALL SELECT doc_id, 'id', 'part ' || part, modified FROM obj
 UNION ALL SELECT user_id, 'event', event_type || ' ' || event_id, ts FROM events)"""


def _dated(spark, folder):
    meta, items = b.doc_meta(spark, folder), b.objects(spark, folder)
    return [
        meta.selectExpr("doc_id", "'metadata' AS source", "'created' AS detail", "CASE WHEN doc_id % 50 > 0 THEN created END AS ts"),
        items.groupBy("doc_id").agg(F.max("modified").alias("ts")).selectExpr(
            "doc_id", "'metadata' AS source", "'modified' AS detail", "ts"),
        items.selectExpr("doc_id", "'id' AS source", "'part ' || CAST(part AS STRING) AS detail", "modified AS ts"),
        table(spark, folder, "events").selectExpr(
            "user_id AS doc_id", "'event' AS source", "event_type || ' ' || CAST(event_id AS STRING) AS detail", "ts"),
    ]


@query("timeline", TIMELINE + """ SELECT doc_id, source, detail, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, row_number() OVER
 (PARTITION BY doc_id ORDER BY tl.ts NULLS FIRST, source, detail) AS place FROM tl""")
def timeline(spark, folder):
    return sq.timeline(_dated(spark, folder)).select(
        "doc_id", "source", "detail", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "place")


@query("union_timeline", TIMELINE + """ SELECT source, count(*) AS n, count(ts) AS n_dated, count(DISTINCT doc_id) AS n_docs FROM tl GROUP BY 1""")
def union_timeline(spark, folder):
    """Events per source of the united timeline."""
    return sq.united(_dated(spark, folder)).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_dated"), F.countDistinct("doc_id").alias("n_docs"))


BLOCKS = f"""WITH {EV}, us AS (SELECT doc_id, ts, score, CAST(round(score * 1000000) AS HUGEINT) AS u FROM ev),
bl AS (SELECT doc_id, CAST(ts AS DATE) AS block, sum(u) AS s, count(*) AS n FROM us GROUP BY ALL),
al AS (SELECT doc_id, sum(u) AS ts, count(*) AS tn, stddev_pop(score) AS sd FROM us GROUP BY 1),
h AS (SELECT doc_id, block, ((2 * s + 100 * n) // (200 * n)) / 10000.0 AS m, ((2 * ts + 100 * tn) // (200 * tn)) / 10000.0 AS am, sd,
 2 * s * tn > 5 * ts * n AND s > 15000000 * n AS hot FROM bl JOIN al USING (doc_id))"""


def _blocks(spark, folder):
    found = b.findings(spark, folder).select("doc_id", F.to_date("ts").alias("block"), "score")
    return sq.block_outliers(found, "doc_id", "block", "score")


@query("block_outliers", BLOCKS + """ SELECT doc_id, round(any_value(am), 4) AS overall_mean, count(*) AS n_blocks, count(*) FILTER (hot) AS hot_blocks,
 round(count(*) FILTER (hot) / count(*) * 100, 4) AS hot_share, CASE WHEN any_value(am) > 20 OR count(*) FILTER (hot) / count(*) * 100 > 15 THEN 'SUSPICIOUS'
 WHEN any_value(am) < 2 AND any_value(sd) < 1 THEN 'LOW_SIGNAL' ELSE 'NORMAL' END AS verdict FROM h GROUP BY doc_id""")
def block_outliers(spark, folder):
    return sq.outlier_verdict(_blocks(spark, folder), "doc_id")


@query("block_hotspots", BLOCKS + """ SELECT doc_id, CAST(block AS VARCHAR) AS block, round(m, 4) AS block_mean, row_number() OVER (PARTITION BY doc_id
 ORDER BY m DESC, h.block) AS place FROM h WHERE hot QUALIFY place <= 10""")
def block_hotspots(spark, folder):
    top = sq.top_per_group(_blocks(spark, folder).filter("hot"), ["doc_id"], [F.desc("block_mean"), F.col("block")], 10)
    return top.select("doc_id", F.col("block").cast("string").alias("block"), F.round("block_mean", 4).alias("block_mean"), F.col("place").cast("long").alias("place"))


@query("regular_spacing", f"""WITH {EV}, p AS (SELECT doc_id, epoch_us(ts) / 3600000000.0 AS x, count(*) OVER (PARTITION BY doc_id) AS n_points,
 row_number() OVER (PARTITION BY doc_id ORDER BY ts, finding_id) AS rn FROM ev),
g AS (SELECT * FROM (SELECT doc_id, n_points, x - lag(x) OVER (PARTITION BY doc_id ORDER BY rn) AS gap FROM p WHERE n_points >= 6) WHERE gap > 2),
l AS (SELECT doc_id, any_value(n_points) AS n_points, list_sort(list(gap)) AS gs FROM g GROUP BY 1),
m AS (SELECT *, gs[len(gs) // 2 + 1] AS md FROM l)
SELECT doc_id, n_points, round(md, 1) AS spacing FROM m WHERE md >= 2 AND len(list_filter(gs, lambda x: abs(x - md) <= 8)) / len(gs) >= 0.5""")
def regular_spacing(spark, folder):
    """Hours of the events of each actor as positions."""
    points = b.findings(spark, folder).select(
        "doc_id", "finding_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("x"))
    return sq.regular_spacing(points, "doc_id", "x", "finding_id")


@query("neighbour_noise", f"""WITH {EV}, d AS (SELECT doc_id, score - lag(score) OVER (PARTITION BY doc_id ORDER BY ts, finding_id) AS d FROM ev)
SELECT doc_id, round(stddev_pop(d), 6) AS noise, count(d) AS n_pairs FROM d GROUP BY 1""")
def neighbour_noise(spark, folder):
    return sq.neighbour_noise(b.findings(spark, folder), "doc_id", "ts", "finding_id", "score")


@query("last_n_context", """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
 FROM conversations) WHERE rn <= 10 AND role IN ('user', 'assistant') AND text <> ''""")
def last_n_context(spark, folder):
    """The last ten entries of a conversation, and of these the user and assistant turns."""
    keep = F.col("role").isin("user", "assistant") & (F.col("text") != "")
    return sq.last_n_then_filter(table(spark, folder, "conversations"), "conv_id", "turn", 10, keep).select(
        "conv_id", "turn", "role")


@query("top_per_group", f"""WITH {EV} SELECT doc_id, finding_id, severity, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'HIGH' THEN 0
 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, finding_id) AS place FROM ev QUALIFY place <= 5""")
def top_per_group(spark, folder):
    """The five worst findings of each document."""
    from vestigia.operators.common import severity_rank

    found = b.findings(spark, folder)
    top = sq.top_per_group(found, ["doc_id"], [severity_rank(F.col("severity")).desc(), F.col("finding_id")], 5)
    return top.select("doc_id", "finding_id", "severity", F.col("place").cast("long").alias("place"))


STEPS = ["network", "rules", "dates", "identifiers", "structure", "revisions", "hidden_text", "correlation"]


def _audit_sql() -> str:
    rows = [(0, "analysis_start", None)] + [(i, f"analyzer_{i:02d}", s) for i, s in enumerate(STEPS, 1)] + [
        (len(STEPS) + 1, "analysis_complete", str(len(STEPS)))]
    return (f"WITH {b.values_table(rows, 'seq, action, detail', 'st')} SELECT doc_id, seq, action, detail, "
            "CASE WHEN action = 'analysis_complete' THEN doc_id % 10 <> 0 END AS evidence_intact FROM documents, st")


@query("audit_log", _audit_sql())
def audit_log(spark, folder):
    docs = _docs(spark, folder).select("doc_id", (F.col("doc_id") % 10 != 0).alias("intact"))
    return sq.audit_log(docs, STEPS, "doc_id", "intact").drop("intact")


# Drawing instructions whose numbers come from the keys.
DRAW = ("'BT /F1 ' || CAST(l_linenumber AS STRING) || ' Tf 0 0 0 rg 10 20 Td (Title) Tj ' || "
        "CASE l_partkey % 4 WHEN 0 THEN '0.93 0.95 1 rg' WHEN 1 THEN '0.92 g' WHEN 2 THEN '0 0 0 0 k' ELSE '1 1 rg' END || ' (white) Tj ' || "
        "CASE l_suppkey % 3 WHEN 0 THEN '3 Tr' WHEN 1 THEN '1 Tr 0.2 g' ELSE 'x Tr 0 0 0 rg' END || ' [ (in) -20 (vis) ] TJ ' || "
        "CASE l_linenumber % 3 WHEN 0 THEN '/F2 0.5 Tf' WHEN 1 THEN '/F2 0 Tf' ELSE 'Tf' END || ' 0 g 0 Tr (tiny\\\\n\\\\101) Tj ' || "
        "CAST(l_quantity * 20 AS INT) || ' -30 Td (moved) Tj 1 0 0 1 ' || CAST(l_partkey % 700 AS STRING) || ' 0 Tm (set) Tj 5 -40 TD (z) Tj -20 -20 TD (down) '' ET'")
PAGE_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def drawn_pages(spark, folder):
    """Pages are spread over the tasks by their keys before they are drawn, so that no drawn page is shuffled."""
    keys = b.derived(spark, folder, "lineitem", f"l_orderkey AS doc_id, {', '.join(PAGE_KEYS)}").repartition("doc_id", *PAGE_KEYS)
    pages = keys.selectExpr("doc_id", *[f"{k} AS {a}" for k, a in zip(PAGE_KEYS, ["ln", "pk", "sk", "q"])], f"{DRAW} AS content")
    return pages.withColumns({"page_width": F.lit(595.28), "page_height": F.lit(841.89)})


# The SQL side replays the same instructions from the keys: one row per shown text with its state.
HIDDEN = """hp AS (SELECT l_orderkey AS doc_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q,
 CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS w1, CAST(l_linenumber AS DOUBLE) AS s1,
 CASE WHEN l_suppkey % 3 = 0 THEN 3 WHEN l_suppkey % 3 = 1 THEN 1 ELSE 0 END AS m1,
 CASE WHEN l_suppkey % 3 = 0 THEN CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END ELSE 0 END AS w2,
 CASE l_linenumber % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END AS s2,
 10 + CAST(l_quantity * 20 AS INT) AS x2, l_partkey % 700 AS x3 FROM lineitem),
ht AS (SELECT doc_id, ln, pk, sk, 'white' AS text, CASE WHEN w1 = 1 THEN 'white_text' END AS reason FROM hp
 UNION ALL SELECT doc_id, ln, pk, sk, 'invis', CASE WHEN m1 = 3 THEN 'invisible_text' WHEN w2 = 1 THEN 'white_text' END FROM hp
 UNION ALL SELECT doc_id, ln, pk, sk, 'tiny', CASE WHEN s2 = 0.5 THEN 'tiny_text' END FROM hp
 UNION ALL SELECT doc_id, ln, pk, sk, 'moved', CASE WHEN s2 = 0.5 THEN 'tiny_text' WHEN x2 > 645.28 THEN 'off_page' END FROM hp
 UNION ALL SELECT doc_id, ln, pk, sk, 'set', CASE WHEN s2 = 0.5 THEN 'tiny_text' WHEN x3 > 645.28 THEN 'off_page' END FROM hp
 UNION ALL SELECT doc_id, ln, pk, sk, 'down', CASE WHEN s2 = 0.5 THEN 'tiny_text' ELSE 'off_page' END FROM hp)"""


def _hidden(spark, folder):
    return tk.hidden_text(drawn_pages(spark, folder).withColumn("page", F.xxhash64("ln", "pk", "sk", "q")),
                          ["doc_id", "page"], "content")


@query("token_state_ffill", f"WITH {HIDDEN} SELECT doc_id, text, reason, count(*) AS n FROM ht WHERE reason IS NOT NULL GROUP BY ALL")
def token_state_ffill(spark, folder):
    blocks = _hidden(spark, folder)
    return blocks.groupBy("doc_id", "text", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("hidden_text_findings", f"""WITH {HIDDEN}, c AS (SELECT doc_id, count(*) FILTER (reason = 'invisible_text') AS n_invisible,
 count(*) FILTER (reason = 'white_text') AS n_white, count(*) FILTER (reason = 'tiny_text') AS n_tiny FROM ht WHERE reason IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN n_invisible > 0 THEN 'HIGH' END AS invisible_severity, CASE WHEN n_white > 0 THEN 'MEDIUM' END AS white_severity,
 CASE WHEN n_tiny > 0 THEN 'LOW' END AS tiny_severity FROM c""")
def hidden_text_findings(spark, folder):
    return tk.hidden_text_findings(_hidden(spark, folder))
