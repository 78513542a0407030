"""Comparison sets: pairs, differences, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.operators import compare as cmp
from vestigia.operators.common import join_reduced, joined
from vestigia.operators.matching import known_tool
from vestigia.plans import bindings as b
from vestigia.plans.bindings import EV, META, OBJ
from vestigia.plans.predicate_plans import FACTS, with_object_facts
from vestigia.plans.registry import ORACLES, QUERIES, query
from vestigia.sources import stores
from vestigia.sources.tables import table

DOCSET = ("dset AS (SELECT doc_id, text, CAST(floor(doc_id / 4) AS BIGINT) AS comparison_id FROM documents "
          "UNION ALL SELECT doc_id + 10000000, text, CAST(floor(doc_id / 4) AS BIGINT) + 10000000 FROM documents "
          "WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 20000000, upper(lang), CAST(floor(doc_id / 2) AS BIGINT) + 20000000 "
          "FROM documents)")
OK_SETS = "SELECT comparison_id FROM {t} GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4"


def document_sets(spark, folder):
    """Neighbouring documents as sets of four; every second one as sets of two; languages as sets of two."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    four = docs.select("doc_id", "text", F.floor(F.col("doc_id") / 4).alias("comparison_id"))
    two = four.filter("doc_id % 2 = 0").select(
        (F.col("doc_id") + 10000000).alias("doc_id"), "text", (F.col("comparison_id") + 10000000).alias("comparison_id"))
    languages = docs.select(
        (F.col("doc_id") + 20000000).alias("doc_id"), F.upper("lang").alias("text"),
        (F.floor(F.col("doc_id") / 2) + 20000000).alias("comparison_id"))
    return four.unionByName(two).unionByName(languages)


@query("identical_pairs", f"""WITH {DOCSET}, v AS ({OK_SETS.format(t='dset')})
SELECT comparison_id, a.doc_id AS doc_a, b.doc_id AS doc_b, sha256(a.text) AS sha256 FROM v JOIN dset a USING (comparison_id)
 JOIN dset b USING (comparison_id) WHERE a.doc_id < b.doc_id AND sha256(a.text) = sha256(b.text)""")
def identical_pairs(spark, folder):
    members = document_sets(spark, folder).select("comparison_id", "doc_id", F.sha2("text", 256).alias("sha256"))
    return cmp.identical_pairs(members)


@query("comparison_status", f"""WITH {META}, s AS (SELECT author AS comparison_id, count(*) AS n_documents FROM meta GROUP BY 1)
SELECT *, CASE WHEN n_documents < 2 THEN 'at least 2 documents needed' WHEN n_documents > 4 THEN 'at most 4 documents allowed' END AS error FROM s""")
def comparison_status(spark, folder):
    """Every requested set with its size, and why it is not compared: here the documents of one author."""
    return cmp.set_sizes(b.doc_meta(spark, folder).withColumn("comparison_id", F.col("author")))


@query("identical_groups", """WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents),
g AS (SELECT sha256, min(doc_id) AS first_doc, count(*) AS n_docs FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, first_doc, n_docs, CAST(n_docs * (n_docs - 1) // 2 AS BIGINT) AS n_pairs FROM h JOIN g USING (sha256)""")
def identical_groups(spark, folder):
    """Corpus-wide equal digests: every copy points to the first one; the pairs are counted, not built.
    Digests are reduced to one row each before they meet the documents, so a digest that a third of the
    corpus shares stays cheap (the join's large side may be split by AQE)."""
    hashed = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    linked = join_reduced(hashed, groups.filter("n_docs > 1"), "sha256")
    return linked.select("doc_id", "first_doc", "n_docs", F.expr("n_docs * (n_docs - 1) div 2").alias("n_pairs"))


@query("time_proximity_pairs", """WITH e AS (SELECT event_id, ts, CAST(floor(event_id / 4) AS BIGINT) AS comparison_id FROM events)
SELECT comparison_id, a.event_id AS doc_a, b.event_id AS doc_b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS delta_us
 FROM e a JOIN e b USING (comparison_id) WHERE a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 300000000""")
def time_proximity_pairs(spark, folder):
    members = b.derived(spark, folder, "events",
                        "event_id AS doc_id, ts, CAST(floor(event_id / 4) AS BIGINT) AS comparison_id")
    return cmp.time_proximity_pairs(members, "ts")


@query("time_proximity_groups", """WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
c AS (SELECT *, count(*) OVER (ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND 299999999 FOLLOWING) - 1 AS n_links,
 CASE WHEN us - lag(us) OVER (ORDER BY us) < 300000000 THEN 0 ELSE 1 END AS s FROM e),
g AS (SELECT *, sum(s) OVER (ORDER BY us, s DESC ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT event_id, us AS ts_us, min(event_id) OVER (PARTITION BY g) AS class_id, CAST(n_links AS BIGINT) AS n_links FROM g""")
def time_proximity_groups(spark, folder):
    """Every event with the number of others less than five minutes apart, and the class that chains of them form."""
    return cmp.time_proximity_groups(table(spark, folder, "events"), "ts", "event_id")


TOOL_CASE = """CASE WHEN {c} LIKE 'Microsoft%' THEN 'Microsoft Word' WHEN {c} LIKE 'Acrobat%' THEN 'Adobe Acrobat Distiller'
 WHEN {c} LIKE 'GPL%' THEN 'Ghostscript' WHEN {c} LIKE 'Libre%' THEN 'LibreOffice' WHEN {c} LIKE 'pdfTeX%' THEN 'pdfTeX (LaTeX)'
 WHEN {c} LIKE 'iText%' THEN 'iText (Java)' WHEN {c} LIKE 'Small%' THEN 'Smallpdf (Online)'
 WHEN {c} LIKE 'ABBYY%' THEN 'ABBYY FineReader (OCR)' WHEN {c} LIKE 'Adobe InDesign%' THEN 'Adobe InDesign' END"""
TOOL = (f"coalesce({TOOL_CASE.format(c='producer')}, {TOOL_CASE.format(c='creator')}, nullif(producer, ''), "
        "nullif(creator, ''))")


@query("same_tool_pairs", f"""WITH {META}, t AS (SELECT doc_id, comparison_id, {TOOL} AS tool FROM meta)
SELECT comparison_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.tool FROM t a JOIN t b USING (comparison_id)
 WHERE a.doc_id < b.doc_id AND a.tool = b.tool""")
def same_tool_pairs(spark, folder):
    return cmp.equal_value_pairs(known_tool(b.doc_meta(spark, folder)), "tool", "tool")


@query("same_producer_pairs", f"""WITH {META} SELECT comparison_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.producer
 FROM meta a JOIN meta b USING (comparison_id) WHERE a.doc_id < b.doc_id AND a.producer = b.producer AND a.producer <> ''""")
def same_producer_pairs(spark, folder):
    return cmp.equal_value_pairs(b.doc_meta(spark, folder), "producer", "producer")


@query("shared_id_clusters", f"""WITH {META}, {OBJ}, o AS (SELECT DISTINCT doc_id, device AS id FROM obj),
m AS (SELECT comparison_id, doc_id, id FROM meta JOIN o USING (doc_id)),
p AS (SELECT comparison_id, a.doc_id AS doc_a, b.doc_id AS doc_b, id, row_number() OVER (PARTITION BY comparison_id, a.doc_id,
 b.doc_id ORDER BY id) AS rn FROM m a JOIN m b USING (comparison_id, id) WHERE a.doc_id < b.doc_id)
SELECT comparison_id, doc_a, doc_b, count(*) AS n_shared, string_agg(id, ',' ORDER BY id) FILTER (rn <= 5) AS shared
 FROM p GROUP BY ALL""")
def shared_id_clusters(spark, folder):
    ids = b.objects(spark, folder).select("doc_id", F.col("device").alias("id"))
    found = cmp.shared_id_pairs(b.doc_meta(spark, folder), ids)
    return found.withColumn("shared", joined(F.col("shared")))


def _found_sql(name: str, code: str) -> str:
    severity = cmp.PAIR_SEVERITIES[code]
    return f"SELECT comparison_id, doc_a, doc_b, '{code}' AS code, '{severity}' AS severity FROM ({ORACLES[name]})"


PAIR_QUERIES = {"identical_content": "identical_pairs", "created_close": "time_proximity_pairs", "same_producer": "same_producer_pairs",
                "shared_ids": "shared_id_clusters"}


@query("comparison_findings", " UNION ALL ".join(_found_sql(name, code) for code, name in PAIR_QUERIES.items()))
def comparison_findings(spark, folder):
    """What the comparisons of all sets found, one finding a pair and reason."""
    return cmp.pair_findings({code: QUERIES[name](spark, folder) for code, name in PAIR_QUERIES.items()})


EVDOC = f"{EV}, vis AS (SELECT DISTINCT doc_id, CAST(floor(doc_id / 3) AS BIGINT) AS comparison_id FROM ev)"


def actor_sets(spark, folder):
    found = b.findings(spark, folder)
    return found.select("doc_id", F.floor(F.col("doc_id") / 3).alias("comparison_id")).distinct()


@query("common_categories", f"""WITH {EVDOC}, n AS (SELECT comparison_id, count(*) AS n FROM vis GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
c AS (SELECT DISTINCT doc_id, section AS category FROM ev) SELECT comparison_id, category FROM vis JOIN n USING (comparison_id)
 JOIN c USING (doc_id) GROUP BY comparison_id, category, n HAVING count(*) = n""")
def common_categories(spark, folder):
    found = b.findings(spark, folder).select("doc_id", F.col("section").alias("category"))
    return cmp.common_categories(actor_sets(spark, folder), found)


@query("metadata_diff", f"""WITH {META}, l AS (UNPIVOT (SELECT comparison_id, doc_id, CAST(author AS VARCHAR) AS author,
 priority AS keywords, creator FROM meta) ON author, keywords, creator INTO NAME field VALUE v),
f AS (SELECT * FROM l WHERE v <> '')
SELECT comparison_id, field, string_agg(doc_id || '=' || v, '; ' ORDER BY doc_id) AS entries FROM f GROUP BY ALL
 HAVING count(*) > 1 AND count(DISTINCT v) > 1""")
def metadata_diff(spark, folder):
    meta = b.doc_meta(spark, folder).withColumnRenamed("priority", "keywords")
    return cmp.metadata_diff(meta, ["author", "keywords", "creator"])


@query("partial_presence", f"""WITH {META}, s AS (SELECT comparison_id, count(*) AS n_documents,
 count(*) FILTER (has_script) AS n_flagged, count(*) FILTER (revisions > 1) AS n_multi_revision FROM meta GROUP BY 1)
SELECT *, CASE WHEN n_flagged > 0 AND n_flagged < n_documents THEN 'HIGH' END AS flag_severity,
 CASE WHEN n_multi_revision > 0 THEN 'MEDIUM' END AS revision_severity FROM s""")
def partial_presence(spark, folder):
    return cmp.partial_presence(b.doc_meta(spark, folder), "has_script", "revisions")


ATTRIBUTES = ["name", "sha256", "risk_level", "producer", "creator", "created", "modified", "page_count", "image_count", "n_high", "n_medium",
              "has_script", "encrypted", "revisions"]


def _matrix_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT comparison_id, '{a}' AS attribute, " + ", ".join(
            f"max(CAST({a} AS VARCHAR)) FILTER (rn = {i}) AS doc_{i}" for i in range(1, 5)) + " FROM r GROUP BY comparison_id"
        for a in ATTRIBUTES)
    return (f"WITH {FACTS}, r AS (SELECT * REPLACE (strftime(created, '%Y-%m-%d') AS created, strftime(modified, '%Y-%m-%d') AS modified), "
            f"sha256(name) AS sha256, row_number() OVER (PARTITION BY comparison_id ORDER BY doc_id) AS rn FROM doc "
            f"WHERE comparison_id IN ({OK_SETS.format(t='meta')})) " + rows)


@query("matrix_transpose", _matrix_sql())
def matrix_transpose(spark, folder):
    docs = with_object_facts(spark, folder).withColumns({
        "sha256": F.sha2("name", 256), "created": F.date_format("created", "yyyy-MM-dd"), "modified": F.date_format("modified", "yyyy-MM-dd")})
    return cmp.attribute_matrix(docs, ATTRIBUTES)


SUMMARY = f"""WITH {META}, t AS (SELECT doc_id, comparison_id, {TOOL} AS tool, producer, created, priority, creator, author FROM meta),
n AS (SELECT comparison_id, count(*) AS n_documents FROM meta GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
p AS (SELECT comparison_id, count(*) FILTER (a.tool = b.tool) AS same_tool,
 count(*) FILTER (a.producer = b.producer AND a.producer <> '') AS same_producer,
 count(*) FILTER (abs(epoch(a.created) - epoch(b.created)) < 300) AS near_in_time
 FROM t a JOIN t b USING (comparison_id) WHERE a.doc_id < b.doc_id GROUP BY 1)
SELECT n.comparison_id, n_documents, coalesce(same_tool, 0) AS same_tool, coalesce(same_producer, 0) AS same_producer,
 coalesce(near_in_time, 0) AS near_in_time FROM n LEFT JOIN p USING (comparison_id)"""


def _summary(spark, folder):
    """Counts of every kind of match per set, from one gathered row per set."""
    meta = known_tool(b.doc_meta(spark, folder)).withColumn("created_us", F.unix_micros(F.col("created").cast("timestamp")))
    sets = cmp.gathered(meta, ["tool", "producer", "created_us"])
    pairs = sets.withColumn("_pairs", cmp.pairs_of(F.col("docs")))

    def n(test):
        return F.size(F.filter("_pairs", test)).cast("long")

    return pairs.select(
        "comparison_id", F.size("docs").cast("long").alias("n_documents"),
        n(lambda p: p["a"]["tool"] == p["b"]["tool"]).alias("same_tool"),
        n(lambda p: (p["a"]["producer"] == p["b"]["producer"]) & (p["a"]["producer"] != "")).alias("same_producer"),
        n(lambda p: F.abs(p["a"]["created_us"] - p["b"]["created_us"])
          < cmp.TIME_WINDOW_SECONDS * 1_000_000).alias("near_in_time"),
        F.array_join(F.transform("docs", lambda d: d["doc_id"].cast("string")), ",").alias("doc_ids"),
    )


@query("compare_summary", SUMMARY)
def compare_summary(spark, folder):
    return _summary(spark, folder).drop("doc_ids")


@query("materialise_comparison", f"SELECT * FROM ({SUMMARY}) WHERE same_tool > 0")
def materialise_comparison(spark, folder):
    """Comparison results with their document ids, stored and read back."""
    path = stores.new_folder(spark, "comparisons")
    _summary(spark, folder).write.mode("append").parquet(path)
    return stores.read_results(spark, path).filter("same_tool > 0").drop("doc_ids")


@query("intersect_sets", """WITH t AS (SELECT DISTINCT l_partkey AS part, l_returnflag AS f FROM lineitem)
SELECT part FROM t WHERE f = 'A' INTERSECT SELECT part FROM t WHERE f = 'R'""")
def intersect_sets(spark, folder):
    """Ids that occur on both sides."""
    items = b.objects(spark, folder)
    return items.filter("type = 'A'").select("part").intersect(items.filter("type = 'R'").select("part"))


@query("except_sets", """SELECT 'added' AS change, doc_id, part FROM (SELECT l_orderkey AS doc_id, l_partkey AS part FROM lineitem
 WHERE l_linestatus = 'F' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O')
UNION ALL SELECT 'removed', * FROM (SELECT l_orderkey, l_partkey FROM lineitem
 WHERE l_linestatus = 'O' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')""")
def except_sets(spark, folder):
    """Ids on one side only, both directions in one pass: reduce to the sides each id was seen on."""
    seen = b.objects(spark, folder).groupBy("doc_id", "part").agg(
        F.bool_or(F.col("state") == "F").alias("now"), F.bool_or(F.col("state") == "O").alias("before")
    )
    return seen.filter("now <> before").select(F.when(F.col("now"), "added").otherwise("removed").alias("change"),
                                               "doc_id", "part")


@query("page_compare", """WITH p AS (SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS page, turn % 2 AS version, md5(text) AS h,
 length(text) AS n FROM conversations)
SELECT conv_id, count(*) FILTER (a.h = b.h) AS identical_pages, count(*) FILTER (a.h <> b.h) AS different_pages,
 count(*) FILTER (a.n <> b.n) AS size_changes FROM p a JOIN p b USING (conv_id, page) WHERE a.version = 0 AND b.version = 1
 GROUP BY conv_id""")
def page_compare(spark, folder):
    """Two versions of a document compared page by page, up to the shorter one."""
    parts = table(spark, folder, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("page"), (F.col("turn") % 2).alias("version"),
        F.md5("text").alias("hash"), F.length("text").alias("size"))
    pages = parts.groupBy("conv_id", "page").agg(*[
        F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{c}_{v}") for v in (0, 1) for c in ("hash", "size")])
    both = pages.filter("hash_0 IS NOT NULL AND hash_1 IS NOT NULL")
    return both.groupBy("conv_id").agg(
        F.count_if(F.col("hash_0") == F.col("hash_1")).alias("identical_pages"),
        F.count_if(F.col("hash_0") != F.col("hash_1")).alias("different_pages"),
        F.count_if(F.col("size_0") != F.col("size_1")).alias("size_changes"))


@query("integrity_recheck", """SELECT doc_id, sha256(text) AS original_hash,
 sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' ' ELSE text END) AS current_hash, doc_id % 10 <> 0 AS intact FROM documents""")
def integrity_recheck(spark, folder):
    """Digest before and after the analysis."""
    docs = table(spark, folder, "documents")
    before = docs.select("doc_id", F.sha2("text", 256).alias("original_hash"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    after = docs.select("doc_id", F.sha2(changed, 256).alias("current_hash"))
    return before.join(after, "doc_id").withColumn(
        "intact", F.col("original_hash").eqNullSafe(F.col("current_hash")))
