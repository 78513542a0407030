"""Objects, layers, ranges and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.operators import structure as st
from vestigia.plans import bindings as b
from vestigia.plans.bindings import OBJ
from vestigia.plans.registry import query
from vestigia.sources.tables import table


@query("orphan_objects", f"""WITH {OBJ} SELECT doc_id, obj_no, count(*) AS n FROM obj WHERE doc_id NOT IN
 (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL""")
def orphan_objects(spark, folder):
    """Objects whose document is missing from the active index."""
    index = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"))
    orphans = st.orphan_objects(b.objects(spark, folder).select("doc_id", "obj_no"), index, ["doc_id"])
    return orphans.groupBy("doc_id", "obj_no").agg(F.count(F.lit(1)).alias("n"))


REFS = "l_suppkey AS doc_id, l_partkey AS obj_no, l_returnflag AS flag, l_linestatus AS state"


@query("unindexed_refs", f"""WITH r AS (SELECT {REFS} FROM lineitem), l AS (SELECT DISTINCT doc_id, obj_no FROM r WHERE flag = 'A'
 OR (flag = 'N' AND state = 'F')), m AS (SELECT DISTINCT doc_id, obj_no FROM r WHERE obj_no <> 0 AND (doc_id, obj_no) NOT IN
 (SELECT (doc_id, obj_no) FROM l))
SELECT doc_id, count(*) AS n_unindexed, CASE WHEN count(*) > 5 THEN 'MEDIUM' END AS severity FROM m GROUP BY doc_id""")
def unindexed_refs(spark, folder):
    refs = b.derived(spark, folder, "lineitem", REFS)
    return st.unindexed_refs(refs, refs.filter("flag = 'A'"), refs.filter("flag = 'N' AND state = 'F'"))


OFFS = ("l_orderkey AS doc_id, l_linenumber AS obj_no, CAST(l_quantity AS BIGINT) * 100 + l_linenumber % 2 AS offset, "
        "l_returnflag AS flag")
ENTRY = "CASE WHEN l_partkey % 9 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN CAST(l_quantity AS BIGINT) * 100 + 7 ELSE CAST(l_quantity AS BIGINT) * 100 END"


@query("offset_consistency", f"""WITH s AS (SELECT DISTINCT doc_id, "offset" AS off FROM (SELECT {OFFS.replace('AS offset', 'AS "offset"')} FROM lineitem)),
e AS (SELECT l_orderkey AS doc_id, l_linenumber AS obj_no, {ENTRY} AS off FROM lineitem),
z AS (SELECT o_orderkey AS doc_id, 3000 + o_custkey % 2000 AS file_size FROM orders)
SELECT doc_id, obj_no, e.off AS "offset", CASE WHEN e.off > file_size THEN 'beyond_end' ELSE 'no_object_start' END AS error
 FROM e JOIN z USING (doc_id) LEFT JOIN s USING (doc_id, off) WHERE e.off > file_size OR (e.off > 0 AND s.doc_id IS NULL)""")
def offset_consistency(spark, folder):
    starts = b.derived(spark, folder, "lineitem", OFFS)
    entries = b.derived(spark, folder, "lineitem", f"l_orderkey AS doc_id, l_linenumber AS obj_no, {ENTRY} AS offset")
    sizes = b.derived(spark, folder, "orders", "o_orderkey AS doc_id, 3000 + o_custkey % 2000 AS file_size")
    return st.offset_consistency(entries, starts, sizes).select("doc_id", "obj_no", "offset", "error")


def revision_index(spark, folder):
    """Turns as revisions, their distinct words as objects; a word said twice in a turn was rewritten."""
    words = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("revision"),
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("obj_no"))
    return words.groupBy("doc_id", "revision", "obj_no").agg((F.count(F.lit(1)) > 1).alias("rewritten"))


REV = """ix AS (SELECT conv_id AS doc_id, turn + 1 AS revision, w AS obj_no, count(*) > 1 AS rewritten FROM (SELECT conv_id, turn,
 unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) GROUP BY ALL),
lim AS (SELECT doc_id, min(revision) AS f, max(revision) AS l FROM ix GROUP BY 1),
ch AS (SELECT doc_id, c.revision AS revision, obj_no, CASE WHEN p.doc_id IS NULL THEN 'added' ELSE 'modified' END AS change FROM ix c JOIN lim USING (doc_id)
  LEFT JOIN (SELECT doc_id, revision + 1 AS revision, obj_no FROM ix) p USING (doc_id, revision, obj_no)
  WHERE c.revision > f AND (p.doc_id IS NULL OR c.rewritten)
 UNION ALL SELECT doc_id, p.revision + 1, obj_no, 'removed' FROM ix p JOIN lim USING (doc_id) WHERE p.revision < l AND NOT EXISTS
  (SELECT 1 FROM ix c WHERE c.doc_id = p.doc_id AND c.obj_no = p.obj_no AND c.revision = p.revision + 1))"""


def _diff_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (change = '{k}') AS n_{k}, string_agg(obj_no, ',' ORDER BY obj_no) FILTER "
                     f"(change = '{k}' AND rn <= 20) AS {k}_objects" for k in ("added", "modified", "removed"))
    parts = ", ".join(f"CASE WHEN n_{k} > 0 THEN n_{k} || ' {k}' END" for k in ("added", "modified", "removed"))
    return f"""WITH {REV}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, revision, change ORDER BY obj_no) AS rn FROM ch),
g AS (SELECT doc_id, revision, {cols} FROM r GROUP BY ALL)
SELECT *, concat_ws(', ', {parts}) AS summary, CASE WHEN n_added + n_modified > 20 THEN 'MEDIUM' END AS severity FROM g"""


@query("revision_diff", _diff_sql())
def revision_diff(spark, folder):
    return st.revision_diff(revision_index(spark, folder))


@query("revision_findings", f"""WITH {REV} SELECT doc_id, revision, obj_no, 'HIGH' AS severity FROM ch WHERE change = 'modified'
 AND obj_no IN ('the', 'que', 'der') UNION ALL SELECT doc_id, NULL, NULL, 'MEDIUM' FROM ix GROUP BY doc_id
 HAVING count(DISTINCT revision) > 5""")
def revision_findings(spark, folder):
    """Three frequent words stand for the catalogue, info and metadata objects."""
    types = F.when(F.col("obj_no") == "the", "Catalog").when(F.col("obj_no") == "que", "Info").when(
        F.col("obj_no") == "der", "Metadata")
    return st.revision_findings(revision_index(spark, folder), types)


LAYER = ("l_orderkey AS doc_id, 'L' || CAST(l_partkey % 15 AS STRING) AS layer, l_suppkey % 10 AS page, "
         "l_returnflag AS flag, l_linestatus AS state")
LAYERS = f"""y AS (SELECT {LAYER} FROM lineitem), ls AS (SELECT doc_id, layer, coalesce(bool_or(flag = 'R' AND state = 'O'), false) AS locked,
 coalesce(bool_or(flag = 'A' AND state = 'F'), false) AS hidden, count(DISTINCT page) AS n_pages, min(page) AS first_page, max(page) AS last_page
 FROM y GROUP BY ALL)"""


def _layers(spark, folder):
    y = b.derived(spark, folder, "lineitem", LAYER)
    return st.layer_state(y, y.filter("flag = 'R' AND state = 'O'"), y.filter("flag = 'A' AND state = 'F'"), y)


@query("layer_state", f"WITH {LAYERS} SELECT * FROM ls")
def layer_state(spark, folder):
    return _layers(spark, folder)


@query("layer_findings", f"""WITH {LAYERS} SELECT doc_id, count(*) AS n_layers, count(*) FILTER (hidden) AS n_hidden,
 CASE WHEN count(*) FILTER (hidden) > 0 THEN 'HIGH' END AS hidden_severity, CASE WHEN count(*) > 10 THEN 'MEDIUM' END AS many_severity
 FROM ls GROUP BY 1""")
def layer_findings(spark, folder):
    return st.layer_findings(_layers(spark, folder))


RANGE = ("o_orderkey AS doc_id, CAST(o_custkey % 2 AS BIGINT) AS o1, 100 AS l1, CAST(500 AS BIGINT) AS o2, "
         "CAST(400 + o_orderkey % 300 AS BIGINT) AS l2, CAST(900 + o_orderkey % 300 + o_custkey % 12 + "
         "CASE WHEN o_custkey % 5 = 0 THEN 200 ELSE 0 END AS BIGINT) AS file_size")
COVER = f"""rg AS (SELECT {RANGE} FROM orders), cv AS (SELECT doc_id, file_size, o1 AS prefix_bytes, o2 + l2 AS range_end,
 file_size - o2 - l2 AS suffix_bytes FROM rg)"""


@query("interval_coverage", f"""WITH {COVER} SELECT doc_id, prefix_bytes, suffix_bytes, prefix_bytes = 0 AND suffix_bytes <= 5 AS covers_full,
 CASE WHEN NOT (prefix_bytes = 0 AND suffix_bytes <= 5) THEN 'HIGH' END AS severity FROM cv""")
def interval_coverage(spark, folder):
    return st.interval_coverage(b.derived(spark, folder, "orders", RANGE)).select(
        "doc_id", "prefix_bytes", "suffix_bytes", "covers_full", "severity")


PLACED = "l_orderkey AS doc_id, CAST(700 + l_quantity * 12 AS BIGINT) AS offset, l_returnflag = 'R' AS is_index"


@query("objects_after_range", f"""WITH {COVER}, pl AS (SELECT {PLACED.replace('AS offset', 'AS off')} FROM lineitem),
j AS (SELECT cv.doc_id, file_size, range_end, range_end < file_size - 10 AS is_open, coalesce(bool_or(off >= range_end AND NOT is_index), false) AS o,
 coalesce(bool_or(off >= range_end AND is_index), false) AS x FROM cv LEFT JOIN pl USING (doc_id) GROUP BY ALL),
k AS (SELECT doc_id, is_open AND o AS has_object_after, is_open AND x AS has_index_after,
 CASE WHEN is_open THEN file_size - range_end ELSE 0 END AS bytes_after FROM j)
SELECT *, CASE WHEN has_object_after OR has_index_after THEN 'HIGH' WHEN bytes_after > 100 THEN 'MEDIUM' END AS severity FROM k""")
def objects_after_range(spark, folder):
    ranges = st.interval_coverage(b.derived(spark, folder, "orders", RANGE)).select("doc_id", "range_end", "file_size")
    placed = b.derived(spark, folder, "lineitem", PLACED)
    return st.objects_after_range(ranges, placed).drop("range_end", "file_size")


@query("range_definitions", """SELECT l_orderkey AS doc_id, count(*) AS n_ranges, CASE WHEN count(*) > 2 THEN 'HIGH' END AS severity
 FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1""")
def range_definitions(spark, folder):
    return st.range_definitions(b.objects(spark, folder).filter("type = 'N'").select("doc_id"))


@query("duplicate_numbers", f"WITH {OBJ} SELECT doc_id, obj_no, count(*) AS occurrences FROM obj GROUP BY ALL HAVING count(*) > 1")
def duplicate_numbers(spark, folder):
    return st.duplicate_numbers(b.objects(spark, folder))


@query("duplicate_offsets", f"""WITH e AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS obj_no, {ENTRY} AS off FROM lineitem),
g AS (SELECT doc_id, off, count(*) AS n_objects FROM e WHERE off <> 0 GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, off AS "offset", obj_no, n_objects FROM e JOIN g USING (doc_id, off)""")
def duplicate_offsets(spark, folder):
    entries = b.derived(spark, folder, "lineitem", f"l_orderkey AS doc_id, l_linenumber AS obj_no, {ENTRY} AS offset")
    return st.duplicate_offsets(entries)


@query("required_member", """WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS obj_no FROM lineitem WHERE l_returnflag = 'N')
SELECT doc_id, count(DISTINCT obj_no) AS chain_length, bool_or(obj_no = 0) AS has_zero,
 CASE WHEN NOT bool_or(obj_no = 0) THEN 'MEDIUM' END AS severity FROM f GROUP BY 1""")
def required_member(spark, folder):
    free = b.derived(spark, folder, "lineitem", "l_orderkey AS doc_id, l_linenumber - 1 AS obj_no, l_returnflag AS flag")
    return st.required_member(free.filter("flag = 'N'"))


@query("type_distribution", f"""WITH {OBJ}, c AS (SELECT doc_id, type, count(*) AS n FROM obj GROUP BY ALL)
SELECT doc_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS types FROM c GROUP BY 1""")
def type_distribution(spark, folder):
    return st.type_distribution(b.objects(spark, folder))


PAGE = ("l_orderkey AS doc_id, CASE l_partkey % 4 WHEN 0 THEN 841.89 WHEN 1 THEN 600.25 ELSE 595.28 END AS width, "
        "CASE l_partkey % 4 WHEN 0 THEN 595.28 WHEN 1 THEN 600.25 ELSE 841.89 + (l_suppkey % 3) * 2.5 END AS height")


@query("size_profile", f"""WITH p AS (SELECT {PAGE} FROM lineitem), s AS (SELECT DISTINCT doc_id, CASE WHEN width < 598 THEN '595.3' WHEN width < 700
 THEN '600.3' ELSE '841.9' END || 'x' || CASE WHEN height < 598 THEN '595.3' WHEN height < 700 THEN '600.3' WHEN height < 843 THEN '841.9'
 WHEN height < 845 THEN '844.4' ELSE '846.9' END AS s FROM p)
SELECT doc_id, string_agg(s, ', ' ORDER BY s) AS sizes, count(*) AS n_sizes, count(*) > 1 AS mixed, CASE WHEN count(*) > 1 THEN 'LOW' END AS severity FROM s GROUP BY 1""")
def size_profile(spark, folder):
    return st.size_profile(b.derived(spark, folder, "lineitem", PAGE))


@query("is_a4", f"""WITH p AS (SELECT CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h FROM (SELECT {PAGE} FROM lineitem)),
c AS (SELECT (abs(w - 595.28) < 5 AND abs(h - 841.89) < 5) OR (abs(w - 841.89) < 5 AND abs(h - 595.28) < 5) AS is_a4,
 CASE WHEN w < h THEN 'portrait' WHEN w > h THEN 'landscape' ELSE 'square' END AS orientation FROM p)
SELECT is_a4, orientation, count(*) AS n FROM c GROUP BY ALL""")
def is_a4(spark, folder):
    """A4 test and orientation of every page."""
    pages = b.derived(spark, folder, "lineitem", PAGE).select(F.col("width").cast("double"), F.col("height").cast("double"))
    w, h = F.col("width"), F.col("height")
    return pages.groupBy(st.is_a4(w, h).alias("is_a4"), st.orientation(w, h).alias("orientation")).agg(
        F.count(F.lit(1)).alias("n"))


COUNTS = ("o_orderkey AS doc_id, CAST(o_orderkey % 5 AS BIGINT) AS pages, CAST(o_custkey % 3 AS BIGINT) AS fonts, "
          "CAST(o_custkey % 2 AS BIGINT) AS images, CAST(o_orderkey % 2 AS BIGINT) AS streams, "
          "CAST(o_custkey % 7 AS BIGINT) AS scripts, CAST(o_orderkey % 3 AS BIGINT) AS embedded")


@query("structure_counts", f"""WITH c AS (SELECT {COUNTS} FROM orders), f AS (SELECT * REPLACE (CASE WHEN pages + fonts + images + streams = 0
 THEN 1 ELSE pages END AS pages) FROM c)
SELECT doc_id, part, n FROM (UNPIVOT f ON pages, fonts, images, streams, scripts, embedded INTO NAME part VALUE n) WHERE n > 0""")
def structure_counts(spark, folder):
    return st.structure_counts(b.derived(spark, folder, "orders", COUNTS),
                               ["pages", "fonts", "images", "streams", "scripts", "embedded"])


@query("stream_totals", f"""WITH {OBJ} SELECT doc_id, count(*) AS n_containers, CAST(sum(size) AS BIGINT) AS n_contained FROM obj
 WHERE type = 'A' GROUP BY 1""")
def stream_totals(spark, folder):
    containers = b.objects(spark, folder).filter("type = 'A'").select("doc_id", F.col("size").cast("long").alias("n_objects"))
    return st.stream_totals(containers)
