"""Fingerprints and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.operators import set_similarity
from vestigia.operators import similarity as sm
from vestigia.operators.structure import type_distribution
from vestigia.plans import bindings as b
from vestigia.plans.bindings import META, OBJ
from vestigia.plans.registry import query
from vestigia.sources.tables import table


def dimensions(spark, folder):
    """Five feature groups per document, hashed from canonical JSON."""
    items = b.objects(spark, folder)
    facts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("device").alias("devices"))
    docs = b.doc_meta(spark, folder).join(facts, "doc_id", "left").join(type_distribution(items), "doc_id", "left")
    blank = F.lit("")
    return docs.select(
        "doc_id", "comparison_id",
        sm.canonical_hash(page_count=F.coalesce("pages", F.lit(0)), types=F.coalesce("types", blank), has_script=F.col("has_script")).alias("structural"),
        sm.canonical_hash(font_count=F.coalesce("devices", F.lit(0)) % 2).alias("font"),
        sm.canonical_hash(producer=F.coalesce("producer", blank), creator=F.coalesce("creator", blank)).alias("metadata"),
        sm.canonical_hash(size=F.col("author") % 3).alias("style"),
        F.when(F.col("doc_id") % 9 > 0, sm.canonical_hash(images=F.col("n_medium") % 2)).alias("content"))


DIMS = f"""{META}, {OBJ}, fc AS (SELECT doc_id, count(*) AS pages, count(DISTINCT device) AS devices FROM obj GROUP BY 1),
ty AS (SELECT doc_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS types FROM (SELECT doc_id, type, count(*) AS n FROM obj GROUP BY ALL) GROUP BY 1),
dm AS (SELECT doc_id, comparison_id, md5('{{"has_script":' || has_script || ',"page_count":' || coalesce(pages, 0) || ',"types":"' || coalesce(types, '') || '"}}') AS structural,
 md5('{{"font_count":' || coalesce(devices, 0) % 2 || '}}') AS font, md5('{{"creator":"' || coalesce(creator, '') || '","producer":"' || coalesce(producer, '') || '"}}') AS metadata,
 md5('{{"size":' || author % 3 || '}}') AS style, CASE WHEN doc_id % 9 > 0 THEN md5('{{"images":' || n_medium % 2 || '}}') END AS content
 FROM meta LEFT JOIN fc USING (doc_id) LEFT JOIN ty USING (doc_id))"""


@query("dimension_hashes", f"WITH {DIMS} SELECT * EXCLUDE (comparison_id) FROM dm")
def dimension_hashes(spark, folder):
    return dimensions(spark, folder).drop("comparison_id")


def _same(t: str, f: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN a.{d} {t} b.{d} THEN '{d}' END" for d in sm.DIMENSION_WEIGHTS) + f") AS {f}"


SCORE = " + ".join(f"CASE WHEN a.{d} = b.{d} THEN {w} ELSE 0 END" for d, w in sm.DIMENSION_WEIGHTS.items())


@query("fingerprint_similarity", f"""WITH {DIMS} SELECT comparison_id, a.doc_id AS doc_a, b.doc_id AS doc_b, round(CAST({SCORE} AS DOUBLE), 4) AS similarity,
 {_same('=', 'identical')}, {_same('<>', 'different')} FROM dm a JOIN dm b USING (comparison_id) WHERE a.doc_id < b.doc_id""")
def fingerprint_similarity(spark, folder):
    return sm.fingerprint_similarity(dimensions(spark, folder))


SH = r"""tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '') AS t FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [] END AS s FROM tk)"""


@query("near_duplicates", f"""WITH {SH}, m AS (SELECT doc_id, CAST(floor(doc_id / 4) AS BIGINT) AS comparison_id, s FROM sh),
v AS (SELECT comparison_id FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4)
SELECT comparison_id, a.doc_id AS doc_a, b.doc_id AS doc_b, round(len(list_intersect(a.s, b.s)) / greatest(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)), 1), 6) AS resemblance
 FROM m a JOIN m b USING (comparison_id) JOIN v USING (comparison_id) WHERE a.doc_id < b.doc_id""")
def near_duplicates(spark, folder):
    """Exact resemblance of the documents of each comparison set."""
    members = table(spark, folder, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("comparison_id"), "text")
    return sm.exact_resemblance(members, "text")


WORDS = r"[^\x20\x09-\x0D]+"
SETS = rf"""tw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS t FROM documents),
ss AS (SELECT doc_id, CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))
 WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM tw)"""


@query("near_duplicate_groups", f"""WITH RECURSIVE {SETS}, n AS (SELECT doc_id, len(s) AS n FROM ss), x AS (SELECT doc_id, hash(e) AS e FROM (SELECT doc_id, unnest(s) AS e FROM ss)),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM x a JOIN x b USING (e) GROUP BY ALL),
j AS (SELECT x, y, c / (p.n + q.n - c) AS share, 100 * c >= 80 * (p.n + q.n - c) AS linked FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y),
l AS (SELECT x, y FROM j WHERE linked), rc AS (SELECT x, y FROM l UNION SELECT rc.x, l.y FROM rc JOIN l ON l.x = rc.y),
g AS (SELECT x AS doc_id, min(y) AS group_id FROM rc GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, group_id, round(coalesce(share, 0), 6) AS resemblance FROM g LEFT JOIN j ON j.x = doc_id AND j.y = group_id""")
def near_duplicate_groups(spark, folder):
    """Groups over the whole corpus of documents that share at least 80 percent of their five-word shingles."""
    return set_similarity.near_duplicate_groups(table(spark, folder, "documents"))


BITS = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))


@query("fuzzy_signature", f"""WITH {SH}, x AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(s) AS g FROM sh)),
c AS (SELECT doc_id, count(*) AS n, {BITS} AS v FROM x GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n >= {sm.MIN_SHINGLES} THEN lower(lpad(to_hex(v), 16, '0')) END AS signature FROM sh LEFT JOIN c USING (doc_id)""")
def fuzzy_signature(spark, folder):
    """Fixed-length similarity digest per document."""
    return sm.sign_digest(table(spark, folder, "documents"), "doc_id", "text")


@query("dot_clusters", """WITH p AS (SELECT label AS doc_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)
SELECT doc_id, CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, count(*) AS n, round(avg(x), 4) AS center_x, round(avg(y), 4) AS center_y FROM p GROUP BY ALL HAVING count(*) >= 3""")
def dot_clusters(spark, folder):
    points = table(spark, folder, "embeddings").select(
        F.col("label").alias("doc_id"), (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"))
    found = sm.grid_clusters(points, ["doc_id"], "x", "y")
    return found.withColumns({c: F.round(c, 4) for c in ("center_x", "center_y")})
