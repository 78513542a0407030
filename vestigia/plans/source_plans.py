"""Reading, classifying, storing and updating evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.plans import bindings as b
from vestigia.plans.bindings import EV, META
from vestigia.plans.registry import query
from vestigia.sources import formats, stores
from vestigia.sources.tables import table


@query("scan_evidence", "SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS name, strlen(text) AS size_bytes, "
       "source, lang FROM documents")
def scan_evidence(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"),
        F.octet_length("text").cast("long").alias("size_bytes"), "source", "lang",
    )


# Pages get a leading-bytes column and a file name from their key; every third keeps its own text and URL.
HEAD = b.pick(["25504446", "504B0304", "D0CF11E0A1B11AE1", "FFD8FF", "89504E470D0A1A0A", "474946383961", "424D",
               "49492A00", "52494646", ""], "(page_id % 30)")
NAME = ("CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[?#].*$', '') ELSE 'file' || CAST(page_id AS STRING) || '.' || "
        + b.pick(b.EXTENSIONS, f"(page_id % {len(b.EXTENSIONS)})") + " END")


def _formats_sql() -> str:
    ooxml = b.values_table(list(formats.OOXML_EXTENSIONS.items()), "e, f", "ooxml")
    ole = b.values_table(list(formats.OLE_EXTENSIONS.items()), "e, f", "ole")
    magic = b.values_table([(m, f, i) for i, (m, f) in enumerate(formats.MAGIC)], "m, f, i", "magic")
    listed = ", ".join(b.sql_text(e) for e in formats.SUPPORTED_EXTENSIONS)
    return f"""WITH {ooxml}, {ole}, {magic},
p AS (SELECT page_id, {NAME} AS name, coalesce({HEAD}, '') || hex(substr(html, 1, 16)) AS head FROM pages),
x AS (SELECT *, regexp_extract(lower(name), '[^/](\\.[^./]+)$', 1) AS ext FROM p),
m AS (SELECT x.*, (SELECT min_by(f, i) FROM magic WHERE starts_with(head, m)) AS mt,
  (SELECT f FROM ooxml WHERE e = ext) AS fo, (SELECT f FROM ole WHERE e = ext) AS fl FROM x),
r AS (SELECT page_id, name, ext, head, CASE WHEN mt = 'OOXML' THEN coalesce(fo, 'OOXML') WHEN mt = 'OLE'
  THEN coalesce(fl, 'OLE') WHEN mt IS NOT NULL THEN mt ELSE coalesce(fo, fl, nullif(upper(substr(ext, 2)), ''), 'UNKNOWN')
  END AS format FROM m),
t AS (SELECT page_id, name, format, CASE WHEN ext NOT IN ({listed}) THEN 'rejected'
  WHEN format = 'PDF' AND NOT starts_with(head, '25504446') THEN 'rejected' WHEN format = 'PDF' THEN 'pdf'
  WHEN format IN ('DOCX','XLSX','PPTX','DOC','XLS','PPT','ODT','ODS','ODP','OOXML','OLE') THEN 'office'
  WHEN format IN ('JPEG','PNG','GIF','BMP','TIFF','WEBP') THEN 'image' ELSE 'rejected' END AS route FROM r)"""


def _classified(spark, folder):
    pages = b.derived(spark, folder, "pages", f"page_id, {NAME} AS name, coalesce({HEAD}, '') AS head, html")
    content = F.concat(F.unhex("head"), F.encode("html", "UTF-8"))
    return pages.select("page_id", "name", content.alias("content")).withColumn(
        "format", formats.detect_format(F.col("content"), F.col("name"))
    )


@query("classify_format", _formats_sql() + " SELECT page_id, name, format FROM t")
def classify_format(spark, folder):
    return _classified(spark, folder).select("page_id", "name", "format")


@query("route_by_format", _formats_sql() + " SELECT route, format, count(*) AS n FROM t GROUP BY ALL")
def route_by_format(spark, folder):
    routed = _classified(spark, folder).withColumn(
        "route", formats.route(F.col("format"), F.col("content"), F.col("name"))
    )
    return routed.groupBy("route", "format").agg(F.count(F.lit(1)).alias("n"))


@query("size_gate", f"SELECT doc_id, size_bytes, CASE WHEN size_bytes > {formats.MAX_SIZE_BYTES} THEN 'too large: ' || size_bytes || "
       f"' > {formats.MAX_SIZE_BYTES} bytes' END AS error FROM (SELECT doc_id, strlen(text) AS size_bytes FROM documents)")
def size_gate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"))
    accepted, rejected = formats.size_gate(docs, "size_bytes")
    return stores.evolve(rejected, accepted)


@query("batch_status", f"""SELECT source, count(*) AS total, count(*) FILTER (strlen(text) <= {formats.MAX_SIZE_BYTES}) AS ok,
 count(*) FILTER (strlen(text) > {formats.MAX_SIZE_BYTES}) AS errors FROM documents GROUP BY source""")
def batch_status(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.octet_length("text").alias("size_bytes"))
    error = F.when(F.col("size_bytes") > formats.MAX_SIZE_BYTES, F.format_string("too large: %d", "size_bytes"))
    return stores.batch_totals(stores.batch_status(docs, "source", error), "source")


@query("batch_items", f"""SELECT source, doc_id, CASE WHEN strlen(text) > {formats.MAX_SIZE_BYTES} THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN strlen(text) > {formats.MAX_SIZE_BYTES} THEN 'too large: ' || strlen(text) END AS error FROM documents""")
def batch_items(spark, folder):
    """One status row for each item of a batch, with its error text."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.octet_length("text").alias("size_bytes"))
    error = F.when(F.col("size_bytes") > formats.MAX_SIZE_BYTES, F.format_string("too large: %d", "size_bytes"))
    return stores.batch_status(docs, "source", error).select("source", "doc_id", "status", "error")


@query("append_results", f"WITH {META} SELECT risk_level, count(*) AS n, CAST(sum(n_high) AS BIGINT) AS high FROM meta "
       "GROUP BY risk_level")
def append_results(spark, folder):
    """Write in two appends, read back, count per partition."""
    path = stores.new_folder(spark, "analyses")
    meta = b.doc_meta(spark, folder).select("doc_id", "name", "risk_level", "n_high")
    stores.append_results(meta.filter("risk_level = 'HIGH'"), path)
    stores.append_results(meta.filter("risk_level <> 'HIGH'"), path)
    return stores.read_results(spark, path).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_high").alias("high")
    )


@query("get_by_key", "SELECT user_id AS doc_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n "
       "FROM events WHERE user_id = 17 GROUP BY ALL")
def get_by_key(spark, folder):
    """Rows of one document with their JSON body as a typed record. The key filter reaches the scan."""
    rows = table(spark, folder, "events").filter(F.col("user_id") == 17)
    record = stores.from_json_record(rows, "props", "k INT")
    return record.groupBy(F.col("user_id").alias("doc_id"), F.col("record.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("summary_projection", f"WITH {META} SELECT doc_id, name, risk_level, n_high, n_medium, n_low FROM meta")
def summary_projection(spark, folder):
    return b.doc_meta(spark, folder).select("doc_id", "name", "risk_level", "n_high", "n_medium", "n_low")


@query("upsert_column", f"""WITH {META} SELECT doc_id, CASE WHEN l_orderkey IS NOT NULL THEN 'report-' || doc_id
 ELSE status END AS status FROM meta LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') u
 ON l_orderkey = doc_id""")
def upsert_column(spark, folder):
    meta = b.doc_meta(spark, folder).select("doc_id", "status")
    hit = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    updates = hit.distinct().withColumn("status", F.concat(F.lit("report-"), F.col("doc_id").cast("string")))
    return stores.upsert_column(meta, updates, "doc_id", "status")


@query("delete_by_key", f"""WITH {META} SELECT CAST((SELECT count(*) FROM meta WHERE doc_id IN
 (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS BIGINT) AS deleted, count(*) AS docs_left,
 (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
 AS children_left FROM meta WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def delete_by_key(spark, folder):
    """Remove documents and their objects; report how many were found."""
    meta = b.doc_meta(spark, folder).select("doc_id")
    items = b.objects(spark, folder)
    gone = items.filter("type = 'R'").select("doc_id").distinct()
    one = F.count(F.lit(1))
    docs = stores.delete_keys(meta, gone, "doc_id").agg(one.alias("docs_left"))
    children = stores.delete_keys(items.select("doc_id"), gone, "doc_id").agg(one.alias("children_left"))
    # Three single-row summaries side by side.
    parts = [stores.deleted_count(meta, gone, "doc_id"), docs, children]
    columns = ["deleted", "docs_left", "children_left"]
    stacked = None
    for part, name in zip(parts, columns):
        row = part.select(*[F.col(c) if c == name else F.lit(None).cast("long").alias(c) for c in columns])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


@query("reuse_cached", """SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS quality,
 l.doc_id IS NOT NULL AS from_cache FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def reuse_cached(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    cached = table(spark, folder, "labels").select("doc_id", "quality")
    return stores.reuse_cached(docs, cached, "doc_id", {"quality": F.when(F.col("n_chars") > 500, 1).otherwise(0)})


@query("evolve_schema", "SELECT CASE WHEN lang IN ('de', 'fr') THEN lang END AS lang, count(*) AS n FROM documents "
       "GROUP BY 1")
def evolve_schema(spark, folder):
    """Older part files without `lang`, newer ones with it, read as one table."""
    path = stores.new_folder(spark, "evolved")
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    late = F.col("lang").isin("de", "fr")
    docs.filter(F.coalesce(~late, F.lit(True))).drop("lang").write.mode("append").parquet(path)
    docs.filter(late).write.mode("append").parquet(path)
    return stores.read_results(spark, path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("export_json", f"WITH {EV} SELECT finding_id, json_extract_string(j, '$.severity') AS severity, "
       "CAST(json_extract(j, '$.doc_id') AS BIGINT) AS doc_id FROM (SELECT finding_id, to_json(ev) AS j FROM ev)")
def export_json(spark, folder):
    """Whole record as a JSON document, written and read back."""
    path = stores.new_folder(spark, "export")
    found = b.findings(spark, folder).select("finding_id", "doc_id", "category", "severity", "message")
    stores.as_json(found, "finding_id").write.mode("append").parquet(path)
    back = stores.from_json_record(spark.read.parquet(path), "document", "severity STRING, doc_id BIGINT")
    return back.select("finding_id", "record.severity", "record.doc_id")
