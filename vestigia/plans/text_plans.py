"""Text extraction, rule scans and token checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.functions import text as tx
from vestigia.operators import scans as sc
from vestigia.operators import tokens as tk
from vestigia.operators.common import emit, rule
from vestigia.plans import bindings as b
from vestigia.plans.bindings import sql_text
from vestigia.plans.registry import query
from vestigia.sources import stores
from vestigia.sources.tables import bytes_as_text, table

# Pages and documents get instruction snippets from their key, so that every rule has hits.
SNIPPETS = [
    "/JavaScript (eval(unescape('%41%42'))) /OpenAction /Launch ", "/Author (A) /Title (B) stream BT (x) Tj ", "/EmbeddedFile /URI (http://a.tk/x) t.co/1 ",
    "/FlateDecode/FlateDecode /Crypt cmd.exe ", "getAnnots( String.fromCharCode(1) \\\\x41\\\\x42 ", "MZ @ECHO OFF CVE-2010-1234 system( ",
    "/SubmitForm /URI /GoToR x ", "/Font /XObject /Metadata ", "q q q q q q q q q q q Q ", "/ImportData /Action /Launch app.launchURL ", "", "plain ",
]
SNIPPET = b.pick(SNIPPETS, f"({{k}} % {len(SNIPPETS)})")
PAGE_TEXT = f"page_id, {SNIPPET.format(k='page_id')} || html AS text"
# The SQL side reads backslashes as they are, Spark SQL text literals unescape them.
PG = "pg AS (SELECT " + PAGE_TEXT.replace("\\\\", "\\") + " FROM pages)"


def pages(spark, folder):
    return b.derived(spark, folder, "pages", PAGE_TEXT)


def re_lit(p: str) -> str:
    return sql_text(p)


def n_lit(col: str, part: str) -> str:
    return f"CAST((length({col}) - length(replace({col}, {sql_text(part)}, ''))) / {len(part)} AS BIGINT)"


def _rules_sql() -> str:
    parts = []
    for i, r in enumerate(sc.BUILTIN_RULES):
        hits = {}
        for s in r.strings:
            if s.regex:
                hits[s.name] = f"CAST(len(regexp_extract_all(text, {re_lit(s.pattern)})) AS BIGINT)"
            else:
                lit = "".join(c for c in s.pattern)
                hits[s.name] = n_lit("lower(text)", lit.lower()) if s.nocase else n_lit("text", lit)
        cols = ", ".join(f"{h} AS {n}_" for n, h in hits.items())
        total = " + ".join(f"{n}_" for n in hits)
        flags = " + ".join(f"CAST({n}_ > 0 AS INT)" for n in hits)
        cond = {"any": f"{flags} >= 1", "2 of them": f"{flags} >= 2"}.get(r.condition)
        if cond is None:
            cond = " ".join(f"({w}_ > 0)" if w in hits else w for w in r.condition.replace("(", "( ").replace(")", " )").split())
        matched = "concat_ws(',', " + ", ".join(f"CASE WHEN {n}_ > 0 THEN '{n}' END" for n in hits) + ")"
        severity = "HIGH" if r.severity in ("CRITICAL", "HIGH") else "MEDIUM"
        parts.append(f"SELECT page_id, '{r.name}' AS rule, '{severity}' AS severity, '{r.category}' AS category, CAST({total} AS BIGINT) "
                     f"AS string_count, {matched} AS matched, CAST({flags} AS BIGINT) AS n_matched FROM (SELECT page_id, {cols} FROM pg) WHERE {cond}")
    return f"WITH {PG} " + " UNION ALL ".join(parts)


@query("signature_rules", _rules_sql())
def signature_rules(spark, folder):
    return sc.scan_rules(pages(spark, folder), "page_id", "text")


@query("binary_rules", """SELECT page_id, 'PDF_Shellcode_Patterns' AS rule, 'HIGH' AS severity, 1 AS string_count,
 CASE page_id % 5 WHEN 0 THEN 'nopsled' WHEN 1 THEN 'heap_spray' WHEN 2 THEN 'int80' ELSE 'syscall' END AS matched FROM pages WHERE page_id % 5 < 4""")
def binary_rules(spark, folder):
    """Rules of byte values over binary content: pages as bytes, most of them followed by shellcode."""
    tail = F.expr("CASE page_id % 5 WHEN 0 THEN X'9090909090909090' WHEN 1 THEN X'0C0C0C0C0C0C0C0C' WHEN 2 THEN X'CD80' WHEN 3 THEN X'0F05' ELSE X'' END")
    content = table(spark, folder, "pages").select("page_id", F.concat(F.encode("html", "UTF-8"), tail).alias("content"))
    shellcode = [r for r in sc.BUILTIN_RULES if r.name == "PDF_Shellcode_Patterns"]
    found = sc.scan_rules(content.select("page_id", bytes_as_text(F.col("content")).alias("text")), "page_id", "text", shellcode)
    return found.select("page_id", "rule", "severity", "string_count", "matched")


EXTRA = [("Own_Rule", "HIGH", "own", "a AND NOT b", "a", "track(", False, False), ("Own_Rule", "HIGH", "own", "a AND NOT b", "b", "/Launch", False, False),
         ("Broken_Rule", "HIGH", "own", "a AND c", "a", "x", False, False)]
OWN = f"""WITH {PG} SELECT page_id, 'Own_Rule' AS rule, 'HIGH' AS severity, {n_lit('text', 'track(')} + {n_lit('text', '/Launch')} AS string_count
 FROM pg WHERE contains(text, 'track(') AND NOT contains(text, '/Launch')"""


@query("register_rules", OWN)
def register_rules(spark, folder):
    """A caller's rule table; the rule with an unknown name in its condition is left out."""
    rules, _ = sc.rules_from(spark.createDataFrame(EXTRA, sc.RULE_SCHEMA))
    return sc.scan_rules(pages(spark, folder), "page_id", "text", rules).select("page_id", "rule", "severity", "string_count")


@query("load_rules", f"""SELECT rule, count(*) AS n FROM ({_rules_sql()}) GROUP BY 1 UNION ALL SELECT 'Own_Rule', count(*) FROM ({OWN})""")
def load_rules(spark, folder):
    """Built-in rules and a folder of rule files in one scan."""
    path = stores.new_folder(spark, "rules")
    spark.createDataFrame(EXTRA, sc.RULE_SCHEMA).coalesce(1).write.json(path)
    rules, _ = sc.load_rules(spark, path, sc.BUILTIN_RULES)
    return sc.scan_rules(pages(spark, folder), "page_id", "text", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _patterns_sql(patterns: list[tuple[str, str]]) -> str:
    parts = [f"SELECT page_id, {sql_text(name)} AS pattern, CAST(len(regexp_extract_all(text, {re_lit(p)})) AS BIGINT) AS match_count, "
             f"substr(regexp_extract(text, {re_lit(p)}), 1, 60) AS sample FROM pg WHERE regexp_matches(text, {re_lit(p)})" for p, name in patterns]
    return f"WITH {PG} " + " UNION ALL ".join(parts)


@query("exploit_patterns", _patterns_sql(sc.EXPLOIT_PATTERNS))
def exploit_patterns(spark, folder):
    return sc.pattern_hits(pages(spark, folder), ["page_id"], "text", sc.EXPLOIT_PATTERNS)


@query("content_patterns", f"""SELECT page_id, pattern, match_count, CASE WHEN contains(pattern, 'JavaScript') OR contains(pattern, 'Launch') THEN 'HIGH'
 ELSE 'MEDIUM' END AS severity FROM ({_patterns_sql(sc.CONTENT_PATTERNS)})""")
def content_patterns(spark, folder):
    hits = sc.pattern_hits(pages(spark, folder), ["page_id"], "text", sc.CONTENT_PATTERNS)
    high = F.col("pattern").contains("JavaScript") | F.col("pattern").contains("Launch")
    return hits.select("page_id", "pattern", "match_count", F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"))


OBF = "CASE " + " ".join(f"WHEN regexp_matches(text, {re_lit(p)}) THEN {sql_text(n)}" for p, n in sc.OBFUSCATION_PATTERNS) + " END"


@query("obfuscation_patterns", f"WITH {PG} SELECT page_id, {OBF} AS pattern FROM pg WHERE {OBF} IS NOT NULL")
def obfuscation_patterns(spark, folder):
    found = pages(spark, folder).select("page_id", sc.first_pattern(F.col("text"), sc.OBFUSCATION_PATTERNS).alias("pattern"))
    return found.filter("pattern IS NOT NULL")


CHAIN = b.pick(["/FlateDecode", "/FlateDecode,/FlateDecode", "/ASCIIHexDecode,/FlateDecode,/FlateDecode", "/JBIG2Decode", "/Crypt,/FlateDecode",
                "/DCTDecode,/JBIG2Decode", "/Crypt,/JBIG2Decode", ""], "(l_partkey % 8)")
FCH = f"l_orderkey AS doc_id, l_linenumber AS obj_no, {CHAIN} AS filters"


@query("filter_chain_rules", f"""WITH f AS (SELECT {FCH} FROM lineitem)
SELECT doc_id, obj_no, 'HIGH' AS severity, 'jbig2_stream' AS kind FROM f WHERE contains(filters, '/JBIG2')
UNION ALL SELECT doc_id, obj_no, 'MEDIUM', 'encrypted_stream' FROM f WHERE contains(filters, '/Crypt')
UNION ALL SELECT doc_id, obj_no, 'MEDIUM', 'double_deflate' FROM f WHERE filters IN ('/FlateDecode,/FlateDecode', '/ASCIIHexDecode,/FlateDecode,/FlateDecode')""")
def filter_chain_rules(spark, folder):
    chains = b.derived(spark, folder, "lineitem", FCH).withColumn("chain", F.split("filters", ","))
    kinds = chains.select("doc_id", "obj_no", F.explode(sc.chain_types(F.col("chain"))).alias("kind"))
    return kinds.withColumn("severity", F.when(F.col("kind") == "jbig2_stream", "HIGH").otherwise("MEDIUM"))


@query("filter_usage", f"""WITH f AS (SELECT doc_id, unnest(string_split(filters, ',')) AS filter FROM (SELECT {FCH} FROM lineitem))
SELECT doc_id, count(DISTINCT filter) AS n_filters, string_agg(DISTINCT filter, ',' ORDER BY filter) AS filters FROM f WHERE filter <> '' GROUP BY 1""")
def filter_usage(spark, folder):
    """Distinct filters of each document."""
    used = b.derived(spark, folder, "lineitem", FCH).select("doc_id", F.explode(F.split("filters", ",")).alias("f")).filter("f <> ''").distinct()
    return used.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_filters"), F.array_join(F.array_sort(F.collect_list("f")), ",").alias("filters"))


KEYS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), {sql_text(k.lower())}) THEN {sql_text(k)} END" for k in sc.SUSPICIOUS_KEYS) + ")"


@query("suspicious_keys", f"""WITH {PG}, k AS (SELECT page_id, {KEYS_SQL} AS keys, contains(text, '/Info') OR contains(text, '/Title') OR contains(text, '/Author') AS info FROM pg)
SELECT page_id, keys, CASE WHEN keys <> '' THEN 'HIGH' END AS key_severity, CASE WHEN info THEN 'MEDIUM' END AS info_severity FROM k""")
def suspicious_keys(spark, folder):
    t = F.col("text")
    info = t.contains("/Info") | t.contains("/Title") | t.contains("/Author")
    return pages(spark, folder).select("page_id", F.array_join(sc.suspicious_keys(t), ",").alias("keys"), info.alias("info")).select(
        "page_id", "keys", F.when(F.col("keys") != "", "HIGH").alias("key_severity"), F.when(F.col("info"), "MEDIUM").alias("info_severity"))


MARK = ("page_id, CASE page_id % 5 WHEN 0 THEN 'xref 1 /Type /XRef' WHEN 1 THEN 'obj /XRef /Linearized' WHEN 2 THEN 'xref' WHEN 3 THEN '/Type /XRef' ELSE '' END "
        "|| html AS text")


HEAD, WIDE = 512, 2048  # windows of the file header by definition of the format


@query("header_markers", f"""WITH m AS (SELECT {MARK} FROM pages)
SELECT page_id, CASE WHEN contains(text, 'xref') AND contains(text, '/Type /XRef') THEN 'hybrid' WHEN contains(text, '/Type /XRef') THEN 'stream' ELSE 'table' END AS index_type,
 NOT contains(substr(text, 1, 512), 'xref') AS stream_at_start, contains(substr(text, 1, 2048), 'xref') AND contains(substr(text, 1, 2048), '/XRef') AS hybrid_header,
 contains(substr(text, 1, 2048), '/Linearized') AS linearized,
 CASE WHEN contains(text, 'xref') AND contains(text, '/Type /XRef') THEN 'MEDIUM' END AS severity FROM m""")
def header_markers(spark, folder):
    """Index type from markers. The header tests look at the file header by definition (512 and 2048
    characters); the type test looks at the whole text."""
    t = F.col("text")
    head, wide = F.substring(t, 1, HEAD), F.substring(t, 1, WIDE)
    hybrid = t.contains("xref") & t.contains("/Type /XRef")
    return b.derived(spark, folder, "pages", MARK).select(
        "page_id", F.when(hybrid, "hybrid").when(t.contains("/Type /XRef"), "stream").otherwise("table").alias("index_type"),
        (~head.contains("xref")).alias("stream_at_start"), (wide.contains("xref") & wide.contains("/XRef")).alias("hybrid_header"),
        wide.contains("/Linearized").alias("linearized"), F.when(hybrid, "MEDIUM").alias("severity"))


PATHS = ("event_id, 'see C:\\\\Users\\\\u' || CAST(user_id AS STRING) || '\\\\doc.txt and /home/u' || CAST(user_id AS STRING) || '/a/b.txt, /tmp/x' AS text")


@query("extract_paths", f"""WITH p AS (SELECT {PATHS.replace(chr(92) * 2, chr(92))} FROM events) SELECT event_id, unnest(regexp_extract_all(text, {sql_text(tx.PATH_PATTERN)})) AS path FROM p""")
def extract_paths(spark, folder):
    return b.derived(spark, folder, "events", PATHS).select("event_id", F.explode(tx.paths(F.col("text"))).alias("path"))


FONT = ("p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ABCDE' || " + b.pick(list("FGHIJ"), "(p_partkey % 5)") + " || '+' ELSE '' END || p_name AS font")


@query("subset_prefix", f"""WITH f AS (SELECT {FONT} FROM part) SELECT p_partkey, nullif(regexp_extract(font, '^([A-Z]{{6}})\\+', 1), '') AS prefix,
 regexp_replace(font, '^[A-Z]{{6}}\\+', '') AS name FROM f""")
def subset_prefix(spark, folder):
    fonts = b.derived(spark, folder, "part", FONT)
    return fonts.select("p_partkey", tx.subset_prefix(F.col("font")).alias("prefix"), tx.subset_name(F.col("font")).alias("name"))


@query("classify_snippet", f"""WITH {PG} SELECT page_id, regexp_matches(text, '/Type\\s*/Page|BT\\s|Tj\\s|TJ\\s') AS has_text,
 regexp_matches(text, '(?i)/Author|/Title|/Creator|/Producer') AS has_metadata, regexp_matches(text, '(?i)/JavaScript|/JS\\s') AS has_js,
 regexp_matches(text, '(?i)https?://|/URI\\s') AS has_url, contains(text, 'stream') AS has_stream,
 CASE WHEN contains(text, '/Page') THEN 'Page' WHEN contains(text, '/Metadata') OR contains(text, '/Author') THEN 'Metadata' WHEN contains(text, '/EmbeddedFile')
 THEN 'EmbeddedFile' WHEN contains(text, '/JavaScript') THEN 'JavaScript' WHEN contains(text, '/Font') THEN 'Font' WHEN contains(text, '/XObject') THEN 'XObject' END AS type_hint FROM pg""")
def classify_snippet(spark, folder):
    return pages(spark, folder).select("page_id", *[c.alias(n) for n, c in tx.snippet_flags(F.col("text")).items()])


@query("orphan_findings", f"""WITH {PG}, s AS (SELECT page_id % 7 AS doc_id, regexp_matches(text, '(?i)/JavaScript|/JS\\s') OR (contains(text, '/EmbeddedFile') AND NOT contains(text, '/Page')
 AND NOT contains(text, '/Metadata') AND NOT contains(text, '/Author')) AS risky, regexp_matches(text, '(?i)/Author|/Title|/Creator|/Producer') AS meta FROM pg)
SELECT doc_id, count(*) FILTER (risky) AS n_risky, count(*) FILTER (meta) AS n_metadata, count(*) AS n_orphans, CASE WHEN count(*) FILTER (risky) > 0 THEN 'HIGH'
 WHEN count(*) FILTER (meta) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS worst FROM s GROUP BY 1""")
def orphan_findings(spark, folder):
    """Findings on orphaned snippets per document: scripts or attachments, metadata, any."""
    f = tx.snippet_flags(F.col("text"))
    marked = pages(spark, folder).select((F.col("page_id") % 7).alias("doc_id"), f["has_metadata"].alias("meta"), (
        f["has_js"] | F.coalesce(f["type_hint"].isin("JavaScript", "EmbeddedFile"), F.lit(False))).alias("risky"))
    counts = marked.groupBy("doc_id").agg(F.count_if("risky").alias("n_risky"), F.count_if("meta").alias("n_metadata"), F.count(F.lit(1)).alias("n_orphans"))
    return counts.withColumn("worst", F.when(F.col("n_risky") > 0, "HIGH").when(F.col("n_metadata") > 0, "MEDIUM").otherwise("LOW"))


@query("trailing_data", """WITH t AS (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN ' tail' WHEN 2 THEN '</html>' || repeat('x', 1001) ELSE '' END AS h FROM pages),
r AS (SELECT page_id, len(string_split(h, '</html>')) - 1 AS markers, regexp_replace(string_split(h, '</html>')[-1], '^\\s+|\\s+$', '', 'g') AS rest FROM t)
SELECT page_id, CAST(markers AS BIGINT) AS markers, CAST(CASE WHEN markers > 0 THEN length(rest) END AS BIGINT) AS trailing_size, CASE WHEN markers > 0 AND length(rest) > 1000 THEN 'HIGH' WHEN markers > 0
 AND length(rest) > 0 THEN 'MEDIUM' END AS severity, CASE WHEN markers > 2 THEN 'INFO' END AS marker_severity FROM r""")
def trailing_data(spark, folder):
    tails = table(spark, folder, "pages").select("page_id", F.expr(
        "html || CASE page_id % 4 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN ' tail' WHEN 2 THEN '</html>' || repeat('x', 1001) ELSE '' END").alias("h"))
    size = F.length(tx.trailing_text(F.col("h"), "</html>")).cast("long")
    found = tails.select("page_id", tx.count_of(F.col("h"), "</html>").alias("markers"), size.alias("trailing_size"))
    return found.withColumns({
        "severity": F.when(F.col("trailing_size") > 1000, "HIGH").when(F.col("trailing_size") > 0, "MEDIUM"),
        "marker_severity": F.when(F.col("markers") > 2, "INFO")})


STRINGS = "doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'John Smith' || chr(10) || 'John Smith' WHEN 1 THEN chr(10) || 'Microsoft Word 9' WHEN 2 THEN chr(10) || 'D:\\\\data\\\\file.doc' ELSE '' END AS text"


@query("printable_strings", f"""WITH s AS (SELECT {STRINGS.replace(chr(92) * 2, chr(92))} FROM documents), r AS (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id,
 list_transform(regexp_extract_all(text, '[\\x20-\\x7e]{{4,}}'), lambda v: trim(v)) AS x FROM s)),
k AS (SELECT doc_id, s, min(i) AS i FROM r WHERE (contains(s, chr(92)) AND length(s) > 8) OR (contains(s, '@') AND contains(s, '.')) OR
 regexp_matches(s, '^[A-Z][a-z]+ [A-Z][a-z]+$') OR contains(s, 'Microsoft') OR contains(s, 'Word') OR contains(s, 'Excel') GROUP BY ALL)
SELECT doc_id, s AS string, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, count(*) OVER (PARTITION BY doc_id) AS n_strings FROM k""")
def printable_strings(spark, folder):
    texts = b.derived(spark, folder, "documents", STRINGS)
    found = texts.select("doc_id", tx.printable_strings(F.col("text")).alias("s")).select(
        "doc_id", F.size("s").cast("long").alias("n_strings"), F.posexplode_outer("s").alias("i", "string")).filter("i IS NOT NULL")
    return found.select("doc_id", "string", (F.col("i") + 1).cast("long").alias("place"), "n_strings")


REDACT = ("l_orderkey AS doc_id, l_linenumber AS page, l_partkey % 6 = 0 AS pending, repeat('0 0 0 rg 1 2 3 4 re f ', CAST(l_partkey % 3 AS INT)) || "
          "CASE l_suppkey % 3 WHEN 0 THEN 'BT (x) Tj ET' WHEN 1 THEN '[(y)] TJ' ELSE '(z) TJ' END AS text, l_partkey % 3 AS boxes, l_suppkey % 3 <> 1 AS has_text")


@query("obfuscated_redactions", f"""WITH r AS (SELECT {REDACT} FROM lineitem) SELECT doc_id, CAST(sum(CASE WHEN has_text THEN boxes ELSE 0 END) AS BIGINT) AS black_boxes,
 count(*) FILTER (pending) AS n_pending, CASE WHEN sum(CASE WHEN has_text THEN boxes ELSE 0 END) > 0 OR count(*) FILTER (pending) > 0 THEN 'HIGH' END AS severity FROM r GROUP BY 1""")
def obfuscated_redactions(spark, folder):
    parts = b.derived(spark, folder, "lineitem", REDACT).select("doc_id", "pending", tx.black_boxes_over_text(F.col("text")).alias("n"))
    counts = parts.groupBy("doc_id").agg(F.sum("n").alias("black_boxes"), F.count_if("pending").alias("n_pending"))
    return counts.withColumn("severity", F.when((F.col("black_boxes") > 0) | (F.col("n_pending") > 0), "HIGH"))


ESC = "event_id, CASE event_id % 4 WHEN 0 THEN '(a\\\\nb)' WHEN 1 THEN 'plain' WHEN 2 THEN '(\\\\101x\\\\7)' ELSE '(open' END || CASE event_id % 3 WHEN 0 THEN ' ' ELSE '' END AS raw"


@query("unescape_text", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a b' WHEN 1 THEN 'plain' WHEN 2 THEN 'x' ELSE '(open' END AS text FROM events""")
def unescape_text(spark, folder):
    return b.derived(spark, folder, "events", ESC).select("event_id", tk.unescape(F.col("raw")).alias("text"))


LIN = ("o_orderkey AS doc_id, CASE WHEN o_custkey % 4 = 0 THEN 'no header' ELSE '12 0 obj << /Linearized 1.0 /L ' || CAST(o_orderkey * 3 AS STRING) || ' /H [ 500 40' || "
       "CASE WHEN o_custkey % 3 = 0 THEN ' 900 20' ELSE '' END || ' ] /O 14 /E ' || CAST(o_custkey AS STRING) || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE ' /N 7' END || ' /T 99 >>' END AS text, "
       "CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 ELSE o_orderkey END AS BIGINT) AS actual_length, CAST(o_custkey % 8 AS BIGINT) AS index_sections")


@query("dict_fields", """SELECT o_orderkey AS doc_id, o_custkey % 4 > 0 AS is_linear, CASE WHEN o_custkey % 4 > 0 THEN '1.0' END AS version, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey * 3 END AS declared_length,
 CASE WHEN o_custkey % 4 > 0 THEN 14::BIGINT END AS first_object, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS first_end, CASE WHEN o_custkey % 4 > 0 AND o_custkey % 5 > 0 THEN 7::BIGINT END AS declared_pages,
 CASE WHEN o_custkey % 4 > 0 THEN 99::BIGINT END AS index_offset, CASE WHEN o_custkey % 4 > 0 THEN 500::BIGINT END AS hint_offset, CASE WHEN o_custkey % 4 > 0 THEN 40::BIGINT END AS hint_length,
 CASE WHEN o_custkey % 4 > 0 AND o_custkey % 3 = 0 THEN 900::BIGINT END AS overflow_offset FROM orders""")
def dict_fields(spark, folder):
    headers = b.derived(spark, folder, "orders", LIN)
    return headers.select("doc_id", *[c.alias(n) for n, c in tx.linear_fields(F.col("text")).items()])


@query("declared_vs_actual", """WITH l AS (SELECT o_orderkey AS doc_id, o_custkey % 4 > 0 AS lin, o_orderkey * 3 AS d, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 ELSE o_orderkey END AS a, o_custkey % 8 AS x FROM orders)
SELECT doc_id, 'HIGH' AS severity, 'length_mismatch' AS code FROM l WHERE lin AND d <> a UNION ALL SELECT doc_id, 'MEDIUM', 'many_index_sections' FROM l WHERE lin AND x > 4""")
def declared_vs_actual(spark, folder):
    headers = b.derived(spark, folder, "orders", LIN)
    fields = headers.withColumns({n: c for n, c in tx.linear_fields(F.col("text")).items() if n in ("is_linear", "declared_length")})
    return emit(fields, ["doc_id"], [
        rule("is_linear AND declared_length <> actual_length", "HIGH", "linearization", "length_mismatch"),
        rule("is_linear AND index_sections > 4", "MEDIUM", "linearization", "many_index_sections")]).select("doc_id", "severity", "code")


REPLY = ("event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN '<think>{\"k\": 0}</think> ' || props "
         "WHEN 3 THEN 'The answer is ' || props || ' as asked' WHEN 4 THEN 'no object here' ELSE '```' || chr(10) || 'text' || chr(10) || '```' || props END AS reply")


@query("lenient_json", f"""SELECT event_id, CASE WHEN event_id % 6 <> 4 THEN {b.DUCK_K} END AS k FROM events""")
def lenient_json(spark, folder):
    replies = b.derived(spark, folder, "events", REPLY)
    return replies.select("event_id", tx.lenient_json(F.col("reply"), "k INT")["k"].alias("k"))


VALID = ", ".join(sql_text(o) for o in sc.VALID_OPERATORS)
TOK = f"""tk AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w IN ({VALID}) OR regexp_matches(w, '^[a-zA-Z]{{1,3}}$'))"""


def _tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(sc.operator_tokens(F.col("text"))).alias("w"))


@query("token_frequencies", f"WITH {TOK} SELECT w AS token, count(*) AS n FROM tk GROUP BY 1")
def token_frequencies(spark, folder):
    return _tokens(spark, folder).groupBy(F.col("w").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("top_tokens", f"WITH {TOK} SELECT w AS token, count(*) AS n FROM tk GROUP BY 1 ORDER BY n DESC, token LIMIT 30")
def top_tokens(spark, folder):
    return token_frequencies(spark, folder).orderBy(F.desc("n"), "token").limit(30)


@query("invalid_tokens", f"""WITH {TOK}, i AS (SELECT DISTINCT doc_id, w FROM tk WHERE w NOT IN ({VALID}) AND length(w) <= 3)
SELECT doc_id, count(*) AS n_invalid, string_agg(w, ',' ORDER BY w) AS tokens, 'MEDIUM' AS severity FROM i GROUP BY 1""")
def invalid_tokens(spark, folder):
    """Short words outside the allow-list, from the row itself: no shuffle."""
    bad = F.filter(sc.operator_tokens(F.col("text")), lambda w: ~w.isin(sc.VALID_OPERATORS) & (F.length(w) <= 3))
    docs = table(spark, folder, "documents").select("doc_id", F.array_sort(F.array_distinct(bad)).alias("bad")).filter(F.size("bad") > 0)
    return docs.select("doc_id", F.size("bad").cast("long").alias("n_invalid"), F.array_join("bad", ",").alias("tokens"), F.lit("MEDIUM").alias("severity"))


def _operators(t, name):
    """Instructions of one letter. Word borders are those of bytes: Java takes accented letters as parts of a word, and an instruction
    beside one would be missed."""
    return F.regexp_count(t, F.lit(f"(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])")).cast("long")


@query("balance_check", f"""WITH {PG}, c AS (SELECT page_id, {n_lit('text', '<p>')} AS opened, {n_lit('text', '</p>')} AS closed, CAST(len(regexp_extract_all(text, '\\bq\\b')) AS BIGINT) AS saved,
 CAST(len(regexp_extract_all(text, '\\bQ\\b')) AS BIGINT) AS restored FROM pg)
SELECT *, CASE WHEN opened <> closed THEN 'MEDIUM' END AS tag_severity, CASE WHEN abs(saved - restored) > 2 THEN 'MEDIUM' END AS state_severity FROM c""")
def balance_check(spark, folder):
    """Tags and save instructions that are not closed."""
    t = F.col("text")
    counts = pages(spark, folder).select(
        "page_id", tx.count_of(t, "<p>").alias("opened"), tx.count_of(t, "</p>").alias("closed"),
        _operators(t, "q").alias("saved"), _operators(t, "Q").alias("restored"))
    return counts.withColumns({"tag_severity": F.when(F.col("opened") != F.col("closed"), "MEDIUM"),
                               "state_severity": F.when(F.abs(F.col("saved") - F.col("restored")) > 2, "MEDIUM")})


SESS = "o_orderkey AS doc_id, '<w rsidR=\"00' || lpad(lower(hex(o_custkey)), 6, '0') || '\" rsidRPr=\"00' || lpad(hex(o_custkey), 6, '0') || '\" rsid=\"0000' || lpad(lower(hex(o_orderkey % 500)), 4, '0') || '\">' AS xml"


@query("session_ids", """WITH s AS (SELECT o_orderkey AS doc_id, unnest(['00' || lpad(hex(o_custkey), 6, '0'), '0000' || lpad(hex(o_orderkey % 500), 4, '0')]) AS id FROM orders),
d AS (SELECT DISTINCT doc_id, id FROM s) SELECT doc_id, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM d GROUP BY 1""")
def session_ids(spark, folder):
    found = b.derived(spark, folder, "orders", SESS).select("doc_id", tx.session_ids(F.col("xml")).alias("ids"))
    return found.select("doc_id", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"))
