"""Network indicators per document, and the flagship overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.functions import network as net
from vestigia.operators import indicators, rollups
from vestigia.operators.common import emit
from vestigia.plans.bindings import sql_text
from vestigia.plans.registry import query
from vestigia.sources.tables import table

URL, IP, MAIL, TAIL = (sql_text(p) for p in (net.URL_PATTERN, net.IP_PATTERN, net.EMAIL_PATTERN, net.URL_TAIL))

def d_urls(t: str) -> str:
    return (f"list_distinct(list_transform(regexp_extract_all({t}, {URL}), "
            f"lambda u: regexp_replace(u, {TAIL}, '')))")


def d_ips(t: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all({t}, {IP}), "
            "lambda i: NOT regexp_matches(i, '(^|\\.)0\\d')))")


def d_mails(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({t}, {MAIL}), lambda m: lower(m)))"


def d_auth(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def d_host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower({d_auth(u)}), '^.*@', ''), ':\\d*$', '')"


def d_susp(u: str) -> str:
    names = ", ".join(sql_text(s) for s in net.URL_SHORTENERS)
    return (f"(regexp_matches({d_host(u)}, '\\.(onion|ru|to|xyz|bit|tk|cc|su)$') "
            f"OR regexp_replace({d_host(u)}, '^www\\.', '') IN ({names}))")


def d_private(i: str) -> str:
    return (f"(regexp_matches({i}, '^(10|127)\\.') OR regexp_matches({i}, '^172\\.(1[6-9]|2\\d|3[01])\\.') "
            f"OR starts_with({i}, '192.168.') OR starts_with({i}, '169.254.'))")


# Shorteners and watched domains never occur in the tables, so some URLs are rewritten on both sides.
HOSTED = ("CASE page_id % 5 WHEN 0 THEN replace(url, '.example.com', '.onion') WHEN 1 THEN 'https://www.bit.ly/x' "
          "|| CAST(page_id AS STRING) WHEN 2 THEN replace(url, '.example.net', '.tools') ELSE url END")


def _pages(spark, folder):
    return table(spark, folder, "pages")


@query("extract_urls", f"SELECT page_id, unnest({d_urls('html')}) AS url FROM "
       "(SELECT page_id, html || ' ' || url || '). ' AS html FROM pages)")
def extract_urls(spark, folder):
    text = _pages(spark, folder).select("page_id", F.expr("html || ' ' || url || '). '").alias("text"))
    return text.select("page_id", F.explode(net.urls(F.col("text"))).alias("url"))


@query("extract_ips", f"SELECT doc_id, unnest({d_ips('text')}) AS ip FROM documents")
def extract_ips(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(net.ips(F.col("text"))).alias("ip"))


@query("extract_emails", f"SELECT doc_id, unnest({d_mails('text')}) AS email FROM documents")
def extract_emails(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(net.emails(F.col("text"))).alias("email"))


@query("url_host", f"SELECT {d_auth('url')} AS domain, count(*) AS n_pages FROM pages GROUP BY 1")
def url_host(spark, folder):
    return _pages(spark, folder).groupBy(net.url_authority(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_pages")
    )


@query("is_private_ip", f"SELECT ip, {d_private('ip')} AS is_internal, count(*) AS n_docs FROM "
       f"(SELECT unnest({d_ips('text')}) AS ip FROM documents) GROUP BY ALL")
def is_private_ip(spark, folder):
    found = extract_ips(spark, folder).groupBy("ip").agg(F.count(F.lit(1)).alias("n_docs"))
    return found.select("ip", net.is_private_ip(F.col("ip")).alias("is_internal"), "n_docs")


@query("is_suspicious_url", f"SELECT page_id, u AS url, {d_susp('u')} AS suspicious, "
       "regexp_matches(lower(u), '\\.(onion|ru|to|xyz|bit|tk|cc|su)') OR "
       f"{d_susp('u')} AS suspicious_compat FROM (SELECT page_id, {HOSTED} AS u FROM pages)")
def is_suspicious_url(spark, folder):
    urls = _pages(spark, folder).selectExpr("page_id", f"{HOSTED} AS url")
    return urls.select(
        "page_id", "url", net.is_suspicious_url(F.col("url")).alias("suspicious"),
        net.is_suspicious_url(F.col("url"), mode="compat").alias("suspicious_compat"),
    )


SHORT = ", ".join(sql_text(s) for s in net.URL_SHORTENERS)


@query("suspicious_indicators", rf"""WITH u AS (SELECT page_id, {HOSTED} AS url FROM pages)
SELECT page_id, url, {d_host('url')} AS host, CASE WHEN contains(lower(url), '.onion') THEN 'onion'
 WHEN regexp_replace({d_host('url')}, '^www\.', '') IN ({SHORT}) THEN 'shortener' ELSE 'domain' END AS reason FROM u WHERE {d_susp('url')}""")
def suspicious_indicators(spark, folder):
    """The suspicious URLs themselves with the reason."""
    urls = _pages(spark, folder).selectExpr("page_id", f"{HOSTED} AS url").withColumn("reason", net.suspicion(F.col("url")))
    return urls.filter("reason IS NOT NULL").select("page_id", "url", net.url_host(F.col("url")).alias("host"), "reason")


@query("distinct_hosts", f"""SELECT page_id, count(DISTINCT h) AS n_hosts FROM (SELECT page_id, {d_host('u')} AS h FROM
 (SELECT page_id, unnest({d_urls('html')}) AS u FROM (SELECT page_id, html || ' ' || url AS html FROM pages))) WHERE h <> '' GROUP BY 1""")
def distinct_hosts(spark, folder):
    """Number of different hosts of each page, counted inside the row."""
    found = _pages(spark, folder).select("page_id", net.urls(F.concat("html", F.lit(" "), "url")).alias("urls"))
    hosts = F.array_distinct(F.filter(F.transform("urls", net.url_host), lambda h: h != ""))
    return found.select("page_id", F.size(hosts).cast("long").alias("n_hosts")).filter("n_hosts > 0")


IND = f"""
ind AS (SELECT kind, id, text, {d_urls('text')} AS urls, {d_ips('text')} AS ips,
               {d_mails('text')} AS emails
        FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents
              UNION ALL SELECT 'page', page_id, html || ' ' || {HOSTED} FROM pages)),
cnt AS (SELECT kind, id, len(urls) + len(ips) + len(emails) AS total_indicators,
   len(list_filter(urls, lambda u: contains(lower(u), '.onion'))) AS onion,
   len(list_filter(urls, lambda u: {d_susp('u')})) AS susp,
   len(list_filter(ips, lambda i: {d_private('i')})) AS internal,
   len(list_filter(ips, lambda i: NOT {d_private('i')})) AS ext FROM ind)"""


def all_text(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("'document' AS kind", "doc_id AS id", "text")
    pages = _pages(spark, folder).selectExpr("'page' AS kind", "page_id AS id", f"html || ' ' || {HOSTED} AS text")
    return docs.unionByName(pages)


@query("ioc_findings", f"""WITH {IND}
SELECT kind, id, 'HIGH' AS severity, 'darknet_url' AS code, CAST(onion AS VARCHAR) AS detail FROM cnt WHERE onion > 0
UNION ALL SELECT kind, id, 'MEDIUM', 'external_ip', CAST(ext AS VARCHAR) FROM cnt WHERE ext > 0
UNION ALL SELECT kind, id, 'LOW', 'internal_ip', CAST(internal AS VARCHAR) FROM cnt WHERE internal > 0
UNION ALL SELECT kind, id, 'MEDIUM', 'suspicious_url', CAST(susp AS VARCHAR) FROM cnt WHERE susp > 0 AND onion = 0""")
def ioc_findings(spark, folder):
    found = indicators.with_indicators(all_text(spark, folder), "text")
    return emit(found, ["kind", "id"], indicators.indicator_rules()).drop("category")


@query("risk_overview", f"""WITH {IND}, sev AS (SELECT kind, id, CAST(total_indicators AS BIGINT) AS total_indicators,
 CAST(onion > 0 AS BIGINT) AS high, CAST(ext > 0 AS BIGINT) + CAST(susp > 0 AND onion = 0 AS BIGINT) AS medium,
 CAST(internal > 0 AS BIGINT) AS low FROM cnt)
SELECT *, CASE WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'CLEAN' END
 AS risk_level FROM sev""")
def risk_overview(spark, folder):
    """Risk level per document and page: one scan, no shuffle."""
    found = indicators.with_indicators(all_text(spark, folder), "text")
    counted = rollups.local_severity_counts(found, indicators.indicator_rules())
    return counted.select("kind", "id", "total_indicators", "high", "medium", "low", "risk_level")
