"""URL verdicts: fixed rules by host and path, and for all other URLs the ratio of two character language models.

URLs that a rule allows or blocks train one model each: interpolated (Witten-Bell) Markov models over an alphabet of SYMBOLS
characters, of order two where the context was seen MIN_CONTEXT times and of a lower order elsewhere. The score of a URL is the
difference of the log-likelihoods by its length, in whole millionths of a nat a character, so that sums are exact in any order. The
threshold is the one that separates the held-out tenth of the rule-judged URLs best.

The models are one table of SYMBOLS ** 3 rows, whatever the input: it is broadcast. URLs are opened into characters, but summed in
the same task before anything is shuffled; counts are summed in each task likewise.

Rows: a null url, or one without `://`, has an empty host and path and no rule; a null url is scored as an empty one. Without training
URLs of both kinds the scores and the threshold are 0 and the verdict is allow. Rows that repeat a page id are judged each by
its own url. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vestigia.llm.common import lower_ascii, stored, table

# Fixed values: (verdict, host, path). The longest rule that fits decides.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&:%#~+"
OTHER, START, END = "*", "^", "$"
SYMBOLS = len(ALPHABET) + 3
MIN_CONTEXT = 2
LIMIT = 20_000_000  # scores beyond 20 nats a character share a bin
BIN = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct `(rule, verdict)` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    parts = pages.select(F.col("page_id").cast("long"), url.alias("url"), host.alias("host"), path.alias("path"))
    return parts.withColumn("_r", rule_of(F.col("host"), F.col("path"))).select(
        "page_id", "url", "host", "path", F.col("_r")["rule"].alias("rule"), F.col("_r")["verdict"].alias("given"))


def grams(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """`keys, gram`: three characters for each character of the URL and its end."""
    chars = F.split(F.concat(F.lit(START * 2), F.regexp_replace(
        lower_ascii(F.coalesce("url", F.lit(""))), r"[^a-z0-9./\-_?=&:%#~+]", OTHER), F.lit(END)), "")
    split = rows.select(*keys, F.filter(chars, lambda c: c != "").alias("_chars"))
    triples = F.transform(F.sequence(F.lit(1), F.size("_chars") - 2), lambda i: F.array_join(F.slice("_chars", i, 3), ""))
    named = [c for c in split.columns if c != "_chars"]
    return split.select(*named, triples.alias("_grams")).select(*named, F.explode_outer("_grams").alias("gram"))


def _fold() -> Column:
    """0 to 9 by the page id; 0 is held out."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(10))


def model(judged: DataFrame) -> DataFrame:
    """`gram, score` for every possible gram (SYMBOLS ** 3 rows)."""
    counts = grams(judged.filter(F.col("given").isNotNull() & (_fold() != 0)), "given").groupBy("gram").agg(
        *[F.count(F.when(F.col("given") == v, 1)).alias(f"n_{v}") for v in ("allow", "block")])
    counts = stored(counts, "grams")
    letters = F.split(F.lit(ALPHABET + OTHER + START + END), "")
    spark = judged.sparkSession
    place = lambda k: F.element_at(letters, (F.floor(F.col("id") / SYMBOLS ** k) % SYMBOLS + 1).cast("int"))
    grid = spark.range(SYMBOLS ** 3).select(place(2).alias("a"), place(1).alias("b"), place(0).alias("c"))
    full = grid.withColumn("gram", F.concat("a", "b", "c")).join(counts, "gram", "left")
    for v in ("allow", "block"):
        n = F.coalesce(f"n_{v}", F.lit(0))
        full = full.withColumn(f"n3_{v}", n)
        # Sums over the first, first two, ... characters; every gram exists, so each sum is spread over SYMBOLS equal rows.
        full = full.withColumn(f"n2_{v}", F.sum(n).over(W.partitionBy("b", "c")))
        full = full.withColumn(f"n1_{v}", F.sum(n).over(W.partitionBy("c")))
        context = W.partitionBy("a", "b")
        full = full.withColumn(f"s3_{v}", F.sum(n).over(context)).withColumn(f"T3_{v}", F.count(F.when(n > 0, 1)).over(context))
        lower = W.partitionBy("a", "b")  # for a fixed a, the rows of b are its pairs (b, c)
        full = full.withColumn(f"s2_{v}", F.sum(f"n2_{v}").over(lower)).withColumn(
            f"T2_{v}", F.count(F.when(F.col(f"n2_{v}") > 0, 1)).over(lower))
        full = full.withColumn(f"s1_{v}", F.sum(f"n1_{v}").over(lower))
        p1 = (F.col(f"n1_{v}") + 1) / (F.col(f"s1_{v}") + SYMBOLS)
        p2 = F.when(F.col(f"s2_{v}") > 0, (F.col(f"n2_{v}") + F.col(f"T2_{v}") * p1) / F.greatest(
            F.col(f"s2_{v}") + F.col(f"T2_{v}"), F.lit(1))).otherwise(p1)
        p3 = F.when(F.col(f"s3_{v}") >= MIN_CONTEXT, (F.col(f"n3_{v}") + F.col(f"T3_{v}") * p2) / F.greatest(
            F.col(f"s3_{v}") + F.col(f"T3_{v}"), F.lit(1))).otherwise(p2)
        full = full.withColumn(f"p_{v}", p3)
    both = full.agg(F.sum("n3_allow").alias("x"), F.sum("n3_block").alias("y")).first()
    score = F.round(1e6 * (F.ln("p_allow") - F.ln("p_block"))).cast("long") if both["x"] and both["y"] else F.lit(0).cast("long")
    return stored(full.select("gram", score.alias("score")), "model")


def scored(rows: DataFrame, table_of_grams: DataFrame) -> DataFrame:
    """`page_id, _url, score`: millionths of a nat a character, for each distinct page and URL of `rows`."""
    opened = grams(rows, "page_id", F.xxhash64("url").alias("_url"))
    return opened.join(F.broadcast(table_of_grams), "gram").groupBy("page_id", "_url").agg(
        F.floor(F.sum("score") / F.count(F.lit(1))).cast("long").alias("score"))


def threshold(judged: DataFrame, table_of_grams: DataFrame) -> int:
    """The place between two bins that gives the best mean of both kinds' recall on the held-out URLs; ties go to the lowest."""
    held = judged.filter(F.col("given").isNotNull() & (_fold() == 0))
    marks = scored(held, table_of_grams)
    named = held.select("page_id", F.xxhash64("url").alias("_url"), "given").distinct()
    bins = F.floor(F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT)) / BIN)
    rows = named.join(marks, (named.page_id.eqNullSafe(marks.page_id)) & (named._url == marks._url)).groupBy(bins.alias("bin")).agg(
        *[F.count(F.when(F.col("given") == v, 1)).alias(v) for v in ("allow", "block")]).collect()  # at most 2 * LIMIT / BIN + 1 rows
    allow, block = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not allow or not block:
        return 0
    best, at, below_allow, below_block, last = -1.0, 0, 0, 0, None
    for r in sorted(rows, key=lambda r: r["bin"]):
        worth = (allow - below_allow) / allow + below_block / block
        if worth > best + 1e-12:
            best, at = worth, ((r["bin"] if last is None else last) + r["bin"]) * BIN // 2
        last = r["bin"]
        below_allow, below_block = below_allow + r["allow"], below_block + r["block"]
    return int(at)


def judged_urls(pages: DataFrame) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` for each row; URLs with a rule are not scored."""
    judged = with_rules(pages)
    marks = model(judged)
    least = threshold(judged, marks)
    open_rows = judged.filter("given IS NULL")
    scores = stored(scored(open_rows, marks), "scores").select(F.col("page_id").alias("_p"), F.col("_url").alias("_u"), "score")
    rows = judged.join(scores, F.col("page_id").eqNullSafe(F.col("_p")) & (F.xxhash64("url") == F.col("_u")), "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce(
        "given", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("score")).alias("score"))


def op5_url_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"))


def _oracle() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    arms = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}:{h}{p}'"
                    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    letters = f"string_split('{ALPHABET + OTHER + START + END}', '')"
    prob = []
    for v in ("allow", "block"):
        p1 = f"((n1_{v} + 1)::DOUBLE / (s1_{v} + {SYMBOLS}))"
        p2 = f"(CASE WHEN s2_{v} > 0 THEN (n2_{v} + T2_{v} * {p1}) / greatest(s2_{v} + T2_{v}, 1) ELSE {p1} END)"
        prob.append(f"(CASE WHEN s3_{v} >= {MIN_CONTEXT} THEN (n3_{v} + T3_{v} * {p2}) / greatest(s3_{v} + T3_{v}, 1) ELSE {p2} END)")
    sums = ", ".join(f"n3_{v}, sum(n3_{v}) OVER (PARTITION BY b, c) AS n2_{v}, sum(n3_{v}) OVER (PARTITION BY c) AS n1_{v}, "
                     f"sum(n3_{v}) OVER (PARTITION BY a, b) AS s3_{v}, count(CASE WHEN n3_{v} > 0 THEN 1 END) OVER (PARTITION BY a, b) AS T3_{v}"
                     for v in ("allow", "block"))
    more = ", ".join(f"sum(n2_{v}) OVER (PARTITION BY a, b) AS s2_{v}, count(CASE WHEN n2_{v} > 0 THEN 1 END) OVER (PARTITION BY a, b) AS "
                     f"T2_{v}, sum(n1_{v}) OVER (PARTITION BY a, b) AS s1_{v}" for v in ("allow", "block"))
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, {lower.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
j AS (SELECT *, CASE {arms} END AS vr, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::UBIGINT % 10 AS fold FROM hp),
s AS (SELECT page_id, vr, fold, '{START * 2}' || regexp_replace({lower.format("coalesce(url, '')")},
  '[^a-z0-9./\\-_?=&:%#~+]', '{OTHER}', 'g') || '{END}' AS s FROM j),
gram AS (SELECT page_id, vr, fold, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram FROM s),
n AS (SELECT gram, count(CASE WHEN vr LIKE 'allow:%' THEN 1 END) AS x, count(CASE WHEN vr LIKE 'block:%' THEN 1 END) AS y
  FROM gram WHERE vr IS NOT NULL AND fold <> 0 GROUP BY gram),
l AS (SELECT unnest({letters}) AS c),
grid AS (SELECT p.c AS a, q.c AS b, r.c AS c, coalesce(x, 0) AS n3_allow, coalesce(y, 0) AS n3_block
  FROM l p, l q, l r LEFT JOIN n ON n.gram = p.c || q.c || r.c),
w AS (SELECT a, b, c, {sums} FROM grid),
w2 AS (SELECT *, {more} FROM w),
m AS (SELECT a || b || c AS gram, CASE WHEN (SELECT sum(x) > 0 AND sum(y) > 0 FROM n) THEN
  round(1e6 * (ln({prob[0]}) - ln({prob[1]})))::BIGINT ELSE 0 END AS score FROM w2),
sc AS (SELECT page_id, any_value(vr) AS vr, any_value(fold) AS fold, floor(sum(score) / count(*))::BIGINT AS score
  FROM gram JOIN m USING (gram) GROUP BY page_id),
bins AS (SELECT floor(least(greatest(score, -{LIMIT}), {LIMIT}) / {BIN})::BIGINT AS bin, count(CASE WHEN vr LIKE 'allow:%' THEN 1 END) AS x,
  count(CASE WHEN vr LIKE 'block:%' THEN 1 END) AS y FROM sc WHERE vr IS NOT NULL AND fold = 0 GROUP BY 1),
cum AS (SELECT bin, coalesce(sum(x) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bx,
  coalesce(sum(y) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bys,
  sum(x) OVER () AS tx, sum(y) OVER () AS ty, coalesce(lag(bin) OVER (ORDER BY bin), bin) AS last FROM bins),
th AS (SELECT coalesce((SELECT (bin + last) * {BIN // 2} FROM cum WHERE tx > 0 AND ty > 0
  ORDER BY round((tx - bx)::DOUBLE / tx + bys::DOUBLE / ty, 11) DESC, bin LIMIT 1), 0) AS t)
SELECT j.page_id, host, path, substr(j.vr, 7) AS rule,
  coalesce(split_part(j.vr, ':', 1), CASE WHEN sc.score >= t THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN j.vr IS NULL THEN sc.score END AS score
FROM j LEFT JOIN sc USING (page_id), th
"""


ORACLE = _oracle()
