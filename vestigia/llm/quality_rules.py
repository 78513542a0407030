"""Learned decision lists: sequential covering over text statistics, as ordered Spark conditional expressions.

`statistics` computes everything inside the row. `learn` reads statistics of a bounded sample of labelled documents, already
counted by Spark into cells of binned values, and grows rules for quality 0: a rule adds the threshold condition of the largest
information gain until it covers no good document, is then pruned on held-out cells, and is kept only if it is precise
there. Rules are tried in order; the first that fits names the verdict.

Rows: a null text counts as empty: no words, which the base rule rejects. Labels with a null id or quality are left out, repeated
labels count once (the lowest quality). Without labels of both kinds the list is empty and only the base rule decides. Rows
that repeat an id are judged each by its own text. Other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import let, set_apart, stored, table

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SPAN = 8
MAX_LABELLED = 5_000  # labelled documents used for learning, lowest id hash first
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_COVER, MIN_PRECISION = 3, 0.95
QUANTILES = [i / 20 for i in range(1, 20)]
FEATURES = {
    "symbol_rate": "n_symbols / n_words",
    "shout_rate": "n_marks / n_words",
    "upper_share": "n_upper / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "word_length": "word_chars / n_words",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bound: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.bound) if self.at_least else value < F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.bound:g}"


Rule = tuple[Condition, ...]


def _repeated_words(ws: Column, hashes: Column) -> Column:
    """Words inside windows of SPAN words that occur twice or more. Equal hashes are confirmed on the words themselves."""
    def neighbours(items: Column, field: str) -> Column:
        same = lambda i, j: F.get(items, i)[field] == F.get(items, j)[field]
        return F.filter(items, lambda s, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))

    numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    maybe = let(numbered, lambda s: neighbours(s, "h"))
    spelled = F.sort_array(F.transform(maybe, lambda s: F.struct(
        F.array_join(F.slice(ws, s["i"] + 1, SPAN), " ").alias("w"), s["i"].alias("i"))))
    at = F.sort_array(F.transform(let(spelled, lambda s: neighbours(s, "w")), lambda s: s["i"]))
    return F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, i: F.struct((acc["n"] + i + SPAN - F.greatest(i, acc["to"])).alias("n"), (i + SPAN).alias("to")),
        lambda acc: acc["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` with its statistics and features; no shuffle. Each step is a projection of its own, so that Spark does not
    repeat a costly value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws, lines = F.col("_ws"), F.col("_lines")
    step = docs.withColumns({
        "_ws": F.filter(F.split(text, BLANKS), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != ""),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
    })
    starts = F.sequence(F.lit(1), F.size(ws) - SPAN + 1)
    step = step.withColumns({
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "_hashes": F.when(F.size(ws) >= SPAN, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, SPAN))))
        .otherwise(F.array().cast("array<bigint>")),
    })
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    step = step.withColumn("n_repeat_words", F.when(some, _repeated_words(ws, F.col("_hashes"))).otherwise(0).cast("long"))
    step = step.drop("_ws", "_lines", "_hashes")
    features = {k: F.coalesce(F.expr(f"try_divide({v.replace(' / ', ', ')})" if "/" in v else v).cast("double"), F.lit(0.0))
                for k, v in FEATURES.items()}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return step.withColumns({**features, "base_failed": failed})


def labelled_sample(labels: DataFrame) -> DataFrame:
    """At most MAX_LABELLED labels, chosen by a hash of the id."""
    once = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)


def _bounds(sample: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles over all labelled documents and over those of quality 0."""
    bad = F.col("quality") == 0
    row = sample.agg(*[F.percentile_approx(F.when(c, F.col(f)), QUANTILES, 10_000).alias(f"{f}{k}")
                       for f in FEATURES for k, c in enumerate((F.lit(True), bad))]).first()
    return {f: sorted({*(row[f"{f}0"] or []), *(row[f"{f}1"] or [])}) for f in FEATURES}


def _cells(sample: DataFrame, bounds: dict[str, list[float]]) -> list[tuple]:
    """`(held_out, bins, bad, good)`: counts of labelled documents by binned features, never more rows than the sample."""
    def passed(feature: str) -> Column:
        return sum((F.when(F.col(feature) >= b, 1).otherwise(0) for b in bounds[feature]), F.lit(0))

    bins = [passed(f) for f in FEATURES]
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3)) == 0
    counted = sample.groupBy(held.alias("held"), F.array(*bins).alias("bins")).agg(
        F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.sum((F.col("quality") != 0).cast("long")).alias("good"))
    return sorted((r["held"], tuple(r["bins"]), r["bad"], r["good"]) for r in counted.collect())


def _fits(conditions, bins: tuple) -> bool:
    return all((bins[f] >= k) == up for f, k, up in conditions)


def _count(cells: list[tuple], conditions) -> tuple[int, int]:
    hit = [(b, g) for _, bins, b, g in cells if _fits(conditions, bins)]
    return sum(b for b, _ in hit), sum(g for _, g in hit)


def _grow(cells: list[tuple], n_bounds: list[int]) -> list[tuple[int, int, bool]]:
    rule: list[tuple[int, int, bool]] = []
    bad, good = _count(cells, rule)
    while good and bad and len(rule) < MAX_CONDITIONS:
        covered = [c for c in cells if _fits(rule, c[1])]
        best = None
        for f, n in enumerate(n_bounds):
            by_bin = [[0, 0] for _ in range(n + 1)]
            for _, bins, b, g in covered:
                by_bin[bins[f]][0] += b
                by_bin[bins[f]][1] += g
            low_b = low_g = 0
            for k in range(1, n + 1):
                low_b += by_bin[k - 1][0]
                low_g += by_bin[k - 1][1]
                for up, b, g in ((True, bad - low_b, good - low_g), (False, low_b, low_g)):
                    if b:
                        gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, (f, k, up), b, g)
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        bad, good = best[2], best[3]
    return rule


def _prune(rule: list, held: list[tuple]) -> list:
    """The prefix of the rule with the best (bad - good) / (bad + good) on held-out cells; ties go to the shorter."""
    def worth(conditions: list) -> float:
        b, g = _count(held, conditions)
        return (b - g) / (b + g) if b + g else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list: conjunctions that mean quality 0, in order."""
    sample = stored(labelled_sample(labels), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most MAX_LABELLED rows
    known = stored(statistics(texts).drop("text"), "statistics")
    bounds = _bounds(known)
    cells = _cells(known, bounds)
    names = list(FEATURES)
    grow, held = [c for c in cells if not c[0]], [c for c in cells if c[0]]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _prune(_grow(grow, [len(bounds[f]) for f in names]), held)
        (b, g), (hb, hg) = _count(grow, rule), _count(held, rule)
        if not rule or b < MIN_COVER or b + hb < MIN_PRECISION * (b + hb + g + hg) or hb < MIN_PRECISION * (hb + hg):
            break
        rules.append(tuple(Condition(names[f], up, bounds[names[f]][k - 1]) for f, k, up in rule))
        grow = [c for c in grow if not _fits(rule, c[1])]
        held = [c for c in held if not _fits(rule, c[1])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that fits (from 1), else 0."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        fits = F.lit(True)
        for condition in rule:
            fits = fits & condition.column()
        out = F.when(fits, number).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with statistics, `base_failed`, `fired_rule` and `kept`."""
    rules = learn(docs, labels)
    return statistics(docs).withColumn("fired_rule", verdict(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("fired_rule") == 0))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the base rule and the learned list keep, with their own columns only."""
    rules = learn(docs, labels)
    rows, columns = set_apart(docs)
    tested = statistics(rows.withColumns({"doc_id": F.col("_in_doc_id"), "text": F.col("_in_text")}))
    # A filter on the bare statistics would be moved below them and split the texts again for every word; a random value,
    # never below 0, holds it in place.
    kept = tested.withColumn("_held", F.rand()).filter(~F.col("base_failed") & (verdict(rules) == 0) & (F.col("_held") >= 0))
    return kept.select(*columns)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judged(docs, table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fired_rule")
