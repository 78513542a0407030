"""Similar sets over a whole corpus: every pair from a given share on, without building pairs of dissimilar sets.

Texts become sets of hashed five-word shingles; a shorter text is one shingle. Equal sets are one class, named by its first document. Classes are
joined by a prefix filter: elements are put in the global order of their frequency, and two sets of a share t have one of their
first n - ceil(t * n) + 1 elements in common. Elements that only one class has are counted and not indexed. Every candidate is
confirmed on the whole sets.

The elements before the first common one are in one of the two sets only, so a pair is met where its members stand early enough for the
share; a link always passes there, at its first common element. Members that stand too late for every other one leave the entry.

A cluster of many similar sets shares its rare elements, so an index entry may be long. Its members are first held against a few, the hubs:
those that stand earliest, as versions with many words of their own are linked to plain ones rather than to each other. Members of different
groups are held against other hubs afterwards, twice as many in every round, until these are as many pairs as all that are left; those are
then all confirmed, so no link is lost, and the number of rounds grows with the logarithm of the longest entry. Sets in long entries have a
mark of some bits, each the parity of the elements dealt to it: bits that differ are no more than elements that differ, so most pairs below the
share are refused before their whole sets are brought together.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vestigia.operators.common import join_reduced
from vestigia.operators.graph import connected_groups
from vestigia.session import cut_lineage

SHINGLE_WORDS = 5
SHARE = 80
PAIRS_FOR_ENTRY = 4
PART = 1_000
LONG_ENTRY = 64
MARK_WORDS = 16


def with_word_sets(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """Sorted distinct hashes of the runs of `words` words between blanks, lower-cased (A-Z). A shorter text is one run; a text without words, or
    null, is the empty set."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = F.filter(F.split(lower, "[ \\t-\\r]+"), lambda w: w != "")
    # One hash for each word, then one for each run: texts are not built again for every run. The outer explode keeps the list computed once.
    hashed = df.withColumn("_w", F.explode_outer(F.array(F.transform(listed, lambda w: F.xxhash64(w)))))
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - words), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(words)]))
    sets = F.when(F.size("_w") >= words, F.array_sort(F.array_distinct(runs))).when(F.size("_w") > 0, F.array(F.xxhash64(F.array_join("_w", " "))))
    return hashed.withColumn(out, F.explode_outer(F.array(F.coalesce(sets, F.array().cast("array<bigint>"))))).drop("_w")


def classes(sets: DataFrame) -> DataFrame:
    """`(doc_id, first)`: the first document with the same set, for each of `sets(doc_id, s)` whose set is not empty."""
    keyed = sets.select("doc_id", F.size("s").alias("n"), F.xxhash64(F.lit(1), "s").alias("k1"), F.xxhash64(F.lit(2), "s").alias("k2")).filter("n > 0")
    keyed = cut_lineage(keyed)
    firsts = keyed.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("first"))
    return join_reduced(keyed, firsts, ["n", "k1", "k2"]).select("doc_id", "first")


def prefix_index(sets: DataFrame, share: int) -> DataFrame:
    """`(e, doc_id, n, late)`: the rarest elements of each set, as many as a partner of that share must have one of. Two sets may meet at an
    element, as the first they have in common, only if the sum of `late`, from the places of the element, is not above 0."""
    elements = sets.select("doc_id", F.explode("s").alias("e"))
    common = cut_lineage(elements.groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    known = elements.join(common, "e").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("l"))
    n = F.size("s")
    needed = n - F.ceil(n * share / 100).cast("int") + 1
    # The elements that no other set has come first in the order.
    own = sets.select("doc_id", n.alias("n"), needed.alias("needed")).join(known, "doc_id").withColumn(
        "_take", F.col("needed") - (F.col("n") - F.size("l"))).filter("_take > 0")
    placed = own.select("doc_id", "n", (F.col("n") - F.size("l")).alias("_own"), F.posexplode(F.slice("l", 1, F.col("_take"))).alias("i", "x"))
    late = (100 + share) * (F.col("_own") + F.col("i")) - (100 - share) * F.col("n")
    index = cut_lineage(placed.select(F.col("x.e").alias("e"), "doc_id", "n", late.alias("late")))
    earliest = index.groupBy("e").agg(F.min("late").alias("_least"), F.count(F.lit(1)).alias("_k")).filter("_k > 1").drop("_k")
    return join_reduced(index, earliest, "e").filter("late + _least <= 0").drop("_least")


def confirmed(candidates: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those of `candidates(a, b)` whose sets have at least `share` percent in common."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    both = candidates.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= share * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _stars(links: DataFrame) -> DataFrame:
    """Links as ids that documents share: each pair is named by its first document."""
    return links.select(F.explode(F.array("a", "b")).alias("doc_id"), F.col("a").alias("id"))


def marked(index: DataFrame, sets: DataFrame) -> DataFrame:
    """`index` with the `mark` of each set that is in a long entry, else null."""
    long = index.groupBy("e").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > LONG_ENTRY).select("e")
    owners = index.join(long, "e", "left_semi").select("doc_id").distinct()
    marks = sets.join(owners, "doc_id", "left_semi").select("doc_id", F.expr(
        f"transform(sequence(0, {MARK_WORDS - 1}), j -> aggregate(s, 0L, (a, x) -> CASE WHEN pmod(x, {MARK_WORDS}) = j "
        f"THEN a ^ shiftleft(1L, CAST(pmod(shiftright(x, {MARK_WORDS.bit_length() - 1}), 64) AS INT)) ELSE a END))").alias("mark"))
    return index.join(cut_lineage(marks), "doc_id", "left")


def _fits(share: int) -> Column:
    bits = reduce(add, [F.bit_count(F.get("mark", F.lit(i)).bitwiseXOR(F.get("other_mark", F.lit(i)))) for i in range(MARK_WORDS)])
    few = F.coalesce((100 + share) * bits <= (100 - share) * (F.col("n") + F.col("m")), F.lit(True))
    return ((F.col("late") + F.col("other_late") <= 0) & (100 * F.least("n", "m") >= share * F.greatest("n", "m"))
            & (F.col("label") != F.col("other_label")) & few)


def groups_of_similar(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """`(doc_id, label)` for every one of `sets(doc_id, s)` that has a partner of at least `share` percent: the first id reachable over such
    links. Sets must be distinct and not empty."""
    sets = cut_lineage(sets.select("doc_id", "s"))
    index = cut_lineage(marked(cut_lineage(prefix_index(sets, share)), sets))
    groups = sets.select("doc_id", F.col("doc_id").alias("label")).limit(0)
    links = None
    hubs = 1
    while True:
        labelled = cut_lineage(index.join(groups, "doc_id", "left").select(
            "e", "doc_id", "n", "late", "mark", F.coalesce("label", "doc_id").alias("label")))
        # Two members that both stand late never fit.
        per_label = labelled.groupBy("e", "label").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("late") > 0).alias("p"))
        per_entry = cut_lineage(per_label.groupBy("e").agg(
            F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") - F.col("p") * F.col("p")).alias("kk"), F.sum("p").alias("p"))
            .select("e", "k", ((F.col("k") * F.col("k") - F.col("p") * F.col("p") - F.col("kk")) / 2).alias("pairs")).filter("pairs > 0"))
        left, rows = per_entry.agg(F.sum("pairs"), F.sum("k")).first()
        if not left:
            return groups
        last = left <= PAIRS_FOR_ENTRY * hubs * rows
        partners = labelled.select("e", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("late").alias("other_late"), F.col("mark").alias("other_mark"), F.col("label").alias("other_label"))
        open_ = join_reduced(labelled, per_entry.select("e", F.ceil(F.col("k") / PART).alias("_parts")), "e")
        if last:
            # Members of a long entry are dealt out, its partners go to each part: no task pairs a whole entry.
            dealt = open_.withColumn("_part", F.pmod(F.xxhash64("doc_id"), "_parts")).drop("_parts")
            spread = join_reduced(partners, per_entry.select("e", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / PART) - 1)).alias("_part")), "e")
            met = dealt.join(spread, ["e", "_part"]).filter((F.col("doc_id") < F.col("b")) & _fits(share)).select(F.col("doc_id").alias("a"), "b")
        else:
            order = [F.col("other_late")] if hubs == 1 else []
            by = W.partitionBy("e").orderBy(*order, F.xxhash64("b", F.lit(hubs)))
            held = partners.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= hubs).drop("_rn")
            met = join_reduced(open_, held, "e").filter(_fits(share)).select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))
        fresh = cut_lineage(confirmed(cut_lineage(met.distinct()), sets, share))
        if not fresh.isEmpty():
            links = fresh if links is None else links.union(fresh)
            groups = connected_groups(_stars(links))
        hubs *= 2
        if last:
            return groups


def near_duplicate_groups(docs: DataFrame, text: str = "text", share: int = SHARE) -> DataFrame:
    """`(doc_id, group_id, resemblance)` for each document that is linked, over sets of at least `share` percent in common, to another one.
    The group has the id of its first document; resemblance is the exact share with that document's set."""
    docs = docs.select("doc_id", text)
    owner = cut_lineage(classes(with_word_sets(docs, text, "s")))
    firsts = owner.select(F.col("first").alias("doc_id")).distinct()
    sets = cut_lineage(with_word_sets(docs.join(firsts, "doc_id", "left_semi"), text, "s").select("doc_id", "s"))
    similar = groups_of_similar(sets, share)
    several = owner.groupBy("first").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(F.col("first").alias("doc_id"))
    alone = several.join(similar, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("label"))
    labels = cut_lineage(similar.select("doc_id", "label").union(alone))
    own = labels.join(sets, "doc_id")
    heads = labels.filter("doc_id = label").join(sets, "doc_id").select("label", F.col("s").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    share_of = own.join(heads, "label").select(F.col("doc_id").alias("first"), F.col("label").alias("group_id"),
                                               F.round(common / (F.size("s") + F.size("t") - common), 6).alias("resemblance"))
    return owner.join(share_of, "first").select("doc_id", "group_id", "resemblance")
