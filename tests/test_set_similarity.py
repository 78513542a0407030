"""Groups of similar texts against all pairs."""

import random
import re

import pytest

from vestigia.operators import set_similarity as ss


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(texts, share=80):
    sets = sets_of(texts)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids, linked = sorted(i for i in sets if sets[i]), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                linked |= {a, b}
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (root(i), round(len(sets[i] & sets[root(i)]) / len(sets[i] | sets[root(i)]), 6)) for i in linked}


def found(spark, texts, share=80):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return {r.doc_id: (r.group_id, r.resemblance) for r in ss.near_duplicate_groups(df, "text", share).collect()}


def drifting(rng, count, words, changes):
    """Versions of a text, each made from an earlier one by a few changed words."""
    made = [[f"w{rng.randrange(5000)}" for _ in range(words)]]
    while len(made) < count:
        new = list(rng.choice(made))
        for _ in range(rng.randrange(changes + 1)):
            new[rng.randrange(words)] = f"w{rng.randrange(5000)}"
        made.append(new)
    return [" ".join(m) for m in made]


def test_pairs_around_the_share_and_short_copies(spark):
    rng = random.Random(5)
    texts = [t for _ in range(8) for t in drifting(rng, 5, 60, 3)]
    # Twenty-four words: 20 shingles. One changed word at the end costs one of each: 19 of 21 stay; further in it costs more.
    base = [f"b{i}" for i in range(24)]
    texts += [" ".join(base), *[" ".join([*base[:k], "other", *base[k + 1:]]) for k in (23, 22, 21, 20, 10)]]
    texts += ["six words are here for copies", "SIX words\tare here for  copies", "one word", "One  word", "", None, " \n", "日本 語", "日本 語", "alone"]
    rows = list(enumerate(texts, 100))
    got = found(spark, rows)
    assert got == brute(rows)
    values = [r for _, r in got.values() if r < 1]
    assert values and min(values) < 0.8 <= max(values)


@pytest.mark.parametrize("factor", [1, 4])
def test_a_large_group_of_different_versions(spark, monkeypatch, factor):
    monkeypatch.setattr(ss, "PAIRS_FOR_ENTRY", factor)
    rng = random.Random(6)
    texts = drifting(rng, 50, 60, 2) + drifting(rng, 12, 60, 9) + ["x y z a b c d"] * 30
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)


def test_another_share_and_empty_tables(spark):
    rng = random.Random(8)
    rows = list(enumerate(drifting(rng, 30, 50, 6)))
    assert found(spark, rows, 50) == brute(rows, 50)
    assert found(spark, []) == {}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS s", "2 AS label", "3 AS first", "4 AS n")
    assert ss.near_duplicate_groups(df.limit(15)).count() == len(brute(rows[:15]))


def versions(rng, base, count, changes):
    """Texts with `changes` words of their own each, five and more words apart."""
    out = []
    for k in range(count):
        new, at = list(base), rng.sample(range(1, len(base) // 5 - 1), changes)
        for i in at:
            new[5 * i] = f"own{k}x{i}"
        out.append(" ".join(new))
    return out


def test_versions_of_one_text_are_not_all_paired(spark, monkeypatch):
    """Each version is linked to the text, or to nothing, and never to another version: pairs do not grow with the square of the versions."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(124)]
    texts = [" ".join(base), *versions(rng, base, 150, 2), *versions(rng, base, 90, 4)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    tried, plain = [], ss.confirmed

    def counted(candidates, sets, share):
        tried.append(candidates.count())
        return plain(candidates, sets, share)

    monkeypatch.setattr(ss, "confirmed", counted)
    assert found(spark, rows) == brute(rows)
    assert sum(tried) < 5 * len(rows) and len(tried) <= 8


@pytest.mark.parametrize("long_entry, part", [(2, 7), (10_000, 1_000)])
def test_marks_and_parts_lose_no_link(spark, monkeypatch, long_entry, part):
    monkeypatch.setattr(ss, "LONG_ENTRY", long_entry)
    monkeypatch.setattr(ss, "PART", part)
    rng = random.Random(10)
    rows = list(enumerate(drifting(rng, 60, 70, 5) + drifting(rng, 20, 30, 2)))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, 60) == brute(rows, 60)
