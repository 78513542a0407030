import random
import re

import numpy as np
import pytest

from vestigia.llm import near_dups
from vestigia.llm.common import components


def brute(docs, share=85):
    """Sizes and component ids by comparing all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i, _ in docs}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(low)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= share * (len(x) + len(y) - both):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def copies(n, words, seed=1):
    """Chains of copies, each of an earlier one, with a few words changed: many pairs about the threshold."""
    rng = random.Random(seed)
    texts = [[f"v{rng.randrange(5000)}" for _ in range(words)]]
    for _ in range(n - 1):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        texts.append(t)
    out = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rows, blocks", [(copies(120, 80), 256), (copies(150, 60, 2), 8), (copies(90, 200, 3), 16)])
def test_same_groups_as_brute_force(spark, monkeypatch, rows, blocks):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", blocks)
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(rows)


def test_keys_meet_within_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 2**16, near_dups.K, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(near_dups.K, near_dups.RADIUS, replace=False)] ^= np.uint16(1)
        x, y = near_dups.keys(np.stack([a, b]))
        assert set(x) & set(y)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("reach", [1, 3])
def test_shuffled_chain_is_one_component(spark, reach):
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    edges = [(ids[i], ids[i + k]) for k in range(1, reach + 1) for i in range(len(ids) - k)] + [(5000, 4000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, 0), 4000: 4000, 5000: 4000}


def test_layout_keeps_the_chances():
    assert near_dups.layout(85) == (near_dups.CHUNKS, 24)
    chunks, far = near_dups.layout(80)
    assert chunks == 14 and 24 < far < chunks * near_dups.SLOTS


def test_share_drops_copies_between_the_two_shares(spark):
    rng = random.Random(9)
    rows, share = [], []
    for k in range(60):
        words = [f"g{k}v{rng.randrange(10**6)}" for _ in range(204)]
        other = list(words)
        for at in rng.sample(range(20, 180, 20), 4 if k % 2 else 6):  # 200 shingles, of which 20 or 30 are others
            other[at] = f"x{at}"
        a, b = ({tuple(w[i:i + 5]) for i in range(200)} for w in (words, other))
        share.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert {0.8 <= s < 0.85 for s in share} == {True, False} and min(share) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dups.distinct_documents(docs, 80).collect()}
    assert kept == {2 * k for k in range(60)} | {2 * k + 1 for k in range(60) if share[k] < 0.8}
    assert near_dups.near_duplicates(docs).filter("kept").count() == 120
