"""run() against a brute-force version of its filtering stages and the exact round trip of its last one."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_dups import brute
from vestigia.llm import personal_data, quality_rules
from vestigia.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_run_is_the_brute_force_pipeline(spark):
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    judged = quality_rules.judged(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    left = {r.doc_id: docs[r.doc_id] for r in judged if r.kept}
    assert all(r.fired_rule or r.base_failed for r in judged if not r.kept)
    left = {i: left[i] for i, (_, _, kept) in brute(list(left.items()), 80).items() if kept}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in table(spark, FOLDER, "benchmark").collect():
        w = cut(r.text)
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    for i in list(left):
        w = cut(left[i])
        hit = {q for n in sizes for p in range(len(w) - n + 1) if tuple(w[p:p + n]) in windows for q in range(p, p + n)}
        if hit and 20 * len(hit) >= len(w):
            del left[i]
    kept = table(spark, FOLDER, "documents").filter(F.col("doc_id").isin(list(left)))
    accepted = personal_data.train(kept)
    want = {i: personal_data.mask(t, personal_data.spans(t, accepted)[1]) for i, t in left.items()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.decoded == r.text and r.piece_ids for r in rows)
    assert 20 < len(rows) < len(docs)
