"""Packing: every id in exactly one piece, limits kept, no padding, and the order in which the heuristic chooses."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm import samples
from tokenizers import Tokenizer

from vestigia.llm import packing, unit_ids
from vestigia.llm.packing import Example, Limits, Packer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Don't STOP'LL it's", "É é ǅ Σς ΑΣ İ", "a b　c d\x1ce", "<|endoftext|> x<|startoftext|>y", "\x00\x01 \x7f~", "x" * 300 + "1234567890" * 30,
       "नमस्ते दुनिया 你好 1½²", "tab\tnew\r\nline", "'s 's's're", "A1b2_c-d.e"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def is_unpadded(n):
    return n == 4096 or n & (n - 1) == 0


def check(pieces, wanted):
    """`wanted`: ids of each row, with the end id."""
    left = sorted(range(len(wanted)), key=lambda i: len(wanted[i]))
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])])[:-1].tolist()
        assert len(own) <= 64 and sum(p.length for p in own) <= 4096 and is_unpadded(sum(p.length for p in own)) and min(p.length for p in own) > 0
    assert sum(p.length for p in pieces) == sum(map(len, wanted)) and left is not None
    return by_doc


def test_documents(spark, tmp_path):
    rows = samples.TEXTS + [(100 + i, t) for i, t in enumerate(ODD)]
    folder = samples.write_tables(spark, tmp_path, samples.clashing(samples.documents(spark, rows)).repartition(3))
    got = packing.op11_vector_packing(spark, folder).collect()
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc = check(got, [w for ws in wanted.values() for w in ws])
    for i, ws in wanted.items():
        for size in {len(w) for w in ws}:
            same = [w for w in ws if len(w) == size]
            own = sorted(by_doc[i, size], key=lambda p: p.start)
            assert sum(p.length for p in own) == size * len(same)
            if len(same) == 1:
                assert [p.start for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])])[:-1].tolist()
                assert [p.ids_crc32 for p in own] == [crc(same[0][p.start:p.start + p.length]) for p in own]


def test_small_slices_and_little_cache_give_the_same_ids(monkeypatch):
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(unit_ids, "CACHE", 40)
    encoder = unit_ids.word_level(open(PATH, encoding="utf-8").read())
    texts = ODD * 3 + [t or "" for _, t in samples.TEXTS if not t or len(t) < 3000]
    for a in range(0, len(texts), 4):
        ids, n = encoder.encode(pa.array(texts[a:a + 4]))
        ends = np.cumsum(n)
        for t, e, k in zip(texts[a:a + 4], ends, n):
            assert ids[e - k:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(min_codepoint=0x21, max_codepoint=0x180)), max_size=12), max_size=8))
def test_any_text_has_the_ids_of_the_library(texts):
    import pyarrow as pa

    encoder = _ENCODERS.setdefault("word", unit_ids.word_level(open(PATH, encoding="utf-8").read()))
    tokenizer = _ENCODERS.setdefault("library", Tokenizer.from_file(PATH))
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    assert [ids[e - k:e].tolist() for e, k in zip(ends, n)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODERS = {}


def examples(rng, count):
    out = []
    for i in range(count):
        n = int(rng.integers(1, 9000 if i % 10 == 0 else 700))
        mask = None if i % 3 == 0 else np.concatenate([[0], np.cumsum(rng.random(n) < rng.choice([0.05, 0.5, 0.95]))])
        out.append(Example(i, np.arange(n, dtype=np.uint32) + 10_000 * i, mask))
    return out


@pytest.mark.parametrize("limits", [Limits(), Limits(1024, 4, 300), Limits(512, 64, 512), Limits(4096, 3, 4096)])
def test_limits_hold_together(limits):
    all_of = examples(np.random.default_rng(1), 900)
    whole = {e.key: (e.ids.copy(), e.before) for e in all_of}
    packer = Packer(limits, 128)
    rows = [packing._row(0, s) for e in all_of for s in packer.add(e)] + [packing._row(0, s) for s in packer.finish()]
    seen = []
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        n = r["n_tokens"]
        assert n == len(ids) and (n == limits.tokens or n & (n - 1) == 0)
        assert n <= limits.tokens and len(r["pieces"]) <= limits.segments and r["n_loss"] <= limits.loss
        mask = np.unpackbits(np.frombuffer(r["loss_bits"], np.uint8))[:n]
        assert mask.sum() == r["n_loss"]
        for p in r["pieces"]:
            own, before = whole[p["doc_id"]]
            a, b = p["start"], p["start"] + p["length"]
            assert ids[p["offset"]:p["offset"] + p["length"]].tolist() == own[a:b].tolist() and p["doc_tokens"] == len(own)
            want = np.ones(b - a) if before is None else np.diff(before[a:b + 1])
            assert mask[p["offset"]:p["offset"] + p["length"]].tolist() == want.tolist()
        seen.append(ids)
    assert sorted(np.concatenate(seen).tolist()) == sorted(np.concatenate([o for o, _ in whole.values()]).tolist())


def test_the_dot_product_mixes_demands():
    """Examples of much loss and of little: each kind alone leaves a limit unused, together both are met."""
    heavy = [Example(i, np.zeros(200, np.uint32), None) for i in range(64)]
    light = [Example(100 + i, np.zeros(800, np.uint32), np.zeros(801, np.int64)) for i in range(64)]
    packer = Packer(Limits(1000, 64, 200), 128)
    rows = [packing._row(0, s) for e in heavy + light for s in packer.add(e)] + [packing._row(0, s) for s in packer.finish()]
    assert len(rows) == 64 and all(r["n_tokens"] == 1000 and r["n_loss"] == 200 and len(r["pieces"]) == 2 for r in rows)


def test_parts_without_loss(spark):
    rows = [(1, [("user text here", False), ("the answer", True)]), (2, [("no loss", False)]), (3, None), (None, [(None, None), ("x", None)])]
    df = spark.createDataFrame(rows, "doc_id long, parts array<struct<text: string, loss: boolean>>").coalesce(1)
    got = packing.packed(df, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    n = {t: len(tokenizer.encode(t).ids) for t in ("user text here", "the answer", "no loss", "x")}
    pieces = [p for r in got for p in r.pieces]
    loss = {k: sum(p.loss for p in pieces if p.doc_id == k) for k in (1, 2, 3, None)}
    assert loss == {1: n["the answer"] + 1, 2: 1, 3: 1, None: n["x"] + 1}
    assert sum(r.n_loss for r in got) == sum(loss.values()) and spark.createDataFrame(got).agg(F.sum("n_tokens")).first()[0] == sum(n.values()) + 4
