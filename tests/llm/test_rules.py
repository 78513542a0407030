"""Quality rules, personal data, decontamination, licences, URLs and archives."""

import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest

from tests.llm import samples
from vestigia.llm import decontaminate, licenses, personal_data, quality_rules, url_filter, warc

FOLDER = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"


def repeated(words, span=8):
    where = {}
    for i in range(len(words) - span + 1):
        where.setdefault(tuple(words[i:i + span]), []).append(i)
    return len({p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + span)})


def test_statistics_are_brute_force(spark):
    rng = random.Random(3)
    noise = [(100 + k, " ".join(rng.choice(["a", "b", "c\n", "#x", " y"]) for _ in range(rng.randrange(80)))) for k in range(60)]
    rows = [*samples.TEXTS, *noise]
    got = quality_rules.statistics(samples.clashing(samples.documents(spark, rows)).select("doc_id", "text")).collect()
    want = []
    for i, t in rows:
        w = re.findall(BLANK, t or "")
        lines = [x for x in (t or "").split("\n") if re.search(BLANK, x)]
        n, rep = len(w), repeated(w)
        want.append((i or -1, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep,
                     n < 20 or 100 * rep > 30 * n))
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)


def test_list_learns_what_makes_documents_bad(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))) for _ in range(60)]
        words = [w + "###" for w in words] if bad and i % 2 else [w.upper() + "!!" for w in words] if bad else words
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    seen = spark.createDataFrame(labels[:400], "doc_id long, quality long, toxic long")
    out = quality_rules.judged(spark.createDataFrame(docs, "doc_id long, text string"), seen).filter("doc_id >= 400").collect()
    assert {r.doc_id for r in out if not r.kept} == {i for i in range(400, 600) if i % 5 == 0}
    rules = quality_rules.learn(spark.createDataFrame(docs, "doc_id long, text string"), seen)
    assert rules and all(1 <= len(r) <= quality_rules.MAX_CONDITIONS for r in rules)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_the_patterns(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "@", "x.y@", "@z.de", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824",
             "+12", "++4930123456", " ", ".", "-", "9", "é", "a@b.c@d.e", "0001.0.0.1", "(at)", "\n"]
    rows = [*samples.TEXTS, *((100 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for k in range(400))]
    rows = [(i, t) for i, t in rows if t != samples.MANY_WORDS]
    got = personal_data.annotated(samples.documents(spark, rows), set()).collect()
    want = sorted((i or -1, ",".join(base_spans(t or ""))) for i, t in rows)
    assert sorted((r.doc_id or -1, r.spans) for r in got) == want
    assert {r.base_sha256 for r in got} == {hashlib.sha256(s.encode()).hexdigest() for _, s in want}
    assert all([r.n_email, r.n_ip, r.n_card, r.n_phone] == [r.spans.count(f"{k}:") for k, _ in BASE] for r in got)


def test_many_spans_in_one_text_take_linear_time():
    part = "call 555-123-4567 or +1 202 555 0143 from 10.0.0.1, a@b.co; "
    text = part * 16_000  # about 1 MB, a base span and a local phone every few words
    accepted = {personal_data.cell(text, *c) for c in personal_data.candidates(text)}
    start = time.time()
    base, every = personal_data.spans(text, accepted)
    assert time.time() - start < 30 and len(base) == 48_000 and len(every) == 64_000


def test_covered_spans_are_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        held = [(a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 8)))]
        covered = personal_data._Covered(held)
        for a in range(70):
            b = a + rnd.randint(1, 5)
            assert covered.meets(a, b) == any(x < b and a < y for x, y in held)


def test_reliabilities_follow_the_better_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.7, 0.6])
    ballots = np.where(rng.random((4000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    kinds, counts = np.unique(ballots, axis=0, return_counts=True)
    p = personal_data.reliabilities(kinds, counts.astype(float))
    table = {tuple(k): q >= 0.5 for k, q in zip(kinds, p)}
    guess = np.array([table[tuple(b)] for b in ballots])
    assert (guess == truth).mean() > 0.95 > (ballots[:, 2] == np.where(truth, 1, -1)).mean()


def test_method_adds_secrets_and_masks_them(spark):
    rng = random.Random(5)
    rows = [(i, f'text {i} token = "{rng.getrandbits(128):032x}" mail me at u{i}@mail.example.com or +1 (743) 555-{1000 + i} build 12345678901234') for i in range(200)]
    docs = samples.documents(spark, rows)
    accepted = personal_data.train(docs)
    found = personal_data.annotated(docs, accepted).collect()
    assert all("secret:" in r.spans and "email:" in r.spans and "card:" not in r.spans for r in found)
    assert all(re.fullmatch(r'text \d+ token = "\[SECRET\]" mail me at \[EMAIL\] or \[PHONE\] build 12345678901234', r.text)
               for r in personal_data.masked(docs, accepted).collect())


@pytest.mark.parametrize("block", [decontaminate.SET_ROWS, 3])
def test_windows_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "SET_ROWS", block)
    rng = random.Random(2)
    pool = [f"w{k}" for k in range(6)]
    make = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, make(n)) for k, n in enumerate([16, 3, 13, 1, 5, 40])] + [(90, None), (91, "--"), (92, "w0 w1 w2")]
    docs = [(k, make(rng.randrange(120)).replace(" ", rng.choice([" ", ", ", "\n"]))) for k in range(60)]
    docs += [(200, items[0][1].upper()), (201, None), (202, items[5][1])]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in docs:
        w, hit, named = cut(t), set(), set()
        for item, text in items:
            ws = cut(text)
            size = min(13, len(ws))
            for k in range(len(ws) - size + 1 if ws else 0):
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == ws[k:k + size]:
                        hit |= set(range(p, p + size))
                        named.add(str(item))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert got[i] == (len(w), len(hit), len(named), digest, len(hit) > 0 and 20 * len(hit) >= len(w))


def test_licence_texts(spark):
    apache = ('Copyright X\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance '
              'with the License.\n')
    rows = [(1, apache), (2, "x\nReleased under the MIT License.\nAll rights reserved. All Rights Reserved!"), (3, None), (4, "a licence to kill"),
            (5, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as "
                "published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")]
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in licenses.recognised(samples.clashing(samples.documents(spark, rows))).collect()}
    assert got == {1: (["Apache-2.0"], 0), 2: (["MIT", "Proprietary"], 0), 3: ([], 0), 4: ([], 0), 5: (["GPL-3.0-or-later"], 0)}


def test_language_model_separates_held_out_urls(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(12))
    good = [f"http://a.com/fr/{word('abcdef')}" for _ in range(400)] + [f"http://a.net/x/{word('abcdef')}" for _ in range(50)]
    bad = [f"http://a.com/de/{word('uvwxyz')}" for _ in range(400)] + [f"http://a.net/x/{word('uvwxyz')}" for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judged_urls(rows).filter("rule IS NULL").collect()}
    right = sum(got[i] == "allow" for i in range(400, 450)) + sum(got[i] == "block" for i in range(850, 900))
    assert len(got) == 100 and right >= 97


def test_archives_are_warc_files(spark, tmp_path):
    pages = [(3, "http://c/", "same"), (1, "http://a/\r\nX: y", "same"), (2, None, None), (5, "http://e/", "a\r\n\r\nWARC/1.1\r\nx"), (None, "u", "same")]
    folder = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    found = {h["WARC-Record-ID"]: (h, b) for h, b in warc.parse(gzip.compress(raw[:100]) + gzip.compress(raw[100:]), step=7)}
    assert len(found) == 5 and found["<urn:page:3>"][0]["WARC-Refers-To"] == "<urn:page:1>"
    assert found["<urn:page:5>"][1].endswith(b"\r\n\r\na\r\n\r\nWARC/1.1\r\nx")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: (4, "response", None), 2: (0, "response", None), 3: (4, "revisit", 1), 5: (16, "response", None), None: (4, "response", None)}
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(raw[:-30])))


def test_small_payloads_are_not_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.revisits(warc.with_digest(pages), min_bytes=3).collect()
    assert [(r.page_id, r.refers_to) for r in got] == [(4, 3)]


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rnd = random.Random(8)
    sizes = [rnd.choice((3, 200, 900)) for _ in range(300)] + [5000 + i for i in range(20)] + [60_000, 300_000, 1_000_000]
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * n) for i, n in enumerate(rnd.sample(sizes, len(sizes)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_archives(pages, folder, record_bytes=2_000, file_bytes=40_000)
    files = [list(warc.parse(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert all(sum(len(block) for _, block in f) <= 40_000 or len(f) == 1 for f in files)
    assert sorted(h["WARC-Record-ID"] for f in files for h, _ in f) == sorted(f"<urn:page:{i}>" for i, _, _ in rows)
    whole = str(tmp_path / "one")
    warc.write_archives(pages, whole)
    assert sorted(map(str, warc.read_archives(spark, folder).collect())) == sorted(map(str, warc.read_archives(spark, whole).collect()))
    edges = warc.size_classes(2_000, 40_000)
    assert [low for low, _, _ in edges][1:] == [top for _, top, _ in edges][:-1] and edges[-1] == (40_000, None, 1)
