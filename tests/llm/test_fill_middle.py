"""Fill-in-middle against a plain rewrite of the whole text, with frames of a few bytes so that cuts fall everywhere."""

import hashlib
import re

import pytest
import zstandard
from tests.llm import samples

from vestigia.llm import fill_middle as fm

ODD = [(20 + i, t) for i, t in enumerate([
    " \t\n", "a", " a ", "日本 語  テキスト\n\n終", "<P> marked", "x<S>y", "half <P", "S> < <P <S <M P> S> M> end", "é" * 50, " 　 x ",
    " ".join(f"w{i}" for i in range(500)), "z" * 3000 + " " * 3000 + "y", "a\x0bb\x0cc\x1cd"])]
ROWS = samples.TEXTS + ODD + [(1000 + i, f"some <short {i} texts < <P for > every form{' ' * (i % 3)}") for i in range(60)]


def plain(doc_id, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("size", [4, 64, fm.FRAME_BYTES])
def test_every_form_equals_the_plain_rewrite(spark, size):
    results = fm.rewritten(fm.seekable(samples.clashing(samples.documents(spark, ROWS)), size))
    got = sorted((tuple(r) for r in fm.digests(results).collect()), key=str)
    want = [(i, *plain(i, t)) for i, t in ROWS]
    assert got == sorted(((*w[:5], sha(w[5]), sha(t)) for w, (_, t) in zip(want, ROWS)), key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert sorted((str(r.doc_id), r.text) for r in fm.texts(results).collect()) == sorted((str(w[0]), w[5]) for w in want)


def test_only_cut_frames_are_packed_anew(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    ids = range(2000, 2040)
    archive = fm.seekable(samples.documents(spark, [(i, text) for i in ids]), 1000)
    before = {r.doc_id: r for r in archive.collect()}
    seen = 0
    for r in fm.rewritten(archive).collect():
        old = before[r.doc_id]
        whole = {bytes(old.frames[a:b]) for a, b in zip([0, *old.frame_ends], old.frame_ends)}
        new = [bytes(r.frames[a:b]) for a, b in zip([0, *r.frame_ends], r.frame_ends)]
        changed = [f for f in new if f not in whole]
        assert r.form == "plain" and not changed or r.form != "plain" and len(changed) <= 3 + 4
        seen += r.form != "plain"
        stream = zstandard.ZstdDecompressor().stream_reader(r.frames, read_across_frames=True).read()
        assert stream.decode() == plain(r.doc_id, text)[4]
    assert seen
    assert old.unit_ends[-1] == old.n == 4000 and old.char_ends[-1] == len(text) and len(old.frame_ends) > 20
