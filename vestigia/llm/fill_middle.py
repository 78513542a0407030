"""Fill-in-middle rewriting of texts that are stored as seekable compressed frames.

A text is kept as independent zstandard frames of at most FRAME_BYTES bytes, with running numbers of units and characters at the end of
each frame. A unit is a word with the blanks before it, or the blanks that end a text. To rewrite a text, only the frames that hold
the two cuts are decompressed; all others are moved as they are. The frames of a result, one after the other, are again a
zstandard stream; digests read it frame by frame.

Rows: a null or empty text has no frames, no units and stays plain. A null id counts as an empty string. Repeated rows are rewritten
each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import stored, table
from vestigia.llm.words import _BLANK, blank_words, slices, text_bytes

FRAME_BYTES = 1 << 16
LEVEL = 3
SEED, PLAIN_FROM, SPM_BELOW = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = re.compile(rb"<[PSM]>")
SEEKABLE = "doc_id long, n long, marked boolean, frames binary, frame_ends array<long>, unit_ends array<long>, char_ends array<long>"
REWRITTEN = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames binary, frame_ends array<long>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def frame_cuts(data: np.ndarray, size: int) -> list[int]:
    """Ends of the frames of one text: at most `size` bytes each, never inside a character."""
    cuts, at = [], 0
    while at < len(data):
        at = min(at + size, len(data))
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    return cuts


def seekable(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The texts of `docs(doc_id, text)` as frames with running counts."""
    size = max(4, frame_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for a, b in slices(batch["text"]):
                data, offsets = text_bytes(batch["text"][a:b])
                starts, lengths, first = blank_words(data, offsets)
                ends = starts + lengths
                rows = []
                for i, doc_id in enumerate(batch["doc_id"][a:b].to_pylist()):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    text = data[lo:hi]
                    own = ends[first[i]:first[i + 1]] - lo
                    n = len(own) + int(hi > lo and _BLANK[text[-1]])
                    cuts = frame_cuts(text, size)
                    parts = [text[p:q] for p, q in zip([0, *cuts], cuts)]
                    packed = [pack(p.tobytes()) for p in parts]
                    units = np.searchsorted(own, cuts, "right")
                    units[-1:] = n
                    chars = np.cumsum([np.count_nonzero(p & 0xC0 != 0x80) for p in parts], dtype=np.int64)
                    rows.append({"doc_id": doc_id, "n": n, "marked": MARK.search(text.tobytes()) is not None, "frames": b"".join(packed),
                                 "frame_ends": np.cumsum([len(p) for p in packed], dtype=np.int64), "unit_ends": units, "char_ends": chars})
                yield pa.RecordBatch.from_pylist(rows, _arrow(SEEKABLE))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SEEKABLE)


class Frames:
    """The frames of one text; the last one read stays decompressed."""

    def __init__(self, data: bytes, ends: list[int]):
        self.data, self.ends, self.starts = memoryview(data), ends, [0, *ends[:-1]]
        self.kept = (-1, b"")

    def packed(self, k: int) -> memoryview:
        return self.data[self.starts[k]:self.ends[k]]

    def raw(self, k: int) -> bytes:
        if self.kept[0] != k:
            self.kept = (k, zstandard.ZstdDecompressor().decompress(self.packed(k)))
        return self.kept[1]

    def stream(self) -> Iterator[bytes]:
        for k in range(len(self.ends)):
            yield self.raw(k)

    def bytes_between(self, a: int, b: int) -> Iterator[bytes]:
        """The bytes from a to b of the text; frames outside are not decompressed."""
        at = 0
        for k in range(len(self.ends)):
            size = zstandard.get_frame_parameters(self.packed(k)).content_size
            lo, hi = max(a - at, 0), min(b - at, size)
            if lo < hi:
                yield self.raw(k)[lo:hi]
            at += size


def _cut(frames: Frames, units: list[int], chars: list[int], k: int) -> tuple[int, int, int]:
    """`(frame, byte in the frame, characters before)` where the k-th unit ends. Decompresses that frame alone."""
    if k == 0:
        return 0, 0, 0
    f = int(np.searchsorted(units, k))
    chars_before = chars[f - 1] if f else 0
    raw = frames.raw(f)
    inner = k - (units[f - 1] if f else 0) - 1
    if k == units[-1]:
        return f, len(raw), chars[f]
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    at = int(ends[inner]) if inner < len(ends) else len(raw)
    part = np.frombuffer(raw, np.uint8, at)
    return f, at, chars_before + int(np.count_nonzero(part & 0xC0 != 0x80))


def _pieces(frames: Frames, a: tuple[int, int, int], b: tuple[int, int, int], pack) -> Iterator[bytes]:
    """Frames of the text between two cuts: whole frames as they are, cut ones packed anew."""
    for k in range(a[0], min(b[0] + 1, len(frames.ends))):
        lo, hi = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
        if lo == 0 and hi is None:
            yield bytes(frames.packed(k))
        elif (part := frames.raw(k)[lo:hi]):
            yield pack(part)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def rewritten(archive: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Each text of a seekable archive as plain, prefix-suffix-middle or suffix-prefix-middle, again as frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        marks = {m: pack(m) for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = []
                for r in batch.slice(start, 1000).to_pylist():
                    n, frames = r["n"], Frames(r["frames"], r["frame_ends"])
                    h1, h2, h3, h4 = draws(r["doc_id"], seed)
                    out = {"doc_id": r["doc_id"], "n": n, "form": "plain", "frames": r["frames"], "frame_ends": r["frame_ends"]}
                    if n and not r["marked"] and h3 % 100 < plain_from:
                        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                        a = _cut(frames, r["unit_ends"], r["char_ends"], first)
                        b = _cut(frames, r["unit_ends"], r["char_ends"], second)
                        end = (len(frames.ends), 0, 0)
                        prefix, middle, suffix = (list(_pieces(frames, *x, pack)) for x in (((0, 0, 0), a), (a, b), (b, end)))
                        if h4 % 100 < spm_below:
                            parts = [marks[SUFFIX], *suffix, marks[PREFIX], *prefix, marks[MIDDLE], *middle]
                        else:
                            parts = [marks[PREFIX], *prefix, marks[SUFFIX], *suffix, marks[MIDDLE], *middle]
                        out |= {"form": "spm" if h4 % 100 < spm_below else "psm", "prefix_chars": a[2], "middle_chars": b[2] - a[2],
                                "frames": b"".join(parts), "frame_ends": np.cumsum([len(p) for p in parts])}
                    rows.append(out)
                yield pa.RecordBatch.from_pylist(rows, _arrow(REWRITTEN))

    return archive.mapInArrow(run, REWRITTEN)


def mark_places(frames: Frames) -> dict[bytes, int]:
    """Where each mark begins, in one pass that holds one frame and the two bytes before it."""
    found, at, tail = {}, 0, b""
    for raw in frames.stream():
        piece = tail + raw
        for m in MARK.finditer(piece):
            found.setdefault(m[0], at - len(tail) + m.start())
        tail, at = piece[-2:], at + len(raw)
    return found


def restored(frames: Frames, form: str) -> Iterator[bytes]:
    """The bytes of the text before it was rewritten, in order; only the result and its form are read."""
    if form == "plain":
        yield from frames.stream()
        return
    at = mark_places(frames)
    total = sum(zstandard.get_frame_parameters(frames.packed(k)).content_size for k in range(len(frames.ends)))
    order = sorted([(p, m) for m, p in at.items()])
    span = {m: (p + len(m), q) for (p, m), q in zip(order, [*(p for p, _ in order[1:]), total])}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from frames.bytes_between(*span[mark])


def _sha256(parts: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


def digests(results: DataFrame) -> DataFrame:
    """SHA-256 of each rewritten text and of the text rebuilt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = []
                for r in batch.slice(start, 1000).to_pylist():
                    frames = Frames(r.pop("frames"), r.pop("frame_ends"))
                    rows.append(r | {"output_sha256": _sha256(frames.stream()), "restored_sha256": _sha256(restored(frames, r["form"]))})
                yield pa.RecordBatch.from_pylist(rows, _arrow(DIGESTS))

    return results.mapInArrow(run, DIGESTS)


def texts(results: DataFrame) -> DataFrame:
    """`(doc_id, form, text)`: the rewritten texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = b"".join(Frames(r["frames"], r["frame_ends"]).stream()).decode()
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "form": r["form"], "text": text}],
                                                 _arrow("doc_id long, form string, text string"))

    return results.mapInArrow(run, "doc_id long, form string, text string")


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return digests(rewritten(stored(seekable(table(spark, folder, "documents")), "frames")))


_BLANKS, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_H = "('0x' || substr(h, {}, 8))::BIGINT"
ORACLE = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANKS}*{_WORD}+|{_BLANKS}+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p"""
