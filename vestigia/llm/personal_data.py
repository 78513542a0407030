"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how reliable each
labeler is, and a span classifier is trained on the resulting soft labels.

Two passes over the texts, both row-local. The first counts candidates by cell (kind, votes, length and digit class): at most
KINDS * 3^LABELERS * 9 cells, summed by Spark over all documents. From the cells the driver estimates the labelers and trains the
classifier. The second pass finds the spans again and keeps those that are valid by their base pattern and those that the
classifier accepts.

Rows: a null text counts as empty and has no spans; texts are read whole and in linear time (e-mail addresses are
searched from each `@`, runs of digits from their first digit). Offsets are code points, the end exclusive. Equal rows get equal
results. Other columns pass through `masked` untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
LABELERS = ("pattern", "context", "gazetteer", "edges", "checksum")
ACCEPT = 0.9
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HIDDEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{2,24})+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w.-])")
_SECRET = re.compile(r"(?:token|secret|passwd|password|api_?key|access_?key)[\"']? ?[=:] ?[\"']?([A-Za-z0-9_/+=-]{16,})")
_SECRET_WORDS = ("token", "secret", "passw", "key")
# Gazetteers and context words.
_TOP_DOMAINS = set("com org net edu gov mil int info biz io co de fr es it nl uk us ca au jp cn br in ru ch at be se no dk fi pl pt".split())
_FOR = {
    "email": ("mail", "contact", "write to", "reach"), "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "payment", "account"), "phone": ("tel", "phone", "call", "fax", "mobile", "contact"),
    "secret": ("token", "secret", "password", "key", "auth"),
}
_AGAINST = ("version", "release", "isbn", "issn", "doi", "section", "figure", "page ", "order no", "invoice no", "sha", "md5", "commit")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    floor = 0
    while at >= 0:
        run = text[max(last, floor):at]
        local = len(run) - len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
            last = domain.end()
        floor, at = at + 1, text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


class _Covered:
    """Spans, searched for one that meets another span by bisection."""

    def __init__(self, found: Iterable[tuple[int, int]]):
        ordered = sorted(found)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """`(kind, start, end, valid)`: all base matches, and further spans that may be personal data."""
    found: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        found += [(0, a, b, True) for a, b in _emails(text)]
    if "(at)" in text or "[at]" in text or "( at )" in text or "[ at ]" in text:
        found += [(0, *m.span(), False) for m in _HIDDEN_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(1, *m.span(), all(map(_small, m[0].split(".")))) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19:
                    found.append((2, *m.span(), len(digits) >= 16 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = sum(c.isdigit() for c in m[0])
                if digits <= 15:
                    found.append((3, *m.span(), digits >= 8))
        strict = _Covered((a, b) for _, a, b, ok in found if ok)
        found += [(3, *m.span(), False) for m in _LOCAL_PHONE.finditer(text) if not strict.meets(*m.span())]
    if ("=" in text or ":" in text) and any(w in text for w in _SECRET_WORDS):
        found += [(4, *m.span(1), False) for m in _SECRET.finditer(text)]
    return found


def votes(text: str, kind: int, start: int, end: int, valid: bool) -> tuple[int, ...]:
    """One vote a labeler: 1 personal, -1 not, 0 no opinion."""
    span, before = text[start:end], text[max(0, start - 40):start].lower()
    name = KINDS[kind]
    pattern = 0 if kind == 4 or (kind in (0, 3) and not valid) else 1 if valid else -1
    context = 1 if any(w in before for w in _FOR[name]) else -1 if any(w in before for w in _AGAINST) else 0
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 0:
        known = 1 if re.split(r"[.\s\])]+", span)[-1].lower() in _TOP_DOMAINS else 0
        check = -1 if ".." in span else 0
    elif kind == 1:
        first = span.split(".")[0]
        known = -1 if first in ("0", "127", "255") else 0
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1 if valid else -1
    elif kind == 2:
        known = 1 if digits[0] in "3456" else -1
        check = 1 if luhn(digits) else -1
    elif kind == 3:
        known = -1 if digits[0] == "0" and span[0] == "+" else 1 if span[0] == "+" else 0
        check = 1 if 10 <= len(digits) <= 13 else -1 if len(digits) < 8 else 0
    else:
        known = -1 if re.fullmatch(r"[a-z_-]+|[A-Z_-]+", span) else 0
        check = 1 if len(set(span)) >= 10 and digits else -1
    edge = text[start - 1:start] + text[end:end + 1]
    edges = -1 if any(c.isalnum() or c in "_=/" for c in edge) else 1
    return pattern, context, known, edges, check


def cell(text: str, kind: int, start: int, end: int, valid: bool) -> tuple[int, ...]:
    n = end - start
    share = sum(c in "0123456789" for c in text[start:min(end, start + 64)]) / max(1, min(n, 64))
    return kind, *votes(text, kind, start, end, valid), (n > 12) + (n > 24), (share > 0.3) + (share > 0.9)


_CELL = ["kind", *LABELERS, "long", "digits"]


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            counts.update(cell(text, *c) for c in candidates(text or ""))
    rows = [(*k, n) for k, n in counts.items()]
    columns = list(zip(*rows)) or [()] * (len(_CELL) + 1)
    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], [*_CELL, "n"])


def reliabilities(ballots: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each ballot's span is personal: a two-class model in which every labeler has a distribution of votes
    for either class, fitted by expectation-maximisation from labelers that are right in most cases."""
    p = np.clip(0.5 + 0.2 * ballots.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        log = np.log(weight.sum(1) + 1)[:, None] + np.zeros((2, len(n)))
        for j in range(ballots.shape[1]):
            for v in (-1, 0, 1):
                hit = ballots[:, j] == v
                # Pseudo-counts say that a labeler is right four times out of five.
                prior = {-1: (4.0, 1.0), 0: (1.0, 1.0), 1: (1.0, 4.0)}[v]
                for c in (0, 1):
                    total = weight[c].sum() + 6.0
                    log[c, hit] += math.log((weight[c, hit].sum() + prior[c]) / total)
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return p


def _features(cells: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(cells))]
    columns += [cells[:, 0] == k for k in range(1, len(KINDS))]
    for j in range(1, 1 + len(LABELERS)):
        columns += [cells[:, j] == 1, cells[:, j] == -1]
    columns += [cells[:, k] == v for k in (-2, -1) for v in (1, 2)]
    return np.stack(columns, 1).astype(float)


def train(docs: DataFrame) -> set[tuple[int, ...]]:
    """The cells whose spans are personal data, learned from all documents."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _count_cells, ", ".join(f"{c} long" for c in [*_CELL, "n"]))
    rows = counted.groupBy(*_CELL).agg(F.sum("n").alias("n")).collect()  # bounded by the number of possible cells
    if not rows:
        return set()
    cells = np.array(sorted(tuple(r[c] for c in _CELL) + (r["n"],) for r in rows))
    cells, n = cells[:, :-1], cells[:, -1].astype(float)
    soft = np.zeros(len(n))
    for k in range(len(KINDS)):
        own = cells[:, 0] == k
        if own.any():
            soft[own] = reliabilities(cells[own, 1:1 + len(LABELERS)], n[own])
    x, w = _features(cells), np.log1p(n)
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # penalised logistic regression on the soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (soft - p)) - 0.1 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return {tuple(map(int, c)) for c, q in zip(cells, p) if q >= ACCEPT}


def spans(text: str, accepted: set[tuple[int, ...]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans `(kind, start, end)`, sorted. An accepted span that meets a base span of its kind is left out."""
    found = candidates(text)
    base = sorted((k, a, b) for k, a, b, valid in found if valid)
    more = [(k, a, b) for k, a, b, valid in found if not valid and cell(text, k, a, b, False) in accepted]
    taken = {k: _Covered((a, b) for kk, a, b in base if kk == k) for k in {k for k, _, _ in more}}
    return base, sorted({*base, *((k, a, b) for k, a, b in more if not taken[k].meets(a, b))})


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def annotated(docs: DataFrame, accepted: set[tuple[int, ...]]) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans` for each row."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = [], [], []
            for text in batch["text"].to_pylist():
                base, every = spans(text or "", accepted)
                counts.append([sum(k == i for k, _, _ in base) for i in range(BASE_KINDS)])
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                lists.append(_written(every))
            per_kind = list(zip(*counts)) or [()] * BASE_KINDS
            yield pa.record_batch([batch["doc_id"], *[pa.array(c, pa.int64()) for c in per_kind], pa.array(digests, pa.string()),
                                   pa.array(lists, pa.string())], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], "base_sha256", "spans"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind, like [EMAIL]; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, accepted: set[tuple[int, ...]]) -> DataFrame:
    """`docs` with personal data masked in `text`; all other columns as they are."""
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and mask(t, spans(t, accepted)[1]) for t in batch["text"].to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)


def op6_pii_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return annotated(docs, train(docs))
