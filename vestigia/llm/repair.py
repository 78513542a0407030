"""Repair of the role structure of conversations by an auction over the lattice of edits.

A node of the lattice is a place between rows together with a state of the role pattern `(s?(ua)+)?`; arcs keep, rerole or delete the
next row, or insert an empty one, at whole-number costs. The auction holds a price for every node, never above the cost of an arc plus the price of its
end, and a path of tight arcs. Where the path's last node has no tight arc its price is raised and the path contracted by one node; else the path is
extended along the tight arc. When the path reaches the end of the lattice, the prices of its nodes are exact distances, so the tight
arcs are those of all cheapest repairs; the one with the ASCII-least initials is traced along them. The rows are worked through in
stretches of STRETCH from the last to the first, as prices depend on later rows only; time is linear in the rows.

Rows are sorted over all tasks by conversation and turn, so a large conversation lies in many tasks. Conversations that lie wholly in one
task are repaired there. Others are cut into pieces of at most PIECE_ROWS rows: repeated rows are found by grouping, each piece gives the
4 x 4 costs between its borders, these are joined per conversation, and a last pass reads the pieces in order. That the whole
conversation passes one task there, piece by piece, is due to its digest and to the audit being one value, which also bounds the
number of pieces by 2^31 / PIECE_ROWS.

Rows: null roles and texts count as one space, a null turn comes first and is left out of the gaps, a null conv_id is a conversation of its own. Rows
of equal turn are ordered by role and then by a hash of the text; repeated rows are duplicates. A conversation whose rows are all
lost has zeros and an empty audit. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import stored, table

PIECE_ROWS, PIECE_CHARS = 4096, 1_000_000
STRETCH = 24
KEPT = 50_000
# States of the role pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (0, 4, 2, 0)  # cost of the inserted rows that a state still needs at the end
ENDING = ("", "II", "I", "")
FAR = 32  # states never differ by as much in their distance to the end
# Costs, and faults of a row: none, cut off, to be deleted.
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
FINE, TRUNCATED, WORTHLESS = range(3)
INITIALS = {"s": 0, "u": 1, "a": 2}
BLANKS = " \t\n\x0b\x0c\r"
NEXT_ROLE = (USER, USER, ASSISTANT, USER)
ROLE_NAME = {USER: "user", ASSISTANT: "assistant"}


def row_code(role: str, fault: int) -> int:
    """All that the lattice needs of a row, in one byte."""
    return 3 * INITIALS.get(role[:1], 3) + fault


def kept_state(state: int, code: int) -> int | None:
    """The state after keeping a row, if the pattern allows it."""
    initial = code // 3
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT_ROLE[state] if initial == NEXT_ROLE[state] - 1 else None


def _arcs() -> list[list[list[tuple[str, int, int, int]]]]:
    """By row code and state, in ASCII order: `(initial, cost, rows read, next state)`."""
    out = []
    for code in range(12):
        fault = code % 3
        per_state = []
        for state in range(4):
            arcs = [("D", DELETE_COST, 1, state), ("I", INSERT_COST, 0, NEXT_ROLE[state])]
            if fault != WORTHLESS:
                extra = TRUNCATED_COST * (fault == TRUNCATED)
                if (after := kept_state(state, code)) is not None:
                    arcs.append(("K", KEEP_COST + extra, 1, after))
                arcs.append(("R", REROLE_COST + extra, 1, NEXT_ROLE[state]))
            per_state.append(arcs)
        out.append(per_state)
    return out


ARCS = _arcs()
LEAST = [min(cost for per_state in ARCS[code] for _, cost, rows, _ in per_state if rows) for code in range(12)]


def _auction(codes: bytes, price: list[list[int]], stop: int, start: int, state: int) -> None:
    """Raises prices until a path of tight arcs leads from `(start, state)` to row `stop`, whose prices are exact."""
    path = [(start, state)]
    while path[-1][0] < stop:
        row, state = path[-1]
        best, to = min((cost + price[row + ahead][after], (row + ahead, after)) for _, cost, ahead, after in ARCS[codes[row]][state])
        if price[row][state] < best:
            price[row][state] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def prices(codes: bytes, final: tuple[int, ...] = FINAL) -> list[list[int]]:
    """Feasible prices of all nodes, exact on every cheapest way from any state before the first row. `final`: exact prices at the end."""
    price = [[0] * 4 for _ in codes] + [list(final)]
    stop = len(codes)
    while stop:
        start = max(0, stop - STRETCH)
        low = min(price[stop])
        for row in range(stop - 1, start - 1, -1):  # what the rows cost at least is a feasible price
            low += LEAST[codes[row]]
            price[row] = [low] * 4
        for state in range(4):
            _auction(codes, price, stop, start, state)
        stop = start
    return price


def trace(codes: bytes, price: list[list[int]], state: int) -> tuple[str, int]:
    """The ASCII-least initials along tight arcs from `state` before the first row, and the state after the last."""
    n = len(codes)
    # A node is on a cheapest way if a tight arc leads to one that is; rows alone decide the order, inserts need two looks.
    good = [[False] * 4 for _ in codes] + [[True] * 4]
    for row in range(n - 1, -1, -1):
        for _ in range(3):
            for q in range(4):
                good[row][q] = good[row][q] or any(
                    price[row][q] == cost + price[row + ahead][after] and good[row + ahead][after] for _, cost, ahead, after in ARCS[codes[row]][q])
    out, row = [], 0
    while row < n:
        for letter, cost, ahead, after in ARCS[codes[row]][state]:
            if price[row][state] == cost + price[row + ahead][after] and good[row + ahead][after]:
                out.append(letter)
                row, state = row + ahead, after
                break
    return "".join(out), state


def costs_between(codes: bytes) -> list[int]:
    """16 numbers: from each state before the first row to each state after the last, by state and end state. What is FAR or more above the
    best end of its state is never part of a cheapest repair and only known to be that far."""
    columns = [prices(codes, tuple(0 if q == end else FAR for q in range(4)))[0] for end in range(4)]
    return [columns[end][q] for q in range(4) for end in range(4)]


def entry_costs(matrix: list[int], after: list[int]) -> list[int]:
    """Distances to the end before a piece, from those after it."""
    return [min(matrix[4 * q + end] + after[end] for end in range(4)) for q in range(4)]


def apply(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired rows as `role:text`."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = NEXT_ROLE[state]
            yield ROLE_NAME[state] + ":"
            continue
        role, text = rows[at]
        at += 1
        if letter == "R":
            state = NEXT_ROLE[state]
            yield f"{ROLE_NAME[state]}:{text}"
        elif letter == "K":
            state = SYSTEM if state == START and role[:1] == "s" else NEXT_ROLE[state]
            yield f"{role}:{text}"


def fault_of(text: str) -> int:
    """Blank texts are worthless; others are truncated unless they end with a sentence mark."""
    solid = text.rstrip(BLANKS)
    return WORTHLESS if not solid else FINE if solid[-1] in ".!?" else TRUNCATED


def is_legal(first: str, second: str) -> bool:
    return first[:1] + second[:1] in ("su", "ua", "au")


def row_digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def damaged(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text, lost, _copy`: rows after the damage that the checksum of `conv_id:turn` selects. Lost rows stay as
    marks without text, so that every conversation is seen."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", "lost", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"))


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
FIRST_PASS = RESULT + ", open boolean, part long, no long, roles array<string>, texts array<string>, turns array<long>, lost long"
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
          "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


class Solver:
    """Repairs of whole conversations; results of equal code sequences are kept."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, str]] = {}

    def __call__(self, codes: bytes) -> tuple[int, str]:
        if codes not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            price = prices(codes)
            audit, state = trace(codes, price, START)
            self.known[codes] = price[0][START], audit + ENDING[state]
        return self.known[codes]


def whole_result(conv_id: int | None, rows: list[tuple[int | None, str, str]], solve: Solver) -> dict:
    """One conversation from its rows `(turn, role, text)` in order."""
    seen, codes = set(), bytearray()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = fault_of(text)
        if fault == WORTHLESS:
            counts["blank"] += 1
        elif (role, text) in seen:
            counts["duplicate"] += 1
            fault = WORTHLESS
        elif fault == TRUNCATED:
            counts["truncated"] += 1
        seen.add((role, text))
        codes.append(row_code(role, fault))
    cost, audit = solve(bytes(codes))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(role, text) for _, role, text in rows]
    return {"conv_id": conv_id, **counts, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "cost": cost, "audit": audit,
            "illegal": sum(not is_legal(a, b) for (a, _), (b, _) in zip(pairs, pairs[1:])),
            "repaired_sha256": hashlib.sha256("\n".join(apply(audit, START, pairs)).encode()).hexdigest()}


def first_pass(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Results of conversations that lie wholly inside a task, and pieces (`open`) of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, solve = TaskContext.get().partitionId(), Solver()
        out: list[dict] = []
        conv, rows, lost, size, no, first = None, [], 0, 0, 0, True

        def piece() -> dict:
            return {"conv_id": conv, "open": True, "part": part, "no": no, "roles": [r for _, r, _ in rows], "texts": [t for _, _, t in rows],
                    "turns": [t for t, _, _ in rows], "lost": lost}

        def close(last: bool) -> None:
            if first or last or no:
                out.append(piece())
            else:
                out.append(whole_result(conv, rows, solve) | {"open": False})

        begun = False
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "lost")]
            for conv_id, turn, role, text, gone in zip(*columns):
                if begun and conv_id != conv:
                    close(False)
                    rows, lost, size, no, first = [], 0, 0, 0, False
                elif len(rows) >= piece_rows or size >= PIECE_CHARS:
                    out.append(piece())
                    rows, lost, size, no = [], 0, 0, no + 1
                begun, conv = True, conv_id
                if gone:
                    lost += 1
                else:
                    rows.append((turn, role, text))
                    size += len(text)
                if len(out) >= 512 or size >= PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, _arrow(FIRST_PASS))
                    out = []
        if begun:
            close(True)
        yield pa.RecordBatch.from_pylist(out, _arrow(FIRST_PASS))

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "_h", "_id"]
    placed = rows.withColumns({"_h": F.xxhash64("text"), "_id": F.monotonically_increasing_id()})
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "lost").mapInArrow(run, FIRST_PASS)


PIECE_SUMS = "key string, part long, no long, codes binary, matrix array<long>, blank long, duplicate long, truncated long"


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            again, codes = set(r["again"] or []), bytearray()
            counts = {"blank": 0, "duplicate": 0, "truncated": 0}
            for i, (role, text) in enumerate(zip(r["roles"], r["texts"])):
                fault = fault_of(text)
                if fault == WORTHLESS:
                    counts["blank"] += 1
                elif i in again:
                    counts["duplicate"] += 1
                    fault = WORTHLESS
                elif fault == TRUNCATED:
                    counts["truncated"] += 1
                codes.append(row_code(role, fault))
            yield pa.RecordBatch.from_pylist([{"key": r["key"], "part": r["part"], "no": r["no"], "codes": bytes(codes),
                                               "matrix": costs_between(bytes(codes)), **counts}], _arrow(PIECE_SUMS))


def _exit_costs(group: pd.DataFrame) -> pd.DataFrame:
    """The exact prices after each piece of one conversation."""
    group = group.sort_values(["part", "no"], ignore_index=True)
    after, rows = list(FINAL), []
    for matrix in reversed(group["matrix"].tolist()):
        rows.append(after)
        after = entry_costs(list(matrix), after)
    return group[["key", "part", "no"]].assign(after=rows[::-1], cost=after[START])


def _ordered_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: the repaired text is hashed as it passes."""
    key = None
    out: dict = {}

    def done() -> pa.RecordBatch:
        out["audit"] = "".join([*out.pop("audits"), ENDING[out["state"]]])
        for line in apply(ENDING[out["state"]], out["state"], []):
            out["hash"].update((b"\n" if out["lines"] else b"") + line.encode())
            out["lines"] += 1
        out["gaps"] = out["last_turn"] - out["first_turn"] + 1 - out["turns"] if out["turns"] else 0
        out["repaired_sha256"] = out["hash"].hexdigest()
        return pa.RecordBatch.from_pylist([{name: out[name] for name in _arrow(RESULT).names}], _arrow(RESULT))

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if r["key"] != key:
                if key is not None:
                    yield done()
                key = r["key"]
                out = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["cost"], "audits": [],
                       "state": START, "hash": hashlib.sha256(), "lines": 0, "turns": 0, "first_turn": None, "last_turn": None, "role": None}
            for name in ("blank", "duplicate", "truncated"):
                out[name] += r[name]
            audit, after = trace(r["codes"], prices(r["codes"], tuple(r["after"])), out["state"])
            for line in apply(audit, out["state"], list(zip(r["roles"], r["texts"]))):
                out["hash"].update((b"\n" if out["lines"] else b"") + line.encode())
                out["lines"] += 1
            out["audits"].append(audit)
            out["state"] = after
            for role, turn in zip(r["roles"], r["turns"]):
                out["illegal"] += out["role"] is not None and not is_legal(out["role"], role)
                out["role"] = role
                if turn is not None:
                    out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
                    out["turns"] += turn != out["last_turn"]
                    out["last_turn"] = turn
    if key is not None:
        yield done()


DIGESTS = "key string, part long, no long, at long, digest binary"


def _row_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["roles"])
            yield pa.record_batch([pa.array([r["key"]] * n, pa.string()), pa.array([r["part"]] * n, pa.int64()), pa.array([r["no"]] * n, pa.int64()),
                                   pa.array(range(n), pa.int64()), pa.array(map(row_digest, r["roles"], r["texts"]), pa.binary())], schema=_arrow(DIGESTS))


def joined_results(pieces: DataFrame) -> DataFrame:
    """Results of conversations that lie in several pieces."""
    pieces = pieces.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).select(
        "key", "conv_id", "part", "no", "roles", "texts", "turns")
    digests = pieces.select("key", "part", "no", "roles", "texts").mapInArrow(_row_digests, DIGESTS)
    place = F.struct("part", "no", "at")
    firsts = stored(digests.groupBy("key", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "firsts")
    again = digests.join(firsts, ["key", "digest"]).filter(place != F.col("first")).groupBy("key", "part", "no").agg(F.collect_list("at").alias("again"))
    place_of = ["key", "part", "no"]
    sums = stored(pieces.join(again, place_of, "left").select(*place_of, "roles", "texts", "again").mapInArrow(_piece_sums, PIECE_SUMS), "sums")
    exits = sums.select(*place_of, "matrix").groupBy("key").applyInPandas(_exit_costs, "key string, part long, no long, after array<long>, cost long")
    known = stored(sums.drop("matrix").join(exits, place_of), "exits")
    return pieces.join(known, place_of).repartition("key").sortWithinPartitions(*place_of).mapInArrow(_ordered_pass, RESULT)


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation from `rows(conv_id, turn, role, text, lost)`."""
    done = stored(first_pass(rows, piece_rows), "repaired")
    names = _arrow(RESULT).names
    return done.filter("NOT open").select(*names).unionByName(joined_results(done.filter("open")))


def op12_auction_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(damaged(table(spark, folder, "conversations")))
