"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm import samples

from vestigia.llm import repair
from vestigia.llm.common import table

FOLDER = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = [], []
    for _, role, text in rows:
        solid = BLANK.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.append((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit, repaired rows) over all edits: best of each (rows read, pattern state), shortest ways by relaxation."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", [])}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for (at, q), (cost, audit, done) in list(best.items()):
                if at == i:
                    for r in ("user", "assistant"):
                        if (q, r[0]) in follow:
                            node, new = (i, follow[q, r[0]]), (cost + 2, audit + "I", done + [(r, "")])
                            best[node] = min(best.get(node, new), new, key=lambda x: x[:2])
        if i == len(rows):
            break
        _, role, text = rows[i]
        for (at, q), (cost, audit, done) in list(best.items()):
            if at != i:
                continue
            ways = [(i + 1, q, cost + 3, audit + "D", done)]
            if marks[i] not in ("blank", "duplicate"):
                extra = marks[i] == "truncated"
                for letter, price, r in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if (q, r[:1]) in follow:
                        ways.append((i + 1, follow[q, r[:1]], cost + price + extra, audit + letter, done + [(r, text)]))
            for i2, q2, *new in ways:
                best[i2, q2] = min(best.get((i2, q2), tuple(new)), tuple(new), key=lambda x: x[:2])
    return min((best[len(rows), q] for q in (0, 3) if (len(rows), q) in best), key=lambda x: x[:2])


def plain(rows):
    marks = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, done = cheapest(rows, marks)
    initials = [role[:1] for _, role, _ in rows]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in done))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())


def damage(rows):
    """Conversations after the damage, rows in order; `rows` are (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        own = out.setdefault(conv, [])
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        own += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for c, own in out.items()}


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = results(repair.op12_auction_repair(spark, FOLDER))
    assert got == {c: plain(own) for c, own in damage(rows).items()}
    assert len({g[6] for g in got.values()}) > 10


def odd_rows(count, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "amy"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why?", "é。", "end.\n ", "a\x1c", "x" * 40 + "."]
    return [(rng.choice([None, *range(12), 5, 5, 5, 5]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"Line {i}.")
            for i in range(count)]


@pytest.mark.parametrize("piece_rows, partitions", [(4096, 1), (3, 7), (1, 2), (50, 40)])
def test_odd_rows_in_pieces(spark, piece_rows, partitions):
    """Rows of one turn are made alike by their order of role, as the order by hash of the text is an inner one."""
    rows, seen = [], set()
    for r in odd_rows(700, 3):
        if (r[0], r[1], r[2] or " ") not in seen and not seen.add((r[0], r[1], r[2] or " ")):
            rows.append(r)
    by_turn = {}
    for r in rows:  # damage 4 may make roles of one turn equal: keep one row of such a turn
        by_turn.setdefault((r[0], r[1]), []).append(r)
    rows = [r for (c, t), own in by_turn.items() for r in (own[:1] if zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 == 4 else own)]
    df = samples.clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("part", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = results(repair.repaired(repair.damaged(df), piece_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {c: plain(own) for c, own in damage(rows).items()}


def test_prices_are_exact_and_pieces_join():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(0, 60)
        codes = bytes(rng.choice([3, 6, 3, 6, *range(12)]) for _ in range(n))
        price = repair.prices(codes)
        audit, state = repair.trace(codes, price, 0)
        cut = rng.randrange(0, n + 1)
        later = repair.entry_costs(repair.costs_between(codes[cut:]), list(repair.FINAL))
        assert later == repair.prices(codes[cut:])[0] and max(later) - min(later) < repair.FAR
        assert repair.entry_costs(repair.costs_between(codes[:cut]), later) == price[0]
        head, middle = repair.trace(codes[:cut], repair.prices(codes[:cut], tuple(later)), 0)
        tail, end = repair.trace(codes[cut:], repair.prices(codes[cut:]), middle)
        assert (head + tail, end) == (audit, state)
        for row in range(n):
            for q in range(4):
                assert all(price[row][q] <= cost + price[row + ahead][to] for _, cost, ahead, to in repair.ARCS[codes[row]][q])


def test_all_lost_and_empty(spark):
    lost = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*lost, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert results(repair.repaired(repair.damaged(df))) == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(repair.damaged(df.limit(0))).collect() == []


def test_a_long_conversation_takes_linear_time(spark):
    import time

    codes = bytes(random.Random(1).choice(range(12)) for _ in range(20_000))
    start = time.time()
    repair.trace(codes, repair.prices(codes), 0)
    assert time.time() - start < 20
    rows = [(1, t, ("user", "assistant", "assistant")[t % 3], f"Line {t % 700}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = repair.repaired(repair.damaged(df), 500).collect()
    assert tuple(got)[1:] == plain(damage(rows)[1])
