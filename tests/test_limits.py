"""Nothing is cut, hostile texts end in time, hot keys are split."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vestigia.functions import network, text
from vestigia.operators import compare, graph, scans, sequences, tokens
from vestigia.operators.common import join_reduced
from vestigia.operators.matching import same_signature
from vestigia.sources.tables import bytes_as_text, files
from vestigia.streaming import flows


def one(spark, value, expression):
    start = time.time()
    out = spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x
    assert time.time() - start < 20
    return out


def test_whole_array_of_a_shown_text(spark):
    words = " ".join(f"(w{i})" for i in range(30))
    page = spark.createDataFrame([(1, f"BT 3 Tr [ {words} ] TJ ET", 100.0, 100.0)], "doc_id int, t string, page_width double, page_height double")
    assert tokens.hidden_text(page, ["doc_id"], "t").first().text == "".join(f"w{i}" for i in range(30))


def test_hidden_text_reads_a_page_once(spark):
    """Instructions are neither rows nor sorted, and a page with very many blocks takes time by its length."""
    page = " ".join(f"1 0 0 1 {k % 7} 0 Tm 0 {k} Td (w{k}) Tj" for k in range(50_000))
    pages = spark.createDataFrame([(1, page, 100.0, 100.0), (2, None, 1.0, 1.0), (3, " ", 1.0, 1.0)], "doc_id int, t string, page_width double, page_height double")
    found = tokens.hidden_text(pages, ["doc_id"], "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    start = time.time()
    rows = found.selectExpr("count(*) AS n", "min(text) AS first", "min(pos) AS pos", "sum(y) AS y", "max(x) AS x", "count_if(reason = 'off_page') AS off").first()
    assert tuple(rows) == (50_000 - 151, "w1000", 151 * 12 + 12, sum(range(151, 50_000)), 6.0, 50_000 - 151)
    assert time.time() - start < 60


def walked(page, width, height):
    """Hidden texts of a page, instruction by instruction: place, text, reason, size, mode, x, y."""
    def number(token):
        return float(token) if re.fullmatch(tokens.NUMBER.removeprefix("^").removesuffix(r"\z"), token) else None

    size, white, mode, x, y, stack = 12.0, False, 0, 0.0, 0.0, []
    for at, op in enumerate(page.split(), 1):
        if op not in tokens.OPERATORS:
            stack.append(op)
            continue
        values, args, stack = [number(a) for a in stack[:-7:-1]], stack, []
        valid = len(values) > 0 and all(v is not None for v in values[:{"rg": 3, "k": 4, "Td": 2, "TD": 2, "Tm": 2}.get(op, 1)])
        if op in ("Tj", "'", '"', "TJ"):
            text = "".join(re.findall(r"\(([^)]*)\)", " ".join(args))) if op == "TJ" else args[-1].strip("()") if args else ""
            off = x < -50 or y < -50 or x > width + 50 or y > height + 50
            reason = "invisible_text" if mode == 3 else "white_text" if white else "tiny_text" if 0 < size < 1 else "off_page" if off else None
            if reason and len(text) >= 2:
                yield at, text, reason, size, mode, x, y
        elif not valid or len(values) < {"Tf": 2, "rg": 3, "k": 4, "Td": 2, "TD": 2, "Tm": 6}.get(op, 1):
            continue
        elif op == "Tf":
            size = values[0]
        elif op in ("g", "rg", "k"):
            white = all(v > 0.92 for v in ([(1 - v) * (1 - values[0]) for v in values[1:4]] if op == "k" else values[:3] if op == "rg" else values[:1]))
        elif op == "Tr":
            mode = int(values[0]) if abs(values[0]) < 2**31 else mode
        elif op in ("Td", "TD"):
            x, y = x + values[1], y + values[0]
        elif op == "Tm" and values[5] is not None:
            x, y = values[1], values[0]


def test_hidden_text_walks_only_pages_of_several_stretches(spark):
    """The state at a shown text is found by string functions; it is carried from stretch to stretch of long pages. Equals a plain walk."""
    draw = random.Random(4)
    some = ["0", "1", "0.95", "-3", ".5", "3", "3.0", "7e2", "1e30", "12", "x", "Tfx", "1f", "[", "(ab)", "(c)", "(two)"]
    count = {"rg": 3, "k": 4, "Td": 2, "TD": 2, "Tm": 6, "Tf": 2}

    def instruction():
        op = draw.choice(tokens.OPERATORS)
        shown = op in ("Tj", "'", '"', "TJ")
        return " ".join([*draw.choices(some[-3:] if shown else some[:10] if draw.random() < 0.8 else some, k=count.get(op, 1)), op])

    pages = [(i, draw.choice([" ", "\n", "  "]).join(instruction() for _ in range(draw.choice([1, 5, 30, 3000]))), 100.0, 100.0) for i in range(120)]
    pages += [(200, "3 Tr " * 2000 + "(ab) Tj " + "1 0 Td (cd) Tj " * 400, 100.0, 100.0), (201, "1 g [ " + "(ab) " * 2000 + "] TJ 2 3 4 (zz) '", 100.0, 100.0)]
    found = tokens.hidden_text(spark.createDataFrame(pages, "doc_id int, t string, page_width double, page_height double"), ["doc_id"], "t")
    got = {tuple(r) for r in found.select("doc_id", "pos", "text", "reason", "font_size", "mode", "x", "y").collect()}
    assert got == {(i, *block) for i, page, width, height in pages for block in walked(page, width, height)} and len(got) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(CASE WHEN") == 1 and "CASE WHEN (size(_parts" in plan


def test_all_strings_of_a_text(spark):
    value = "\n".join(f"C:\\data\\file{i:02d}" for i in range(31))
    assert len(one(spark, value, text.printable_strings)) == 31
    assert len(one(spark, value, lambda t: text.printable_strings(t, 30))) == 30


def test_sets_of_any_size_have_a_status(spark):
    rows = [(s, 10 * s + i) for s, n in ((1, 1), (2, 4), (3, 5)) for i in range(n)]
    got = {r.comparison_id: r.error for r in compare.set_sizes(spark.createDataFrame(rows, "comparison_id int, doc_id int")).collect()}
    assert got[2] is None and "at least" in got[1] and "at most" in got[3]


def test_every_match_of_every_probe(spark):
    signed = spark.createDataFrame([(i, [i % 2]) for i in range(120)], "doc_id int, signature array<int>")
    probes = signed.filter("doc_id IN (0, 1)")
    assert same_signature(signed, probes).groupBy("probe_id").count().collect() and same_signature(signed, probes).count() == 118


def test_trees_of_any_depth_and_cycles_end(spark):
    edges = [(1, f"n{i}", f"n{i + 1}") for i in range(9)] + [(1, "n9", "n3"), (1, "n9", "leaf")]
    roots = spark.createDataFrame([(1, "n0")], "doc_id int, node string")
    frame = spark.createDataFrame(edges, "doc_id int, src string, dst string")
    got = graph.tree_flatten(frame, roots).collect()
    assert [(r.node, r.depth) for r in got] == [("leaf", 10)]
    assert graph.tree_flatten(frame, roots, 5).collect() == []


def test_large_texts_are_analysed_and_the_limit_still_holds(spark):
    rows = spark.createDataFrame([(1, "x " * 5000 + "http://a.example.ru/y"), (2, "z" * 30)], "doc_id int, text string")
    assert {r.doc_id: r.status for r in flows.analysed(rows, "text", 200 * 1024 * 1024).collect()} == {1: "ok", 2: "ok"}
    got = {r.doc_id: (r.status, r.risk_level, r.error) for r in flows.analysed(rows, "text", 40).collect()}
    assert got[1] == ("error", "UNKNOWN", "too large") and got[2][0] == "ok"


def test_spacing_of_busy_actors(spark):
    rows = [(1, float(10 * i if i > 12 else i * i), i) for i in range(200)]
    got = sequences.regular_spacing(spark.createDataFrame(rows, "k int, x double, i int"), "k", "x", "i").collect()
    assert [(r.n_points, r.spacing) for r in got] == [(200, 10.0)]
    assert sequences.regular_spacing(spark.createDataFrame(rows, "k int, x double, i int"), "k", "x", "i", points=10).collect() != got


def test_long_ranges_are_not_one_array(spark):
    span = spark.createDataFrame([(1, 0, 25_000, "D", "", 1)], "doc_id int, start int, end int, style string, prefix string, first int")
    assert sequences.page_labels(span).agg(F.count("*"), F.min("page"), F.max("page")).first()[:] == (25_000, 0, 24_999)


MB = 1_000_000


def test_repeated_instructions(spark):
    hits = scans.pattern_hits(spark.createDataFrame([(1, "q " * (MB // 2))], "id int, t string"), ["id"], "t", scans.CONTENT_PATTERNS)
    assert [(r.match_count, len(r["sample"])) for r in hits.collect()] == [(1, 60)]


def test_many_path_segments(spark):
    assert [len(p) for p in one(spark, "see /home/" + "a/" * 400_000 + "b and /var/x//y", text.paths)] == [len("/home/") + 800_001, 6]


def test_letters_before_an_at_sign(spark):
    assert one(spark, "a" * MB + "@ b@c.de1x@y.org " + "a" * MB, network.emails) == ["b@c.de", "1x@y.org"]


def test_open_brackets(spark):
    assert one(spark, "(" * MB, text.black_boxes_over_text) == 0
    assert one(spark, "0 0 0 rg 1 2 3 4 re f" + "(" * MB + ") Tj", text.black_boxes_over_text) == 1


def test_many_markers_and_few_zeros(spark):
    pattern = [p for p in scans.EXPLOIT_PATTERNS if "JBIG2" in p[0]]
    frame = spark.createDataFrame([(1, "/JBIG2Decode " * 80_000), (2, "/JBIG2Decode " * 40_000 + "\0" * 25 + "/JBIG2Decode " * 40_000),
                                   (3, "\0" * 25 + "/JBIG2Decode")], "id int, t string")
    start = time.time()
    assert [(r.id, r.match_count) for r in scans.pattern_hits(frame, ["id"], "t", pattern).collect()] == [(2, 1)]
    assert time.time() - start < 20


@pytest.mark.parametrize("tail, name", [(b"\x90" * 8, "nopsled"), (b"\x0c" * 8, "heap_spray"), (b"\xcd\x80", "int80"), (b"\x0f\x05", "syscall")])
def test_bytes_of_shellcode_in_files(spark, tmp_path, tail, name):
    (tmp_path / "a.bin").write_bytes(b"%PDF \xff\xfe" + tail + b" end")
    (tmp_path / "b.bin").write_bytes(b"%PDF \xff\xfe end")
    found = scans.scan_rules(files(spark, str(tmp_path)).select("name", bytes_as_text(F.col("content")).alias("t")), "name", "t")
    assert [(r.name, r.matched) for r in found.filter("rule = 'PDF_Shellcode_Patterns'").collect()] == [("a.bin", name)]


def test_hot_key_of_a_reduced_join_is_split(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "20",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.md5(
            F.col("id").cast("string")).alias("v")).repartition(20)
        counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = join_reduced(rows, counts, "k").agg(F.sum("n"), F.max("v"))
        assert joined.collect()[0][0] == 100_000 ** 2 + 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
