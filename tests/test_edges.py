"""Threshold and format edges on hand-written rows."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from vestigia.functions import dates, network, numbers, text
from vestigia.operators import compare, correlate, graph, matching, measures, rollups, rulesets, scans, sequences, similarity, structure, tokens
from vestigia.operators.common import emit, first_k
from vestigia.plans import catalog
from vestigia.plans.measure_plans import digests
from vestigia.sources import formats, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,utc,offset,label", [
    ("D:20240101120000Z", "2024-01-01 12:00:00", 0, "Z (UTC)"),
    ("D:20240101120000+01'00'", "2024-01-01 11:00:00", 60, "+01:00"),
    ("D:20240101120000-03'30'", "2024-01-01 15:30:00", -210, "-03:30"),
    ("D:20240101120000-08", "2024-01-01 20:00:00", -480, "-08:00"),
    ("  D:20240101120000 ", "2024-01-01 12:00:00", 0, "Z (UTC)"),
    ("D:20241301120000Z", None, None, None), ("D:20240101120060Z", None, None, None),
    ("2024-01-01", None, None, None), ("", None, None, None), (None, None, None, None),
])
def test_document_dates(spark, raw, utc, offset, label):
    got = one(spark, dates.parse_document_date(F.lit(raw).cast("string")))
    if utc is None:
        assert got is None
    else:
        assert (str(got["utc_ts"]), got["offset_min"], got["label"]) == (utc, offset, label)


def test_offset_format(spark):
    for minutes, shown in [(-210, "-3:30"), (345, "+5:45"), (0, "+0:00"), (-60, "-1:00")]:
        assert one(spark, dates.format_offset(F.lit(minutes))) == shown


def test_uuid_time(spark):
    v1 = "d9428888-122b-11e1-b85c-61cd3cbb3210"
    ticks = uuid.UUID(v1).time - dates.UUID_EPOCH_TICKS
    assert abs(one(spark, dates.uuid1_micros(F.lit(v1))) - ticks / 10) <= 0.5
    found = one(spark, dates.uuids1(F.lit(f"{v1.upper()} {v1} 11111111-2222-4333-8444-555555555555")))
    assert found == [v1]
    for delta, severity in [(60, None), (60.5, "MEDIUM"), (3600, "MEDIUM"), (3600.5, "HIGH")]:
        assert one(spark, dates.uuid_severity(F.lit(float(delta)))) == severity


def test_private_addresses(spark):
    inside = ["10.0.0.1", "172.16.0.1", "172.31.255.255", "192.168.1.1", "127.0.0.1", "169.254.0.1"]
    outside = ["172.15.0.1", "172.32.0.1", "8.8.8.8"]
    for ip in inside + outside:
        assert one(spark, network.is_private_ip(F.lit(ip))) == (ip in inside)
    assert one(spark, network.ips(F.lit("a 01.2.3.4 b 256.1.1.1 c 8.8.8.8 d 8.8.8.8"))) == ["8.8.8.8"]


@pytest.mark.parametrize("url,host_mode,compat", [
    ("http://x.onion/a", True, True), ("https://a.to/", True, True), ("https://a.tools/", False, True),
    ("https://bit.ly/1", True, True), ("https://www.bit.ly/1", True, True), ("https://wow.ly/1", False, False),
    ("https://u:p@t.co:8080/x", True, True), ("https://example.com", False, False),
])
def test_suspicious_urls(spark, url, host_mode, compat):
    assert one(spark, network.is_suspicious_url(F.lit(url))) == host_mode
    assert one(spark, network.is_suspicious_url(F.lit(url), mode="compat")) == compat
    assert one(spark, network.urls(F.lit(f"see ({url}).,"))) == [url]


def test_scores_and_levels(spark):
    rows = spark.createDataFrame([(1, "INFO"), (2, "LOW"), (3, "MEDIUM"), (4, "HIGH"), (5, None)], "doc_id int, severity string")
    docs = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id int")
    levels = {r.doc_id: r.risk_level for r in rollups.risk_levels(docs, rows).collect()}
    assert levels == {1: "CLEAN", 2: "LOW", 3: "MEDIUM", 4: "HIGH", 5: "CLEAN", 6: "CLEAN"}
    zero = {c: 0 for c in rollups.MANIPULATION_WEIGHTS}
    for high, low, band, severity in [(2, 4, "safe", None), (3, 6, "note", None), (3, 7, "note", "MEDIUM"), (7, 4, "warn", "MEDIUM"),
                                      (7, 5, "warn", "HIGH"), (50, 0, "warn", "HIGH")]:
        row = spark.createDataFrame([{**zero, "high": high, "low": low}])
        scored = rollups.manipulation_score(row)
        got = scored.first()
        assert got["score"] == min(100, 8 * high + low) and got["band"] == band
        fired = emit(scored, ["score"], rollups.manipulation_rules()).collect()
        assert [f["severity"] for f in fired] == ([severity] if severity else [])


def test_numbers(spark):
    for n, r, a in [(4, "IV", "d"), (9, "IX", "i"), (40, "XL", "an"), (1994, "MCMXCIV", "bxr"), (26, "XXVI", "z"), (27, "XXVII", "aa"),
                    (52, "LII", "az"), (0, "0", "?"), (-3, "-3", "?")]:
        assert one(spark, numbers.roman(F.lit(n))) == r and one(spark, numbers.alpha_label(F.lit(n))) == a
    for w, h, want in [(595.28 + 4.99, 841.89, True), (595.28 + 5.0, 841.89, False), (841.89, 595.28, True), (600.0, 600.0, False)]:
        assert one(spark, structure.is_a4(F.lit(w), F.lit(h))) == want
    assert [one(spark, numbers.snap(F.lit(float(v)))) for v in (304.9, 305.0, 84.0)] == [300, None, None]
    assert one(spark, text.trailing_text(F.lit("a</html> \n"), "</html>")) == ""


def test_sha512(spark):
    row = digests(spark.createDataFrame([(1, "äbc")], "doc_id int, text string"), "text").first()
    assert row["sha512"] == hashlib.sha512("äbc".encode()).hexdigest() and row["size"] == 4


def test_formats_and_size(spark):
    rows = spark.createDataFrame([(b"%PDF-1.4", "a.PDF", 5), (b"PK\x03\x04", "b.docm", 5), (b"zz", "c.pdf", 6), (b"zz", ".hidden", 5)],
                                 "content binary, name string, n int")
    fmt = formats.detect_format(F.col("content"), F.col("name"))
    got = rows.withColumn("f", fmt).withColumn("r", formats.route(F.col("f"), F.col("content"), F.col("name"))).collect()
    assert [(r.f, r.r) for r in got] == [("PDF", "pdf"), ("DOCX", "office"), ("PDF", "rejected"), ("UNKNOWN", "rejected")]
    fine, big = formats.size_gate(rows, "n", 5)
    assert (fine.count(), big.count()) == (3, 1)


def test_range_cover(spark):
    rows = spark.createDataFrame([(1, 0, 100, 500, 400, 905), (2, 0, 100, 500, 400, 906), (3, 1, 100, 500, 400, 900)],
                                 "doc_id int, o1 int, l1 int, o2 int, l2 int, file_size int")
    cover = structure.interval_coverage(rows)
    assert {r.doc_id: r.covers_full for r in cover.collect()} == {1: True, 2: False, 3: False}
    ends = spark.createDataFrame([(1, 990, 1000), (2, 989, 1000), (3, 800, 1000)], "doc_id int, range_end int, file_size int")
    things = spark.createDataFrame([(1, 995, False), (2, 989, False), (3, 10, True)], "doc_id int, offset int, is_index boolean")
    found = {r.doc_id: (r.has_object_after, r.bytes_after, r.severity) for r in structure.objects_after_range(ends, things).collect()}
    assert found == {1: (False, 0, None), 2: (True, 11, "HIGH"), 3: (False, 200, "MEDIUM")}


def test_revision_changes_match_sets(spark):
    revisions = {1: {1, 2, 3}, 2: {2, 3, 4}, 3: {1, 4}, 4: {1, 4, 5}}
    rows = [(7, r, o, o == 4) for r, objs in revisions.items() for o in objs]
    got = {(r.revision, r.change, r.obj_no) for r in structure.revision_changes(
        spark.createDataFrame(rows, "doc_id int, revision int, obj_no int, rewritten boolean")).collect()}
    want = set()
    for r in (2, 3, 4):
        now, before = revisions[r], revisions[r - 1]
        want |= {(r, "added", o) for o in now - before} | {(r, "removed", o) for o in before - now}
        want |= {(r, "modified", o) for o in now & before if o == 4}
    assert got == want


def test_label_ranges(spark):
    ranges = spark.createDataFrame([(1, 2, "/r", 1, ""), (1, 4, "/D", 1, "p"), (2, 5, "/D", 2, "")], "doc_id int, start int, style string, first int, prefix string")
    pages = spark.createDataFrame([(1, 6), (2, 3)], "doc_id int, page_count int")
    spans = sequences.label_spans(ranges, pages)
    checks = {r.doc_id: r for r in sequences.label_checks(spans).collect()}
    assert (checks[1].declared, checks[1].count_severity, checks[1].past_end_severity, checks[1].first_severity) == (4, "HIGH", None, None)
    assert (checks[2].declared, checks[2].past_end_severity, checks[2].first_severity) == (0, "HIGH", "LOW")
    assert [r.label for r in sequences.page_labels(spans).orderBy("page").collect()] == ["i", "ii", "p1", "p2"]


def test_wrong_sets_are_rejected_before_gathering(spark):
    members = spark.createDataFrame([(1, i, "x") for i in range(500)] + [(2, 1000, "x"), (2, 1001, "x"), (3, 2000, "x")],
                                    "comparison_id int, doc_id int, sha256 string")
    assert [(r.doc_a, r.doc_b) for r in compare.identical_pairs(members).collect()] == [(1000, 1001)]
    errors = {r.comparison_id: r.error for r in compare.set_sizes(members).collect()}
    assert errors == {1: "at most 4 documents allowed", 2: None, 3: "at least 2 documents needed"}


def test_time_window_is_strict(spark):
    members = spark.sql("SELECT 1 AS comparison_id, id AS doc_id, timestamp_micros(CAST(CASE id WHEN 0 THEN 0 WHEN 1 THEN 299900000 ELSE 600000000 END AS BIGINT)) AS ts FROM range(3)")
    got = [(r.doc_a, r.doc_b) for r in compare.time_proximity_pairs(members, "ts").collect()]
    assert got == [(0, 1)]
    exact = spark.sql("SELECT 1 AS comparison_id, id AS doc_id, timestamp_micros(CAST(id * 300000000 AS BIGINT)) AS ts FROM range(3)")
    assert compare.time_proximity_pairs(exact, "ts").count() == 0


def test_rules(spark):
    docs = spark.createDataFrame([(1, "eval( x"), (2, "EVAL( UNESCAPE("), (3, "/GoToR /URI"), (4, "/GoToR"), (5, "cmd.EXE"), (6, None)], "doc_id int, t string")
    got = {(r.doc_id, r.rule) for r in scans.scan_rules(docs, "doc_id", "t").collect()}
    assert got == {(2, "PDF_JavaScript_Obfuscation"), (3, "PDF_Data_Exfiltration"), (5, "PDF_Suspicious_Launch")}
    table = spark.createDataFrame([("a", "HIGH", "c", "x; drop", "x", "1", False, False), (None, "HIGH", "c", "any", "x", "1", False, False)], scans.RULE_SCHEMA)
    rules, warnings = scans.rules_from(table)
    assert rules == [] and len(warnings) == 2


def test_lenient_json(spark):
    for reply, want in [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('<think>{"k": 9}</think>{"k": 3}', 3), ('so {"k": 4} it is', 4), ("none", None), ("{bad}", None)]:
        got = one(spark, text.lenient_json(F.lit(reply), "k INT"))
        assert (got["k"] if got else None) == want


def test_save_instructions_beside_accented_letters(spark, tmp_path):
    page = "<p>\u00e9q q\u00e9 \u00c9Q q xq q_ q1</p>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (row,) = catalog.QUERIES["balance_check"](spark, str(tmp_path)).collect()
    assert (row.saved, row.restored) == (3, 1)


def test_hidden_text(spark):
    content = (r"BT /F1 12 Tf (a) Tj (plain) Tj 0.93 0.93 0.93 rg (white) Tj 0.92 g (grey) Tj 3 Tr (gone) Tj 0 Tr /F1 0.5 Tf (tiny) Tj "
               r"/F1 9 Tf 300 0 Td (in) Tj 400 0 Td (out) Tj 1 0 0 1 5 5 Tm (back) Tj 0 0 0 0 k [ (sp) 3 (lit) ] TJ ET")
    pages = spark.createDataFrame([(1, 1, content, 595.28, 841.89)], "doc_id int, page int, c string, page_width double, page_height double")
    got = [(r.text, r.reason) for r in tokens.hidden_text(pages, ["doc_id", "page"], "c").orderBy("pos").collect()]
    assert got == [("white", "white_text"), ("gone", "invisible_text"), ("tiny", "tiny_text"), ("out", "off_page"), ("split", "white_text")]


def test_graph_with_cycles_and_depth(spark):
    chain = [(1, f"n{i}", f"n{i + 1}") for i in range(21)] + [(1, "n3", "n0"), (1, "n5", "n5")]
    diamond = [(2, "a", "b"), (2, "a", "c"), (2, "b", "d"), (2, "c", "d")]
    edges = spark.createDataFrame(chain + diamond, "doc_id int, src string, dst string")
    roots = spark.createDataFrame([(1, "n0"), (2, "a")], "doc_id int, node string")
    nodes = graph.bfs(edges, roots)
    summary = {r.doc_id: (r.n_nodes, r.max_depth, r.severity) for r in graph.graph_summary(nodes).collect()}
    assert summary == {1: (22, 21, "MEDIUM"), 2: (4, 2, None)}
    kinds = {(r.src, r.dst): r.kind for r in graph.edge_kinds(edges, nodes).collect()}
    assert (kinds["b", "d"], kinds["c", "d"], kinds["n3", "n0"], kinds["n5", "n5"]) == ("contains", "reference", "reference", "reference")


def test_reciprocal_edges(spark):
    rows = [(1, "a", "b", 1), (1, "b", "a", 2), (1, "a", "b", 3), (1, "c", "c", 4), (1, "c", "c", 5), (1, "x", "y", 6)]
    found = graph.reciprocal_edges(spark.createDataFrame(rows, "doc_id int, src string, dst string, seq int"))
    assert sorted(r.seq for r in found.collect()) == [2, 3, 5]


def test_groups_match_union_find(spark):
    links = [(i, f"x{i // 2}") for i in range(40)] + [(i, f"y{(i + 1) // 2}") for i in range(0, 20)] + [(i, "hot") for i in range(50, 80)] + [(99, "z")]
    parent = {d: d for d, _ in links}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    first = {}
    for d, i in links:
        a, b = find(d), find(first.setdefault(i, d))
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.label for r in graph.connected_groups(spark.createDataFrame(links, "doc_id int, id string")).collect()}
    assert got == {d: find(d) for d in parent}


def test_shuffled_chain_of_links_is_one_group(spark):
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    links = [(d, f"x{i + k}") for i, d in enumerate(ids) for k in (0, 1)] + [(5000, "z")]
    got = {r.doc_id: r.label for r in graph.connected_groups(spark.createDataFrame(links, "doc_id int, id string")).collect()}
    assert got == {**dict.fromkeys(ids, 0), 5000: 5000}


def test_sign_digest_matches_plain_python(spark):
    words = "the quick brown fox jumps over the lazy dog and runs away from the quick brown fox".split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "The Quick, brown fox"), (3, ""), (4, " ".join(words).upper())], "doc_id int, text string")
    got = {r.doc_id: r.signature for r in similarity.sign_digest(docs, "doc_id", "text").collect()}
    runs = {" ".join(words[i:i + 3]) for i in range(len(words) - 2)}
    hashes = [int(hashlib.md5(r.encode()).hexdigest()[:16], 16) for r in runs]
    value = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)
    assert got == {1: f"{value:016x}", 2: None, 3: None, 4: f"{value:016x}"}


def test_compliance_only_for_claims(spark):
    base = dict(doc_id=1, has_xmp=False, has_script=True, has_forbidden_action=False, encrypted=False, has_unembedded_font=False,
                has_transparency=True, has_output_intent=False, trapped=None)
    schema = ("doc_id int, has_xmp boolean, has_script boolean, has_forbidden_action boolean, encrypted boolean, has_unembedded_font boolean, "
              "has_transparency boolean, has_output_intent boolean, trapped string, xmp string")
    rows = [{**base, "xmp": "<pdfaid:part>1<"}, {**base, "doc_id": 2, "xmp": "nothing"}, {**base, "doc_id": 3, "xmp": "GTS_PDFXVersion>PDF/X-1a<"}]
    got = {r.doc_id: r for r in rulesets.compliance(rulesets.with_claims(spark.createDataFrame(rows, schema), "xmp"), "doc_id").collect()}
    assert (got[1].total_issues, got[1].critical_issues, got[1].claim_broken) == (3, 3, True)
    assert (got[2].total_issues, got[2].passes, got[2].claim_broken, got[2].intent_missing) == (0, 2, False, False)
    assert (got[3].total_issues, got[3].critical_issues, got[3].intent_missing) == (2, 1, True)


def test_store_roundtrip(spark):
    path = stores.new_folder(spark, "t")
    stores.append_results(spark.createDataFrame([(1, "HIGH")], "doc_id int, risk_level string"), path)
    stores.append_results(spark.createDataFrame([(2, "LOW", "x")], "doc_id int, risk_level string, note string"), path)
    got = {r.doc_id: (r.risk_level, r.note) for r in stores.read_results(spark, path).collect()}
    assert got == {1: ("HIGH", None), 2: ("LOW", "x")}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    up = spark.createDataFrame([(2, None)], "k int, v string")
    assert sorted((r.k, r.v or "") for r in stores.upsert_column(base, up, "k", "v").collect()) == [(1, "a"), (2, "")]
    forced = stores.reuse_cached(base, base.limit(1), "k", {"v": F.lit("new")}, force=True)
    assert {r.v for r in forced.collect()} == {"new"}


def test_first_k_keeps_order(spark):
    rows = spark.createDataFrame([(1, v) for v in range(30)] + [(2, 5)], "k int, v int")
    got = {r.k: r.out for r in first_k(rows, ["k"], [F.col("v").desc()], "v", 3, "out").collect()}
    assert got == {1: [29, 28, 27], 2: [5]}


def test_chi_square_against_plain_python(spark):
    values = [i * i % 256 for i in range(12000)]
    counts = [values.count(i) for i in range(256)]
    chi, pairs = 0.0, 0
    for i in range(0, 254, 2):
        e = (counts[i] + counts[i + 1]) / 2
        if e > 0:
            chi += (counts[i] - e) ** 2 / e + (counts[i + 1] - e) ** 2 / e
            pairs += 1
    row = measures.value_pair_chi_square(spark.createDataFrame([("g", v) for v in values], "g string, v int"), "g", "v").first()
    assert row["chi_norm"] == round(chi / (2 * pairs), 6) and row["n_values"] == 12000


def test_correlation_needs_both_sides(spark):
    schema = ("doc_id int, creator string, producer string, max_gap_s double, n_offsets int, n_authors int, encrypted boolean, has_script boolean, revisions int, "
              "has_sig_field boolean, hidden_blocks int, insecure_redactions int, suspicious_indicators int, embedded_files int, image_findings int, compression_findings int")
    rows = [(1, "a", "b", 3600.0, 1, 5, True, False, 2, False, 1, 0, 0, 1, 0, 1), (2, "a", "b", 3601.0, 2, 2, True, True, 2, True, 1, 1, 1, 1, 1, 1), (3, "", "b", 172801.0, 0, 0, False, True, 1, True, 0, 0, 0, 0, 0, 0)]
    found = emit(spark.createDataFrame(rows, schema), ["doc_id"], correlate.correlation_rules()).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {2: 7, 3: 1}


def test_every_probe_is_searched(spark):
    rows = [(i, [i % 3]) for i in range(1, 301)] + [(400, []), (401, [])]
    signed = spark.createDataFrame(rows, "doc_id int, signature array<int>").withColumn("is_probe", F.col("doc_id") % 100 == 0)
    found = matching.probe_groups(signed, "is_probe").collect()
    assert {(r.doc_id, r.probe_id, r.n_probes, r.n_matches) for r in found} == {(i, {1: 100, 2: 200, 0: 300}[i % 3], 1, 99) for i in range(1, 301)}
    hot = matching.probe_groups(signed.withColumn("signature", F.array(F.lit(1))), "is_probe").collect()
    assert len(hot) == 302 and {(r.probe_id, r.n_probes, r.n_matches) for r in hot} == {(100, 4, 301)}


def test_case_digest_counts_what_its_lists_cut(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    found = spark.createDataFrame([(1, "LOW", "c", "m", k) for k in range(7)], "doc_id long, severity string, category string, message string, finding_id long")
    tools = spark.createDataFrame([(1, f"t{k:02d}") for k in range(12)] * 2, "doc_id long, value string")
    rows = {r.doc_id: r for r in correlate.case_digest(docs, found, {"tools": (tools, 10)}, shown=5).collect()}
    assert (len(rows[1].findings), rows[1].n_findings, len(rows[1].tools), rows[1].n_tools) == (5, 7, 10, 12)
    assert rows[1].tools == [f"t{k:02d}" for k in range(10)]
    assert rows[2].tools is None and rows[2].n_tools is None and rows[2].risk_level == "CLEAN"
