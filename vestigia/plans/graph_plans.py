"""Graphs and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.functions import network as net
from vestigia.operators import graph as gr
from vestigia.plans import bindings as b
from vestigia.plans.network_plans import d_ips, d_mails
from vestigia.plans.registry import query
from vestigia.session import cut_lineage
from vestigia.sources.tables import table

# region → nation → customer → order, one graph per region, with some extra edges: customers that point
# back to their region and customers that a second nation of the region refers to.
TREE_PARTS = [
    ("SELECT n_regionkey AS doc_id, 'R' || CAST(n_regionkey AS STRING) AS src, 'N' || CAST(n_nationkey AS STRING) AS dst FROM {nation}"),
    ("SELECT n_regionkey, 'N' || CAST(n_nationkey AS STRING), 'C' || CAST(c_custkey AS STRING) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"),
    ("SELECT n_regionkey, 'C' || CAST(c_custkey AS STRING), 'O' || CAST(o_orderkey AS STRING) FROM {orders} JOIN {customer} ON o_custkey = c_custkey "
     "JOIN {nation} ON c_nationkey = n_nationkey"),
]
EXTRA_PARTS = [
    ("SELECT n_regionkey, 'C' || CAST(c_custkey AS STRING), 'R' || CAST(n_regionkey AS STRING) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0"),
    ("SELECT n.n_regionkey, 'N' || CAST(m.n_nationkey AS STRING), 'C' || CAST(c_custkey AS STRING) FROM {customer} JOIN {nation} n ON c_nationkey = n.n_nationkey "
     "JOIN {nation} m ON m.n_nationkey = (n.n_nationkey + 5) % 25 AND m.n_regionkey = n.n_regionkey WHERE c_custkey % 7 = 0"),
]
NAMES = ("nation", "customer", "orders")


def _union(parts: list[str], names: dict[str, str]) -> str:
    return " UNION ALL ".join(p.format(**names) for p in parts)


def edges(spark, folder, parts):
    for name in NAMES:
        table(spark, folder, name).createOrReplaceTempView(f"_v_{name}")
    return spark.sql(_union(parts, {n: f"_v_{n}" for n in NAMES}))


def roots(spark, folder):
    return table(spark, folder, "region").selectExpr("r_regionkey AS doc_id", "'R' || CAST(r_regionkey AS STRING) AS node")


PLAIN = {n: n for n in NAMES}
BFS = f"""WITH RECURSIVE ed AS ({_union(TREE_PARTS + EXTRA_PARTS, PLAIN)}),
wk AS (SELECT r_regionkey AS doc_id, 'R' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT ed.doc_id, dst, depth + 1 FROM wk JOIN ed ON ed.doc_id = wk.doc_id AND src = node WHERE depth < 6),
nd AS (SELECT doc_id, node, min(depth) AS depth FROM wk GROUP BY ALL)"""


def _walk(spark, folder):
    graph = cut_lineage(edges(spark, folder, TREE_PARTS + EXTRA_PARTS))
    return graph, gr.bfs(graph, roots(spark, folder))


@query("graph_bfs", BFS + " SELECT * FROM nd")
def graph_bfs(spark, folder):
    return _walk(spark, folder)[1]


@query("graph_summary", BFS + " SELECT doc_id, count(*) AS n_nodes, max(depth) AS max_depth, CASE WHEN max(depth) > 20 THEN 'MEDIUM' END AS severity FROM nd GROUP BY 1")
def graph_summary(spark, folder):
    return gr.graph_summary(_walk(spark, folder)[1])


@query("edge_typing", BFS + """, sn AS (SELECT ed.*, p.depth AS pd, c.depth AS cd FROM ed JOIN nd p ON p.doc_id = ed.doc_id AND p.node = src JOIN nd c ON c.doc_id = ed.doc_id AND c.node = dst),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dst ORDER BY pd, src) AS rn FROM sn)
SELECT doc_id, src, dst, CASE WHEN cd > 0 AND rn = 1 THEN 'contains' ELSE 'reference' END AS kind FROM r""")
def edge_typing(spark, folder):
    graph, nodes = _walk(spark, folder)
    return gr.edge_kinds(graph, nodes)


LINKS = "CAST(event_id % 10 AS BIGINT) AS doc_id, 'n' || CAST(user_id % 40 AS STRING) AS src, 'n' || CAST(event_id * 7 % 43 AS STRING) AS dst, event_id AS seq"


@query("reciprocal_edges", f"""WITH e AS (SELECT {LINKS} FROM events) SELECT doc_id, count(*) AS n_circular, 'HIGH' AS severity FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id
 AND b.src = a.dst AND b.dst = a.src AND b.seq < a.seq) GROUP BY 1""")
def reciprocal_edges(spark, folder):
    return gr.reciprocal_findings(b.derived(spark, folder, "events", LINKS))


NODE_KEYS = [*gr.NODE_TYPES, "/Kids", "/Root"]
NODE = f"l_orderkey AS doc_id, l_suppkey AS parent, l_partkey AS node, {b.pick(NODE_KEYS, f'(l_partkey % {len(NODE_KEYS)})')} AS k"
NODE_CASE = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gr.NODE_TYPES.items()) + " ELSE 'Object' END"


@query("node_classify", f"WITH n AS (SELECT {NODE} FROM lineitem) SELECT parent, {NODE_CASE} AS node_type, count(*) AS n_children, min(node) AS first_child FROM n GROUP BY ALL")
def node_classify(spark, folder):
    """Type of each node from its key, and the children of each parent by type."""
    nodes = b.derived(spark, folder, "lineitem", NODE).withColumn("node_type", gr.node_type(F.col("k")))
    return nodes.groupBy("parent", "node_type").agg(F.count(F.lit(1)).alias("n_children"), F.min("node").alias("first_child"))


@query("tree_flatten", f"""WITH ed AS ({_union(TREE_PARTS, PLAIN)}), l1 AS (SELECT r_regionkey AS doc_id, 'R' || r_regionkey AS p, 'R' || r_regionkey AS n FROM region),
l2 AS (SELECT l1.doc_id, p || '/' || dst AS p, dst AS n FROM l1 JOIN ed ON ed.doc_id = l1.doc_id AND src = n), l3 AS (SELECT l2.doc_id, p || '/' || dst AS p, dst AS n FROM l2 JOIN ed ON ed.doc_id = l2.doc_id AND src = n),
l4 AS (SELECT l3.doc_id, p || '/' || dst AS p, dst AS n FROM l3 JOIN ed ON ed.doc_id = l3.doc_id AND src = n),
al AS (SELECT *, 0 AS depth FROM l1 UNION ALL SELECT *, 1 FROM l2 UNION ALL SELECT *, 2 FROM l3 UNION ALL SELECT *, 3 FROM l4)
SELECT doc_id, n AS node, p AS path, depth FROM al WHERE (doc_id, n) NOT IN (SELECT (doc_id, src) FROM ed)""")
def tree_flatten(spark, folder):
    """Leaves with their path, one row for every way to a leaf."""
    return gr.tree_paths(edges(spark, folder, TREE_PARTS), roots(spark, folder))


def shared_ids(spark, folder):
    """Whole-text digests, addresses and IPs of the documents."""
    t = F.col("text")
    ids = F.concat(F.array(F.sha2(t, 256)), net.emails(t), net.ips(t))
    return table(spark, folder, "documents").select("doc_id", F.explode(ids).alias("id"))


@query("signature_clusters", f"""WITH RECURSIVE i AS (SELECT doc_id, unnest(list_concat([sha256(text)], {d_mails('text')}, {d_ips('text')})) AS id FROM documents),
pr AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM i a JOIN i b USING (id)),
rc AS (SELECT x, y FROM pr UNION SELECT rc.x, pr.y FROM rc JOIN pr ON pr.x = rc.y)
SELECT x AS doc_id, min(y) AS label FROM rc GROUP BY 1""")
def signature_clusters(spark, folder):
    """Documents connected through equal texts or shared indicators."""
    return gr.connected_groups(shared_ids(spark, folder))
