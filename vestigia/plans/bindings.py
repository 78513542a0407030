"""Canonical views over the provided tables.

Columns a table lacks are derived from its keys by SQL text that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vestigia.operators.rollups import PHASE_SECTIONS
from vestigia.sources.tables import table


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: list[str | None], index: str) -> str:
    """CASE expression choosing values[index]."""
    arms = " ".join(f"WHEN {i} THEN {sql_text(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def values_table(rows: list[tuple], columns: str, name: str) -> str:
    """A WITH entry holding constant rows, for the SQL side."""
    def cell(v: object) -> str:
        return sql_text(v) if isinstance(v, str) or v is None else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


SEVERITY = ("CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' "
            "WHEN 'signup' THEN 'LOW' ELSE 'INFO' END")
SPARK_K = "CAST(get_json_object(props, '$.k') AS INT)"
DUCK_K = "CAST(json_extract_string(props, '$.k') AS INT)"
SECTIONS = [s for sections in PHASE_SECTIONS.values() for s in sections]
MESSAGES = [
    "Metadata date differs", "Script action found", "JPEG saved twice", "External ip address", "Xref offset shared",
    "Font not embedded", "Nothing special", "Redaction over text",
]
_EV = ("event_id AS finding_id, user_id AS doc_id, ts, event_type AS category, {sev} AS severity, value AS score, "
       "{k} AS k, 'src' || CAST(user_id % 20 AS STRING) AS source, {section} AS section, {message} AS message")


def _ev(k: str) -> str:
    return _EV.format(sev=SEVERITY, k=k, section=pick(SECTIONS, f"({k} % {len(SECTIONS)})"),
                      message=pick(MESSAGES, f"({k} % {len(MESSAGES)})"))


EV = f"ev AS (SELECT {_ev(DUCK_K)} FROM events)"


def findings(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "events").createOrReplaceTempView("_v_events")
    return spark.sql(f"SELECT {_ev(SPARK_K)} FROM _v_events")


PRODUCERS = [
    "Microsoft® Word 2016", "Acrobat Distiller 9.0.1", "GPL Ghostscript 9.26", "LibreOffice 7.3", "pdfTeX-1.40.21",
    "iText 5.5.13", "SmallPDF.com 2.1", "ABBYY FineReader 12", "Adobe InDesign CC 14.0", "Homemade Tool", "", None,
]
EXTENSIONS = ["pdf", "docx", "exe", "jpg", "odt", "js", "txt", "png", "xls", "tiff", "docm", "sh"]
_META = (
    "o_orderkey AS doc_id, 'Case-' || CAST(o_orderkey AS STRING) || '.' || {ext} AS name, "
    "o_custkey AS author, o_orderdate AS created, o_orderstatus AS status, o_totalprice AS total, "
    "o_orderpriority AS priority, {producer} AS producer, {creator} AS creator, "
    "CAST(floor(o_orderkey / 4) AS BIGINT) AS comparison_id, "
    "CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'P' THEN 'MEDIUM' ELSE 'CLEAN' END AS risk_level, "
    "CAST(o_custkey % 7 AS BIGINT) AS n_high, CAST(o_orderkey % 5 AS BIGINT) AS n_medium, "
    "CAST((o_orderkey + o_custkey) % 6 AS BIGINT) AS n_low, "
    "o_custkey % 11 = 0 AS has_script, o_custkey % 13 = 0 AS encrypted, "
    "CAST(1 + o_orderkey % 4 AS BIGINT) AS revisions"
).format(ext=pick(EXTENSIONS, f"(o_orderkey % {len(EXTENSIONS)})"),
         producer=pick(PRODUCERS, f"(o_custkey % {len(PRODUCERS)})"),
         creator=pick(PRODUCERS, f"((o_custkey + o_orderkey) % {len(PRODUCERS)})"))
META = f"meta AS (SELECT {_META} FROM orders)"


def doc_meta(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("_v_orders")
    return spark.sql(f"SELECT {_META} FROM _v_orders")


_OBJ = ("l_orderkey AS doc_id, l_linenumber AS obj_no, l_partkey AS part, l_suppkey AS device, l_quantity AS size, "
        "l_extendedprice AS price, l_shipdate AS modified, l_returnflag AS type, l_linestatus AS state")
OBJ = f"obj AS (SELECT {_OBJ} FROM lineitem)"


def objects(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "lineitem").createOrReplaceTempView("_v_lineitem")
    return spark.sql(f"SELECT {_OBJ} FROM _v_lineitem")


def derived(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    """SELECT of shared SQL text over one table."""
    table(spark, folder, name).createOrReplaceTempView(f"_v_{name}")
    return spark.sql(f"SELECT {columns} FROM _v_{name}")
