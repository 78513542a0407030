"""User detectors: named functions that return findings, run together and reported one by one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING_COLUMNS = ["doc_id", "severity", "category", "code", "detail"]
FINDING_SCHEMA = "analyzer string, doc_id bigint, severity string, category string, code string, detail string"


@dataclass(frozen=True)
class Detector:
    name: str
    build: Callable[[], DataFrame]


@dataclass
class DetectorRun:
    findings: DataFrame
    status: list[tuple[str, str, str | None]] = field(default_factory=list)


def _checked(name: str, df: DataFrame) -> DataFrame:
    missing = [c for c in FINDING_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"detector {name} lacks columns {missing}")
    return df.select(F.lit(name).alias("analyzer"), F.col("doc_id").cast("long").alias("doc_id"),
                     *[F.col(c).cast("string").alias(c) for c in FINDING_COLUMNS[1:]])


def run_detectors(spark: SparkSession, detectors: list[Detector]) -> DetectorRun:
    """Union of all detectors. One that cannot be planned becomes an error row and stops nobody else."""
    union: DataFrame | None = None
    status: list[tuple[str, str, str | None]] = []
    for detector in detectors:
        try:
            found = _checked(detector.name, detector.build())
            union = found if union is None else union.unionByName(found)
            status.append((detector.name, "ok", None))
        except Exception as exc:  # noqa: BLE001
            status.append((detector.name, "error", str(exc)[:200]))
    if union is None:
        union = spark.createDataFrame([], FINDING_SCHEMA)
    return DetectorRun(union, status)
