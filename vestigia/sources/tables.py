"""Readers for the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; timestamps stay zone-less, as stored."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bytes_as_text(content: Column) -> Column:
    """Bytes as characters of the same number, so that rules of byte values and of words hold alike."""
    return F.decode(content, "ISO-8859-1")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Evidence files as rows: the file name, its size and its bytes."""
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    return reader.load(path).selectExpr(
        "path AS doc_id",
        "element_at(split(path, '/'), -1) AS name",
        "content",
        "length AS size_bytes",
        "modificationTime AS received_at",
    )
