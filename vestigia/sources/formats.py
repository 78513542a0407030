"""File format from leading bytes and name; routing and size checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading bytes (hex), extension tables, accepted extensions, size limit.
MAGIC = [
    ("25504446", "PDF"), ("504B0304", "OOXML"), ("D0CF11E0A1B11AE1", "OLE"), ("FFD8FF", "JPEG"),
    ("89504E470D0A1A0A", "PNG"), ("474946383761", "GIF"), ("474946383961", "GIF"), ("424D", "BMP"),
    ("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("52494646", "WEBP"),
]
OOXML_EXTENSIONS = {
    ".docx": "DOCX", ".xlsx": "XLSX", ".pptx": "PPTX", ".docm": "DOCX", ".xlsm": "XLSX", ".pptm": "PPTX",
    ".odt": "ODT", ".ods": "ODS", ".odp": "ODP",
}
OLE_EXTENSIONS = {".doc": "DOC", ".xls": "XLS", ".ppt": "PPT"}
SUPPORTED_EXTENSIONS = [
    ".pdf", ".docx", ".xlsx", ".pptx", ".docm", ".xlsm", ".pptm", ".doc", ".xls", ".ppt", ".odt", ".ods", ".odp",
    ".jpg", ".jpeg", ".png",
]
OFFICE_FORMATS = ["DOCX", "XLSX", "PPTX", "DOC", "XLS", "PPT", "ODT", "ODS", "ODP", "OOXML", "OLE"]
IMAGE_FORMATS = ["JPEG", "PNG", "GIF", "BMP", "TIFF", "WEBP"]
MAX_SIZE_BYTES = 200 * 1024 * 1024


def extension(name: Column) -> Column:
    """Last suffix of the file name with its dot, lower case; empty if there is none."""
    return F.regexp_extract(F.lower(name), r"[^/](\.[^./]+)$", 1)


def _from_table(key: Column, table: dict[str, str], default: Column) -> Column:
    return reduce(lambda rest, item: F.when(key == item[0], item[1]).otherwise(rest), reversed(table.items()), default)


def detect_format(content: Column, name: Column) -> Column:
    """Leading bytes first, then the extension; containers are told apart by extension."""
    head = F.hex(F.substring(content, 1, 16))
    ext = extension(name)
    bare = F.upper(F.substring(ext, 2, 100))
    fallback = F.coalesce(
        _from_table(ext, {**OOXML_EXTENSIONS, **OLE_EXTENSIONS}, F.lit(None)),
        F.when(bare != "", bare), F.lit("UNKNOWN"),
    )
    magic = reduce(
        lambda rest, item: F.when(head.startswith(item[0]), item[1]).otherwise(rest), reversed(MAGIC), F.lit("")
    )
    return (
        F.when(magic == "", fallback)
        .when(magic == "OOXML", _from_table(ext, OOXML_EXTENSIONS, F.lit("OOXML")))
        .when(magic == "OLE", _from_table(ext, OLE_EXTENSIONS, F.lit("OLE")))
        .otherwise(magic)
    )


def route(fmt: Column, content: Column, name: Column) -> Column:
    """pdf / office / image, or rejected: unsupported name, unsupported format, missing PDF header."""
    supported = extension(name).isin(SUPPORTED_EXTENSIONS)
    has_header = F.hex(F.substring(content, 1, 4)) == "25504446"
    return (
        F.when(~supported, "rejected")
        .when(fmt == "PDF", F.when(has_header, "pdf").otherwise("rejected"))
        .when(fmt.isin(OFFICE_FORMATS), "office").when(fmt.isin(IMAGE_FORMATS), "image").otherwise("rejected")
    )


def branches(routed: DataFrame, column: str = "route") -> dict[str, DataFrame]:
    return {name: routed.filter(F.col(column) == name) for name in ("pdf", "office", "image", "rejected")}


def size_gate(df: DataFrame, size: str, max_bytes: int = MAX_SIZE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and too large ones with the reason; no row is lost."""
    fits = F.coalesce(F.col(size), F.lit(0)) <= max_bytes
    reason = F.format_string(f"too large: %d > {max_bytes} bytes", F.col(size).cast("long"))
    return df.filter(fits), df.filter(~fits).withColumn("error", reason)
