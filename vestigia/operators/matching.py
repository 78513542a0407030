"""Corpus-wide matching: probe lookups, known-tool tables, digest verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators.common import first_k, join_reduced, rule

# Known producer strings and the words of each tool category.
KNOWN_PRODUCERS = {
    "Microsoft Word": "Microsoft Word",
    "Microsoft® Word": "Microsoft Word",
    "Acrobat Distiller": "Adobe Acrobat Distiller",
    "Adobe PDF Library": "Adobe PDF Library",
    "Adobe Acrobat": "Adobe Acrobat",
    "GPL Ghostscript": "Ghostscript",
    "Ghostscript": "Ghostscript",
    "LibreOffice": "LibreOffice",
    "OpenOffice": "OpenOffice",
    "PScript5": "Adobe PostScript Driver",
    "pdfTeX": "pdfTeX (LaTeX)",
    "LaTeX": "LaTeX",
    "FPDF": "FPDF (PHP Library)",
    "iTextSharp": "iTextSharp (.NET)",
    "iText": "iText (Java)",
    "PDFsharp": "PDFsharp (.NET)",
    "PDFium": "PDFium (Chromium)",
    "Chromium": "Chromium/Chrome",
    "Prince": "Prince (XML → PDF)",
    "wkhtmltopdf": "wkhtmltopdf",
    "Bullzip": "Bullzip PDF Printer",
    "CutePDF": "CutePDF Writer",
    "doPDF": "doPDF",
    "PDF24": "PDF24 Creator",
    "Nitro": "Nitro PDF",
    "Foxit": "Foxit PDF",
    "PDFelement": "Wondershare PDFelement",
    "pdfcreator": "PDFCreator",
    "PyPDF": "PyPDF (Python)",
    "reportlab": "ReportLab (Python)",
    "pikepdf": "pikepdf (Python)",
    "cairo": "Cairo Graphics",
    "Scribus": "Scribus",
    "Quark": "QuarkXPress",
    "InDesign": "Adobe InDesign",
    "FrameMaker": "Adobe FrameMaker",
    "CorelDRAW": "CorelDRAW",
    "Illustrator": "Adobe Illustrator",
    "Pages": "Apple Pages",
    "Word for Mac": "Microsoft Word (macOS)",
    "Mac OS X": "macOS CoreGraphics/Quartz",
    "Quartz": "macOS Quartz PDFContext",
    "PDF Architect": "PDF Architect",
    "SmallPDF": "Smallpdf (Online)",
    "ILovePDF": "iLovePDF (Online)",
    "Sejda": "Sejda PDF (Online)",
    "PDF2GO": "PDF2Go (Online)",
    "pdfforge": "PDFForge",
    "ABBYY": "ABBYY FineReader (OCR)",
    "OmniPage": "OmniPage (OCR)",
    "Tesseract": "Tesseract OCR",
}
TOOL_CATEGORIES = {
    "Online-Dienst": ["online", "smallpdf", "ilovepdf", "sejda", "pdf2go", "pdfforge", "pdf24"],
    "OCR-Software": ["abbyy", "omnipage", "tesseract", "ocr"],
    "Programm-Bibliothek": ["fpdf", "itextsharp", "itext", "pdfsharp", "reportlab", "pikepdf", "pdfium", "pypdf"],
    "Desktop-Anwendung": ["word", "libreoffice", "openoffice", "indesign"],
    "Konverter/Renderer": ["ghostscript", "distiller", "latex"],
}
OTHER_TOOL = "PDF-Software"
UNKNOWN_TOOL = "Unbekannt"
VERSION_PATTERN = r"(\d+[.\d]+)"


def first_match(text: Column, table: dict[str, str]) -> Column:
    """Value of the first key contained in the text, ignoring case; null if none is. The table is a
    short constant, so the lookup is one expression and needs no join."""
    low = F.lower(text)
    hits = [F.when(low.contains(key.lower()), value) for key, value in table.items()]
    return F.coalesce(*hits)


def last_match(text: Column, table: dict[str, str]) -> Column:
    return first_match(text, dict(reversed(table.items())))


def tool_category(tool: Column) -> Column:
    low = F.lower(tool)
    result = F.lit(OTHER_TOOL)
    for name, words in reversed(TOOL_CATEGORIES.items()):
        hit = reduce(lambda a, w: a | low.contains(w), words, F.lit(False))
        result = F.when(hit, name).otherwise(result)
    return F.when(tool.isNotNull(), result)


def version_hint(text: Column) -> Column:
    found = F.regexp_extract(text, VERSION_PATTERN, 1)
    return F.when(found != "", found)


def known_tool(df: DataFrame, producer: str = "producer", creator: str = "creator") -> DataFrame:
    """Tool, category and version from the producer, else from the creator, else the raw value."""
    # The tools become columns of their own first, so that each side is searched once and not once for each result.
    df = df.withColumns({"_tp": first_match(F.col(producer), KNOWN_PRODUCERS), "_tc": first_match(F.col(creator), KNOWN_PRODUCERS)})
    from_producer, from_creator = F.col("_tp"), F.col("_tc")
    raw = F.coalesce(F.when(F.col(producer) != "", F.col(producer)), F.when(F.col(creator) != "", F.col(creator)))
    known = F.coalesce(from_producer, from_creator)
    return df.withColumns({
        "tool": F.coalesce(known, raw),
        "tool_category": F.when(known.isNotNull(), tool_category(known)).when(raw.isNotNull(), UNKNOWN_TOOL),
        "version": F.when(from_producer.isNotNull(), version_hint(F.col(producer)))
        .when(from_creator.isNotNull(), version_hint(F.col(creator))),
        "tool_severity": F.when(known.isNotNull(), F.lit(None)).when(raw.isNotNull(), "INFO").otherwise("LOW"),
    }).drop("_tp", "_tc")


def tool_mismatch_rule(producer: str = "producer", creator: str = "creator") -> Column:
    """Known tools on both sides that differ. Here the last matching key names the tool."""
    made = last_match(F.col(creator), KNOWN_PRODUCERS)
    written = last_match(F.col(producer), KNOWN_PRODUCERS)
    differ = (F.col(producer) != "") & (F.col(creator) != "") & (F.col(producer) != F.col(creator)) & (made != written)
    return rule(differ, "INFO", "software", "tool_mismatch", F.concat_ws(" > ", made, written))


def lookup(df: DataFrame, key: str | Sequence[str], table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Left join on a table with one row per key; missing entries take the default. Spark broadcasts the table if it is
    small; constant tables are marked so by the caller."""
    found = df.join(table, key, "left")
    return found.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def digest_reputation(df: DataFrame, verdicts: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a known verdict, and the distinct digests still to be submitted."""
    hits = join_reduced(df, verdicts, digest)
    misses = join_reduced(df, verdicts.select(digest), digest, "left_anti").select(digest).distinct()
    return hits, misses


def shared_with_probe(items: DataFrame, probe: DataFrame, show: int = 10, key: str = "doc_id",
                      value: str = "value") -> DataFrame:
    """All other documents sharing a value with a probe document: number shared and the first few, for each probe. The corpus is
    scanned once and reduced per probe and document."""
    keys = ["probe_id", key]
    wanted = probe.select(value, F.col(key).alias("probe_id")).distinct()
    hit = items.join(wanted, value).filter(F.col(key) != F.col("probe_id")).select(*keys, value).distinct()
    counts = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shared"))
    return counts.join(first_k(hit, keys, [F.col(value)], value, show, "shared"), keys)


def same_signature(signed: DataFrame, probe: DataFrame, signature: str = "signature", key: str = "doc_id") -> DataFrame:
    """Other documents with a probe's non-empty signature, all of them, for each probe."""
    wanted = probe.select(signature, F.col(key).alias("probe_id")).filter(F.size(signature) > 0).distinct()
    return signed.join(wanted, signature).filter(F.col(key) != F.col("probe_id"))


def probe_groups(signed: DataFrame, is_probe: str, signature: str = "signature", key: str = "doc_id") -> DataFrame:
    """All rows whose non-empty signature some probe has, with the group's first probe, number of probes and matches of each probe. Groups
    stand for pairs: probes of equal signature match the same rows, each all but its own."""
    groups = signed.filter(F.size(signature) > 0).groupBy(signature).agg(
        F.min(F.when(F.col(is_probe), F.col(key))).alias("probe_id"), F.count_if(F.col(is_probe)).alias("n_probes"),
        (F.count(F.lit(1)) - 1).alias("n_matches")).filter("n_probes > 0")
    return join_reduced(signed, groups, signature)
