"""Text patterns and extractions. Row-local expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
PATH_PATTERN = (
    r"""(?i)(?:[A-Za-z]:\\|/home/|/Users/|/var/|C:/)(?:[^\s"'<>:*?|/\\]+[/\\])*[^\s"'<>:*?|/\\]+"""
)
# The same matches without one level of recursion for each segment.
PATH_SEARCH = r"""(?i)(?:[A-Za-z]:\\|/home/|/Users/|/var/|C:/)[^\s"'<>:*?|/\\]++(?:[/\\][^\s"'<>:*?|/\\]++)*+"""
SUBSET_PATTERN = r"^([A-Z]{6})\+(.+)$"
SESSION_PATTERN = r'rsid[A-Z]*="([0-9A-Fa-f]{8})"'
BLACK_BOX_PATTERN = r"0\s+0\s+0\s+(?:rg|RG)\s*[\d.]+\s+[\d.]+\s+[\d.]+\s+[\d.]+\s+re\s+f"
TEXT_SHOWN_END = r"\)\s*+(?:Tj|TJ|')"
LINEAR_PATTERN = r"(?s)(\d+\s+\d+\s+obj\s*<<[^>]*?/Linearized\s+[\d.]+[^>]*?>>)"
HEADER_WINDOW = 4096  # the format places the leading dictionary here
SNIPPET_PATTERNS = {
    "has_text": r"/Type\s*/Page|BT\s|Tj\s|TJ\s",
    "has_metadata": r"(?i)/Author|/Title|/Creator|/Producer",
    "has_js": r"(?i)/JavaScript|/JS\s",
    "has_url": r"(?i)https?://|/URI\s",
}
PRODUCT_WORDS = ["Microsoft", "Word", "Excel"]


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def paths(text: Column) -> Column:
    return extract_all(text, PATH_SEARCH)


def subset_prefix(name: Column) -> Column:
    found = F.regexp_extract(name, SUBSET_PATTERN, 1)
    return F.when(found != "", found)


def subset_name(name: Column) -> Column:
    return F.when(subset_prefix(name).isNotNull(), F.regexp_extract(name, SUBSET_PATTERN, 2)).otherwise(name)


def session_ids(text: Column) -> Column:
    """Distinct session ids, upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(extract_all(text, SESSION_PATTERN, 1), F.upper)))


def printable_strings(text: Column, limit: int | None = None) -> Column:
    """Printable runs of at least four characters that look like a path, an address, a name or an office
    product; distinct, in order, all of them or the first `limit`."""
    runs = F.transform(extract_all(text, r"[\x20-\x7e]{4,}"), lambda s: F.trim(s))

    def telling(s: Column) -> Column:
        return (
            (s.contains("\\") & (F.length(s) > 8)) | (s.contains("@") & s.contains("."))
            | s.rlike(r"^[A-Z][a-z]+ [A-Z][a-z]+$")
            | s.rlike("|".join(PRODUCT_WORDS))
        )

    found = F.array_distinct(F.filter(runs, lambda s: telling(s)))
    return found if limit is None else F.slice(found, 1, limit)


def snippet_flags(text: Column) -> dict[str, Column]:
    """What an orphaned snippet contains, and its type by precedence."""
    flags = {name: text.rlike(pattern) for name, pattern in SNIPPET_PATTERNS.items()}
    flags["has_stream"] = text.contains("stream")
    kind = (
        F.when(text.contains("/Page"), "Page").when(text.contains("/Metadata") | text.contains("/Author"), "Metadata")
        .when(text.contains("/EmbeddedFile"), "EmbeddedFile").when(text.contains("/JavaScript"), "JavaScript")
        .when(text.contains("/Font"), "Font").when(text.contains("/XObject"), "XObject")
    )
    return {**flags, "type_hint": kind}


def trailing_text(text: Column, marker: str) -> Column:
    """Text behind the last marker without surrounding blanks; null if there is no marker."""
    rest = F.substring_index(text, marker, -1)
    return F.when(text.contains(marker), F.regexp_replace(rest, r"^\s+|\s+$", ""))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal, not overlapping. The plain search comes first: most texts have none."""
    pieces = F.size(F.split(text, f"\\Q{part}\\E", -1)) - 1
    return F.when(text.contains(part), pieces).when(text.isNotNull(), 0).cast("long")


def black_boxes_over_text(text: Column) -> Column:
    boxes = F.regexp_count(text, F.lit(BLACK_BOX_PATTERN))
    opened = F.instr(text, "(")
    shown = (opened > 0) & F.substr(text, opened + 1).rlike(TEXT_SHOWN_END)
    return F.when(shown, boxes).otherwise(F.lit(0)).cast("long")


def linear_fields(text: Column, window: int = HEADER_WINDOW) -> dict[str, Column]:
    """Numbers of the leading dictionary, looked for in the first `window` characters, where the format places it."""
    entry = F.regexp_extract(F.substring(text, 1, window), LINEAR_PATTERN, 1)

    def number(key: str) -> Column:
        return F.regexp_extract(entry, rf"/{key}\s+(\d+)", 1).try_cast("long")

    version = F.regexp_extract(entry, r"/Linearized\s+([\d.]+)", 1)
    hint = r"/H\s*\[\s*(\d+)\s+(\d+)(?:\s+(\d+)\s+(\d+))?\s*\]"
    return {
        "is_linear": entry != "",
        "version": F.when(version != "", version),
        "declared_length": number("L"), "first_object": number("O"), "first_end": number("E"),
        "declared_pages": number("N"), "index_offset": number("T"),
        "hint_offset": F.regexp_extract(entry, hint, 1).try_cast("long"),
        "hint_length": F.regexp_extract(entry, hint, 2).try_cast("long"),
        "overflow_offset": F.regexp_extract(entry, hint, 3).try_cast("long"),
    }


def lenient_json(reply: Column, schema: str) -> Column:
    """Object from a chatty reply: the whole text, else a fenced block, else first { to last }."""
    text = F.trim(F.regexp_replace(F.trim(reply), r"(?s)<think>.*?</think>", ""))
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)

    def parsed(candidate: Column) -> Column:
        keys = F.json_object_keys(candidate)
        return F.when(keys.isNotNull(), F.from_json(candidate, schema))

    return F.coalesce(parsed(text), parsed(fenced), parsed(braces))
