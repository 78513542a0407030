"""Numbers, labels, flags, coordinates and vectors. Row-local expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals, permission bits, reference quantisation table, standard resolutions.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"),
         (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
PERMISSION_BITS = {
    "print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "extract": 9, "assemble": 10,
    "print_highres": 11,
}
REFERENCE_TABLE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
STANDARD_DPI = [72, 96, 150, 200, 300, 400, 600, 1200]


def roman(n: Column) -> Column:
    """Upper-case roman numeral; zero and below stay plain numbers."""
    whole = n.cast("long")
    thousands = F.repeat(F.lit("M"), F.floor(whole / 1000).cast("int"))

    def digit(place: int, one: str, five: str, ten: str) -> Column:
        d = F.floor(whole / place) % 10
        small = F.repeat(F.lit(one), (d % 5).cast("int"))
        return (F.when(d == 9, one + ten).when(d == 4, one + five)
                .when(d >= 5, F.concat(F.lit(five), small)).otherwise(small))

    text = F.concat(thousands, digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))
    return F.when(whole <= 0, whole.cast("string")).otherwise(text)


def alpha_label(n: Column) -> Column:
    """a … z, aa … in bijective base 26; zero and below give ?."""
    whole = n.cast("long")
    state = F.struct(whole.alias("rest"), F.lit("").alias("text"))
    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)), state,
        lambda s, _: F.struct(
            F.when(s["rest"] > 0, F.floor((s["rest"] - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("rest"),
            F.when(s["rest"] > 0, F.concat(F.char((97 + (s["rest"] - 1) % 26).cast("int")), s["text"]))
            .otherwise(s["text"]).alias("text"),
        ),
        lambda s: s["text"],
    )
    return F.when(whole <= 0, "?").otherwise(folded)


def label_text(style: Column, prefix: Column, number: Column) -> Column:
    """Page label: /D decimal, /R /r roman, /A /a letters; anything else decimal."""
    body = (
        F.when(style == "/R", F.upper(roman(number))).when(style == "/r", F.lower(roman(number)))
        .when(style == "/A", F.upper(alpha_label(number))).when(style == "/a", alpha_label(number))
        .otherwise(number.cast("string"))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), body)


def permission_bits(mask: Column) -> dict[str, Column]:
    return {name: mask.bitwiseAND(F.lit(1 << bit)) != 0 for name, bit in PERMISSION_BITS.items()}


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = deg + minutes / 60 + seconds / 3600
    return F.round(F.when(ref.isin("S", "W"), -value).otherwise(value), 7)


def match_score(vector: Column, reference: list[int] | None = None) -> Column:
    """Share of equal positions; 0 unless both have 64 entries."""
    table = F.array(*[F.lit(float(v)) for v in (reference or REFERENCE_TABLE)])
    equal = F.aggregate(F.zip_with(vector, table, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0),
                        lambda s, x: s + x)
    return F.when(F.size(vector) == 64, equal / 64).otherwise(F.lit(0.0))


def quality_from_first(first: Column) -> Column:
    return (F.when(first <= 0, 0).when(first <= 2, 95).when(first <= 8, 85).when(first <= 16, 75)
            .when(first <= 32, 50).otherwise(30))


def tail_distinct_ratio(vector: Column, start: int = 33, length: int = 32) -> Column:
    tail = F.slice(vector, start, length)
    return F.size(F.array_distinct(tail)) / F.size(tail)


def aspect_difference(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Relative difference of two aspect ratios."""
    main = w1 / h1
    return F.abs(main - w2 / h2) / (main + F.lit(1e-10))


def aspect_gap(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.abs(w1 / h1 - w2 / h2)


def diff_ratio(a: Column, b: Column, limit: float) -> Column:
    """Share of positions that differ by more than the limit; null if the sizes differ."""
    different = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > limit))
    return F.when(F.size(a) == F.size(b), F.round(different / F.greatest(F.size(a), F.lit(1)), 4))


def snap(value: Column, standards: list[int] | None = None, tolerance: float = 5) -> Column:
    """Nearest standard value (the smaller one on a tie) if it is closer than the tolerance."""
    options = F.array(*[F.struct(F.abs(value - F.lit(s)).alias("d"), F.lit(s).alias("s")) for s in (standards or STANDARD_DPI)])
    best = F.array_min(options)
    return F.when(best["d"] < tolerance, best["s"])
