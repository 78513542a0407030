"""Hidden text in drawing instructions: running state over an ordered token stream.

A page is written as one letter a token: blanks for operands, a letter for each instruction that changes the state or shows text. The
state (size, colour, mode, position) at a shown text is that of the last letter of its kind before it, which string functions find, so
compiled code does the work of every shown text and only hidden blocks leave it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators.common import computed_once

# Instructions that end an operand list, and thresholds.
OPERATORS = ["BT", "ET", "Tf", "rg", "RG", "g", "k", "Tr", "Td", "TD", "Tm", "Tj", "'", '"', "TJ"]
NUMBER = r"^[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+\z"
SPACES = " \t\n\x0b\f\r"
WHITE = 0.92
PAGE_MARGIN = 50
# Letters: f size, c colour, r mode, d move, m place, j shown text, o any other instruction. A stretch has eight moves and 1,008 letters
# at most, but for the operands of its last instruction, and ends behind an instruction.
STRETCH = r"(?=.)(?:[^dm]{0,125}+[dm]?+){1,7}+ *+[^ ]?+"
STATE = "struct<before:int,font_size:double,white:boolean,mode:int,x:double,y:double>"


def unescape(text: Column) -> Column:
    """Text of one parenthesised string: escapes for line ends become blanks, octal escapes vanish."""
    bare = F.trim(text)
    inner = F.when(bare.startswith("(") & bare.endswith(")") & (F.length(bare) >= 2),
                   F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(inner, r"\\[nrt]", " "), r"\\[0-7]{1,3}", "")


def join_strings(text: Column) -> Column:
    """All parenthesised parts of an array string, joined."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), "")


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _before(text: Column, mark: str, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), n)


def _tokens(text: Column) -> Column:
    """Tokens between white space; a text with single blanks only is split without a pattern."""
    odd = text.rlike("[\t\n\x0b\f\r]") | F.contains(text, F.lit("  ")) | text.startswith(" ") | text.endswith(" ")
    return F.when(odd, F.split(F.btrim(text, F.lit(SPACES)), r"\s+")).otherwise(F.split(text, " "))


def _letter(t: Column, w: Column, i: Column) -> Column:
    """Letter of the token w at place i; an instruction whose operands are not numbers changes nothing."""
    def numbers(*ks: int) -> Column:
        return _all([F.get(t, i - k).rlike(NUMBER) for k in ks])

    def operands(*ks: int) -> Column:
        return _all([~F.get(t, i - k).isin(OPERATORS) for k in ks])

    mode = F.get(t, i - 1).try_cast("double").try_cast("int")
    letters = [
        (w == "Tj", "j", None), (w.isin("Td", "TD"), "d", numbers(1, 2)), (w == "rg", "c", numbers(1, 2, 3)), (w == "Tf", "f", numbers(1) & operands(2)),
        (w == "Tr", "r", numbers(1) & mode.isNotNull()), (w == "g", "c", numbers(1)), (w == "Tm", "m", numbers(1, 2, 6) & operands(3, 4, 5)),
        (w == "k", "c", numbers(1, 2, 3, 4)), (w.isin("TJ", "'", '"'), "j", None)]
    out = F.lit("o")
    for of_kind, letter, valid in reversed(letters):
        out = F.when(of_kind, F.lit(letter) if valid is None else F.when(valid, letter).otherwise("o")).otherwise(out)
    return F.when(w.isin(OPERATORS), out).otherwise(" ")


def _marks(letters: Column) -> dict[str, Column]:
    """Number of letters, place of the last one of each kind (0 if there is none), and the moves behind the last place that was set."""
    size = F.octet_length(letters)
    places = {k: size - F.octet_length(F.substring_index(letters, k, -1)) for k in "fcrm"}
    tail = F.substring_index(letters, "m", -1)
    return {"size": size, **places, "tail": tail, "moved": F.octet_length(tail) - F.octet_length(F.replace(tail, F.lit("d"), F.lit("")))}


def _start() -> dict[str, Column]:
    return {"before": F.lit(0), "font_size": F.lit(12.0), "white": F.lit(False), "mode": F.lit(0), "x": F.lit(0.0), "y": F.lit(0.0)}


def _after(s: Column, m: dict[str, Column] | Column, t: Column, first: Column) -> dict[str, Column]:
    """The state behind letters with these marks, from the state before them; `first` is the place of their first token in t."""
    def number(at: Column, k: int) -> Column:
        """k-th operand from the end of the instruction at that place, counted from 1."""
        return F.get(t, at - 1 - k).try_cast("double")

    def white(*parts: Column) -> Column:
        return _all([p > WHITE for p in parts])

    size, colour, mode, place = (first + m[k] for k in "fcrm")
    op, key = F.get(t, colour - 1), 1 - number(colour, 1)
    is_white = (F.when(op == "rg", white(*[number(colour, k) for k in (3, 2, 1)])).when(op == "g", white(number(colour, 1)))
                .otherwise(white(*[(1 - number(colour, k)) * key for k in (4, 3, 2)])))

    def position(k: int, old: Column) -> Column:
        begin = F.when(m["m"] > 0, number(place, k)).otherwise(old)
        moved = F.aggregate(F.sequence(F.lit(1), m["moved"]), begin, lambda a, n: a + number(place + F.octet_length(_before(m["tail"], "d", n)) + 1, k))
        return F.when(m["moved"] > 0, moved).otherwise(begin)

    return {
        "before": s["before"] + m["size"],
        "font_size": F.when(m["f"] > 0, number(size, 1)).otherwise(s["font_size"]),
        "white": F.when(m["c"] > 0, is_white).otherwise(s["white"]),
        "mode": F.when(m["r"] > 0, number(mode, 1).try_cast("int")).otherwise(s["mode"]),
        "x": position(2, s["x"]), "y": position(1, s["y"]),
    }


def _states(parts: Column, t: Column) -> Column:
    """The state before each stretch. States are listed in runs of about the root of their number, so that the list of a page with very
    many is not copied for each of them."""
    n = F.size(parts)
    run = F.ceil(F.sqrt(n)).cast("int")

    def stretch(s: Column, i: Column) -> Column:
        behind = F.get(F.transform(F.array(_struct(_marks(F.get(parts, i)))), lambda m: _struct(_after(s["now"], m, t, s["now"]["before"]))), 0)
        return F.struct(behind.alias("now"), F.array_append(s["seen"], s["now"]).alias("seen"))

    def runs(s: Column, i: Column) -> Column:
        begin = F.struct(s["now"].alias("now"), F.array().cast(f"array<{STATE}>").alias("seen"))
        return F.aggregate(F.sequence(i, F.least(i + run, n) - 1), begin, stretch, lambda r: F.struct(
            r["now"].alias("now"), F.array_append(s["seen"], r["seen"]).alias("seen")))

    begin = F.struct(_struct(_start()).alias("now"), F.array().cast(f"array<array<{STATE}>>").alias("seen"))
    many = F.aggregate(F.sequence(F.lit(0), n - 1, run), begin, runs, lambda s: F.flatten(s["seen"]))
    return F.when(n > 1, many).when(n == 1, F.array(_struct(_start())))


def hidden_text(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Hidden text blocks with their reason, in the order of precedence: invisible, white, tiny, off page.

    Pages stay in the tasks they are in, and each is split once. No instruction becomes a row, nothing is sorted: a row is a shown
    text with the tokens of the stretch it lies in and the letters before it; the state before a stretch is carried along the page.
    Columns are built one upon the other, as one that several later ones read is computed once."""
    keep = [*keys, "page_width", "page_height", "_t"]
    split = pages.select(*keep[:-1], _tokens(F.col(text)).alias("_t"))
    lettered = split.withColumn("_letters", F.array_join(F.transform("_t", lambda w, i: _letter(F.col("_t"), w, i)), ""))
    parts = lettered.withColumn("_parts", F.regexp_extract_all("_letters", F.lit(STRETCH), F.lit(0)))
    carried = parts.withColumn("_states", _states(F.col("_parts"), F.col("_t")))
    stretches = carried.select(*keep, "_parts", F.posexplode_outer("_states").alias("_i", "_s")).withColumn("_part", F.get("_parts", F.col("_i")))
    own = F.when(F.size("_parts") == 1, F.col("_t")).otherwise(F.slice("_t", F.col("_s.before") + 1, F.octet_length("_part")))
    counted = stretches.withColumn("_t", own).withColumn("_shown", F.octet_length("_part") - F.octet_length(F.replace("_part", F.lit("j"), F.lit(""))))
    places = counted.withColumn("_k", F.explode_outer(F.when(F.col("_shown") > 0, F.sequence(F.lit(1), "_shown")))).filter("_k IS NOT NULL")
    cut = places.withColumn("_l", _before(F.col("_part"), "j", F.col("_k")))
    marks = {k: v.alias(f"_m_{k}") for k, v in _marks(F.col("_l")).items()}
    marked = cut.select(*keep, "_s", "_l", *marks.values())
    t = F.col("_t")
    s = _after(F.col("_s"), {k: F.col(f"_m_{k}") for k in marks}, t, F.lit(0))
    sized = marked.withColumn("font_size", s["font_size"])
    font, width, height, x, y = (F.col(c) for c in ("font_size", "page_width", "page_height", "_x", "_y"))
    off = (width > 0) & (height > 0) & ((x < -PAGE_MARGIN) | (y < -PAGE_MARGIN) | (x > width + PAGE_MARGIN) | (y > height + PAGE_MARGIN))
    first = sized.withColumn("_reason", F.when(s["mode"] == 3, "invisible_text").when(s["white"], "white_text").when((font < 1) & (font > 0), "tiny_text"))
    set_ = first.withColumns({"_x": F.when(F.col("_reason").isNull(), s["x"]), "_y": F.when(F.col("_reason").isNull(), s["y"])})
    hidden = computed_once(set_, "reason", F.coalesce("_reason", F.when(off, "off_page"))).filter("reason IS NOT NULL")

    size = F.col("_m_size")
    n = size - F.octet_length(F.rtrim("_l", F.lit(" ")))
    shown = F.when(F.get(t, size) == "TJ", join_strings(F.array_join(F.slice(t, size + 1 - n, n), " "))).when(n > 0, unescape(F.get(t, size - 1)))
    named = computed_once(hidden, "text", F.trim(shown)).filter(F.length("text") >= 2)
    return named.select(*keys, (s["before"] + 1).alias("pos"), "text", "reason", "font_size", s["mode"].alias("mode"), s["x"].alias("x"), s["y"].alias("y"))


def hidden_text_findings(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    counts = blocks.groupBy(key).agg(*[
        F.count_if(F.col("reason") == r).alias(f"n_{r.split('_')[0]}") for r in ("invisible_text", "white_text", "tiny_text")])
    return counts.withColumns({
        "invisible_severity": F.when(F.col("n_invisible") > 0, "HIGH"),
        "white_severity": F.when(F.col("n_white") > 0, "MEDIUM"),
        "tiny_severity": F.when(F.col("n_tiny") > 0, "LOW"),
    })
