"""Rule scans over whole texts.

Rules are few and fixed for a run, so they are compiled into column expressions: one projection tests
all of them while the text is in memory. Nothing is joined and no text is copied per rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.functions.text import count_of

MAX_RULES = 2000
MATCHED_STRINGS_SHOWN = 10


@dataclass(frozen=True)
class RuleString:
    name: str
    pattern: str
    nocase: bool = False
    regex: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    category: str
    strings: tuple[RuleString, ...]
    condition: str  # "any", "N of them", or a boolean expression over string names


def _words(nocase: bool, **strings: str) -> tuple[RuleString, ...]:
    return tuple(RuleString(k, v, nocase) for k, v in strings.items())


# The built-in rules and patterns.
BUILTIN_RULES = [
    Rule("PDF_JavaScript_Obfuscation", "HIGH", "malware", _words(
        True, eval="eval(", unescape="unescape(", fromcharcode="fromCharCode", settimeout="setTimeout(",
        activex="ActiveXObject", shellexec="Shell.Execute", wscript="WScript.Shell", powershell="powershell"), "2 of them"),
    Rule("PDF_Exploit_CVE_Patterns", "CRITICAL", "exploit", _words(
        True, cve1="collectEmailInfo", cve2="getAnnots", cve3="getIcon", cve4="spell.customDictionaryOpen",
        cve5="media.newPlayer", cve6="Collab.collectEmailInfo", cve7="util.printf", cve8="app.doc.Collab"), "any"),
    Rule("PDF_Suspicious_Streams", "MEDIUM", "evasion", _words(
        False, jbig2="/JBIG2Decode", crypt="/Crypt", double_flate="/FlateDecode/FlateDecode", asciihex="/ASCIIHexDecode",
        ascii85="/ASCII85Decode", runlen="/RunLengthDecode"), "2 of them"),
    Rule("PDF_Embedded_Executable", "CRITICAL", "malware", _words(
        False, mz="MZ", elf="\x7fELF", pe="This program cannot be run in DOS mode") + _words(
        True, bat="@echo off", ps1="-ExecutionPolicy Bypass", vbs="CreateObject"), "any"),
    Rule("PDF_Phishing_Indicators", "MEDIUM", "phishing", (
        RuleString("login", r"https?://[a-z0-9\-\.]+\.(tk|ml|ga|cf|gq|xyz|top|buzz|club)/", regex=True),
        *_words(True, shortener1="bit.ly/", shortener2="tinyurl.com/", shortener3="t.co/"),
        RuleString("form_action", r"/URI\s*\(https?://", regex=True), *_words(False, submit_form="/SubmitForm")), "2 of them"),
    Rule("PDF_Shellcode_Patterns", "CRITICAL", "exploit", _words(
        False, nopsled="\x90" * 8, heap_spray="\x0c" * 8, int80="\xcd\x80", syscall="\x0f\x05"), "any"),
    Rule("PDF_Suspicious_Launch", "HIGH", "malware", _words(False, launch="/Launch", action="/Action") + _words(
        True, cmd="cmd.exe") + _words(False, open="/OpenAction"), "(launch AND action) OR cmd OR (open AND launch)"),
    Rule("PDF_Data_Exfiltration", "HIGH", "exfiltration", _words(
        False, submit="/SubmitForm", uri="/URI", importdata="/ImportData", gotor="/GoToR", launch="/Launch"),
        "(submit AND uri) OR importdata OR (gotor AND uri) OR (launch AND uri)"),
]
EXPLOIT_PATTERNS = [
    (r"\\x[0-9a-fA-F]{2}", "Shell-Escape-Sequenzen"),
    (r"(?i)getenv|system|exec|popen|passthru", "System-Call-Hinweise"),
    (r"\\u[0-9a-fA-F]{4}", "Unicode-Escape (JS-Obfuskation)"),
    (r"(?i)eval\s*\(", "eval()-Aufruf"),
    (r"(?i)unescape\s*\(", "unescape()-Aufruf"),
    (r"(?i)String\.fromCharCode", "String.fromCharCode (Obfuskation)"),
    (r"(?i)ActiveXObject", "ActiveX-Objekt-Erstellung"),
    (r"(?i)shellcode|heap\s*spray|NOP\s*sled", "Exploit-Terminologie"),
    (r"(?i)CVE-\d{4}-\d+", "CVE-Referenz"),
    (r"(?:%[0-9a-fA-F]{2}){10}", "URL-kodierter Payload (>=10 Seq.)"),
    (r"(?s)/JBIG2Decode.*\x00{20,}", "JBIG2-Null-Padding (CVE-2009-*)"),
    (r"(?i)this\.exportDataObject", "exportDataObject (Datei-Exfiltration)"),
    (r"(?i)app\.launchURL", "launchURL (URL-Start)"),
    (r"(?i)util\.printf", "util.printf (Format-String)"),
]
CONTENT_PATTERNS = [
    (r"(?:q\s+){10,}", "Excessive q (save-state) — Stack-Overflow-Versuch"),
    (r"(?:Q\s+){10,}", "Excessive Q (restore-state) — Stack-Underflow-Versuch"),
    (r"/JavaScript\s", "JavaScript-Referenz im Content-Stream"),
    (r"/Launch\s", "Launch-Action im Content-Stream"),
    (r"/URI\s", "URI-Action im Content-Stream"),
    (r"/GoTo\w*\s", "GoTo-Action im Content-Stream"),
    (r"\\x[0-9a-fA-F]{2}", "Hex-Escape-Sequenzen"),
]
# Possessive forms with the same matches: the plain ones recurse once for each repetition.
POSSESSIVE = {r"(?:q\s+){10,}": r"(?:q\s+){10,}+", r"(?:Q\s+){10,}": r"(?:Q\s+){10,}+"}
# Pattern that takes everything from the first marker to the last run of zeros: one match at most, and only behind a marker.
PADDED = {r"(?s)/JBIG2Decode.*\x00{20,}": ("/JBIG2Decode", r"\x00{20}")}
OBFUSCATION_PATTERNS = [
    (r"eval\s*\(", "eval() — mögliche Code-Obfuskation"),
    (r"unescape\s*\(", "unescape() — häufig bei Exploit-Code"),
    (r"String\.fromCharCode", "fromCharCode — Byte-Level-Obfuskation"),
    (r"\\u[0-9a-fA-F]{4}", "Unicode-Escape-Sequenzen"),
    (r"%[0-9a-fA-F]{2}%[0-9a-fA-F]{2}", "URL-Encoding in JS"),
]
SUSPICIOUS_CHAINS = [
    ["/FlateDecode", "/FlateDecode"], ["/ASCIIHexDecode", "/FlateDecode", "/FlateDecode"], ["/JBIG2Decode"], ["/Crypt"],
]
SUSPICIOUS_KEYS = [
    "/JavaScript", "/JS", "/Launch", "/EmbeddedFile", "/RichMedia", "/OpenAction", "/AA", "/URI", "/SubmitForm",
    "/ImportData", "/SetOCGState", "/Sound", "/Movie", "/Hide", "/GoToE",
]
VALID_OPERATORS = [
    "w", "J", "j", "M", "d", "ri", "i", "gs", "q", "Q", "cm", "m", "l", "c", "v", "y", "h", "re", "S", "s", "f", "F",
    "f*", "B", "B*", "b", "b*", "n", "W", "W*", "BT", "ET", "Tc", "Tw", "Tz", "TL", "Tf", "Tr", "Ts", "Td", "TD", "Tm",
    "T*", "Tj", "TJ", "'", '"', "d0", "d1", "CS", "cs", "SC", "SCN", "sc", "scn", "G", "g", "RG", "rg", "K", "k", "sh",
    "Do", "BI", "ID", "EI", "MP", "DP", "BMC", "BDC", "EMC", "BX", "EX",
]


def string_hits(text: Column, lowered: Column, s: RuleString) -> Column:
    """Number of occurrences of one rule string."""
    if s.regex:
        return F.regexp_count(text, F.lit(("(?i)" if s.nocase else "") + s.pattern)).cast("long")
    return count_of(lowered, s.pattern.lower()) if s.nocase else count_of(text, s.pattern)


def scan_rules(df: DataFrame, key: str, text: str, rules: list[Rule] | None = None) -> DataFrame:
    """Fired rules per document: severity (CRITICAL counts as HIGH), occurrences and matched strings.

    Two projections: first the occurrences of every string as plain columns, then the conditions as
    ordinary SQL over those columns."""
    rules = BUILTIN_RULES if rules is None else rules
    names = {(r.name, s.name): f"_h{i}_{j}" for i, r in enumerate(rules) for j, s in enumerate(r.strings)}
    raw, lowered = F.col("_text"), F.col("_low")
    based = df.select(key, F.col(text).alias("_text"), F.lower(F.col(text)).alias("_low"))
    counted = based.select(key, *[
        string_hits(raw, lowered, s).alias(names[r.name, s.name]) for r in rules for s in r.strings])
    fired = [_fired(r, {s.name: names[r.name, s.name] for s in r.strings}) for r in rules]
    found = F.filter(F.array(*fired), lambda f: f.isNotNull())
    return counted.select(key, F.explode(found).alias("f")).select(key, "f.*")


def _condition(rule: Rule, columns: dict[str, str]) -> Column:
    if rule.condition == "any" or rule.condition.endswith(" of them"):
        needed = 1 if rule.condition == "any" else int(rule.condition.split()[0])
        present = F.lit(0)
        for c in columns.values():
            present = present + F.when(F.col(c) > 0, 1).otherwise(0)
        return present >= needed
    words = re.findall(r"\w+|[()]|\S", rule.condition)
    allowed = {"(", ")", "AND", "OR", "NOT", *columns}
    if bad := [w for w in words if w not in allowed]:
        raise ValueError(f"rule {rule.name}: {bad} not allowed in its condition")
    return F.expr(" ".join(f"({columns[w]} > 0)" if w in columns else w for w in words))


def _fired(rule: Rule, columns: dict[str, str]) -> Column:
    total = F.lit(0).cast("long")
    for c in columns.values():
        total = total + F.col(c)
    matched = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(n)) for n, c in columns.items()]), lambda n: n.isNotNull())
    return F.when(_condition(rule, columns), F.struct(
        F.lit(rule.name).alias("rule"),
        F.lit("HIGH" if rule.severity in ("CRITICAL", "HIGH") else "MEDIUM").alias("severity"),
        F.lit(rule.category).alias("category"), total.alias("string_count"),
        F.array_join(F.slice(matched, 1, MATCHED_STRINGS_SHOWN), ",").alias("matched"), F.size(matched).cast("long").alias("n_matched")))


RULE_SCHEMA = ("rule string, severity string, category string, condition string, string string, pattern string, "
               "nocase boolean, regex boolean")


def rules_from(table: DataFrame, known: list[Rule] | None = None) -> tuple[list[Rule], list[str]]:
    """Rules from a table with one row per rule string, after the known ones; broken rules are left out
    and reported. The table must be small: it is part of the query text."""
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rule strings")
    grouped: dict[str, list] = {}
    for row in rows:
        grouped.setdefault(row["rule"] or "", []).append(row)
    rules, warnings = list(known or []), []
    for name, parts in sorted(grouped.items()):
        head = parts[0]
        strings = tuple(RuleString(p["string"], p["pattern"], bool(p["nocase"]), bool(p["regex"]))
                        for p in parts if p["string"] and p["pattern"])
        rule = Rule(name, head["severity"] or "MEDIUM", head["category"] or "unknown", strings, head["condition"] or "any")
        try:
            if not name or not strings:
                raise ValueError(f"rule {name!r} has no strings")
            _condition(rule, {s.name: s.name for s in strings})
            rules.append(rule)
        except ValueError as exc:
            warnings.append(str(exc))
    return rules, warnings


def load_rules(spark: SparkSession, path: str, known: list[Rule] | None = None) -> tuple[list[Rule], list[str]]:
    """JSON rule files of a folder; unreadable lines are skipped."""
    table = spark.read.schema(RULE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rules_from(table, known)


def pattern_hits(df: DataFrame, keys: list[str], text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Matches and first match per pattern over the whole text, in time linear in its length."""
    t = F.col(text)

    def hit(pattern: str, name: str) -> Column:
        count = F.regexp_count(t, F.lit(POSSESSIVE.get(pattern, pattern)))
        test = t.rlike(POSSESSIVE.get(pattern, pattern))
        if pattern in PADDED:
            marker, rest = PADDED[pattern]
            at = F.instr(t, marker)
            test, count = (at > 0) & F.substr(t, at).rlike(rest), F.lit(1)
        return F.when(test, F.struct(
            F.lit(name).alias("pattern"), count.cast("long").alias("match_count"),
            F.substring(F.regexp_extract(t, POSSESSIVE.get(pattern, pattern), 0), 1, 60).alias("sample")))

    found = F.filter(F.array(*[hit(p, name) for p, name in patterns]), lambda h: h.isNotNull())
    return df.select(*keys, F.explode(found).alias("h")).select(*keys, "h.*")


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike(POSSESSIVE.get(p, p)), name) for p, name in patterns])


def chain_types(chain: Column) -> Column:
    """Kinds of a suspicious filter chain, one per matching entry of the list."""
    flates = F.size(F.filter(chain, lambda f: f == "/FlateDecode"))
    crypt = F.array_contains(chain, "/Crypt")
    kinds = []
    for listed in SUSPICIOUS_CHAINS:
        same = chain == F.array(*[F.lit(f) for f in listed])
        hit = same | F.array_contains(chain, listed[0]) if len(listed) == 1 else same
        kind = F.lit("jbig2_stream") if listed == ["/JBIG2Decode"] else (
            F.when(crypt, "encrypted_stream").when(flates >= 2, "double_deflate"))
        kinds.append(F.when(hit, kind))
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def suspicious_keys(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in SUSPICIOUS_KEYS]), lambda k: k.isNotNull())


def operator_tokens(text: Column) -> Column:
    """Instruction-like words: valid ones, and letters-only words of up to three characters."""
    words = F.split(text, r"\s+")
    return F.filter(words, lambda w: w.isin(VALID_OPERATORS) | w.rlike(r"^[a-zA-Z]{1,3}$"))
