"""Network indicators inside text: URLs, IP addresses, e-mail addresses. Row-local expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicator patterns and the watched hosts.
URL_PATTERN = r"""(?i)https?://[^\s<>"{}|\\^`\[\]']{4,}"""
IP_PATTERN = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
# The same matches in linear time: a search starts where a run of local characters starts, or where the last match ended.
EMAIL_SEARCH = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL_TAIL = r"""[.,;)"']+$"""
SUSPICIOUS_TLDS = [".onion", ".ru", ".to", ".xyz", ".bit", ".tk", ".cc", ".su"]
URL_SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "short.link",
    "cutt.ly", "rebrand.ly", "is.gd", "buff.ly", "adf.ly",
]
PRIVATE_RANGES = [
    ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16),
]


def _where(test: Column, found: Column) -> Column:
    """Run the costly pattern only where a cheap necessary test holds."""
    return F.when(test, found).when(test.isNotNull(), F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    """Distinct URLs in order of first appearance, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))
    trimmed = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, URL_TAIL, "")))
    return _where(text.contains("://"), trimmed)


def ips(text: Column) -> Column:
    """Distinct dotted quads; a zero-padded octet makes the address invalid."""
    found = F.regexp_extract_all(text, F.lit(IP_PATTERN), F.lit(0))
    valid = F.array_distinct(F.filter(found, lambda ip: ~ip.rlike(r"(^|\.)0\d")))
    return _where(text.rlike(r"\d\.\d{1,3}\.\d"), valid)


def emails(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(EMAIL_SEARCH), F.lit(0))
    return _where(text.contains("@"), F.array_distinct(F.transform(found, F.lower)))


def url_authority(url: Column) -> Column:
    """User info, host and port, as written; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(url_authority(url)), r"^.*@", "")
    return F.regexp_replace(bare, r":\d*$", "")


def ip_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.element_at(octets, i + 1).cast("long")
    return value


def _network(address: str, bits: int) -> tuple[int, int]:
    low = 0
    for part in address.split("."):
        low = low * 256 + int(part)
    return low, low + 2 ** (32 - bits) - 1


def is_private_ip(ip: Column) -> Column:
    number = ip_number(ip)
    hit = F.lit(False)
    for address, bits in PRIVATE_RANGES:
        low, high = _network(address, bits)
        hit = hit | number.between(F.lit(low), F.lit(high))
    return hit


def is_suspicious_url(url: Column, mode: str = "host") -> Column:
    """A watched top-level domain or a shortener. mode="compat" looks for the domain anywhere in the URL."""
    host = url_host(url)
    if mode == "compat":
        tld = F.lit(False)
        for suffix in SUSPICIOUS_TLDS:
            tld = tld | F.lower(url).contains(suffix)
    else:
        tld = host.rlike(r"\.(" + "|".join(t[1:] for t in SUSPICIOUS_TLDS) + r")$")
    return tld | F.regexp_replace(host, r"^www\.", "").isin(URL_SHORTENERS)


def suspicion(url: Column) -> Column:
    """Why a URL is suspicious: onion, shortener or domain; null if it is not."""
    shortener = F.regexp_replace(url_host(url), r"^www\.", "").isin(URL_SHORTENERS)
    return F.when(is_suspicious_url(url), F.when(is_onion(url), "onion").when(shortener, "shortener").otherwise("domain"))


def is_onion(url: Column) -> Column:
    return F.lower(url).contains(".onion")
