"""Dates and time stamps hidden in text and identifiers. Row-local expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, epochs and the region of each UTC offset (minutes).
DOCUMENT_DATE = r"^[Dd]:\d{14}"
UUID1_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-1[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
UUID_EPOCH_TICKS = 122192928000000000
FILETIME_EPOCH_MICROS = 11644473600000000
UUID_HIGH_DELTA_SECONDS = 3600
UUID_MEDIUM_DELTA_SECONDS = 60
UTC_LABEL = "Z (UTC)"
OFFSET_REGIONS = {
    -720: "UTC-12 (Baker Island)",
    -660: "UTC-11 (Samoa)",
    -600: "UTC-10 (Hawaii)",
    -570: "UTC-9:30 (Marquesas)",
    -540: "UTC-9 (Alaska)",
    -480: "UTC-8 (USA Pacific / Los Angeles)",
    -420: "UTC-7 (USA Mountain / Denver)",
    -360: "UTC-6 (USA Central / Chicago)",
    -300: "UTC-5 (USA Eastern / New York, Brasilien)",
    -240: "UTC-4 (Atlantik, Venezuela)",
    -210: "UTC-3:30 (Neufundland)",
    -180: "UTC-3 (Argentinien, Brasília)",
    -120: "UTC-2 (Südatlantik)",
    -60: "UTC-1 (Azoren, Kap Verde)",
    0: "UTC+0 (UK, Irland, Portugal, West-Afrika)",
    60: "UTC+1 (Mitteleuropa: DE, FR, IT, ES, PL)",
    120: "UTC+2 (Osteuropa: GR, RO, FI; Israel; Südafrika)",
    180: "UTC+3 (Russland/Moskau, Ostafrika, Saudi-Arabien)",
    210: "UTC+3:30 (Iran)",
    240: "UTC+4 (Russland/Samara, UAE, Pakistan-Westrand)",
    270: "UTC+4:30 (Afghanistan)",
    300: "UTC+5 (Pakistan, Usbekistan)",
    330: "UTC+5:30 (Indien, Sri Lanka)",
    345: "UTC+5:45 (Nepal)",
    360: "UTC+6 (Bangladesch, Kasachstan)",
    390: "UTC+6:30 (Myanmar)",
    420: "UTC+7 (Thailand, Vietnam, Russland/Krasnojarsk)",
    480: "UTC+8 (China, Australien/Perth, Singapur)",
    525: "UTC+8:45 (Australien/Eucla)",
    540: "UTC+9 (Japan, Südkorea, Russland/Jakutsk)",
    570: "UTC+9:30 (Australien/Darwin, Adelaide-Normalzeit)",
    600: "UTC+10 (Australien/Sydney, Papua-Neuguinea)",
    630: "UTC+10:30 (Australien/Lord Howe Island)",
    660: "UTC+11 (Salomonen, Russland/Magadan)",
    720: "UTC+12 (Neuseeland, Russland/Kamtschatka)",
    765: "UTC+12:45 (Neuseeland/Chatham)",
    780: "UTC+13 (Tonga, Samoa-Sommerzeit)",
    840: "UTC+14 (Kiribati/Linieninseln)",
}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def parse_document_date(raw: Column) -> Column:
    """Struct of local time, UTC time, offset and label from `D:YYYYMMDDHHmmSS±HH'mm'`; null if invalid.
    The sign is one of + - Z, and the offset is really applied to the UTC time. One regex decides about the
    shape; the digits have fixed places."""
    text = F.trim(raw)

    def digits(start: int, length: int) -> Column:
        return F.substring(text, start, length).try_cast("int")

    second = digits(15, 2)
    sign = F.substring(text, 17, 1)
    zone = F.substring(text, 17, 8)
    shifted = sign.isin("+", "-")
    hours = F.coalesce(F.regexp_extract(zone, r"^[+-](\d{2})", 1).try_cast("int"), F.lit(0))
    rest = F.coalesce(F.regexp_extract(zone, r"^[+-](?:\d{2})?+'?(\d{2})", 1).try_cast("int"), F.lit(0))
    offset = F.when(~shifted, 0).when(sign == "+", hours * 60 + rest).otherwise(-(hours * 60 + rest))
    label = F.when(shifted, F.format_string("%s%02d:%02d", sign, hours, rest)).otherwise(UTC_LABEL)
    local = F.try_make_timestamp_ntz(digits(3, 4), digits(7, 2), digits(9, 2), digits(11, 2), digits(13, 2),
                                     second.cast("decimal(8,6)"))
    valid = text.rlike(DOCUMENT_DATE) & (second <= 59) & (digits(3, 4) >= 1) & local.isNotNull()
    return F.when(
        valid,
        F.struct(local.alias("local_ts"), (local - F.make_dt_interval(mins=offset)).alias("utc_ts"),
                 offset.alias("offset_min"), label.alias("label")))


def parse_iso(raw: Column) -> Column:
    """Date with optional time, from the first 19 characters; null if it does not parse."""
    head = F.substring(raw, 1, 19)
    shaped = head.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2})?$")
    return F.when(shaped, head.try_cast("timestamp_ntz"))


def uuid1_micros(uuid: Column) -> Column:
    """Creation time in epoch microseconds of a version 1 UUID."""
    digits = F.concat(F.substring(uuid, 16, 3), F.substring(uuid, 10, 4), F.substring(uuid, 1, 8))
    ticks = F.conv(digits, 16, 10).cast("long") - F.lit(UUID_EPOCH_TICKS)
    return F.call_function("div", ticks + 5, F.lit(10))


def uuids1(text: Column) -> Column:
    """Distinct version 1 UUIDs of a text, lower case, in order."""
    found = F.regexp_extract_all(text, F.lit(UUID1_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def uuid_severity(delta_seconds: Column) -> Column:
    return F.when(delta_seconds > UUID_HIGH_DELTA_SECONDS, "HIGH").when(delta_seconds > UUID_MEDIUM_DELTA_SECONDS, "MEDIUM")


def filetime(ticks: Column) -> Column:
    """100-nanosecond count since 1601 as a UTC time; 0 means not set."""
    us = F.call_function("div", ticks, F.lit(10)) - F.lit(FILETIME_EPOCH_MICROS)
    return F.when(ticks != 0, F.timestamp_micros(us))


def format_offset(minutes: Column) -> Column:
    sign = F.when(minutes < 0, "-").otherwise("+")
    size = F.abs(minutes)
    hours = F.floor(size / 60).cast("string")
    return F.concat(sign, hours, F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
