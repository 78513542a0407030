"""Findings from the network indicators of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.functions import network as net
from vestigia.operators.common import rule


def with_indicators(df: DataFrame, text: str) -> DataFrame:
    """Adds urls, ips, emails and their split. One projection per step, no shuffle."""
    found = df.withColumns({
        "urls": net.urls(F.col(text)), "ips": net.ips(F.col(text)), "emails": net.emails(F.col(text)),
    })
    return found.withColumns({
        "external_ips": F.filter("ips", lambda ip: ~net.is_private_ip(ip)),
        "internal_ips": F.filter("ips", net.is_private_ip),
        "onion_urls": F.filter("urls", net.is_onion),
        "suspicious_urls": F.filter("urls", lambda u: net.is_suspicious_url(u)),
        "total_indicators": (F.size("urls") + F.size("ips") + F.size("emails")).cast("long"),
    })


def indicator_rules() -> list[Column]:
    def n(name: str) -> Column:
        return F.size(name)

    return [
        rule(n("onion_urls") > 0, "HIGH", "ioc", "darknet_url", n("onion_urls")),
        rule(n("external_ips") > 0, "MEDIUM", "ioc", "external_ip", n("external_ips")),
        rule(n("internal_ips") > 0, "LOW", "ioc", "internal_ip", n("internal_ips")),
        rule((n("suspicious_urls") > 0) & (n("onion_urls") == 0), "MEDIUM", "ioc", "suspicious_url",
             n("suspicious_urls")),
    ]
