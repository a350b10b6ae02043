"""Host classification: which URLs point at private or blocked addresses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import urls
from ..functions.text import constant, let

# Address ranges, host names and addresses that are never public.
BLOCKED_RANGES: list[str] = [
    "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16",
    "0.0.0.0/8", "100.64.0.0/10", "198.18.0.0/15", "::1/128", "fc00::/7", "fe80::/10",
]
BLOCKED_HOSTNAMES: list[str] = ["localhost", "metadata.google.internal", "metadata.internal", "instance-data"]
BLOCKED_IPS: list[str] = ["169.254.169.254", "169.254.170.2", "fd00:ec2::254"]

_V4 = [n for n in map(ipaddress.ip_network, BLOCKED_RANGES) if n.version == 4]
_V6 = [n for n in map(ipaddress.ip_network, BLOCKED_RANGES) if n.version == 6]
_NUMERIC_HOST = r"^(?:0[xX][0-9a-fA-F]+|[0-9]+)(?:\.(?:0[xX][0-9a-fA-F]+|[0-9]+)){0,3}$"


def blocked_ranges() -> list[dict]:
    """IPv4 ranges as closed integer intervals."""
    return [
        {"cidr": str(n), "lo": int(n.network_address), "hi": int(n.broadcast_address)} for n in _V4
    ]


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as a number, in any notation an address parser accepts
    (decimal, octal and hexadecimal parts, 1 to 4 of them); NULL for names."""

    def part(p: Column) -> Column:
        lower = F.lower(p)
        return (
            F.when(lower.startswith("0x"), F.conv(F.substring(lower, 3, 64), 16, 10))
            .when(lower.rlike("^0[0-7]+$"), F.conv(lower, 8, 10))
            .when(lower.rlike("^(0|[1-9][0-9]*)$"), lower)
            .try_cast("bigint")
        )

    def combine(parts: Column) -> Column:
        n = F.size(parts)
        head = F.slice(parts, F.lit(1), n - 1)
        last = F.element_at(parts, -1)
        width = F.lit(5) - n  # bytes the last part stands for
        limit = F.pow(F.lit(256.0), width).cast("bigint")
        value = F.aggregate(head, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
        valid = ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(head, lambda p: p > 255) & (last < limit)
        return F.when(valid, value * limit + last)

    parts = F.transform(F.split(host, r"\.", -1), part)
    return F.when(host.rlike(_NUMERIC_HOST), let(parts, combine))


def ipv4_text(number: Column) -> Column:
    octets = [F.shiftright(number, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


@F.pandas_udf(T.StringType())
def _ipv6_reason(hosts: pd.Series) -> pd.Series:
    def reason(host: str | None) -> str | None:
        if host is None:
            return None
        try:
            address = ipaddress.ip_address(host.split("%")[0])
        except ValueError:
            return None
        if str(address) in BLOCKED_IPS:
            return f"Blocked IP (cloud metadata): {address}"
        for network in _V6:
            if address in network:
                return f"Private/internal IP: {address} ({network})"
        return None

    return hosts.map(reason)


def classify_host(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``allowed`` and ``reason``. Names are not looked up and count as public."""
    host, authority = F.col("_host"), F.col("_net")
    ranges = constant(blocked_ranges(), "array<struct<cidr: string, lo: bigint, hi: bigint>>")
    staged = df.withColumn("_net", urls.netloc(F.col(url_col))).withColumn("_host", urls.hostname(F.col(url_col)))
    staged = staged.withColumn("_v4", ipv4_number(host)).withColumn("_ip", F.when(F.col("_v4").isNotNull(), ipv4_text(F.col("_v4"))))
    hit = F.get(
        let(F.col("_v4"), lambda v: F.filter(ranges, lambda r: (v >= r.getField("lo")) & (v <= r.getField("hi")))), F.lit(0)
    )
    staged = staged.withColumn("_range", hit.getField("cidr"))
    staged = staged.withColumn("_v6", _ipv6_reason(F.when(F.contains(host, F.lit(":")), host)))

    name_blocked = F.lit(False)
    for name in BLOCKED_HOSTNAMES:
        name_blocked = name_blocked | (host == name) | host.endswith("." + name)
    reason = (
        F.when(
            F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]")),
            F.lit("URL validation error: Invalid IPv6 URL"),
        )
        .when(host.isNull(), F.lit("No hostname in URL"))
        .when(name_blocked, F.concat(F.lit("Blocked hostname: "), host))
        .when(F.col("_ip").isin(BLOCKED_IPS), F.concat(F.lit("Blocked IP (cloud metadata): "), F.col("_ip")))
        .when(
            F.col("_range").isNotNull(),
            F.concat(F.lit("Private/internal IP: "), F.col("_ip"), F.lit(" ("), F.col("_range"), F.lit(")")),
        )
        .otherwise(F.coalesce("_v6", F.lit("")))
    )
    return staged.withColumn("reason", reason).select(*df.columns, (F.col("reason") == "").alias("allowed"), "reason")
