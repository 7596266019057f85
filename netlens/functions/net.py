"""Column helpers for addresses, labels and remark lines."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens import model


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative numbers."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b).cast("long")


def total(x: Column) -> Column:
    """Sum of numbers that may be large: nanoseconds of many rows do not fit 64 bits."""
    return F.sum(x.cast("decimal(28,0)"))


def ip_to_hex(ip: Column) -> Column:
    """Eight lower-case hex digits of an IPv4 number."""
    return F.lower(F.lpad(F.hex(ip), 8, "0"))


def hex_to_ip(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def ip_to_text(ip: Column) -> Column:
    """Dotted form of an IPv4 number."""
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def text_to_ip(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return sum((parts[k].cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), parts[0].cast("long") * (1 << 24))


@F.pandas_udf(T.StringType())
def ipv6_to_hex(text: pd.Series) -> pd.Series:
    """32 hex digits of an IPv6 text (with :: forms); null where it is none."""

    def one(x: str | None) -> str | None:
        try:
            return ipaddress.IPv6Address(x).packed.hex()
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def is_hex(text: Column) -> Column:
    return text.rlike("^([0-9a-fA-F]{2})+$")


def epoch_to_iso(second: Column) -> Column:
    """ISO text in the session's time zone."""
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss")


def iso_to_epoch(text: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(F.regexp_replace(text, "Z$", ""), "yyyy-MM-dd'T'HH:mm:ss")).cast("long")


def minute(second: Column) -> Column:
    return div(second, 60) * 60


def label(value: Column, names: dict[int, str]) -> Column:
    """Text of an enumerated number, empty where it has none."""
    out = F.lit("")
    for k, name in names.items():
        out = F.when(value == k, name).otherwise(out)
    return out


def protocol_label(l7: Column, protocol: Column) -> Column:
    """Application protocol if one was detected, else the transport."""
    return F.when(l7 > 0, label(l7, model.L7)).otherwise(F.coalesce(F.nullif(label(protocol, model.PROTOCOLS), F.lit("")), F.lit("non-IP")))


def cast_type(source_is_small: Column, src: Column, dst: Column) -> Column:
    """UNICAST, MULTICAST or BROADCAST by the destination if the source is the smaller address, else by the source."""
    ip = F.when(source_is_small == 1, dst).otherwise(src)
    first = F.shiftright(ip, 24)
    return F.when(ip == 0xFFFFFFFF, "BROADCAST").when((first >= 224) & (first <= 239), "MULTICAST").when(ip.isNull(), "UNKNOWN").otherwise("UNICAST")


def in_network(ip: Column, network: Column, mask: Column) -> Column:
    return ip.bitwiseAND(mask) == network


def remark(content: Column, key: str) -> Column:
    """Value of the first ``key=`` line of a remark; empty if there is none."""
    return F.regexp_extract(content, rf"(?m)^{key}=([^\r\n]*)", 1)


def remarks(content: Column, key: str) -> Column:
    """Values of all ``key=`` lines."""
    return F.regexp_extract_all(content, F.lit(rf"(?m)^{key}=([^\r\n]*)"), F.lit(1))


def header(content: Column, key: str) -> Column:
    """Value of a header line ``key: value``."""
    return F.trim(F.regexp_extract(content, rf"(?m)^{key}: *([^\r\n]*)", 1))


def browser(agent: Column) -> Column:
    """Browser of a user agent; the first name that it contains, in this order."""
    names = [("Chrome", "Chrome"), ("Firefox", "Firefox"), ("Edg/", "Edge"), ("Trident/", "Internet Explorer"), ("MSIE", "Internet Explorer"), ("Safari", "Safari")]
    return _first(agent, names)


def operating_system(agent: Column) -> Column:
    names = [
        ("Windows NT 10", "Windows 10"), ("Windows NT 6.3", "Windows 8.1"), ("Windows NT 6.2", "Windows 8"), ("Windows NT 6.1", "Windows 7"), ("Windows", "Windows"),
        ("Android", "Android"), ("Mac OS X", "macOS"), ("iPhone OS", "iOS"), ("iPad", "iPadOS"), ("Linux", "Linux"),
    ]
    return _first(agent, names)


def _first(text: Column, names: list[tuple[str, str]]) -> Column:
    out = F.lit("Others")
    for part, name in reversed(names):
        out = F.when(text.contains(part), name).otherwise(out)
    return out
