"""Query conditions, compiled to a predicate on sessions and semi-joins on facts."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import model
from netlens.functions import net
from netlens.sources.tables import TIME, Tables


@dataclass(frozen=True)
class Network:
    """An IPv4 network with an optional port and alias; host bits must be zero."""

    ip: int
    mask: int = 0xFFFFFFFF
    port: int = 0
    alias: str = ""

    def __post_init__(self) -> None:
        if self.ip & ~self.mask & 0xFFFFFFFF:
            raise ValueError(f"host bits are set in {self.ip:08x} under mask {self.mask:08x}")

    @classmethod
    def parse(cls, text: str) -> Network | Network6:
        """Dotted text with an optional /length, or hex of 8 digits, or of 10 with the length in the last two; of version 6:
        text with colons, or hex of 32 digits, or of 34."""
        if ":" in text:
            six = ipaddress.IPv6Network(text, strict=True)
            return Network6(six.network_address.packed.hex(), six.broadcast_address.packed.hex())
        if "." in text:
            net_ = ipaddress.IPv4Network(text, strict=True)
            return cls(int(net_.network_address), int(net_.netmask))
        digits = {8: 8, 10: 8, 32: 32, 34: 32}.get(len(text))
        if digits is None:
            raise ValueError(f"{text!r} is no address")
        bits = int(text[digits:], 16) if len(text) > digits else 4 * digits
        if digits == 32:
            return cls.parse(f"{ipaddress.IPv6Address(int(text[:32], 16))}/{bits}")
        return cls(int(text[:8], 16), (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF)

    def covers(self, other: Network | Network6) -> bool:
        return isinstance(other, Network) and self.mask <= other.mask and other.ip & self.mask == self.ip


@dataclass(frozen=True)
class Network6:
    """An IPv6 network as the range of its addresses in 32 lower-case hex digits, whose order as text is their own."""

    low: str
    high: str
    port: int = 0
    alias: str = ""

    def covers(self, other: Network | Network6) -> bool:
        return isinstance(other, Network6) and self.low <= other.low and other.high <= self.high


def networks(texts: list[str]) -> list[Network | Network6]:
    """Parsed networks without those that another one covers."""
    found = [Network.parse(t) for t in dict.fromkeys(texts)]
    return [x for x in found if not any(y != x and y.covers(x) for y in found)]


@dataclass(frozen=True)
class Conditions:
    """What a query asks for.  An empty list or None asks for nothing; times are inclusive seconds."""

    second_from: int = 0
    second_to: int = 1 << 40
    ips: tuple[Network | Network6, ...] = ()
    include_external: bool = True
    ports: tuple[tuple[int, int], ...] = ()
    payload_protocol: int | None = None
    l7: int | None = None
    vlans: tuple[int, ...] = ()
    mpls: tuple[int, ...] = ()
    tags: tuple[str, ...] = ()
    apps: tuple[str, ...] = ()
    excluded: tuple[tuple[int, int | None], ...] = ()
    server_ports: tuple[tuple[int, int], ...] = ()
    cached: tuple[int, int] | None = None
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def within(self, second: Column) -> Column:
        """Time predicate of a fact, without the range that a rollup answers."""
        inside = second.between(self.second_from, self.second_to)
        return inside & ~second.between(*self.cached) if self.cached else inside

    def asked(self) -> set[str]:
        """Names of the conditions, besides time, that this question sets."""
        free = {"second_from", "second_to", "include_external", "cached", "extra"}
        return {f.name for f in fields(self) if f.name not in free and getattr(self, f.name) not in ((), None)}

    def parts(self, cached: tuple[int, int]) -> tuple[Conditions, Conditions]:
        """The same question for raw data outside a rollup's range, and for the rollup inside it."""
        return replace(self, cached=cached), replace(self, second_from=max(self.second_from, cached[0]), second_to=min(self.second_to, cached[1]))


def parse_ports(text: str) -> tuple[tuple[int, int], ...]:
    """Ports and ranges: ``80,443,1000-2000``."""
    out = []
    for part in filter(None, text.split(",")):
        low, _, high = part.partition("-")
        out.append((int(low), int(high or low)))
    return tuple(out)


#: Conditions that a kind of query brings along.
IMPLIED = {"http": {"l7": 2}, "dnstracker": {"l7": 1}, "tlstracker": {"l7": 7}, "voipmonitor": {"l7": 11}, "icmpwalk": {"payload_protocol": model.ICMP}, "icmp6walk": {"payload_protocol": model.ICMP6}, "packethash": {"payload_protocol": model.TCP}}


def implied(where: Conditions, kind: str) -> Conditions:
    """The conditions with those that a kind of query brings along."""
    return replace(where, **IMPLIED[kind])


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def member(ip: Column, nets: tuple[Network | Network6, ...], ip6: Column | None = None) -> Column:
    """Whether an address, or its form of version 6, lies in one of the networks."""
    tests = [net.in_network(ip, F.lit(n.ip), F.lit(n.mask)) for n in nets if isinstance(n, Network)]
    if ip6 is not None:
        tests += [F.coalesce(ip6.between(n.low, n.high), F.lit(False)) for n in nets if isinstance(n, Network6)]
    return any_of(tests) if tests else F.lit(False)


def named_addresses(tables: Tables, where: Conditions) -> DataFrame | None:
    """Addresses (ip_hex) that the asked tags and apps stand for; None where none is asked."""
    names = None
    if where.tags:
        names = tables["tag_ip"].where(F.col("tag").isin(*where.tags)).select("ip_hex")
    if where.apps:
        called = lambda rows: rows.where(any_of([F.col("name").contains(a) for a in where.apps]))
        like = called(tables["fqdns"]).select("ip_hex")
        like = like.unionByName(called(tables["user_apps"]).select(F.explode(F.split("ips", ",")).alias("ip_hex")))
        if like.isEmpty():  # the users' lists, small tables
            raise ValueError(f"no app is called {' or '.join(where.apps)}")
        names = like if names is None else names.unionByName(like)
    return names


def accepted(tables: Tables, where: Conditions) -> DataFrame:
    """Sessions that meet the conditions."""
    s = tables["sessions"]
    s = s.where((F.col("last_second") >= where.second_from) & (F.col("first_second") <= where.second_to))
    columns = s.columns
    if any(isinstance(n, Network6) for n in where.ips):
        s = s.join(tables["session_ip6"], "session_id", "left")
        src, dst = member(F.col("src_ip"), where.ips, F.col("src_ip6")), member(F.col("dst_ip"), where.ips, F.col("dst_ip6"))
        s = s.where(src | dst if where.include_external else src & dst).select(*columns)
    elif where.ips:
        src, dst = member(F.col("src_ip"), where.ips), member(F.col("dst_ip"), where.ips)
        s = s.where(src | dst if where.include_external else src & dst)
    names = named_addresses(tables, where)
    if names is not None:
        digits = F.length("ip_hex")
        wanted = names.where(digits == 8).select(net.hex_to_ip(F.col("ip_hex")).alias("wanted")).distinct()
        ends = [s.join(wanted, s[c] == wanted["wanted"], "left_semi").select("session_id") for c in ("src_ip", "dst_ip")]
        if not names.where(digits == 32).isEmpty():
            six, wanted6 = tables["session_ip6"], names.where(digits == 32).select(F.col("ip_hex").alias("wanted6")).distinct()
            more = [six.join(wanted6, six[c] == wanted6["wanted6"], "left_semi").select("session_id") for c in ("src_ip6", "dst_ip6")]
            ends = [a.unionByName(b) for a, b in zip(ends, more, strict=True)]
        src, dst = ends
        s = s.join(src.unionByName(dst).distinct() if where.include_external else src.intersect(dst), "session_id", "left_semi")
    if where.ports:
        s = s.where(any_of([F.col("src_port").between(a, b) | F.col("dst_port").between(a, b) for a, b in where.ports]))
    if where.server_ports:
        s = s.where(any_of([F.col("dst_port").between(a, b) for a, b in where.server_ports]))
    if where.payload_protocol is not None:
        s = s.where(F.col("payload_protocol") == where.payload_protocol)
    if where.l7 is not None:
        s = s.where(F.col("l7") == where.l7)
    for table, tags in (("session_vlan", where.vlans), ("session_mpls", where.mpls)):
        if tags:
            s = s.join(tables[table].where(F.col("tag").isin(*tags)), "session_id", "left_semi")
    for a, b in where.excluded:
        if b is None:
            s = s.where((F.col("src_ip") != a) & (F.col("dst_ip") != a))
        else:
            s = s.where(~((F.least("src_ip", "dst_ip") == min(a, b)) & (F.greatest("src_ip", "dst_ip") == max(a, b))))
    return s


def facts(tables: Tables, name: str, where: Conditions, columns: list[str] | None = None) -> DataFrame:
    """Facts in time, with the named columns of their accepted sessions (none: a semi-join)."""
    time = TIME[name]
    fact = tables[name].where(where.within(F.col(time)))
    sessions = accepted(tables, where)
    if name == "timeouts":
        ids = sessions.select("session_id")
        return fact.join(ids, "session_id", "left_semi")
    if not columns:
        return fact.join(sessions.select("session_id"), "session_id", "left_semi")
    return fact.join(sessions.select("session_id", *columns), "session_id")
