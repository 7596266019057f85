"""Answers from stored rollups: what is stored, which questions a rollup covers, and how facts fill the rest.

A rollup covers a question if its key holds everything the question filters by.  The range is then cut into a head of
facts, whole stored minutes, and a tail of facts; a question that no rollup covers, or a range with less than two stored
minutes, is answered from facts alone.  Each path gives the same rows as the operator on facts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.functions import net
from netlens.operators import rollup, series, topn, trackers
from netlens.plans.conditions import Conditions, accepted, any_of, implied, member, named_addresses
from netlens.sources.rollups import RollupStore
from netlens.sources.tables import TIME, Tables

#: What the key of each rollup can filter by.  Ports are not in the list: a client's port is in no key.
ANSWERS = {
    "seconds": set(),
    "flows": set(),
    "signature_seconds": {"ips", "tags", "apps"},
    "signature_flows": {"ips", "tags", "apps"},
    "pairs": {"ips", "tags", "apps", "payload_protocol", "l7", "server_ports", "excluded"},
    "dns": set(),
    "icmp": set(),
    "http_blocks": set(),
}
#: Columns of the service rollup besides minute, grain, metric and its sums.
PAIR_KEYS = ("ip", "ip2", "port", "direction", "payloadprotocol", "l7", "ip6", "ip62")
#: Those without the direction.
ENDS = tuple(c for c in PAIR_KEYS if c != "direction")
SERIES = ("bps", "pps", "averagelatency", "flowcounts", *series.COUNTS)
#: A timeout is noted so long after its session's last packet.
LAG = {"timeoutcounts": model.TIMEOUT_SECONDS, "timeouts": model.TIMEOUT_SECONDS}


# ---------------------------------------------------------------- what is stored


def _build_range(low: int, high: int, lag: int = model.TIMEOUT_SECONDS) -> Conditions:
    """Facts from ``low`` to before ``high``, also those of sessions that ended a little before."""
    return Conditions(low - lag, high - 1, cached=(low - lag, low - 1))


def _with_ip6(tables: Tables, sessions: DataFrame) -> DataFrame:
    six = tables["session_ip6"].select("session_id", F.col("src_ip6").alias("ip6"), F.col("dst_ip6").alias("ip62"))
    return sessions.join(six, "session_id", "left")


def pair_facts(tables: Tables, where: Conditions) -> DataFrame:
    """(minute, keys, metric, forward, backward) of every fact that a pair rollup adds up, with its session's keys; ``metric``
    is its place in :data:`PAIR_METRICS`, and the values of the two directions stand in one row.

    Each fact table is read once, and sessions are joined once for all of them, as the table that is hashed, so no fact is
    sorted."""
    none = F.lit(None).cast("long")
    code = lambda metric: F.lit(rollup.PAIR_METRICS.index(metric)).alias("metric")
    row = lambda time, metric, side, n, m=none: ["session_id", net.minute(F.col(time)).alias("minute"), code(metric), side.alias("side"), n.cast("long").alias("n"), m.alias("m")]
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = None
    for table, metric in (("bps", "bytes"), ("pps", "packets")):
        part = tables[table].where(where.within(F.col("second"))).where("small_to_big > 0 OR big_to_small > 0")
        part = part.select(*row("second", metric, F.lit(1), some("small_to_big"), some("big_to_small")))
        rows = part if rows is None else rows.unionByName(part)
    trips = tables["rtts"].where(where.within(F.col("second"))).where(series.good_rtt())
    rows = rows.unionByName(trips.select(*row("second", "latencies", F.col("small_to_big"), F.col("tail"))))
    for table, number, metric in [(*series.COUNTS["timeoutcounts" if b == "timeouts" else b], b) for b in topn.BASES[2:]]:
        found = tables[table].where(where.within(F.col(TIME[table])))
        found = found.where("marker_second <> 0") if table == "timeouts" else found if number is None else found.where(F.col("tail").bitwiseAND(0xFFFFFFFF) == number)
        own = F.lit(None).cast("int") if table == "timeouts" else F.col("small_to_big")
        rows = rows.unionByName(found.select(*row(TIME[table], metric, own, F.lit(1))))
    s = _with_ip6(tables, accepted(tables, where)).select("session_id", "source_is_small", F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2"), F.col("dst_port").alias("port"), F.col("payload_protocol").alias("payloadprotocol"), "l7", "ip6", "ip62")
    ahead = (F.col("metric") == code("timeouts")) | F.coalesce(F.col("side") == F.col("source_is_small"), F.lit(False))
    rows = rows.join(s.hint("shuffle_hash"), "session_id")
    return rows.select("minute", *ENDS, "metric", F.when(ahead, F.col("n")).otherwise(F.col("m")).alias("forward"), F.when(ahead, F.col("m")).otherwise(F.col("n")).alias("backward"))


def pair_minutes(tables: Tables, where: Conditions) -> DataFrame:
    """All metrics by minute and service, and by minute and source or destination, in wide rows: (minute, grain, keys without
    the direction, and for each metric its value in direction 1, ``metric_1``, and 0, ``metric_0``; null where it has none).

    The finest grain is added up first, in :func:`rollup.tasks` parts by minute and client, which are those of the sources
    too; the destinations come from its rows."""
    facts = pair_facts(tables, where).repartition(rollup.tasks(tables, where), "minute", "ip")
    place = {m: F.col("metric") == k for k, m in enumerate(rollup.PAIR_METRICS)}
    one = F.lit(1).cast("long")
    cells = []
    for way, column in ((1, "forward"), (0, "backward")):
        cells += [F.sum(F.when(place[m], F.col(column))).cast("long").alias(f"{m}_{way}") for m in rollup.PAIR_METRICS]
        cells.append(F.sum(F.when(place["latencies"] & F.col(column).isNotNull(), one)).alias(f"d_{way}"))
    finest = facts.groupBy("minute", *ENDS).agg(*cells)
    kinds = dict(finest.dtypes)
    values = [c for c in finest.columns if c not in ("minute", *ENDS)]
    out = None
    for grain, keys in (("service", ENDS), ("source", ("ip",)), ("destination", ("ip2", "port"))):
        rows = finest if grain == "service" else finest.groupBy("minute", *keys).agg(*[F.sum(c).cast("long").alias(c) for c in values])
        rows = rows.select("minute", F.lit(grain).alias("grain"), *[F.col(c) if c in keys else F.lit(None).cast(kinds[c]).alias(c) for c in ENDS], *values)
        out = rows if out is None else out.unionByName(rows)
    return out


def metric_rows(wide: DataFrame, *metrics: str) -> DataFrame:
    """Rows of :func:`pair_minutes` as one row for each metric and direction: (minute, grain, metric, keys, value, d)."""
    zero = F.lit(0).cast("long")
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(way).alias("direction"), F.coalesce(f"{m}_{way}", zero).alias("value"), (F.coalesce(f"d_{way}", zero) if m == "latencies" else zero).alias("d")) for m in metrics for way in (1, 0)]
    rows = wide.select("minute", "grain", *ENDS, F.explode(F.array(*cells)).alias("x")).select("minute", "grain", *ENDS, "x.*").where("value > 0 OR d > 0")
    return rows.select("minute", "metric", *PAIR_KEYS, "grain", "value", "d")


def pairs(tables: Tables, where: Conditions) -> DataFrame:
    """All metrics by minute and service, and by minute and source or destination: (minute, grain, metric, keys, value, d)."""
    return metric_rows(pair_minutes(tables, where), *rollup.PAIR_METRICS)


def flow_levels(sessions: DataFrame, low: int, high: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Sessions alive, in a form that can be added: for each minute the ``level`` in its last second before, and the changes
    in its seconds, ``steps``.  Minutes without either are left out.

    Rows of different sessions add up: :func:`merged_levels`.  The running level is a sum within hours and one over hours,
    so no task holds a long range."""
    s = sessions.where((F.col("last_second") >= low) & (F.col("first_second") < high))
    ends = F.array(F.struct(F.greatest("first_second", F.lit(low)).alias("t"), F.lit(1).alias("n")), F.struct((F.col("last_second") + 1).alias("t"), F.lit(-1).alias("n")))
    begun = F.col("x.n") * F.when((F.col("x.n") == 1) & (F.col("first_second") < low), 0).otherwise(1)
    steps = s.select(*by, "first_second", F.explode(ends).alias("x")).select(*by, F.col("x.t").alias("second"), begun.alias("n"), F.when(begun == 0, 1).otherwise(0).alias("carried"))
    steps = steps.where(F.col("second") < high).groupBy(*by, "second").agg(F.sum("n").alias("n"), F.sum("carried").alias("carried"))
    minute = steps.groupBy(*by, net.minute(F.col("second")).alias("minute")).agg(
        F.array_sort(F.collect_list(F.when(F.col("n") != 0, F.struct("second", "n")))).alias("steps"), F.sum("n").alias("change"), F.sum("carried").alias("carried")
    )  # at most 60 steps a minute
    keys = s.select(*by).distinct() if by else None
    calendar = sessions.sparkSession.range(low, high, 60).withColumnRenamed("id", "minute")
    # each key has every minute from its first to the end: a level goes on until it is changed
    if keys is not None:
        first = minute.groupBy(*by).agg(F.min("minute").alias("_from"))
        calendar = first.select(*by, F.explode(F.sequence(F.col("_from"), F.lit(high - 60).cast("long"), F.lit(60).cast("long"))).alias("minute"))
    every = calendar.join(minute, [*by, "minute"], "left").withColumn("moved", F.coalesce(F.col("change") + F.col("carried"), F.lit(0))).withColumn("block", net.div(F.col("minute"), 3600))
    blocks = every.groupBy(*by, "block").agg(F.sum("moved").alias("n"))
    ahead = F.sum("n").over(W.partitionBy(*by).orderBy("block")) - F.col("n")  # one row for each key and hour
    blocks = blocks.select(*by, "block", ahead.alias("before"))
    inside = F.sum("moved").over(W.partitionBy(*by, "block").orderBy("minute")) - F.col("moved")
    out = every.withColumn("inside", inside).join(blocks, [*by, "block"])
    level = F.col("before") + F.col("inside") + F.coalesce("carried", F.lit(0))
    none = F.array().cast("array<struct<second:bigint,n:bigint>>")
    return out.select(*by, "minute", level.cast("long").alias("level"), F.coalesce(F.col("steps").cast("array<struct<second:bigint,n:bigint>>"), none).alias("steps")).where("level <> 0 OR size(steps) > 0")


def merged_levels(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of :func:`flow_levels` of several sets of sessions added up."""
    return parts.groupBy(*by, "minute").agg(F.sum("level").cast("long").alias("level"), F.flatten(F.collect_list("steps")).alias("steps"))


def alive(levels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(timestamp, value) of every second of the minutes of :func:`merged_levels`."""
    second = F.explode(F.sequence(F.col("minute"), F.col("minute") + 59)).alias("timestamp")
    before = F.aggregate(F.filter("steps", lambda x: x["second"] <= F.col("timestamp")), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return levels.select(*by, "level", "steps", second).select(*by, "timestamp", (F.col("level") + before).cast("long").alias("value"))


#: Rollups with a folder for each signature.
SIGNED = ("signature_seconds", "signature_flows")


def _signatures(tables: Tables) -> set[str]:
    """All signatures of the users' tags and apps, which are small lists."""
    return {r["signature"] for r in rollup.signatures(tables, (8, 32)).select("signature").distinct().collect()}


def _members(tables: Tables, sessions: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Sessions that have an address of either version in a signature's set, with the signature, once for each."""
    sets = rollup.signatures(tables, (8, 32))
    sets = sets if only is None else sets.where(F.col("signature").isin(sorted(only)))
    sets = F.broadcast(sets.select("signature", F.explode("ips").alias("hex")))  # the users' lists are small
    ends = F.array(*[net.ip_to_hex(F.col(c)) for c in ("src_ip", "dst_ip")], "ip6", "ip62")
    rows = _with_ip6(tables, sessions).select(*sessions.columns, F.explode(ends).alias("hex"))
    return rows.join(sets, "hex").select(*sessions.columns, "signature").distinct()


def signature_flows(tables: Tables, low: int, high: int, only: set[str] | None = None) -> DataFrame:
    """Sessions alive by signature, as :func:`flow_levels` has them."""
    sessions = tables["sessions"].select("session_id", "src_ip", "dst_ip", "first_second", "last_second")
    return flow_levels(_members(tables, sessions, only), low, high, ("signature",))


def signature_seconds(tables: Tables, where: Conditions, only: set[str] | None = None) -> DataFrame:
    """Every per-second metric by signature, of addresses of both versions."""
    members = _members(tables, accepted(tables, where).select("session_id", "source_is_small", "src_ip", "dst_ip"), only)
    return rollup.by_metric(rollup.by_second(tables, where, members, "signature"), "signature")


def build(store: RollupStore, tables: Tables, low: int, high: int, names: tuple[str, ...] = tuple(ANSWERS)) -> None:
    """Build rollups for the whole minutes from ``low`` to before ``high``, from the tables of facts of that range."""
    where = _build_range(low, high)
    sessions = tables["sessions"]
    begun = F.col("minute").between(low, high - 60)

    def of(name: str) -> tuple[DataFrame, str]:
        if name == "seconds":
            return rollup.per_second(tables, where), "second"
        if name == "flows":
            return flow_levels(sessions, low, high), "minute"
        if name == "signature_seconds":
            return signature_seconds(tables, where), "second"
        if name == "signature_flows":
            return signature_flows(tables, low, high), "minute"
        if name == "pairs":
            return pair_minutes(tables, where), "minute"
        if name == "dns":
            return rollup.dns(tables, Conditions(low, high - 1 + model.TIMEOUT_SECONDS)).where(begun), "minute"
        if name == "icmp":
            return rollup.icmp(tables, where), "minute"
        return http_segments(tables, Conditions(low, high - 1)), "minute"

    known = _signatures(tables) if set(names) & set(SIGNED) else set()
    store.build(low, high, {name: of(name) for name in names}, {name: ("signature", known) for name in SIGNED})


def maintain_signatures(store: RollupStore, tables: Tables) -> tuple[set[str], set[str]]:
    """Bring the signature rollups up to the users' present tags and apps: new sets of addresses are built over all that is
    stored already, vanished ones lose their folders, and the files of all others are left alone.  Returns both sets."""
    now, new, gone = _signatures(tables), set(), set()
    for name in SIGNED:
        covered = store.covered(name)
        if covered is None:
            continue
        low, high = covered
        have = store.parts(name)
        fresh, old = now - have, have - now
        if fresh:
            rows = signature_seconds(tables, _build_range(low, high), fresh) if name == "signature_seconds" else signature_flows(tables, low, high, fresh)
            store.backfill(name, rows, "second" if name == "signature_seconds" else "minute", "signature", fresh)
        if old:
            store.drop(name, "signature", old)
        new, gone = new | fresh, gone | old
    return new, gone


# ---------------------------------------------------------------- the planner


@dataclass(frozen=True)
class Plan:
    """Where an answer comes from: stored minutes from ``low`` to before ``high`` of a rollup, or facts alone (None)."""

    rollup: str | None
    low: int = 0
    high: int = 0
    signature: str | None = None
    reason: str = ""

    def pieces(self, where: Conditions, lag: int = 0) -> list[Conditions]:
        """The questions that are left to facts.  Facts that come ``lag`` seconds late keep the sessions of the whole range."""
        if self.rollup is None:
            return [where]
        out = []
        if where.second_from < self.low:
            out.append(replace(where, second_to=self.low - 1))
        if self.high <= where.second_to:
            start = max(where.second_from, self.high - lag)
            out.append(replace(where, second_from=start, cached=(start, self.high - 1) if start < self.high else None))
        return out


def facts_only(reason: str) -> Plan:
    return Plan(None, reason=reason)


def plan(store: RollupStore, tables: Tables, name: str, where: Conditions, lag: int = 0) -> Plan:
    """Whether a rollup covers a question, and for which minutes."""
    missing = where.asked() - ANSWERS[name]
    if missing:
        return facts_only(f"{name} has no {', '.join(sorted(missing))} in its key")
    signature = None
    if name in SIGNED:
        if not where.include_external:
            return facts_only("a signature counts sessions with one end in its set")
        signature = asked_signature(tables, where)
        if signature is None:
            return facts_only("no signature has exactly the addresses that are asked for")
    covered = store.covered(f"{name}/{signature}" if signature else name)
    if covered is None:
        return facts_only(f"{name} has not been built")
    low = -(-max(where.second_from + lag, covered[0]) // 60) * 60
    high = min(where.second_to + 1, covered[1]) // 60 * 60
    if high - low < rollup.LEAST_SECONDS:
        return facts_only("less than two stored minutes")
    return Plan(name, low, high, signature, "covered")


def asked_signature(tables: Tables, where: Conditions) -> str | None:
    """The stored signature of exactly the asked addresses; None if they are none, networks, or differ from every set.
    The lists of tags and apps are the users' own and small."""
    names = named_addresses(tables, where)
    if where.ips and names is not None:
        return None  # both conditions hold at once: an intersection of sessions, not a set of addresses
    if names is None:
        whole = [f"{n.ip:08x}" for n in where.ips if getattr(n, "mask", 0) == 0xFFFFFFFF] + [n.low for n in where.ips if getattr(n, "low", None) is not None and n.low == n.high]
        if not whole or len(whole) != len(where.ips):
            return None
        names = tables.spark.createDataFrame([(x,) for x in whole], "ip_hex string")
    digest = F.md5(F.array_join(F.sort_array(F.collect_set("ip_hex")), ",").cast("binary"))
    asked = names.where(F.length("ip_hex").isin(8, 32)).agg(digest.alias("signature"))
    found = rollup.signatures(tables, (8, 32)).select("signature").distinct().join(asked, "signature").head()
    return found["signature"] if found else None


# ---------------------------------------------------------------- answers


def _raw_series(tables: Tables, metric: str, where: Conditions) -> DataFrame:
    if metric in series.COUNTS:
        return series.counts(tables, metric, where)
    return {"bps": series.bps, "pps": series.pps, "averagelatency": series.average_latency, "flowcounts": series.flow_counts}[metric](tables, where)


def _stored_series(store: RollupStore, chosen: Plan, metric: str) -> DataFrame:
    """(timestamp, value or casts) of the stored seconds that have facts."""
    inside = F.col("second").between(chosen.low, chosen.high - 1)
    if metric == "flowcounts":
        levels = store.read(chosen.rollup, chosen.low, chosen.high).where(F.col("minute").between(chosen.low, chosen.high - 60))
        return alive(merged_levels(levels if chosen.signature is None else levels.where(F.col("signature") == chosen.signature)))
    names = {"pps": [f"pps_{c}" for c in series.CASTS], "averagelatency": ["n0", "d0", "n1", "d1"]}.get(metric, [metric])
    rows = store.read(chosen.rollup, chosen.low, chosen.high).where(inside)
    if chosen.rollup == "signature_seconds":
        # one row a metric: turned into columns; several builds or feeds of one second add up
        rows = rows.where((F.col("signature") == chosen.signature) & F.col("metric").isin(*names))
        rows = rows.groupBy("second").agg(*[F.coalesce(F.sum(F.when(F.col("metric") == c, F.col("value"))), F.lit(0)).cast("long").alias(c) for c in names])
    if metric == "pps":
        return rows.select(F.col("second").alias("timestamp"), *[F.col(f"pps_{c}").alias(c) for c in series.CASTS])
    return rows.select(F.col("second").alias("timestamp"), (series.represent() if metric == "averagelatency" else F.col(metric)).alias("value"))


def plan_series(store: RollupStore, tables: Tables, metric: str, where: Conditions) -> Plan:
    if metric == "flowcounts":
        return plan(store, tables, "signature_flows" if where.asked() else "flows", where)
    return plan(store, tables, "signature_seconds" if where.asked() else "seconds", where, LAG.get(metric, 0))


def per_second(store: RollupStore, tables: Tables, metric: str, where: Conditions) -> DataFrame:
    """A dense series, one of :data:`SERIES`."""
    chosen = plan_series(store, tables, metric, where)
    if chosen.rollup is None:
        return _raw_series(tables, metric, where)
    rows = _stored_series(store, chosen, metric)
    t = F.col("timestamp")
    for piece in chosen.pieces(where, LAG.get(metric, 0)):
        own = _raw_series(tables.narrowed(piece.second_from, piece.second_to), metric, piece)
        rows = rows.unionByName(own.where((t < chosen.low) | (t >= chosen.high)))
    return series.dense(rows, where)


def _named(keys: DataFrame, tables: Tables, where: Conditions) -> DataFrame:
    """Keys that have an address of the asked tags and apps at one end, or at both."""
    names = named_addresses(tables, where)
    if names is None:
        return keys
    wanted = names.select(F.lower("ip_hex").alias("hex")).distinct()
    four = wanted.where(F.length("hex") == 8).select(net.hex_to_ip(F.col("hex")).alias("a"), F.lit(True).alias("hit"))
    six = wanted.where(F.length("hex") == 32).select(F.col("hex").alias("a"), F.lit(True).alias("hit"))
    out = keys
    for k, (column, list_) in enumerate((("ip", four), ("ip2", four), ("ip6", six), ("ip62", six))):
        out = out.join(list_.select(F.col("a").alias(f"_a{k}"), F.col("hit").alias(f"_hit{k}")), out[column] == F.col(f"_a{k}"), "left")
    end, end2 = (F.coalesce(f"_hit{a}", f"_hit{b}", F.lit(False)) for a, b in ((0, 2), (1, 3)))
    return out.where(end | end2 if where.include_external else end & end2).select(*keys.columns)


def key_filter(keys: DataFrame, tables: Tables, where: Conditions) -> DataFrame:
    """Rows of the service grain that meet every condition of ``ANSWERS["pairs"]``."""
    if where.asked() - ANSWERS["pairs"]:
        raise ValueError(f"a service key can't answer {', '.join(sorted(where.asked() - ANSWERS['pairs']))}")
    if where.ips:
        src, dst = member(F.col("ip"), where.ips, F.col("ip6")), member(F.col("ip2"), where.ips, F.col("ip62"))
        keys = keys.where(src | dst if where.include_external else src & dst)
    if where.payload_protocol is not None:
        keys = keys.where(F.col("payloadprotocol") == where.payload_protocol)
    if where.l7 is not None:
        keys = keys.where(F.col("l7") == where.l7)
    if where.server_ports:
        keys = keys.where(any_of([F.col("port").between(a, b) for a, b in where.server_ports]))
    for a, b in where.excluded:
        if b is None:
            keys = keys.where((F.col("ip") != a) & (F.col("ip2") != a))
        else:
            keys = keys.where(~((F.least("ip", "ip2") == min(a, b)) & (F.greatest("ip", "ip2") == max(a, b))))
    return _named(keys, tables, where)


def _grain_keys(grain: str) -> list[Column]:
    if grain == "destination":
        return [F.col("ip2").alias("ip"), "port"]
    return topn.names(grain)


def _stored_pairs(store: RollupStore, tables: Tables, chosen: Plan, metric: str, grain: str, where: Conditions) -> DataFrame:
    """Stored rows of a metric, from the coarse grain where nothing is filtered and no column of the finest is needed."""
    coarse = grain if not where.asked() and metric == "latencies" else "service"
    rows = store.read("pairs", chosen.low, chosen.high).where((F.col("grain") == coarse) & F.col("minute").between(chosen.low, chosen.high - 60))
    rows = metric_rows(rows, metric)
    return key_filter(rows, tables, where) if coarse == "service" else rows


class Rewriter:
    """Rankings of a question, with the stored minutes where a rollup covers it."""

    def __init__(self, store: RollupStore, tables: Tables):
        self.store, self.tables = store, tables

    def plan(self, base: str, where: Conditions) -> Plan:
        return plan(self.store, self.tables, "pairs", where, LAG.get(base, 0))

    def totals(self, tables: Tables, base: str, grain: str, where: Conditions) -> DataFrame:
        """As :func:`topn.totals`."""
        chosen = self.plan(base, where)
        if chosen.rollup is None:
            return topn.totals(tables, base, grain, where)
        rows = _stored_pairs(self.store, tables, chosen, base, grain, where).select(*_grain_keys(grain), "value", "l7")
        for piece in chosen.pieces(where, LAG.get(base, 0)):
            rows = rows.unionByName(topn.totals(tables.narrowed(piece.second_from, piece.second_to), base, grain, piece))
        return rows.groupBy(*topn.names(grain)).agg(F.sum("value").cast("long").alias("value"), F.max("l7").alias("l7"))

    def round_trips(self, tables: Tables, grain: str, where: Conditions) -> DataFrame:
        """As :func:`topn.round_trips`."""
        chosen = self.plan("latencies", where)
        if chosen.rollup is None:
            return topn.round_trips(tables, grain, where)
        side = lambda c, forward: F.when(F.col("direction") == int(forward), F.col(c)).otherwise(0)
        sums = {"n0": side("value", True), "d0": side("d", True), "n1": side("value", False), "d1": side("d", False)}
        rows = _stored_pairs(self.store, tables, chosen, "latencies", grain, where).select(*_grain_keys(grain), *[c.alias(k) for k, c in sums.items()])
        for piece in chosen.pieces(where):
            rows = rows.unionByName(topn.round_trips(tables.narrowed(piece.second_from, piece.second_to), grain, piece))
        return rows.groupBy(*topn.names(grain)).agg(*[F.sum(c).cast("long").alias(c) for c in sums])

    def ranking(self, base: str, grain: str, where: Conditions, n: int | None = 100) -> DataFrame:
        """As :func:`topn.ranking`; sessions, which bases of timeouts and reused ports need, are counted in their table."""
        return topn.ranking(self.tables, base, grain, where, n, self.totals)

    def latencies(self, grain: str, where: Conditions, n: int = 100) -> DataFrame:
        """As :func:`topn.latencies`."""
        return topn.latencies(self.tables, grain, where, n, self.totals, self.round_trips)


def ranking6(store: RollupStore, tables: Tables, base: str, end: str, where: Conditions, n: int = 100) -> DataFrame:
    """Addresses of version 6 at one ``end`` (src or dst) by any base, from the stored service grain and facts."""
    column = "ip6" if end == "src" else "ip62"
    chosen = plan(store, tables, "pairs", where, LAG.get(base, 0))
    six = tables["session_ip6"].select("session_id", F.col(f"{end}_ip6").alias("ip6"))
    rows = None
    if chosen.rollup:
        stored = _stored_pairs(store, tables, chosen, base, "service", where)
        rows = stored.where(F.col(column).isNotNull()).select(F.col(column).alias("ip6"), F.col("value").alias("n"))
    for piece in chosen.pieces(where, LAG.get(base, 0)):
        own = topn.measured(tables.narrowed(piece.second_from, piece.second_to), base, piece).join(six, "session_id").select("ip6", "n")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("ip6").agg(F.sum("n").cast("long").alias("value")).where("value > 0").orderBy(F.desc("value"), "ip6").limit(n)


def dns(store: RollupStore, tables: Tables, where: Conditions, by: list[str]) -> DataFrame:
    """DNS sessions by some of server, status, query and client.

    Sessions that begin in stored minutes come from the rollup, with the status they had when it was built; the others,
    also those that began before the range, from facts."""
    chosen = plan(store, tables, "dns", where)
    one = F.lit(1).cast("long").alias("hits")
    if chosen.rollup is None:
        rows = trackers.dns_sessions(tables, where, latency=False).select(*by, one)
    else:
        rest = trackers.dns_sessions(tables, where, ~F.col("first_second").between(chosen.low, chosen.high - 1), latency=False).select(*by, one)
        rows = store.read("dns", chosen.low, chosen.high).where(F.col("minute").between(chosen.low, chosen.high - 60)).select(*by, "hits").unionByName(rest)
    return rows.groupBy(*by).agg(F.sum("hits").cast("long").alias("hits"))


def icmp(store: RollupStore, tables: Tables, where: Conditions) -> DataFrame:
    """ICMP packets by type, code and addresses."""
    keys = ["type", "code", "ip", "ip2"]
    chosen = plan(store, tables, "icmp", where)
    rows = None
    if chosen.rollup:
        rows = store.read("icmp", chosen.low, chosen.high).where(F.col("minute").between(chosen.low, chosen.high - 60)).select(*keys, "hits")
    for piece in chosen.pieces(where):
        own = rollup.icmp(tables.narrowed(piece.second_from, piece.second_to), piece).select(*keys, "hits")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*keys).agg(F.sum("hits").cast("long").alias("count"))


# ---------------------------------------------------------------- HTTP across minutes

_RECORD = "struct<status:int,host:string,path:string,server_ip:bigint,server_port:int,client_ip:bigint,requestat:bigint>"


def http_segments(tables: Tables, where: Conditions) -> DataFrame:
    """What the HTTP blocks of a range say, by session and minute: failed requests that were answered within the minute,
    and what is open at its two ends.

    A row is (minute, session_id, first, last, failed, head, tail): ``head`` is the status of a response that came first
    and so belongs to a request of an earlier minute, ``tail`` the request that came last and has no answer yet.  Two rows
    of a session that follow each other join by the earlier tail and the later head, which is why rows of any minutes, and
    of parts of minutes, can be put together in any grouping: :func:`paired_requests`."""
    blocks = trackers.http_blocks(tables, implied(where, "http"))
    second = net.div(F.col("at"), 1_000_000_000)
    blocks = blocks.where(second.between(where.second_from, where.second_to)).withColumn("minute", net.minute(second))
    order = W.partitionBy("session_id", "minute").orderBy("file_seq", "place")
    code = F.when(F.col("response") != "", F.substring("response", 21, 3).cast("int"))
    asked = F.when(F.col("request") != "", F.struct("host", "path", "server_ip", "server_port", "client_ip", F.col("at").alias("requestat")))
    rows = blocks.select("session_id", "minute", "file_seq", "place", code.alias("code"), asked.alias("asked"))
    rows = rows.withColumn("answer", F.lead("code").over(order)).withColumn("n", F.row_number().over(order)).withColumn("final", F.lead("n").over(order).isNull())
    record = F.struct(F.col("answer").alias("status"), *[F.col(f"asked.{c}").alias(c) for c in ("host", "path", "server_ip", "server_port", "client_ip", "requestat")])
    place = F.struct("file_seq", "place")
    open_ = F.col("asked").isNotNull() & F.col("final")
    out = rows.groupBy("minute", "session_id").agg(
        F.min(place).alias("first"),
        F.max(place).alias("last"),
        F.collect_list(F.when(F.col("asked").isNotNull() & (F.col("answer") >= 400), record)).cast(f"array<{_RECORD}>").alias("failed"),
        F.max(F.when((F.col("n") == 1) & F.col("asked").isNull(), F.col("code"))).alias("head"),
        F.max(F.when(open_, F.struct(F.lit(None).cast("int").alias("status"), *[F.col(f"asked.{c}").alias(c) for c in ("host", "path", "server_ip", "server_port", "client_ip", "requestat")]))).cast(_RECORD).alias("tail"),
    )
    return out


def paired_requests(segments: DataFrame) -> DataFrame:
    """Failed requests of segments: those within one, and those whose answer heads the session's next segment."""
    after = F.lead("head").over(W.partitionBy("session_id").orderBy("first"))
    across = segments.select("tail", after.alias("status")).where("tail IS NOT NULL AND status >= 400")
    inside = segments.select(F.explode("failed").alias("x")).select("x.*")
    return inside.unionByName(across.select("status", *[f"tail.{c}" for c in ("host", "path", "server_ip", "server_port", "client_ip", "requestat")]))


def failed_requests(store: RollupStore, tables: Tables, where: Conditions) -> DataFrame:
    """Requests of the range that were answered by an error within 72 seconds of its end."""
    chosen = plan(store, tables, "http_blocks", where)
    late = replace(where, second_to=where.second_to + model.TIMEOUT_SECONDS)
    if chosen.rollup is None:
        rows = http_segments(tables, late)
    else:
        rows = store.read("http_blocks", chosen.low, chosen.high).where(F.col("minute").between(chosen.low, chosen.high - 60))
        for piece in chosen.pieces(late):
            rows = rows.unionByName(http_segments(tables.narrowed(piece.second_from, piece.second_to), piece))
    return paired_requests(rows).where(net.div(F.col("requestat"), 1_000_000_000).between(where.second_from, where.second_to))


def http_errors(store: RollupStore, tables: Tables, where: Conditions, n: int = 100) -> DataFrame:
    """The ranking of HTTP errors by description."""
    return topn.http_errors(failed_requests(store, tables, where), n)


__all__ = ["ANSWERS", "Plan", "Rewriter", "alive", "build", "dns", "failed_requests", "flow_levels", "http_errors", "http_segments", "icmp", "key_filter", "maintain_signatures", "merged_levels", "paired_requests", "pairs", "per_second", "plan", "plan_series", "ranking6"]
