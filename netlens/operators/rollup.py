"""Minute-grain rollups, and answering series and rankings from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.operators import series, topn, trackers
from netlens.plans.conditions import Conditions, Network, accepted, any_of, facts, member
from netlens.sources.tables import Tables

#: Shortest range that is worth a rollup.
LEAST_SECONDS = 120
#: Facts of one table that a task adds up at a time; each has a few rows of other tables beside it.
FACTS_A_TASK = 100_000
#: Per-second metrics of :func:`per_second`, in the order of its columns.
METRICS = ("bps", "pps_unknown", "pps_broadcast", "pps_multicast", "pps_unicast", "n0", "d0", "n1", "d1", *series.COUNTS)
PAIR_METRICS = (*topn.BASES, "latencies")


def tasks(tables: Tables, where: Conditions) -> int:
    """Tasks that hold the facts of a range in parts of bounded size, at least as many as Spark's own number."""
    n = tables["bps"].where(where.within(F.col("second"))).count()
    return max(int(tables.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FACTS_A_TASK))


def by_second(tables: Tables, where: Conditions, sessions: DataFrame, *by: str) -> DataFrame:
    """One wide row for each second that has facts: a sum for each of :data:`METRICS`, and in ``seen`` a bit for each that
    has rows.  ``sessions`` are the accepted ones, a row for each value of ``by``.

    Sessions are joined once for all metrics, as the table that is hashed, so no fact is sorted.  Facts of a session's second
    then meet in one of :func:`tasks` before seconds are added up, so neither a busy second nor a large table fills a task."""
    n = F.col("small_to_big") + F.col("big_to_small")
    side = F.lit(None).cast("int").alias("side")
    columns = lambda kind, value, at=None: ["session_id", "second", kind.alias("kind"), value.cast("long").alias("n"), side if at is None else F.col(at).alias("side")]
    within = lambda table, time="second": tables[table].where(where.within(F.col(time)))
    slot = {m: F.lit(k) for k, m in enumerate(METRICS)}
    rows = within("bps").select(*columns(slot["bps"], n * 8))
    rows = rows.unionByName(within("pps").select(*columns(slot["pps_unknown"], n)))
    rows = rows.unionByName(within("rtts").where(series.good_rtt()).select(*columns(slot["n0"], F.col("tail"), "small_to_big")))
    marker = F.coalesce(*[F.when(F.col("kind") == k, slot[k]) for k in series.COUNTS])
    rows = rows.unionByName(series.markers(tables, tuple(series.COUNTS), where).select(*columns(marker, F.lit(1))))
    keys = ["source_is_small", "src_ip", "dst_ip"]
    rows = rows.join(sessions.select("session_id", *by, *keys).hint("shuffle_hash"), "session_id")
    cast = F.concat(F.lit("pps_"), F.lower(net.cast_type(*[F.col(k) for k in keys])))
    cast = F.coalesce(*[F.when(cast == m, slot[m]) for m in METRICS if m.startswith("pps_")])
    forward = F.when(F.col("side") == F.col("source_is_small"), slot["n0"]).otherwise(slot["n1"])
    found = F.when(F.col("kind") == slot["pps_unknown"], cast).when(F.col("kind") == slot["n0"], forward).otherwise(F.col("kind"))
    rows = rows.select("session_id", *by, "second", found.alias("slot"), "n").repartition(tasks(tables, where), "session_id", "second")
    # a round trip counts twice: its nanoseconds (n0, n1) and itself (d0, d1)
    cell = lambda m: F.sum(F.when(F.col("slot") == slot["n" + m[1:] if m in ("d0", "d1") else m], F.lit(1).cast("long") if m in ("d0", "d1") else F.col("n"))).cast("long").alias(m)
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))).alias("seen")
    return rows.groupBy(*by, "second").agg(*[cell(m) for m in METRICS], seen)


def by_metric(wide: DataFrame, *by: str) -> DataFrame:
    """Rows of :func:`by_second` as one row for each metric that was seen."""
    bit = lambda m: 1 << METRICS.index("n" + m[1:] if m in ("d0", "d1") else m)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(bit(m)).cast("long").alias("bit"), F.col(m).alias("value")) for m in METRICS])
    rows = wide.select(*by, "second", "seen", F.explode(cells).alias("x")).where(F.col("seen").bitwiseAND(F.col("x.bit")) != 0)
    return rows.select(*by, "x.metric", "second", "x.value")


def per_second(tables: Tables, where: Conditions) -> DataFrame:
    """One wide row for each second that has facts: bits, packets by cast, round-trip sums, and every marker count."""
    wide = by_second(tables, where, accepted(tables, where))
    return wide.select("second", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in METRICS])


def from_per_second(rollup: DataFrame, metric: str, where: Conditions) -> DataFrame:
    """A dense series from the rollup."""
    value = series.represent() if metric == "averagelatency" else F.col(metric)
    return series.dense(rollup.where(F.col("second").between(where.second_from, where.second_to)).select(F.col("second").alias("timestamp"), value.alias("value")), where)


def series_with_rollup(tables: Tables, rollup: DataFrame, metric: str, where: Conditions) -> DataFrame:
    """bps or a count: whole minutes inside the range from the rollup, the rest from facts.  Short ranges use facts only, and
    so does a question with any condition, since the rollup has no key to filter by."""
    low, high = -(-where.second_from // 60) * 60, (where.second_to + 1) // 60 * 60 - 1
    plain = series.bps if metric == "bps" else lambda t, w: series.counts(t, metric, w)
    if where.asked() or where.second_to - where.second_from < LEAST_SECONDS or low > high:
        return plain(tables, where)
    outside, inside = where.parts((low, high))
    both = plain(tables, outside).unionByName(from_per_second(rollup, metric, inside))
    return both.groupBy("timestamp").agg(F.sum("value").cast("long").alias("value"))


def per_minute(tables: Tables, metric: str, grain: str, where: Conditions) -> DataFrame:
    """Values of a metric by minute and key of a grain, zeros left out.  Latencies keep their sums, which can be added."""
    minute = net.minute(F.col("second")).alias("minute")
    if metric == "latencies":
        rows = facts(tables, "rtts", where, topn.SESSION).where(series.good_rtt()).withColumn("direction", F.when(F.col("small_to_big") == F.col("source_is_small"), 1).otherwise(0))
        return rows.groupBy(minute, *topn.keys(grain)).agg(*series.rtt_sums())
    return topn.measured(tables, metric, where).groupBy(minute, *topn.keys(grain)).agg(F.sum("n").cast("long").alias("value")).where("value > 0")


#: Conditions that the keys of :func:`per_minute` by service can answer; addresses of version 4 only.
PAIR_CONDITIONS = {"ips", "payload_protocol", "server_ports"}


def key_filter(rollup: DataFrame, where: Conditions) -> DataFrame:
    """The rows of a service rollup that meet the conditions; those that its keys can't answer are refused."""
    if where.asked() - PAIR_CONDITIONS or any(not isinstance(n, Network) for n in where.ips):
        raise ValueError(f"the key has no {', '.join(sorted(where.asked() - PAIR_CONDITIONS)) or 'address of version 6'}")
    if where.ips:
        src, dst = member(F.col("ip"), where.ips), member(F.col("ip2"), where.ips)
        rollup = rollup.where(src | dst if where.include_external else src & dst)
    if where.payload_protocol is not None:
        rollup = rollup.where(F.col("payloadprotocol") == where.payload_protocol)
    if where.server_ports:
        rollup = rollup.where(any_of([F.col("port").between(a, b) for a, b in where.server_ports]))
    return rollup


def ranking_with_rollup(tables: Tables, rollup: DataFrame, base: str, where: Conditions, n: int = 100) -> DataFrame:
    """Pairs of client and service by value: whole minutes inside the range from the rollup, the rest from facts.  A question
    that the rollup's keys can't answer is answered from facts."""
    own = topn.names("service")
    low, high = -(-where.second_from // 60) * 60, (where.second_to + 1) // 60 * 60 - 1
    uncovered = where.asked() - PAIR_CONDITIONS or any(not isinstance(n, Network) for n in where.ips)
    if uncovered or where.second_to - where.second_from < LEAST_SECONDS or low > high:
        both = topn.totals(tables, base, "service", where).select(*own, "value")
    else:
        outside, inside = where.parts((low, high))
        cached = key_filter(rollup.where(F.col("minute").between(inside.second_from, inside.second_to)), where)
        both = topn.totals(tables, base, "service", outside).select(*own, "value").unionByName(cached.select(*own, "value"))
    return both.groupBy(*own).agg(F.sum("value").cast("long").alias("value")).orderBy(F.desc("value"), *own).limit(n)


def http_errors(records: DataFrame) -> DataFrame:
    """Failed requests by minute."""
    minute = net.minute(net.div(F.col("requestat"), 1_000_000_000)).alias("minute")
    return records.where("status >= 400").groupBy(minute, "status", "host", "path", "server_ip", "server_port", "client_ip").agg(F.count(F.lit(1)).alias("hits"))


def answer(rollup: DataFrame, by: list[str], name: str, where: Conditions) -> DataFrame:
    """Hits of a range of whole minutes by some of a rollup's keys; :mod:`netlens.operators.rewriting` answers other ranges."""
    if where.second_from % 60 or (where.second_to + 1) % 60:
        raise ValueError("the rollup answers whole minutes only")
    rows = rollup.where(F.col("minute").between(where.second_from, where.second_to - 59))
    return rows.groupBy(*by).agg(F.sum("hits").cast("long").alias(name))


def http_error_ranking(rollup: DataFrame, where: Conditions | None = None, n: int = 100) -> DataFrame:
    """The ranking of HTTP errors by description, from the rollup: of a range of whole minutes, or of all that is in it.

    A rollup of a range's sessions also has requests that they made outside it, which the ranking of their records counts."""
    rows = rollup if where is None else answer(rollup, ["status", "host", "path", "server_ip", "server_port", "client_ip"], "hits", where)
    return topn.described(rows).groupBy("description").agg(F.sum("hits").cast("long").alias("value")).orderBy(F.desc("value"), "description").limit(n)


def dns(tables: Tables, where: Conditions) -> DataFrame:
    """DNS sessions by the minute they begin, server, status, question and client."""
    rows = trackers.dns_sessions(tables, where, latency=False, keep=("first_second",))
    return rows.groupBy(net.minute(F.col("first_second")).alias("minute"), "server", "status", "query", "client").agg(F.count(F.lit(1)).alias("hits"))


def icmp(tables: Tables, where: Conditions) -> DataFrame:
    rows = tables["icmp_packets"].where(where.within(F.col("second"))).join(accepted(tables, where).select("session_id", "src_ip", "dst_ip"), "session_id")
    return rows.groupBy(net.minute(F.col("second")).alias("minute"), "type", "code", F.col("src_ip").alias("ip"), F.col("dst_ip").alias("ip2")).agg(F.count(F.lit(1)).alias("hits"))


def signatures(tables: Tables, digits: tuple[int, ...] = (8,)) -> DataFrame:
    """Sets of addresses, a tag's or a user app's, named by their hash, with the tag or app as a label; of IPv4 addresses, or
    of those with the given numbers of hex digits."""
    apps = tables["user_apps"].select(F.col("name").alias("tag"), F.explode(F.split("ips", ",")).alias("ip_hex"))
    rows = tables["tag_ip"].select("tag", "ip_hex").unionByName(apps).where(F.length("ip_hex").isin(*digits))
    sets = rows.groupBy("tag").agg(F.sort_array(F.collect_set("ip_hex")).alias("ips"))
    return sets.select("tag", F.md5(F.array_join("ips", ",").cast("binary")).alias("signature"), "ips")


def per_second_by_signature(tables: Tables, where: Conditions) -> DataFrame:
    """Every metric by signature and second; a session counts once for a signature, however many of its addresses are in
    the set."""
    ips = signatures(tables).select("signature", F.explode("ips").alias("hex")).select("signature", net.hex_to_ip(F.col("hex")).alias("ip")).distinct()
    keys = ["session_id", "source_is_small", "src_ip", "dst_ip"]
    s = accepted(tables, where).select(*keys, F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    members = s.join(F.broadcast(ips), "ip").select(*keys, "signature").distinct()  # the users' lists are small
    return by_metric(by_second(tables, where, members, "signature"), "signature")
