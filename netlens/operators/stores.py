"""Active probes, scripted probes, logs, traps, tags and anomaly documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.functions import net

SUCCESS = 8


def probe_results(probes: DataFrame, second_from: int, second_to: int, mac: str | None = None) -> DataFrame:
    rows = probes.where(F.col("testedat").between(second_from, second_to))
    rows = rows if mac is None else rows.where(F.col("mac") == mac)
    return rows.select("mac", "testname", "testedat", "result", "resultdetail", "rtt", "bps")


def probe_lookback(probes: DataFrame, mac: str, test: str, seconds: int) -> DataFrame:
    """Rows of the last seconds before a test's newest row."""
    own = probes.where((F.col("mac") == mac) & (F.col("testname") == test))
    newest = own.agg(F.max("testedat").alias("newest"))
    return own.join(F.broadcast(newest)).where(F.col("testedat") >= F.col("newest") - seconds).drop("newest")  # one row


def probe_binned(probes: DataFrame, second_from: int, second_to: int, width: int) -> DataFrame:
    """Bins of each test from its first row in the range on, without gaps: sums, extremes with their time, errors."""
    rows = probes.where(F.col("testedat").between(second_from, second_to))
    anchor = rows.groupBy("mac", "testname").agg(F.min("testedat").alias("anchor"), F.max("testedat").alias("newest"))
    k = net.div(F.col("testedat") - F.col("anchor"), width)
    good = F.col("result") == SUCCESS
    v = F.when(good, F.col("rtt"))
    found = rows.join(anchor, ["mac", "testname"]).groupBy("mac", "testname", k.alias("k")).agg(
        F.sum(v).alias("rttsum"), F.count(v).alias("rttcount"), F.max(v).alias("rttmax"), F.min(F.when(good, F.struct(-F.col("rtt"), "testedat"))).getField("testedat").alias("timestamprttmax"),
        F.min(v).alias("rttmin"), F.min(F.when(good, F.struct("rtt", "testedat"))).getField("testedat").alias("timestamprttmin"), F.count(F.when(~good, 1)).alias("errors"),
    )
    grid = anchor.select("mac", "testname", "anchor", F.explode(F.sequence(F.lit(0).cast("long"), net.div(F.col("newest") - F.col("anchor"), width))).alias("k"))
    out = grid.join(found, ["mac", "testname", "k"], "left")
    names = ["rttsum", "rttcount", "rttmax", "timestamprttmax", "rttmin", "timestamprttmin", "errors"]
    return out.select("mac", "testname", (F.col("anchor") + F.col("k") * width).alias("timestamp"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def probe_latest(probes: DataFrame, major: int, minor: int) -> DataFrame:
    """The newest row of each device's test with the mean of its successes in the 60 seconds before, and a status: 0 good,
    1 above the minor limit, 2 above the major limit, 3 failed.  Devices have the worst status of their tests."""
    newest = probes.groupBy("mac", "testname").agg(F.max_by(F.struct("testedat", "result", "rtt"), F.struct("testedat", "uploadat")).alias("x")).select("mac", "testname", "x.*")
    before = probes.where(F.col("result") == SUCCESS).select("mac", "testname", F.col("testedat").alias("at"), F.col("rtt").alias("own"))
    near = newest.select("mac", "testname", "testedat").join(before, ["mac", "testname"]).where(F.col("at").between(F.col("testedat") - 60, F.col("testedat")))
    mean = near.groupBy("mac", "testname").agg(net.div(F.sum("own"), F.count("own")).alias("mean"))
    rows = newest.join(mean, ["mac", "testname"], "left").withColumn("mean", F.coalesce("mean", F.lit(0)))
    status = F.when(F.col("result") != SUCCESS, 3).when(F.col("mean") > major, 2).when(F.col("mean") > minor, 1).otherwise(0)
    rows = rows.select("mac", "testname", "testedat", "result", "rtt", "mean", status.alias("status"))
    return rows.withColumn("devicestatus", F.max("status").over(W.partitionBy("mac")))


def probe_ranking(probes: DataFrame, limit: int = 100) -> DataFrame:
    """Tests by their newest successful round trip, the slowest first."""
    newest = W.partitionBy("mac", "testname").orderBy(F.desc("testedat"), F.desc("uploadat"))
    rows = probes.where(F.col("result") == SUCCESS).withColumn("n", F.row_number().over(newest)).where("n = 1")
    return rows.select("mac", "testname", "testedat", "rtt").orderBy(F.desc("rtt"), "mac", "testname").limit(limit)


def probe_inventory(probes: DataFrame) -> DataFrame:
    return probes.groupBy("mac", "testname").agg(F.count(F.lit(1)).alias("count"), F.min("testedat").alias("oldest"), F.max("testedat").alias("newest"))


def probe_ingest(incoming: DataFrame, stored: DataFrame, now: int) -> DataFrame:
    """New rows that may be stored: later than the test's newest stored row, not in the future, and plausible."""
    newest = stored.groupBy("mac", "testname").agg(F.max("testedat").alias("newest"))
    rows = incoming.join(newest, ["mac", "testname"], "left")
    bad = (F.col("result") == SUCCESS) & ((F.col("rtt") < -1) | (F.col("bps") < -1))
    return rows.where((F.col("testedat") > F.coalesce("newest", F.lit(-1))) & (F.col("testedat") <= now) & ~bad).select(*incoming.columns)


def expire(probes: DataFrame, seconds: int) -> DataFrame:
    """Rows not older than ``seconds`` before the newest of all."""
    return probes.join(F.broadcast(probes.agg(F.max("testedat").alias("_newest")))).where(F.col("testedat") >= F.col("_newest") - seconds).drop("_newest")  # one row


def paranoia_latest(rows: DataFrame) -> DataFrame:
    """The newest success of each device's test, with a number out of its details."""
    newest = W.partitionBy("mac", "testname").orderBy(F.desc("testedat"), "details")
    own = rows.where("success = 1").withColumn("n", F.row_number().over(newest)).where("n = 1")
    return own.select("mac", "testname", "testedat", F.get_json_object("details", "$.steps").cast("int").alias("steps"))


def paranoia_results(rows: DataFrame, second_from: int, second_to: int) -> DataFrame:
    own = rows.where(F.col("testedat").between(second_from, second_to))
    return own.groupBy("mac", "testname", "testtemplate").agg(F.count(F.lit(1)).alias("count"), F.sum("success").cast("long").alias("successes"), F.max("testedat").alias("newest"))


def syslog_search(rows: DataFrame, second_from: int, second_to: int, message: str = "", host: str = "", ip: str = "", tag: str = "", facility: int | None = None, priority: int | None = None, limit: int = 100) -> DataFrame:
    own = rows.where(F.col("receivedat").between(second_from, second_to))
    for column, part in (("message", message), ("hostname", host), ("hostip", ip), ("syslogtag", tag)):
        own = own.where(F.col(column).contains(part)) if part else own
    own = own if facility is None else own.where(F.col("facility") == facility)
    own = own if priority is None else own.where(F.col("priority") <= priority)
    return own.orderBy(F.desc("receivedat"), "hostname", "message").limit(limit)


def syslog_summary(rows: DataFrame, second_from: int, second_to: int) -> DataFrame:
    """Messages of priorities 0 to 4 by host."""
    own = rows.where(F.col("receivedat").between(second_from, second_to))
    return own.groupBy("hostname").agg(*[F.count(F.when(F.col("priority") == k, 1)).alias(f"priority{k}") for k in range(5)])


#: Trap types that the summary counts.
TRAPS = {"reset": (0, 1), "linkdown": (2,), "authfail": (4,)}


def snmp_search(rows: DataFrame, second_from: int, second_to: int, sender: str = "", enterprise: str = "", message: str = "", kind: int | None = None, limit: int = 100) -> DataFrame:
    own = rows.where(F.col("timestamp").between(second_from, second_to))
    for column, part in (("sender", sender), ("enterprisestring", enterprise), ("message", message)):
        own = own.where(F.col(column).contains(part)) if part else own
    own = own if kind is None else own.where(F.col("traptype") == kind)
    return own.orderBy(F.desc("timestamp"), "sender", "message").limit(limit)


def snmp_summary(rows: DataFrame, second_from: int, second_to: int) -> DataFrame:
    own = rows.where(F.col("timestamp").between(second_from, second_to))
    return own.groupBy("sender").agg(*[F.count(F.when(F.col("traptype").isin(*kinds), 1)).alias(name) for name, kinds in TRAPS.items()])


def ip_tags(tag_ip: DataFrame, ip_hex: str) -> DataFrame:
    return tag_ip.where(F.col("ip_hex") == ip_hex).select("tag").distinct()


def describe_edges(edges: DataFrame, tag_ip: DataFrame, fqdns: DataFrame, apps: DataFrame, ip: str = "ip", port: str = "port") -> DataFrame:
    """Addresses with their tags, user apps and names, each as sorted comma-separated text."""
    from netlens.operators.dashboard import alias_of

    named = alias_of(edges, apps, ip, port).withColumnRenamed("alias", "app").withColumn("_hex", net.ip_to_hex(F.col(ip)))
    joined = lambda rows, column, name: rows.groupBy(F.col("ip_hex").alias("_hex")).agg(F.array_join(F.sort_array(F.collect_set(column)), ",").alias(name))
    out = named.join(joined(tag_ip, "tag", "tags"), "_hex", "left").join(joined(fqdns, "name", "names"), "_hex", "left")
    return out.select(*edges.columns, "app", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("names", F.lit("")).alias("names"))


def describe_edges6(edges: DataFrame, tag_ip: DataFrame, names: DataFrame, networks: DataFrame) -> DataFrame:
    """As :func:`describe_edges` for edges (ip6, port) of version 6 and networks of :func:`dashboard.alias_of6`."""
    from netlens.operators.dashboard import alias_of6

    named = alias_of6(edges, networks, "ip6", "port").withColumnRenamed("alias", "app")
    joined = lambda rows, column, name: rows.groupBy(F.lower("ip_hex").alias("ip6")).agg(F.array_join(F.sort_array(F.collect_set(column)), ",").alias(name))
    out = named.join(joined(tag_ip, "tag", "tags"), "ip6", "left").join(joined(names, "name", "names"), "ip6", "left")
    return out.select("ip6", "port", "app", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("names", F.lit("")).alias("names"))


def occurring_tags(sessions: DataFrame, tag_ip: DataFrame) -> DataFrame:
    """(ip, tag) of the addresses that sessions have."""
    seen = sessions.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    tags = tag_ip.where(F.length("ip_hex") == 8).select(net.hex_to_ip(F.col("ip_hex")).alias("ip"), "tag").distinct()
    return seen.join(tags, "ip")


def check_apps(entries: DataFrame) -> DataFrame:
    """Entries (name, ips, port as text) of user apps with ``problem``, the first thing that is wrong (null: none): no name,
    no ips, no port (a number up to 65535), an entry of ips that is no address or network (8 or 32 hex digits, or 10 or 34 with
    the length of the network behind), or host bits in a network."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    port = F.coalesce(F.col("port").rlike("^[0-9]{1,5}$") & (F.try_to_number("port", F.lit("99999")) <= 65535), F.lit(False))
    digits = lambda x: F.when(F.length(x).isin(8, 10), 8).otherwise(32)
    length = lambda x: F.when(F.length(x).isin(8, 32), 4 * digits(x)).otherwise(F.conv(F.right(x, F.lit(2)), 16, 10).cast("int"))
    address = lambda x: x.rlike("^([0-9A-Fa-f]{8}|[0-9A-Fa-f]{10}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{34})$") & (length(x) <= 4 * digits(x))

    def host_bits(x):
        """Whether anything stands behind a network's length: in the digit that it ends in, or in those after it."""
        full = net.div(length(x), 4).cast("int")
        mask = F.element_at(F.array(*[F.lit(m) for m in (15, 7, 3, 1)]), (length(x) % 4 + 1).cast("int"))
        split = F.coalesce(F.conv(F.substring(F.left(x, digits(x)), full + 1, F.lit(1)), 16, 10).cast("int"), F.lit(0))
        return (split.bitwiseAND(mask) != 0) | F.substring(F.left(x, digits(x)), full + 2, F.lit(32)).rlike("[^0]")

    each = F.split("ips", ",")
    problem = F.when(~filled("name"), "no name").when(~filled("ips"), "no ips").when(~port, "no port").when(F.exists(each, lambda x: ~address(x)), "no address").when(F.exists(each, host_bits), "host bits")
    return entries.withColumn("problem", problem)


def latest_apps(entries: DataFrame) -> DataFrame:
    """The user apps (name, ips, port) of entries in the order of ``at``: a right entry takes the place of earlier ones of
    its name, a wrong one changes nothing."""
    right = check_apps(entries).where("problem IS NULL")
    return right.groupBy("name").agg(F.max_by(F.struct("ips", "port"), F.struct("at", "ips", "port")).alias("x")).select("name", "x.ips", F.col("x.port").cast("int").alias("port"))


# ---------------------------------------------------------------- anomaly documents

WEEK = 7 * 86400


def anomaly_parse(documents: DataFrame, column: str = "document") -> DataFrame:
    """Documents as columns with ``valid`` and, where not, ``problem``: the first thing that is missing or wrong."""
    d = documents.withColumn("d", F.from_json(column, model.ANOMALY_SCHEMA))
    checks = [(F.col("d").isNull(), "not a document")]
    checks += [(F.coalesce(F.col(f"d.{c}"), F.lit("")) == "", f"no {c}") for c in ("device_mac", "device_alias", "device_ip", "scenario_name")]
    checks += [(F.col("d.device_responsive").isNull(), "no device_responsive"), (F.col("d.threshold.major_ns").isNull() | F.col("d.threshold.minor_ns").isNull(), "no threshold")]
    start, end = net.iso_to_epoch(F.col("d.time_range.start")), net.iso_to_epoch(F.col("d.time_range.end"))
    checks += [(start.isNull() | end.isNull() | (start > end), "no time_range"), (F.coalesce(F.size("d.values"), F.lit(0)) <= 0, "no values")]
    checks += [(F.exists("d.values", lambda v: v["timestamp"].isNull() | v["rtt_ns"].isNull()), "incomplete values")]
    problem = F.lit(None).cast("string")
    for wrong, text in reversed(checks):
        problem = F.when(F.coalesce(wrong, F.lit(False)), text).otherwise(problem)
    mac = F.lower(F.regexp_replace("d.device_mac", "[^0-9A-Fa-f]", ""))
    out = d.select("d.*", problem.alias("problem"), mac.alias("mac"), start.alias("start_second"), end.alias("end_second"))
    return out.withColumn("valid", F.col("problem").isNull()).withColumn("ai_ready", F.coalesce(F.col("end_second") - F.col("start_second") >= WEEK, F.lit(False)))


def anomaly_prepared(parsed: DataFrame) -> DataFrame:
    """By device: scenarios, values, span, and whether it is long enough to learn from."""
    out = parsed.where("valid").groupBy("mac").agg(F.countDistinct("scenario_name").alias("scenarios"), F.sum(F.size("values")).cast("long").alias("values"), F.min("start_second").alias("start_second"), F.max("end_second").alias("end_second"))
    return out.withColumn("ai_ready", F.col("end_second") - F.col("start_second") >= WEEK)


def anomaly_threshold(parsed: DataFrame) -> DataFrame:
    """Values above the limits of their own document, by device."""
    rows = parsed.where("valid").select("mac", "threshold", F.explode("values").alias("v"))
    return rows.groupBy("mac").agg(F.count(F.when(F.col("v.rtt_ns") >= F.col("threshold.major_ns"), 1)).alias("major"), F.count(F.when((F.col("v.rtt_ns") >= F.col("threshold.minor_ns")) & (F.col("v.rtt_ns") < F.col("threshold.major_ns")), 1)).alias("minor"))
