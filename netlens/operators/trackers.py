"""Application protocols, read from remark texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens import model
from netlens.functions import net
from netlens.operators import series
from netlens.operators.flows import lag_in_blocks, session_bytes
from netlens.plans.conditions import Conditions, accepted, facts, implied
from netlens.sources.rollups import written
from netlens.sources.tables import Tables


def _ends(tables: Tables, where: Conditions) -> DataFrame:
    return accepted(tables, where).select("session_id", F.col("src_ip").alias("client"), F.col("dst_ip").alias("server"), "dst_port", "first_second")


def _mean(value: Column) -> Column:
    return F.coalesce(net.div(net.total(value), F.nullif(F.count(value), F.lit(0))), F.lit(0)).cast("long")


# ---------------------------------------------------------------- DNS


def dns_status(content: Column) -> Column:
    """What a DNS remark tells of its question."""
    code = F.substring(net.remark(content, "DnsException"), 1, 1)
    return F.when(content.contains("DnsAnswerRRs="), "RESOLVED").when(code == "A", "ZEROANSWER").when(code == "R", "ANSWERBROKEN").when(code == "M", "MULTIPLEQUERIES").otherwise("REQUESTONLY")


def dns_sessions(tables: Tables, where: Conditions, only: Column | None = None, latency: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each DNS remark: status, question, client, server, latency (null without a round trip; ``latency``: whether
    it is wanted).  ``only`` is a further condition on session rows (first_second, client, server), of which ``keep`` names
    more columns.

    Only-requests are timeouts if their session has one, and stay requests otherwise.  Only sessions of DNS count.
    """
    where = implied(where, "dnstracker")
    content = F.col("content")
    status = dns_status(content)
    ends = _ends(tables, where)
    ends = ends if only is None else ends.where(only)
    rows = tables["dns_remarks"].join(ends.hint("shuffle_hash"), "session_id")
    rows = rows.select("session_id", "client", "server", *keep, status.alias("status"), F.substring_index(net.remark(content, "DnsQuestion"), ",", 1).alias("query"))
    gone = tables["timeouts"].where(where.within(F.col("marker_second"))).select("session_id").distinct().withColumn("gone", F.lit(True))
    rows = rows.join(gone.hint("shuffle_hash"), "session_id", "left")  # of the sessions above only
    if latency:
        rtt = facts(tables, "rtts", where, ["source_is_small"]).where(series.good_rtt()).groupBy("session_id").agg(*series.rtt_sums()).select("session_id", series.represent().alias("latency"))
        rows = rows.join(rtt, "session_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "REQUESTONLY") & F.col("gone").isNotNull(), "TIMEOUT").otherwise(F.col("status"))).drop("gone")


def dns_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Latency and status counts; a mean is over the sessions that have a latency, clients are counted once."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    return rows.groupBy(*by).agg(
        F.coalesce(F.min("latency"), F.lit(0)).cast("long").alias("fastest"), F.coalesce(F.max("latency"), F.lit(0)).cast("long").alias("slowest"), _mean(F.col("latency")).alias("average"),
        F.countDistinct("client").alias("clientsserved"), F.count(F.lit(1)).alias("queriestaken"), *[count(s) for s in ("RESOLVED", "TIMEOUT", "ZEROANSWER", "ANSWERBROKEN", "MULTIPLEQUERIES")],
    )


def dns_top(rows: DataFrame, column: str, name: str, limit: int = 10) -> DataFrame:
    return rows.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), name).limit(limit)


def dns_answers(remarks: DataFrame, *keep: str) -> DataFrame:
    """Names and addresses (hex) of A and AAAA answers."""
    answers = net.remark(F.col("content"), "DnsAnswerRRs")
    rows = remarks.select(*keep, F.substring_index(answers, ",", 1).alias("name"), F.explode(F.split(answers, " ")).alias("record")).where(F.col("record").rlike(",(1|28),[0-9a-f]+$"))
    return rows.select(*keep, "name", F.regexp_extract("record", ",(?:1|28),([0-9a-f]+)$", 1).alias("ip_hex"))


def fqdn_from_dns(remarks: DataFrame) -> DataFrame:
    """Names and addresses (hex) of A and AAAA answers, each pair once.  Works on a stream as on a table."""
    return dns_answers(remarks).dropDuplicates(["name", "ip_hex"])


# ---------------------------------------------------------------- mail and files


def _lines(content: str, key: str) -> Column:
    return F.size(net.remarks(F.col(content), key)).cast("long")


def mail_pairs(tables: Tables, where: Conditions, content: str, keys: dict[str, str]) -> DataFrame:
    """Per client and server: bytes of the sessions, and how often each kind of error line occurs.  ``keys`` names the
    output column of each remark key; ``errors`` is their sum."""
    rows = tables["mail_remarks"].join(_ends(tables, where), "session_id")
    found = rows.groupBy("session_id", "client", "server").agg(*[F.sum(_lines(content, key)).cast("long").alias(name) for key, name in keys.items()])
    moved = session_bytes(tables, where).select("session_id", (F.col("ip1toip2") + F.col("ip2toip1")).alias("bytes"))
    out = found.join(moved, "session_id", "left").groupBy("client", "server").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytestransferred"), *[F.sum(n).cast("long").alias(n) for n in keys.values()])
    return out.withColumn("errors", sum((F.col(n) for n in list(keys.values())[1:]), F.col(list(keys.values())[0])))


POP3 = {"Pop3Err": "pop3errors"}
IMAP = {"ImapNo": "no", "ImapBad": "bad", "ImapAlert": "alert"}


def mail_error_texts(tables: Tables, where: Conditions, content: str, key: str) -> DataFrame:
    """The error lines themselves."""
    rows = tables["mail_remarks"].join(_ends(tables, where), "session_id")
    return rows.select("client", "server", F.explode(net.remarks(F.col(content), key)).alias("text"))


def mail_rankings(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """Busiest and most erroneous clients."""
    by = pairs.groupBy("client").agg(F.sum("bytestransferred").cast("long").alias("bytestransferred"), F.sum("errors").cast("long").alias("errors"))
    pick = lambda kind, c: by.orderBy(F.desc(c), "client").limit(limit).select(F.lit(kind).alias("kind"), "client", F.col(c).alias("value"))
    return pick("busiest", "bytestransferred").unionByName(pick("erroneous", "errors"))


def smtp_sessions(tables: Tables, where: Conditions) -> DataFrame:
    """Per session: the last sender (else the client's address), recipients, errors, bytes."""
    rows = tables["mail_remarks"].join(_ends(tables, where), "session_id").withColumn("from", F.element_at(net.remarks(F.col("smtp"), "SmtpMailFrom"), -1))
    out = rows.groupBy("session_id", "client", "server").agg(
        F.max_by("from", F.when(F.col("from").isNotNull(), F.col("file_seq"))).alias("sender"), F.sum(_lines("smtp", "SmtpRcptTo")).cast("long").alias("recipients"), F.sum(_lines("smtp", "SmtpError")).cast("long").alias("errors")
    )
    moved = session_bytes(tables, where).select("session_id", (F.col("ip1toip2") + F.col("ip2toip1")).alias("bytes"))
    return out.join(moved, "session_id", "left").select(F.col("session_id").alias("sessionid"), F.col("server").alias("serverip"), F.coalesce("sender", net.ip_to_text(F.col("client"))).alias("sender"), "recipients", "errors", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def ftp_sessions(tables: Tables, where: Conditions) -> DataFrame:
    """Per session: files stored, retrieved and deleted, errors, bytes each way."""
    rows = tables["mail_remarks"].join(_ends(tables, where), "session_id")
    listed = lambda key: F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_seq", net.remarks(F.col("ftp"), key).alias("x")))), lambda r: r["x"])), ",")
    out = rows.groupBy("session_id", "client", "server", "first_second").agg(listed("FtpStor").alias("stored"), listed("FtpRetr").alias("retrieved"), listed("FtpDele").alias("deleted"), F.sum(_lines("ftp", "FtpError")).cast("long").alias("errors"))
    return out.join(session_bytes(tables, where), "session_id", "left").select(
        F.col("session_id").alias("sessionid"), F.col("client").alias("clientip"), F.col("server").alias("serverip"), F.col("first_second").alias("from"), "stored", "retrieved", "deleted", "errors",
        F.coalesce("ip1toip2", F.lit(0)).cast("long").alias("clienttoserver"), F.coalesce("ip2toip1", F.lit(0)).cast("long").alias("servertoclient"),
    )


# ---------------------------------------------------------------- HTTP


def http_records(tables: Tables, where: Conditions, feed_end_ns: int | None = None, block_pattern: str | None = None) -> DataFrame:
    """Requests with their responses, however a session's blocks are spread over files.

    Blocks of a session are put in order of file and place; a response belongs to the request right before it.  A request
    without one has status 0 and responseat -1; with ``feed_end_ns``, only once 72 seconds have passed, else it is left out.
    With ``block_pattern`` only requests whose own block matches it count.  Only sessions of HTTP count.
    """
    where = implied(where, "http")
    blocks = tables["http_remarks"].select("session_id", "file_seq", F.posexplode(F.split("content", r"HttpEnd=[A-Za-z]+\n")).alias("place", "block")).where("block <> ''")
    request, response = net.remark(F.col("block"), "HttpRequest"), net.remark(F.col("block"), "HttpResponse")
    blocks = blocks.select("session_id", "file_seq", "place", "block", request.alias("request"), response.alias("response"))
    order = W.partitionBy("session_id").orderBy("file_seq", "place")
    paired = blocks.withColumn("answer", F.lead("response").over(order)).where("request <> ''")
    paired = paired if block_pattern is None else paired.where(F.col("block").rlike(block_pattern))
    answered = F.coalesce(F.col("answer"), F.lit("")) != ""
    agent = net.header(F.col("block"), "User-Agent")
    out = paired.join(_ends(tables, where), "session_id").select(
        F.col("session_id").alias("sessionid"), F.col("client").alias("client_ip"), F.col("server").alias("server_ip"), F.col("dst_port").alias("server_port"), net.header(F.col("block"), "Host").alias("host"),
        F.regexp_extract("request", r"^\d+ (\S+) ", 1).alias("method"), F.regexp_extract("request", r"^\d+ \S+ (.*)$", 1).alias("path"), net.header(F.col("block"), "Referer").alias("referer"),
        net.browser(agent).alias("browser"), net.operating_system(agent).alias("os"), F.substring("request", 1, 19).cast("long").alias("requestat"),
        F.when(answered, F.substring("answer", 1, 19).cast("long")).otherwise(-1).cast("long").alias("responseat"), F.when(answered, F.substring("answer", 21, 3).cast("int")).otherwise(0).alias("status"),
    )
    return out if feed_end_ns is None else out.where((F.col("responseat") >= 0) | (F.col("requestat") + model.TIMEOUT_SECONDS * 1_000_000_000 <= feed_end_ns))


def http_blocks(tables: Tables, where: Conditions) -> DataFrame:
    """Blocks of HTTP sessions: place, text of the request or response line, the block's nanosecond ``at``, and the columns
    of its request and session."""
    blocks = tables["http_remarks"].select("session_id", "file_seq", F.posexplode(F.split("content", r"HttpEnd=[A-Za-z]+\n")).alias("place", "block")).where("block <> ''")
    request, response = net.remark(F.col("block"), "HttpRequest"), net.remark(F.col("block"), "HttpResponse")
    rows = blocks.withColumn("request", request).withColumn("response", response).join(_ends(tables, where), "session_id")
    at = F.substring(F.when(F.col("request") != "", F.col("request")).otherwise(F.col("response")), 1, 19).cast("long")
    return rows.select(
        "session_id", "file_seq", "place", "request", "response", at.alias("at"), net.header(F.col("block"), "Host").alias("host"), F.regexp_extract("request", r"^\d+ \S+ (.*)$", 1).alias("path"),
        F.col("server").alias("server_ip"), F.col("dst_port").alias("server_port"), F.col("client").alias("client_ip"),
    )


def with_country(records: DataFrame, geo: DataFrame, column: str = "client_ip") -> DataFrame:
    """The country whose range holds an address, '' without one.  Ranges are cut at /16 borders, so the join has an
    equality to hash on and needs no broadcast."""
    pieces = geo.select("ip_from", "ip_to", "country", F.explode(F.sequence(F.shiftright("ip_from", 16), F.shiftright("ip_to", 16))).alias("_block"))
    ip = F.col(column)
    joined = records.withColumn("_block", F.shiftright(ip, 16)).join(pieces, "_block", "left").withColumn("_in", (ip >= F.col("ip_from")) & (ip <= F.col("ip_to")))
    return joined.groupBy(*records.columns).agg(F.coalesce(F.max(F.when(F.col("_in"), F.col("country"))), F.lit("")).alias("country"))


def client_profile(records: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent countries, browsers, systems and referers."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("country", "browser", "os", "referer")]))
    counted = records.select(kinds.alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("hits"))
    return counted.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("hits"), "name"))).where(f"n <= {limit}").drop("n")


def http_performance(records: DataFrame) -> DataFrame:
    """Per method and path: requests, responses, mean delay, unanswered requests, errors of either side."""
    has = F.col("responseat") >= 0
    return records.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(has, 1)).alias("responses"), _mean(F.when(has, F.col("responseat") - F.col("requestat"))).alias("meanreqtores"),
        F.count(F.when(~has, 1)).alias("noresponses"), F.count(F.when(F.col("status").between(400, 499), 1)).alias("clienterrors"), F.count(F.when(F.col("status") >= 500, 1)).alias("servererrors"),
    )


def http_requests(records: DataFrame, where: Conditions) -> DataFrame:
    """Requests per second, dense."""
    return series.dense(records.groupBy(net.div(F.col("requestat"), 1_000_000_000).alias("timestamp")).agg(F.count(F.lit(1)).alias("value")), where)


def http_error_details(records: DataFrame, path_pattern: str) -> DataFrame:
    side = F.when(F.col("status") < 500, "client").otherwise("server")
    return records.where((F.col("status") >= 400) & F.col("path").rlike(path_pattern)).groupBy(side.alias("side"), "status").agg(F.count(F.lit(1)).alias("hits"))


def transaction_roots(records: DataFrame) -> DataFrame:
    """Requests under their root: the URL that is reached by following referers.

    The referer of a URL is that of its earliest request.  Every round each URL's pointer jumps to its pointer's pointer,
    so chains of 2^n links take n rounds, and rounds go on until no pointer moves; a round's table replaces the one before.  Following stops at a URL without a
    referer or outside the table; the members of a loop, and the URLs that lead into it, take the loop's least URL.
    """
    url = F.concat(F.lit("http://"), F.col("host"), F.col("path"))
    rows = records.withColumn("url", url)
    parent = rows.groupBy("url").agg(F.min_by("referer", F.struct("requestat", "sessionid")).alias("p"))
    pointer = written(parent.where("p <> ''").select("url", F.col("p").alias("root"), F.col("url").alias("least"), F.lit(True).alias("open")))
    left, reach = pointer.count(), 1
    while left:
        step = pointer.select(F.col("url").alias("root"), F.col("root").alias("next"), F.col("least").alias("other"))
        moved = pointer.where("open").join(step, "root", "left")
        moved = moved.select("url", F.coalesce("next", "root").alias("root"), F.least("least", F.coalesce("other", "least")).alias("least"), F.col("next").isNotNull().alias("open"))
        pointer = written(moved.union(pointer.where("not open")), pointer)
        before, left, reach = left, pointer.where("open").count(), 2 * reach
        # A chain has URLs at every distance from its end, so a round that ends none leaves loops and what leads into
        # them; after as many links as there are such URLs, each pointer is in its loop and has met all of it.
        if left == before and reach >= left:
            break
    inside = pointer.where("open").select(F.col("url").alias("root"), F.col("least").alias("of_loop"))
    found = pointer.where("open").join(inside, "root").select("url", F.col("of_loop").alias("root")).union(pointer.where("not open").select("url", "root"))
    return rows.join(found, "url", "left").select(
        "client_ip", F.coalesce("root", "url").alias("root"), "status", F.col("requestat"), F.when(F.col("responseat") >= 0, F.col("responseat") - F.col("requestat")).otherwise(-1).cast("long").alias("latency"), "host", "path", "referer"
    )


# ---------------------------------------------------------------- TLS


def _server_names(tables: Tables, where: Conditions) -> DataFrame:
    rows = tables["tls_remarks"].join(_ends(tables, implied(where, "tlstracker")), "session_id")
    return rows.withColumn("sni", net.remark(F.col("content"), "TLSSNI")).where(F.col("sni").rlike("^[A-Za-z0-9.-]+$"))


def tls_tracker(tables: Tables, where: Conditions) -> DataFrame:
    """Per server name, server and client: sessions, bytes and round trips each way, timeouts."""
    s = _server_names(tables, where).select("session_id", "sni", "client", "server").distinct()
    rtt = facts(tables, "rtts", where, ["source_is_small"]).where(series.good_rtt()).groupBy("session_id").agg(*series.rtt_sums())
    gone = facts(tables, "timeouts", where).groupBy("session_id").agg(F.count(F.lit(1)).alias("gone"))
    joined = s.join(session_bytes(tables, where), "session_id", "left").join(rtt, "session_id", "left").join(gone, "session_id", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return joined.groupBy("sni", F.col("server").alias("serverip"), F.col("client").alias("clientip")).agg(
        F.count(F.lit(1)).alias("sessions"), total("ip1toip2", "bytescs"), total("ip2toip1", "bytessc"), total("n0", "rttcssum"), total("d0", "rttcshits"), total("n1", "rttscsum"), total("d1", "rttschits"), total("gone", "timeouts")
    )


def tls_rows(tables: Tables, where: Conditions) -> DataFrame:
    """Rollup rows of TLS sessions, each session once: (session_id, timestamp, client_ip, server_ip, server_port, sni)."""
    rows = _server_names(tables, where).select("session_id", F.col("first_second").alias("timestamp"), F.col("client").alias("client_ip"), F.col("server").alias("server_ip"), F.col("dst_port").alias("server_port"), "sni", "file_seq")
    return rows.groupBy("session_id", "timestamp").agg(F.min_by(F.struct("client_ip", "server_ip", "server_port", "sni"), "file_seq").alias("x")).select("session_id", "timestamp", "x.*")


def tls_dump(rollup: DataFrame, where: Conditions, limit: int, offset: int = 0) -> DataFrame:
    rows = rollup.where(F.col("timestamp").between(where.second_from, where.second_to))
    return rows.orderBy("timestamp", "sni", "session_id").offset(offset).limit(limit).select("timestamp", F.col("client_ip").alias("clientip"), F.col("server_ip").alias("serverip"), F.col("server_port").alias("serverport"), "sni")


# ---------------------------------------------------------------- SIP


def sip_messages(tables: Tables, where: Conditions) -> DataFrame:
    """SIP messages with their header fields; a response's type is RESPONSE and its code is set."""
    s = accepted(tables, implied(where, "voipmonitor")).select("session_id", "src_ip", "dst_ip", "source_is_small")
    rows = tables["sip_remarks"].join(s, "session_id")
    body, line = F.col("body"), F.col("start_line")
    address = lambda key: F.regexp_replace(F.substring_index(net.header(body, key), ";", 1), "([^>])$", "$1>")
    reply = line.startswith("SIP/2.0")
    forward = F.col("direction") == F.col("source_is_small")
    return rows.select(
        "session_id", F.col("at").alias("timestamp"), F.when(reply, "RESPONSE").otherwise(F.substring_index(line, " ", 1)).alias("type"), F.when(reply, F.substring(line, 9, 3).cast("int")).otherwise(0).alias("code"),
        net.header(body, "Call-ID").alias("callid"), net.header(body, "CSeq").alias("cseq"), address("From").alias("sipfrom"), address("To").alias("sipto"),
        F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("fromip"), F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("toip"),
        F.regexp_extract(body, r"(?m)^m=audio (\d+) ", 1).alias("media_port"),
    ).where("callid <> ''")


def sip_rtt(messages: DataFrame) -> DataFrame:
    """Round trip of each request (but ACK) to the first response of its call and sequence number."""
    order = W.partitionBy("callid", "cseq").orderBy("timestamp", "type")
    rows = messages.where("type <> 'ACK'").withColumn("before_type", F.lag("type").over(order)).withColumn("before_at", F.lag("timestamp").over(order))
    return rows.where("type = 'RESPONSE' AND before_type <> 'RESPONSE'").select("sipfrom", "sipto", "callid", "cseq", F.col("before_type").alias("request"), (F.col("timestamp") - F.col("before_at")).alias("rtt"))


def rtp_jitter(messages: DataFrame, tables: Tables, where: Conditions) -> DataFrame:
    """Mean deviation of packet intervals of the UDP streams at the endpoints that a call names as its media: of the sessions
    that have the endpoint as destination, else as source.

    Each stream (session and direction) has its own deviation; these are added up by endpoint before the calls are joined, so a
    call has one row for each endpoint with ``streams``, their mean ``jitter`` and its ``total``, however many sessions met there.
    """
    media = messages.where("media_port <> ''").select("sipfrom", "sipto", "callid", F.col("fromip").alias("ip"), F.col("media_port").cast("int").alias("port")).distinct()
    s = accepted(tables, where).where(F.col("payload_protocol") == model.UDP)
    at = facts(tables, "packets", where).select("session_id", "small_to_big", "second", (F.col("second") * 1_000_000_000 + F.col("ns")).alias("t"))
    gap = lag_in_blocks(at, ["session_id", "small_to_big"], ["t"], "t", F.col("second")).select("session_id", "small_to_big", (F.col("t") - F.col("before")).alias("gap")).where("gap IS NOT NULL")
    mean = gap.groupBy("session_id", "small_to_big").agg(net.div(net.total(F.col("gap")), F.count("gap")).alias("mean"), F.count("gap").alias("n")).where("n > 1")
    off = net.total(F.abs(F.col("gap") - F.col("mean")))
    streams = gap.join(mean, ["session_id", "small_to_big"]).groupBy("session_id", "small_to_big", "n").agg(off.alias("dev")).select("session_id", net.div(F.col("dev"), F.col("n")).alias("jitter"))
    own = streams.groupBy("session_id").agg(F.count(F.lit(1)).alias("streams"), net.total(F.col("jitter")).alias("total"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")), F.struct(F.lit(1).alias("side"), F.col("src_ip").alias("ip"), F.col("src_port").alias("port")))
    ends = s.join(own, "session_id", "left").select("streams", "total", F.explode(sides).alias("x")).groupBy("x.ip", "x.port", "x.side").agg(F.sum("streams").alias("streams"), F.sum("total").alias("total"))
    ends = ends.groupBy("ip", "port").agg(F.min_by(F.struct("streams", "total"), "side").alias("x")).select("ip", "port", "x.streams", F.col("x.total").cast("decimal(38,0)").alias("total")).where("streams > 0")
    return media.join(ends, ["ip", "port"]).select("sipfrom", "sipto", "callid", "ip", "port", "streams", net.div(F.col("total"), F.col("streams")).alias("jitter"), "total")


def voip_pairs(messages: DataFrame) -> DataFrame:
    return messages.select("sipfrom", "sipto").distinct()


def voip_summary(messages: DataFrame, rtt: DataFrame, jitter: DataFrame) -> DataFrame:
    """Per pair and method: requests and responses to them; mean SIP round trip and RTP jitter of the pair."""
    asked = messages.where("type <> 'RESPONSE'").groupBy("sipfrom", "sipto", F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("requests"))
    answered = rtt.groupBy("sipfrom", "sipto", F.col("request").alias("name")).agg(F.count(F.lit(1)).alias("responses"))
    trip = rtt.groupBy("sipfrom", "sipto").agg(_mean(F.col("rtt")).alias("siprtt"))
    shake = jitter.groupBy("sipfrom", "sipto").agg(net.div(F.sum("total"), F.sum("streams")).alias("rtpjitter"))
    out = asked.join(answered, ["sipfrom", "sipto", "name"], "left").join(trip, ["sipfrom", "sipto"], "left").join(shake, ["sipfrom", "sipto"], "left")
    return out.select("sipfrom", "sipto", "name", "requests", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("responses", "siprtt", "rtpjitter")])


def voip_details(messages: DataFrame) -> DataFrame:
    return messages.select("timestamp", "callid", "sipfrom", "sipto", "type", "code", "cseq", "fromip", "toip")
