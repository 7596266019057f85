"""The logical tables of one feed as DataFrames, from a Parquet store or derived from general-purpose tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens import model
from netlens.sources import fixtures
from netlens.sources.sessions import whole_sessions

#: Fact tables and the column that holds their time.
TIME = {"bps": "second", "pps": "second", "rtts": "second", "tcp_rsts": "second", "tcp_dupacks": "second", "tcp_retransmissions": "second", "tcp_misc": "second", "tcp_syns": "second", "timeouts": "marker_second", "packets": "second", "icmp_packets": "second", "icmp6_packets": "second"}
#: Tables without a time of their own: their rows stand in the hours of their session.
BY_SESSION = ("session_vlan", "session_mpls", "session_ip6", "http_remarks", "dns_remarks", "tls_remarks", "mail_remarks", "sip_remarks", "icmp_remarks", "icmp6_remarks")
#: Columns of stored tables, given so that a table without any row can be read.
SCHEMAS = {"sessions": model.SESSION_SCHEMA, "bps": model.TRAFFIC_SCHEMA, "pps": model.TRAFFIC_SCHEMA, "timeouts": model.SESSION_SCHEMA + ", marker_second long, marker_ns long"}
SCHEMAS |= dict.fromkeys(("rtts", "tcp_rsts", "tcp_dupacks", "tcp_retransmissions", "tcp_misc", "tcp_syns"), model.MARKER_SCHEMA)
#: Tasks that write the rows of one hour.
WRITERS = 8
SOURCES = ("events", "pages", "orders", "conversations", "documents")


class Tables:
    """Tables by name, built when they are first asked for: ``tables["bps"]``."""

    def __init__(self, spark: SparkSession, open_table):
        self.spark = spark
        self._open = open_table
        self._made: dict[str, DataFrame] = {}
        self.origin = ""
        self._reopen: Callable[[int, int], Tables] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._open(self, name)
        return self._made[name]

    def __setitem__(self, name: str, table: DataFrame) -> None:
        self._made[name] = table

    def narrowed(self, second_from: int, second_to: int) -> Tables:
        """The tables for facts of a range: those of a store are opened for its hours only."""
        return self._reopen(second_from, second_to) if self._reopen else self

    @classmethod
    def derived(cls, spark: SparkSession, directory: str) -> Tables:
        """Tables computed from the general-purpose tables below ``directory``."""
        spark.conf.set("spark.sql.session.timeZone", "UTC")

        def open_table(self: Tables, name: str) -> DataFrame:
            if name in SOURCES:
                return spark.read.parquet(f"{directory}/{name}.parquet")
            if name in fixtures.LITERALS:
                columns, rows = fixtures.LITERALS[name]
                return spark.createDataFrame(rows, columns)
            text = fixtures.STATEMENTS[name].replace("USEC(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace("USEC(o_orderdate)", "unix_micros(CAST(o_orderdate AS TIMESTAMP))")
            text = text.replace("AS VARCHAR(20)", "AS STRING").replace("AS VARCHAR(10)", "AS STRING").replace("AS VARCHAR(5)", "AS STRING").replace("{", "{{").replace("}", "}}")
            inputs = {n: self[n] for n in set(re.findall(r"(?:FROM|JOIN) ([a-z_0-9]+)", text))}
            for n in inputs:
                text = re.sub(rf"((?:FROM|JOIN) ){n}\b", rf"\1{{{n}}}", text)
            if name == "timeouts":
                text = text.replace("{e} JOIN", "{e} e JOIN")
            return spark.sql(text, **inputs)

        tables = cls(spark, open_table)
        tables.origin = directory
        return tables

    @classmethod
    def stored(cls, spark: SparkSession, root: str, feed: str, second_from: int | None = None, second_to: int | None = None, files: bool = False) -> Tables:
        """Tables of a store with a folder for each table, partitioned by feed and hour; a time range prunes hours.

        Sessions stand in every hour that they touch and in every file that has packets of them; what is read of them is
        merged by session and turned to the known services (:func:`netlens.sources.sessions.whole_sessions`).  Rows of
        :data:`BY_SESSION` are read once: where their session begins or, if that is before the range, in its first hour.
        With ``files``, records outside the time of their file, by the table of that name, are left out.
        """

        def open_table(self: Tables, name: str) -> DataFrame:
            reader = spark.read.schema(f"{SCHEMAS[name]}, feed string, hour long") if name in SCHEMAS else spark.read
            table = reader.parquet(f"{root}/{name}").where(F.col("feed") == feed)
            timed = name in TIME or name == "sessions" or name in BY_SESSION
            if name in BY_SESSION:
                table = table.where(F.col("home") if second_from is None else F.col("home") | (F.col("hour") == second_from // 3600)).drop("home")
            if timed and second_from is not None:
                table = table.where(F.col("hour") >= second_from // 3600)
            if timed and second_to is not None:
                table = table.where(F.col("hour") <= second_to // 3600)
            table = table.drop("feed", "hour")
            return whole_sessions(table, self["files"] if files else None) if name == "sessions" else table

        tables = cls(spark, open_table)
        tables.origin = f"{root}:{feed}"
        tables._reopen = lambda low, high: cls.stored(spark, root, feed, low, high, files)
        return tables


def store(tables: Tables, root: str, feed: str, names: list[str] | None = None, mode: str = "append") -> None:
    """Write tables below ``root``, partitioned by feed and hour; a session goes to every hour that it touches, and so do its
    rows of :data:`BY_SESSION`, marked where the session begins (``home``); what has no time goes to hour 0.  The rows of an
    hour are dealt to ``WRITERS`` tasks, so no task writes a busy hour alone."""
    for name in names or [*TIME, "sessions", *BY_SESSION]:
        table = tables[name]
        if name in BY_SESSION:
            spans = tables["sessions"].groupBy("session_id").agg(F.min(F.expr("first_second div 3600")).alias("_a"), F.max(F.expr("greatest(first_second, last_second) div 3600")).alias("_b"))
            none = F.lit(0).cast("long")
            table = table.join(spans, "session_id", "left").withColumn("_a", F.coalesce("_a", none)).withColumn("_b", F.coalesce("_b", none))
            table = table.select(*tables[name].columns, "_a", F.explode(F.sequence("_a", "_b")).alias("hour")).withColumn("home", F.col("hour") == F.col("_a")).drop("_a")
            hour = F.col("hour")
        elif name == "sessions":
            hour = F.explode(F.sequence(F.expr("first_second div 3600"), F.greatest(F.expr("first_second div 3600"), F.expr("last_second div 3600"))))
        else:
            hour = F.expr(f"{TIME[name]} div 3600") if name in TIME else F.lit(0).cast("long")
        rows = table.withColumn("feed", F.lit(feed)).withColumn("hour", hour)
        dealt = "session_id" if "session_id" in table.columns else table.columns[0]
        rows.repartition("hour", F.pmod(F.xxhash64(dealt), F.lit(WRITERS))).write.mode(mode).partitionBy("feed", "hour").parquet(f"{root}/{name}")


def feeds(spark: SparkSession, root: str, name: str = "bps") -> DataFrame:
    """The feeds of a store with their first and last second, by whole hours, from the names of partitions only."""
    hours = spark.read.parquet(f"{root}/{name}").select(F.col("feed").cast("string").alias("feed"), F.col("hour").cast("long").alias("hour"))
    return hours.groupBy("feed").agg((F.min("hour") * 3600).alias("from"), (F.max("hour") * 3600 + 3599).alias("to"))


def drop_old_hours(spark: SparkSession, root: str, name: str, feed: str, keep_from_hour: int) -> list[int]:
    """Retention: remove the hours of a table before ``keep_from_hour``; returns them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/feed={feed}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder) if files.exists(folder) else []:
        hour = status.getPath().getName().removeprefix("hour=")
        if hour.isdigit() and int(hour) < keep_from_hour:
            files.delete(status.getPath(), True)
            gone.append(int(hour))
    return sorted(gone)


def drop_old_data(spark: SparkSession, root: str, max_bytes: int | None = None, ages: dict[str, int] | None = None, spare: tuple[str, ...] = (), raw: tuple[str, ...] = ("packets", "icmp_packets", "icmp6_packets")) -> list[tuple[str, int, str]]:
    """Retention by age and size: what went, as (feed, hour, table).

    First, of feeds with an age in hours, the ``raw`` tables lose the hours that are older than that before the feed's
    newest hour.  Then, while the store has more than ``max_bytes``, the oldest hour of any feed but those of ``spare`` goes
    with all its tables; a feed without an hour loses its folders.  Only names and sizes of folders are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = lambda folder: [x.getPath() for x in files.listStatus(folder) if x.isDirectory()] if files.exists(folder) else []
    found: dict[tuple[str, int, str], tuple] = {}
    for table in below(path(root)):
        for feed in (f for f in below(table) if f.getName().startswith("feed=")):
            for hour in (h for h in below(feed) if h.getName().startswith("hour=") and h.getName()[5:].isdigit()):
                key = (feed.getName()[5:], int(hour.getName()[5:]), table.getName())
                found[key] = (hour, files.getContentSummary(hour).getLength())
    gone: list[tuple[str, int, str]] = []

    def drop(key: tuple[str, int, str]) -> None:
        hour, _ = found.pop(key)
        files.delete(hour, True)
        gone.append(key)
        if not below(hour.getParent()):
            files.delete(hour.getParent(), True)

    for feed, hours in (ages or {}).items():
        newest = max((h for f, h, _ in found if f == feed), default=0)
        for key in sorted(k for k in found if k[0] == feed and k[2] in raw and k[1] < newest - hours):
            drop(key)
    left = sum(size for _, size in found.values())
    for hour, feed in sorted({(h, f) for f, h, _ in found if f not in spare}):
        if max_bytes is None or left <= max_bytes:
            break
        for key in sorted(k for k in found if k[:2] == (feed, hour)):
            left -= found[key][1]
            drop(key)
    return gone


def drop_old_rollups(spark: SparkSession, root: str, feed: str, keep_from_hour: int) -> dict[str, list[int]]:
    """Expiry of every table of a rollup store; returns the hours that went, by table."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return {name: drop_old_hours(spark, root, name, feed, keep_from_hour) for name in sorted(names)}


def write_tsv(result: DataFrame, path: str) -> None:
    """Result sink: tab-separated text with a header."""
    result.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(result: DataFrame, path: str) -> None:
    """Result sink: one JSON object a line."""
    result.write.mode("overwrite").json(path)
