"""A store of rollups: one folder a rollup, partitioned by feed, hour and build, and a table of what has been built.

A build covers whole minutes and follows the one before.  Its rows are written first, each build overwriting only its own
partitions, and its range is noted last, so a build that fails half-way is not read and can simply be repeated.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.sources.tables import drop_old_rollups

_RANGES = "rollup string, low long, high long, kind string, seq long"
_temporary: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; only in local mode it may be unset and is a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="netlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(rows: DataFrame, *before: DataFrame) -> DataFrame:
    """The rows, computed once, written below the shared folder and read back; what ``before`` was read from is removed.
    The last of such steps is removed when the driver ends."""
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/netlens/step-{uuid.uuid4().hex}"
    rows.write.parquet(root)
    _temporary.append((spark, root))
    for old in before:
        for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            for item in [x for x in _temporary if folder.endswith(x[1].split("://")[-1].split(":", 1)[-1])]:
                path, files = _path(spark, item[1])
                files.delete(path, True)
                _temporary.remove(item)
    return spark.read.schema(rows.schema).parquet(root)


class RollupStore:
    """Rollups of one feed below ``root``; a folder holds ``hours`` hours and is named by the first."""

    def __init__(self, spark: SparkSession, root: str, feed: str, hours: int = 1):
        self.spark, self.root, self.feed, self.hours = spark, root.rstrip("/"), feed, hours

    @classmethod
    def temporary(cls, spark: SparkSession, feed: str = "feed") -> RollupStore:
        """A store below the shared folder, with a folder a day, that is removed when the driver ends."""
        store = cls(spark, f"{shared_folder(spark)}/netlens/rollups-{uuid.uuid4().hex}", feed, 24)
        _temporary.append((spark, store.root))
        return store

    def _noted(self) -> list[tuple[str, int, int, str, int]]:
        """What has been done to this feed's rollups, in order: one row for each rollup and step."""
        folder = f"{self.root}/ranges/feed={self.feed}"
        path, files = _path(self.spark, folder)
        rows = self.spark.read.schema(_RANGES).parquet(folder).collect() if files.exists(path) else []
        return sorted((tuple(r) for r in rows), key=lambda r: r[4])

    def _note(self, rows: list[tuple]) -> None:
        first = 1 + max((r[4] for r in self._noted()), default=0)
        numbered = [(*r, first + k) for k, r in enumerate(rows)]
        self.spark.createDataFrame(numbered, _RANGES).coalesce(1).write.mode("append").parquet(f"{self.root}/ranges/feed={self.feed}")

    def covered(self, name: str) -> tuple[int, int] | None:
        """First second, and the second behind the last, of what a rollup holds without a gap."""
        found = None
        for rollup, low, high, kind, _ in self._noted():
            if rollup != name:
                continue
            if kind == "built":
                found = (found[0] if found else low, high)
            elif kind == "dropped":
                found = None
            elif found:
                found = (max(found[0], high), found[1])
        return found if found and found[0] < found[1] else None

    def parts(self, name: str) -> set[str]:
        """The parts of a rollup that has a folder for each, by name, that are there now."""
        names = {r[0] for r in self._noted() if r[0].startswith(f"{name}/")}
        return {n.split("/", 1)[1] for n in names if self.covered(n)}

    def build(self, low: int, high: int, rollups: dict[str, tuple[DataFrame, str]], parts: dict[str, tuple[str, set[str]]] | None = None) -> None:
        """Write rollups, each with its column of time, for the whole minutes from ``low`` to before ``high``.  ``parts``
        names a column of a rollup whose values have folders of their own, and the values that this build covers."""
        if low % 60 or high % 60 or low >= high:
            raise ValueError("a build covers whole minutes")
        for name in rollups:
            before = self.covered(name)
            if before and before[1] != low:
                raise ValueError(f"{name} is built up to {before[1]}, the next build begins there")
        for name, (rows, time) in rollups.items():
            column, values = (parts or {}).get(name, (None, set()))
            self._write(name, rows, time, low, column)
            self._note([(name, low, high, "built"), *[(f"{name}/{v}", low, high, "built") for v in sorted(values)]])

    def _write(self, name: str, rows: DataFrame, time: str, low: int, column: str | None) -> None:
        out = rows.withColumn("feed", F.lit(self.feed)).withColumn("hour", F.expr(f"{time} div {3600 * self.hours} * {self.hours}")).withColumn("build", F.lit(low))
        # rows of a busy hour are split over tasks, those of quiet hours share one
        inner = [column] if column else []
        out = out.hint("rebalance", F.col("hour"), *[F.col(c) for c in inner])
        keys = ["feed", "hour", "build", *inner]
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/{name}")

    def backfill(self, name: str, rows: DataFrame, time: str, column: str, values: set[str]) -> None:
        """Add parts to what a rollup holds already: their folders only are written."""
        low, high = self.covered(name)
        self._write(name, rows, time, low, column)
        self._note([(f"{name}/{v}", low, high, "built") for v in sorted(values)])

    def drop(self, name: str, column: str, values: set[str]) -> list[str]:
        """Remove parts of a rollup, noted first, so nobody reads half of one; returns the folders that went."""
        self._note([(f"{name}/{v}", 0, 0, "dropped") for v in sorted(values)])
        gone = []
        for value in sorted(values):
            pattern, files = _path(self.spark, f"{self.root}/{name}/feed={self.feed}/hour=*/build=*/{column}={value}")
            for status in files.globStatus(pattern) or []:
                gone.append(status.getPath().toString())
                files.delete(status.getPath(), True)
        return gone

    def read(self, name: str, low: int, high: int) -> DataFrame:
        """Rows of the hours of a range; only noted builds count."""
        builds = sorted({x for n, x, _, kind, _ in self._noted() if n == name and kind == "built"})
        rows = self.spark.read.parquet(f"{self.root}/{name}").where((F.col("feed") == self.feed) & F.col("hour").between(low // 3600 - self.hours + 1, (high - 1) // 3600) & F.col("build").isin(builds))
        return rows.drop("feed", "hour", "build")

    def expire(self, keep_from_hour: int) -> dict[str, list[int]]:
        """Remove the folders before an hour; from then on the rollups cover what is left."""
        keep_from_hour = keep_from_hour // self.hours * self.hours
        names = sorted({r[0] for r in self._noted()})
        names, every = [n for n in names if "/" not in n], names
        self._note([(name, 0, keep_from_hour * 3600, "expired") for name in every])
        gone = drop_old_rollups(self.spark, self.root, self.feed, keep_from_hour)
        return {name: gone.get(name, []) for name in names}


class OnDemand(RollupStore):
    """A store that builds a rollup when it is first asked what that covers."""

    def __init__(self, *where) -> None:
        super().__init__(*where)
        self.fill: Callable[[RollupStore, str], None] | None = None
        self._asked: set[str] = set()

    def covered(self, name: str) -> tuple[int, int] | None:
        rollup = name.split("/", 1)[0]
        if self.fill and rollup not in self._asked:
            self._asked.add(rollup)
            try:
                self.fill(self, rollup)
            except BaseException:
                self._asked.discard(rollup)
                raise
        return super().covered(name)


_made: dict[tuple[str, str], OnDemand] = {}


def store_of(spark: SparkSession, key: str, fill: Callable[[RollupStore, str], None]) -> RollupStore:
    """The store of a key; each rollup is filled when this application first asks for it."""
    name = spark.sparkContext.applicationId, key
    if name not in _made:
        _made[name] = OnDemand.temporary(spark)
        _made[name].fill = fill
    return _made[name]


@atexit.register
def _sweep() -> None:
    for spark, root in _temporary:
        try:
            path, files = _path(spark, root)
            files.delete(path, True)
        except Exception:  # the JVM may be gone already at interpreter exit
            return
