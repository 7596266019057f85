"""Sharding by a hierarchical weighted hash tree, in built-in Spark functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Leaf:
    """A shard at its place in the tree; ``generation`` is 0 for the first build and grows with later additions."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    generation: int = 0


def topology(n_shards: int, first_build: int = 8, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Equal shards 0..n-1: the first build fills racks of ``per_rack`` and regions of ``racks``; each later shard joins
    the tree at the next place, as a generation of its own."""
    leaves = []
    for shard in range(n_shards):
        rack = shard // per_rack
        leaves.append(Leaf(shard, rack // racks, rack % racks, 1.0, max(0, shard - first_build + 1)))
    return leaves


def _draw(key: Column, name: Column | str) -> Column:
    """Uniform in (0, 1] from the key and a node's name: 52 bits of an MD5, the same on every engine."""
    name = F.lit(name) if isinstance(name, str) else name
    digest = F.md5(F.concat_ws("/", name, key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def _descend(key: Column, children: dict[str, float]) -> Column:
    """Name of the child that wins the weighted draw: the least of -ln(u)/weight; ties go to the lesser name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    clocks = [F.struct((-F.log(_draw(key, name)) / w).alias("clock"), F.lit(name).alias("name")) for name, w in sorted(children.items())]
    return F.least(*clocks)["name"]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of a key: region, then rack, then shard, each by a weighted hash draw.

    A node's weight is the sum of its leaves' weights, held as one part for each generation, and each part draws for
    itself.  A draw is an exponential clock of rate weight, so the parts together win exactly as often as one clock of
    the whole weight would.  The part that wins decides which leaves remain: adding a shard adds one part at each level
    above it, which can only take keys for that shard.  Everything outside the changed subtree stays where it was.
    """
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard of positive weight")

    def level(nodes: list[Leaf], names: list) -> Column:
        if not names:
            return F.lit(nodes[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for x in nodes:
            groups.setdefault(names[0](x), []).append(x)
        if len(groups) == 1:
            return level(nodes, names[1:])
        won = _descend(key, {name: sum(x.weight for x in below) for name, below in groups.items()})
        out = None
        for name, below in sorted(groups.items()):
            inner = level(below, names[1:])
            out = F.when(won == name, inner) if out is None else out.when(won == name, inner)
        return out

    return level(
        live,
        [
            lambda x: f"region{x.region}.{x.generation}",
            lambda x: f"rack{x.region}-{x.rack}.{x.generation}",
            lambda x: f"shard{x.shard}",
        ],
    ).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """Every row of ``docs`` with its shard and a slot that counts 0, 1, 2 ... without gaps inside the shard.

    Returns id_col, size (UTF-8 bytes + 1), text_crc32, law ('key'), shard, slot, grown_shard (with one more shard).
    Law ``key``: the id and the shard count alone decide, so equal ids share a shard.

    The slot needs no global order: rows are dealt to ``buckets`` ranges of a hash inside each shard, numbered inside
    each range, and shifted by the counts of the ranges before.  The table of counts has shards x buckets rows at most,
    whatever the input, which is why it may be broadcast.  The hash covers id and text, so one id or one text held by
    a third of all rows is still dealt evenly unless whole rows repeat.

    A null text counts as empty (size 1, CRC 0); a null id is a key like any other; repeated rows get slots of their
    own; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    grown = place(key, topology(n_shards + 1, n_shards))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        place(key, topology(n_shards, n_shards)).alias("shard"),
        grown.alias("grown_shard"),
        (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit("slot"), key, F.crc32(text).cast("string")).cast("binary")), 1, 3), 16, 10).cast("int") % buckets).alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        F.col("shard").alias("s"),
        F.col("bucket").alias("b"),
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    inner = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inner))
        .join(F.broadcast(offsets), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
