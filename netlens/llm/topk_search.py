"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netlens.llm.common import HOT_KEYS, HOT_ROWS, bucketed, materialize


def segment_codes(vector: Column, dims: int, segments: int) -> Column:
    """Sign bits of a vector as ``segments`` integers.  A missing, null or NaN component is 0 like a negative one."""
    bounds = [round(k * dims / segments) for k in range(segments + 1)]

    def pack(low: int, high: int) -> Column:
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.when(F.isnan(F.get(vector, F.lit(i))), 0).otherwise(1 << (i - low))).otherwise(0) for i in range(low, high)]
        total = bits[0]
        for bit in bits[1:]:
            total = total + bit
        return total.cast("int")

    return F.array(*[pack(a, b) for a, b in zip(bounds, bounds[1:], strict=False)])


def distance(a: Column, b: Column, segments: int) -> Column:
    """Hamming distance of two segment arrays."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for k in range(1, segments):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total.cast("int")


def topk_hamming(rows: DataFrame, query_filter: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", segment_bits: int | None = None) -> DataFrame:
    """The k nearest other rows, by Hamming distance of sign codes and then id, of every row that ``query_filter`` names.

    Returns query_id, rank (1..k), neighbor_id, distance.  Fewer than k rows only where the table has no more.

    A code is cut into m segments of about log2(rows) bits, and each segment has an index from its value to the codes.  The
    index is written once, in buckets of the segment's value; only probes are shuffled from round to round.
    Round r looks up all segment values at exactly r flipped bits.  After round r every code at distance below m(r+1)
    has been met (one of its segments differs in r bits or fewer), so a query whose kth distance is below that is
    finished; only the others go on.  Every candidate's full distance is computed, so the result is exact.

    Equal codes are one entry that keeps its k+1 least ids: more could never be reported.  A vector that a third of the
    rows hold is therefore one index row.  Rows without an id or a vector are neither queries nor answers; repeated ids
    count once, with their least code; ties go to the lesser id; an empty table gives no rows.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(query_filter, F.lit(False)).alias("q")).where("id is not null and v is not null")
    n, dims = plain.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = f"query_id {dict(plain.dtypes)['id']}, rank int, neighbor_id {dict(plain.dtypes)['id']}, distance int"
    if not n or not dims:
        return spark.createDataFrame([], schema)
    bits = min(16, segment_bits or max(4, round(math.log2(n + 1))))
    m = max(1, round(dims / bits))
    widest = max(round((s + 1) * dims / m) - round(s * dims / m) for s in range(m))
    coded = plain.select("id", "q", segment_codes(F.col("v"), dims, m).alias("code")).groupBy("id").agg(F.min("code").alias("code"), F.max("q").alias("q"))

    # the k+1 least ids of each code, in two steps so that a common code is not one task's work; the least one names it
    salted = W.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    by_code = coded.select("code", "id").withColumn("n", F.row_number().over(salted)).where(f"n <= {k + 1}")
    by_code = by_code.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(f"n <= {k + 1}")
    codes = by_code.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = materialize(codes.select("code", "ids", F.col("ids")[0].alias("cid")), "mih-codes")
    entries = codes.select("cid", "code", F.posexplode("code").alias("seg", "value"))
    sizes = materialize(entries.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")), "mih-sizes")
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    # segment values of very many codes, fewer than HOT_KEYS of them: their codes are dealt over parts that each probe visits
    hot = F.broadcast(sizes.where(F.col("n") > limit).select("seg", "value", F.ceil(F.col("n") / limit).cast("int").alias("parts"))) if most > limit else None

    keys = ["seg", "value"] if hot is None else ["seg", "value", "part"]

    def parted(table: DataFrame, part: Column) -> DataFrame:
        return table if hot is None else table.join(hot, ["seg", "value"], "left").withColumn("part", part).drop("parts")

    index = bucketed(parted(entries, F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), F.lit(0))), keys, "mih-index")
    queries = materialize(coded.where("q").select(F.col("id").alias("query_id"), F.col("code").alias("qcode")), "mih-queries")

    # codes, not ids, are ranked between rounds: an id among the k nearest belongs to one of the k+1 first codes
    nearest = W.partitionBy("query_id").orderBy("distance", "cid")
    open_queries, best, done = queries, None, []
    for radius in range(widest + 1):
        flips = [sum(1 << b for b in c) for c in combinations(range(widest), radius)]
        probes = (
            open_queries.select("query_id", "qcode", F.posexplode("qcode").alias("seg", "own"))
            .withColumn("flip", F.explode(F.lit(flips)))
            .select("query_id", "qcode", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
        )
        probes = parted(probes, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        # the planner sees a small table of queries and not what it explodes to, so it must not broadcast it
        met = probes.hint("merge").join(index, keys).select("query_id", "cid", distance(F.col("qcode"), F.col("code"), m).alias("distance"))
        if best is not None:
            met = met.unionByName(best.join(open_queries.select("query_id"), "query_id", "left_semi"))
        met = met.groupBy("query_id", "cid").agg(F.min("distance").alias("distance"))
        best = materialize(met.withColumn("n", F.row_number().over(nearest)).where(f"n <= {k + 1}").drop("n"), f"mih-best-{radius}")
        covered = m * (radius + 1)
        finished = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where(f"n > {k} AND far < {covered}").select("query_id")
        if radius == widest:
            done.append(best)
            break
        done.append(best.join(finished, "query_id", "left_semi"))
        open_queries = materialize(open_queries.join(finished, "query_id", "left_anti"), f"mih-open-{radius}")
        if open_queries.isEmpty():
            break
    total = done[0]
    for part in done[1:]:
        total = total.unionByName(part)
    named = total.join(codes.select("cid", "ids"), "cid").select("query_id", "distance", F.explode("ids").alias("neighbor_id")).where("neighbor_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return named.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "neighbor_id", "distance")
