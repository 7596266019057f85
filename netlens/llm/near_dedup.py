"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import LOWER, SPACE_WORDS, SpanHash, aside, chain, discard, join_counted, materialize, partitions, slices, word_spans

#: Values of a sketch, and the chance at which a link at the very threshold may look too weak in its sketches.
SKETCH, MISS = 64, 1e-9
#: Rows of (id, id, 16 bytes) that may be broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of sketches that may be broadcast to candidate pairs.
BROADCAST_SKETCHES = 16 << 20
#: Rows of a task in tables of candidates and links, about.
ROWS_A_TASK = 20_000
#: Lists of so many nodes at most turn into pairs; the nodes of longer lists are compared in blocks of so many.
LIST_PAIRS, BLOCK = 64, 2048
#: Nodes of a large cluster that all its nodes are compared with first.
LEADS = 8


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets by document): the distinct 63-bit hashes of each document's word shingles, ascending.

    A document with fewer words than ``size`` has its whole sequence as one shingle; without words it has none.
    """
    starts, ends, tokens = word_spans(data, offsets, SPACE_WORDS)
    n_docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    words = SpanHash(LOWER[data])(starts, ends)
    counts = np.diff(tokens)
    doc = np.repeat(np.arange(n_docs), counts)
    docs, values = [], []
    n = len(words) - size + 1
    if n > 0:
        good = np.flatnonzero(doc[:n] == doc[size - 1 :])
        docs.append(doc[good])
        values.append(chain(*(words[k : k + n] for k in range(size)))[good])
    for short in range(1, size):
        first = tokens[:-1][counts == short]
        if len(first):
            docs.append(doc[first])
            values.append(chain(*(words[first + k] for k in range(short))))
    owner, value = np.concatenate(docs), np.concatenate(values) >> np.uint64(1)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n_docs + 1))


def _signature(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("_text")):
                values, bounds = shingles(data, offsets, size)
                counts = np.diff(bounds)
                take = np.minimum(counts, k)
                first = np.repeat(bounds[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(values[first].view(np.int64)))
                signs = [_signature(values[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("_key").slice(low, high - low), pa.array(counts, pa.int64()), pa.array(signs, pa.binary()), sketch],
                    names=["doc_id", "_key", "n", "sig", "sketch"],
                )

    return run


def _sets(size: int):
    """(nid, set) of the texts whose signature is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column("nid"), batch.column("sig").to_pylist()
            for low, high, data, offsets in slices(batch.column("_text")):
                values, bounds = shingles(data, offsets, size)
                rows, sets = [], []
                for k in range(high - low):
                    own = values[bounds[k] : bounds[k + 1]]
                    if _signature(own) == wanted[low + k]:
                        rows.append(low + k)
                        sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], names=["nid", "set"])

    return run


def _jaccard(num: int, den: int):
    """Pairs whose full sets meet den * |A and B| >= num * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (a, b) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, value, size of its set) of every value."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            sets = [np.frombuffer(x.as_py(), np.int64) for x in part.column("set")]
            sizes = np.array([len(x) for x in sets])
            rows = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays([part.column("nid").take(rows), pa.array(np.concatenate(sets)), pa.array(np.repeat(sizes, sizes))], names=["nid", "v", "size"])


def _to_leads(num: int, den: int):
    """Links of every node to the leads of its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for nid, own, leads in zip(batch.column("nid").to_pylist(), batch.column("set"), batch.column("leads"), strict=True):
                x = np.frombuffer(own.as_py(), np.uint64)
                for lead in leads.as_py():
                    y = np.frombuffer(lead["set"], np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if nid != lead["nid"] and den * both >= num * (len(x) + len(y) - both):
                        a.append(lead["nid"])
                        b.append(nid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the pairwise intersections.  Only values of two sets and more count: frequent ones by a
    product of membership matrices, rare ones by adding up their few pairs."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, starts = owner[order], np.cumsum(counts) - counts
    total = np.zeros((n, n), np.float32)
    often = np.flatnonzero(counts >= 24)
    for low in range(0, len(often), 1024):
        part = often[low : low + 1024]
        member = np.zeros((n, len(part)), np.float32)
        for k, c in enumerate(part):
            member[owner[starts[c] : starts[c] + counts[c]], k] = 1
        total += member @ member.T
    for f in np.unique(counts[(counts > 1) & (counts < 24)]):
        cols = np.flatnonzero(counts == f)
        for low in range(0, len(cols), 20_000):
            rows = owner[starts[cols[low : low + 20_000], None] + np.arange(f)]
            cells = (rows[:, :, None] * n + rows[:, None, :]).ravel()
            total += np.bincount(cells, minlength=n * n).reshape(n, n).astype(np.float32)
    return total


def _block(num: int, den: int):
    """Links among the sets of one block, enough of them to connect what they connect."""

    def run(table: pa.Table) -> pa.Table:
        ids, place = np.unique(table.column("nid").to_numpy(), return_index=True)  # a node may stand on both sides
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").take(pa.array(place)).to_pylist()]
        sizes = np.array([len(x) for x in sets], np.float64)
        both = intersections(sets).astype(np.float64)
        linked = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
        linked |= np.eye(len(ids), dtype=bool)
        label = np.arange(len(ids))
        while True:
            least = np.where(linked, label[None, :], len(ids)).min(axis=1)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        rows = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[label[rows]]), "b": pa.array(ids[rows])})

    return run


def least_shared(k: int, share: float, miss: float = MISS) -> int:
    """The largest t for which a union sketch of k values shows fewer than t shared ones with probability at most ``miss``."""
    total = 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * share**t * (1 - share) ** (k - t)
        if total > miss:
            return max(1, t)
    return k


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its rows fill."""
    return df.coalesce(max(1, min(partitions(df.sparkSession), rows // ROWS_A_TASK)))


def components(edges: DataFrame) -> DataFrame:
    """(nid, comp) of every node of ``edges`` (a, b): comp is the least id that can be reached.

    Each step takes the least label among a node and its neighbours and then that label's own label, so paths halve.
    Labels live in written tables; only whether one changed comes to the driver.  Labels are broadcast to the edges while
    they are few, and joined by a shuffle beyond that.
    """
    pair = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ways = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("u", "v"), ("v", "u"), ("u", "u"), ("v", "v"))])
    size = edges.count() * 4
    both = materialize(_sized(pair.select(F.explode(ways).alias("x")).select("x.u", "x.v").distinct(), size), "cc-edges")
    labels = materialize(_sized(both.groupBy(F.col("u").alias("nid")).agg(F.min("v").alias("comp")), size), "cc-labels")
    few = labels.count() <= BROADCAST_ROWS
    while True:
        known = F.broadcast(labels) if few else labels
        own = both.join(known.select(F.col("nid").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"), F.max(F.when(F.col("u") == F.col("v"), F.col("c"))).alias("old"))
        jump = known.select(F.col("nid").alias("c"), F.col("comp").alias("next"))
        after = materialize(_sized(own.join(jump, "c").select(F.col("u").alias("nid"), "old", F.least("c", "next").alias("comp")), size), "cc-labels")
        changed = after.where("old <> comp").limit(1).count()
        discard(labels)
        labels = after.select("nid", "comp")
        if not changed:
            discard(both)
            return labels


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`, the one of the least id; of rows that repeat id and
    text one stays.  Columns may have any names."""
    docs, back = aside(docs, [id_col, text_col])
    found = near_duplicates(docs, shingle, num, den, id_col=id_col, text_col=text_col, with_key=True)
    found = materialize(found.groupBy("doc_id", "_key").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-found")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"))
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    left = keyed.join(small, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left_anti")
    if found.where("kept AND n > 1").limit(1).count():
        left = left.dropDuplicates([id_col, "_key"])
    return back(left)


def near_duplicates(docs: DataFrame, shingle: int = 3, num: int = 85, den: int = 100, k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Groups of near duplicates: one row for each row of ``docs``, with n_shingles, component_id and kept (and _key, the
    text's xxhash64, with ``with_key``).

    Two texts are linked if den * |A and B| >= num * |A or B| for their sets of word shingles; component_id is the least
    id that links reach.

    1. Equal sets collapse to one node, so copies never make pairs.
    2. Every node has a sketch: the ``k`` least hashes of its shingles.  Inverted lists hold, for each value, the nodes
       that retain it.  A link at the threshold shows at least t shared values in the union sketch (all but ``MISS`` of
       the time), so two linked nodes still meet if each enters only its k-t+1 rarest values; values that a common
       passage brings into many texts are the last to be entered.
    3. A list of up to ``LIST_PAIRS`` nodes gives its pairs.  A longer one never does: lists that share nodes form a
       cluster, and one of up to ``BLOCK`` nodes is compared inside a task, which returns no more links than nodes.
    4. Larger clusters enter the rarest values of their full sets in new lists, where texts that only share a passage
       part.  What still meets in long lists is compared with a few leads of its cluster first; only nodes outside the
       largest group that this connects are compared with all others, in blocks.
    5. The union-sketch estimate drops weak pairs; the full sets decide on the rest, and on all in the blocks.

    A null or empty text, or one without words, has no shingles: it is linked with nothing and is its own component.
    Rows with equal ids share a row's fate only if their texts are linked.  A null id never becomes a component id unless
    nothing else is there.  Equal rows come back alike; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"))
    kind = dict(source.dtypes)["doc_id"]
    base = materialize(source.mapInArrow(_sketches(shingle, k), f"doc_id {kind}, _key long, n long, sig binary, sketch array<long>"), "near-sketches")
    nodes = base.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "near-nodes")
    share = num / den
    shared = least_shared(k, share)

    values = nodes.select("nid", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = values.join(common, "v").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("held"))  # k at most
    least = F.least(F.lit(shared), F.ceil(F.col("n") * F.lit(num) / F.lit(den))).cast("int")
    room = F.size("sketch") - least + 1 - (F.size("sketch") - F.size("held"))  # values of no other node are the rarest
    index = nodes.select("nid", "n", "sketch").join(held, "nid").withColumn("room", room).where("room > 0")
    index = materialize(index.select("nid", "n", F.explode(F.slice("held", F.lit(1), F.col("room"))).alias("x")).select(F.col("x.v").alias("v"), "nid", "n"), "near-index")

    entered = index.select("nid").distinct()
    light = materialize(nodes.select("nid", "sketch", "sig", "doc").join(entered, "nid", "left_semi"), "near-candidates")
    n_light = light.count()
    light = _sized(light, n_light)
    sketches = light.select("nid", "sketch")
    sketches = F.broadcast(sketches) if n_light * (k * 8 + 32) <= BROADCAST_SKETCHES else sketches
    place = light.select("nid", "sig", "doc")

    def sets_of(ids: DataFrame, n: int) -> DataFrame:
        """(nid, set) of the nodes ``ids`` (nid), of which there are ``n`` at most, from their texts."""
        wanted = materialize(_sized(ids.distinct().join(place, "nid"), n), "near-wanted")
        small = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
        texts = source.join(small, source["doc_id"].eqNullSafe(small["doc"])).select("nid", "sig", "_text")
        sets = materialize(texts.mapInArrow(_sets(shingle), "nid long, set binary"), "near-sets")
        discard(wanted)
        return sets.dropDuplicates(["nid"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among ``pairs`` (a, b)."""
        x = pairs.join(sketches.select(F.col("nid").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("nid").alias("b"), F.col("sketch").alias("sb")), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        x = x.select("a", "b", F.size(union).alias("u"), F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))).alias("s"))
        likely = materialize(x.where(F.when(F.col("u") < k, F.col("s") * den >= F.col("u") * num).otherwise(F.col("s") >= shared)).select("a", "b"), "near-likely")
        n = likely.count()
        likely = _sized(likely, n)
        sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("nid")), 2 * n)
        full = likely.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("set_b")), "b")
        return materialize(_sized(full, 10 * n).mapInArrow(_jaccard(num, den), "a long, b long"), "near-links")

    def clustered(members: DataFrame) -> DataFrame:
        """(nid, comp): lists (v, nid) that share nodes form one cluster, so nodes that meet in many lists are compared once."""
        heads = members.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("a"))
        ties = join_counted(members, materialize(heads, "near-heads"), ["v"], ["nid"]).where("nid <> a").select("a", F.col("nid").alias("b"))
        return components(ties.distinct())

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Links among the rows (nid, set) of each block (comp, lo, hi), enough to connect what is linked."""
        return materialize(rows.groupBy("comp", "lo", "hi").applyInArrow(_block(num, den), "a long, b long"), "near-links")

    def compared(members: DataFrame) -> DataFrame:
        """Links among the members (v, nid) of long lists: clusters of one block in that block, larger ones by :func:`deeper`."""
        clusters = clustered(members)
        n = clusters.count()
        large = materialize(clusters.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "near-large")
        small = clusters.join(large, "comp", "left_anti")
        zero = F.lit(0).alias
        links = in_blocks(sets_of(small.select("nid"), n).join(small, "nid").select("nid", "set", "comp", zero("lo"), zero("hi")))
        return links if large.isEmpty() else links.unionByName(deeper(join_counted(clusters, large, ["comp"], ["nid"]).select("nid"), n))

    def deeper(nodes: DataFrame, n: int) -> DataFrame:
        """Links among the nodes of large clusters.  Linked sets x and y share num / den of the larger one at least, so they
        meet in a value even if each enters only its |x| - ceil(|x| num / den) + 1 rarest values, now of the full set.
        Texts that share a passage but differ otherwise part here; lists that are still long are near copies for the most."""
        sets = materialize(sets_of(nodes, n), "near-sets")
        values = materialize(sets.mapInArrow(_values, "nid long, v long, size long"), "near-values")
        often = values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        often = materialize(often.withColumn("f", F.col("n")), "near-often")
        held = join_counted(values, often, ["v"], ["nid"]).groupBy("nid", "size").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("held"))  # as many as the set has
        least = F.ceil(F.col("size") * F.lit(num) / F.lit(den))
        rare = held.withColumn("room", (F.size("held") - least + 1).cast("int")).where("room > 0")
        entries = materialize(rare.select("nid", F.col("size").alias("n"), F.explode(F.slice("held", F.lit(1), F.col("room"))).alias("x")).select(F.col("x.v").alias("v"), "nid", "n"), "near-entries")
        lists = materialize(entries.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-lists")
        links = paired(join_counted(entries, lists.where(F.col("n") <= LIST_PAIRS), ["v"], ["nid"]))
        long = materialize(join_counted(entries, lists.where(F.col("n") > LIST_PAIRS), ["v"], ["nid"]).select("v", "nid"), "near-long")
        discard(values, often)
        return links if long.isEmpty() else links.unionByName(dense(clustered(long), sets))

    def dense(clusters: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among the nodes of clusters of near copies: all are compared with a few leads first, which connects most
        of them.  Then only those outside a cluster's largest group are compared with all of it, block by block."""
        rows = materialize(sets.join(clusters, "nid"), "near-dense")
        leads = clusters.groupBy("comp", F.pmod(F.xxhash64("nid"), F.lit(LEADS)).alias("k")).agg(F.min("nid").alias("nid")).select("nid")
        chosen = rows.join(leads, "nid", "left_semi").groupBy("comp").agg(F.collect_list(F.struct("nid", "set")).alias("leads"))  # LEADS at most
        chosen = materialize(chosen.join(clusters.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "comp"), "near-leads")
        links = materialize(join_counted(rows, chosen, ["comp"], ["nid"]).mapInArrow(_to_leads(num, den), "a long, b long"), "near-links")
        labels = clusters.withColumn("label", F.col("nid"))
        if not links.isEmpty():
            labels = clusters.join(components(links).withColumnRenamed("comp", "l"), "nid", "left").select("nid", "comp", F.coalesce("l", "nid").alias("label"))
        labels = materialize(labels, "near-labels")
        groups = labels.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("c"))
        main = groups.groupBy("comp").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("c"))
        blocks = lambda x: F.ceil(x / BLOCK).cast("int")
        main = materialize(main.where("n > c").select("comp", "main", "n", blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("c")).alias("rest")), "near-main")
        if main.isEmpty():
            return links
        own = join_counted(rows.join(labels.select("nid", "label"), "nid"), main, ["comp"], ["nid"])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = lambda n, seed: F.pmod(F.xxhash64("nid", F.lit(seed)), F.col(n)).cast("int")
        one = own.select("nid", "set", "comp", every("rest").alias("lo"), place("all", 1).alias("hi"))
        two = own.where("label <> main").select("nid", "set", "comp", place("rest", 2).alias("lo"), every("all").alias("hi"))
        return links.unionByName(in_blocks(one.unionByName(two)))

    def paired(short: DataFrame) -> DataFrame:
        """Links among the nodes (v, nid, n) that meet in short lists."""
        other = short.select("v", F.col("nid").alias("x"), F.col("n").alias("m"))
        fits = F.least("n", "m") * den >= F.greatest("n", "m") * num
        return verified(short.join(other, "v").where((F.col("nid") < F.col("x")) & fits).select(F.col("nid").alias("a"), F.col("x").alias("b")).distinct())

    lists = index.groupBy("v").agg(F.count(F.lit(1)).alias("all"))
    long = materialize(index.join(lists.where(F.col("all") > LIST_PAIRS).select("v"), "v").select("v", "nid"), "near-long")
    short = index.join(lists.where(F.col("all").between(2, LIST_PAIRS)).select("v"), "v")
    links = paired(short)
    if not long.isEmpty():
        links = links.unionByName(compared(long))
    labels = None if links.isEmpty() else components(links)
    comp = nodes.select("nid", "sig", "doc")
    comp = comp.withColumn("comp", F.col("nid")) if labels is None else comp.join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    comp = comp.select("sig", "doc", "comp")
    roots = comp.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = comp.join(roots, "comp").select(F.col("sig").alias("_sig"), "component_id")
    out = base.select("doc_id", "_key", "n", "sig").join(named, F.col("sig") == F.col("_sig"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(*["_key"] * with_key, "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
