"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

The corpus is cut into slices of about a million tokens.  A slice holds its words once, as hashes, and its tokens as
places in that list, and it asks for the count of each different word and word pair once.  The questions are dealt by
hash to groups that add up the counts of all slices and answer each; so a pair that fills the corpus is one question a
slice, and no count table is ever broadcast or held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import LOWER, SPACE_WORDS, SpanHash, chain, discard, materialize, partitions, slices, word_spans

#: Tokens of a slice, about, and different keys that one group adds up, about.
SLICE_TOKENS, GROUP_KEYS = 1_000_000, 2_000_000
#: Additive constant of the base model.
BASE_ADD = 0.1
#: Context-frequency buckets: 0 for a context never seen, then one for each power of two, the last open.
BUCKETS = 24
#: Weights of pair, word and uniform estimates where held-out counts say nothing, and how many tokens they weigh.
PRIOR, PRIOR_TOKENS = np.array([0.5, 0.4, 0.1]), 5.0
#: Steps of the grid on which held-out likelihood ratios are counted, per factor of two.
GRID = 4
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
KEEP, DELETED, UNSEEN = 0, 1, 2


def _blob(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unblob(x: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to slices; a slice has documents of the deleted part only, or none of them."""
    serial = TaskContext.get().partitionId() << 32
    for batch in batches:
        roles = batch.column("role").to_numpy(zero_copy_only=False)
        for deleted in (False, True):
            rows = np.flatnonzero((roles == DELETED) == deleted)
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            own, pending, first, held = roles[rows], [], 0, 0
            for low, high, data, offsets in slices(part.column("text")):
                starts, ends, tokens = word_spans(data, offsets, SPACE_WORDS)
                words = np.insert(SpanHash(LOWER[data])(starts, ends), tokens[1:], _END)
                pending.append((words, np.diff(tokens) + 1))
                held += len(words)
                if held >= SLICE_TOKENS or high == len(rows):
                    words, sizes = (np.concatenate(x) for x in zip(*pending, strict=True))
                    vocab, places, counts = np.unique(words, return_inverse=True, return_counts=True)
                    order = np.argsort(-counts, kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    ids = part.column("doc_id").slice(first, high - first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([serial], pa.int64()),
                            pa.array([deleted]),
                            pa.ListArray.from_arrays(pa.array([0, high - first], pa.int32()), ids),
                            pa.array([own[first:high].tolist()], pa.list_(pa.int32())),
                            pa.array([sizes.tolist()], pa.list_(pa.int64())),
                            pa.array([_blob(vocab[order])], pa.binary()),
                            pa.array([len(vocab)], pa.int64()),
                            pa.array([_blob(rank[places].astype("<u4"))], pa.binary()),
                            pa.array([len(words)], pa.int64()),
                            pa.array([int(sizes[own[first:high] != UNSEEN].sum())], pa.int64()),
                        ],
                        names=["slice", "deleted", "doc_ids", "roles", "sizes", "vocab", "n_vocab", "tokens", "n_tokens", "n_train"],
                    )
                    serial += 1
                    pending, first, held = [], high, 0


class _Slice:
    """A slice unpacked: its words (the last one begins every document), pairs, and which tokens count as training."""

    def __init__(self, row: dict):
        vocab = _unblob(row["vocab"], "<u8", row["n_vocab"])
        self.words = np.append(vocab, _BEGIN)
        self.token = _unblob(row["tokens"], "<u4", row["n_tokens"]).astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[first] = len(vocab)
        learn = np.array(row["roles"]) != UNSEEN
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.learn = learn[self.doc]
        self.n_begin = int(learn.sum())
        pairs, self.pair = np.unique(self.before * len(self.words) + self.token, return_inverse=True)
        self.pair_hash = chain(self.words[pairs // len(self.words)], self.words[pairs % len(self.words)])

    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, order, sorted hashes, training counts in that order) of words and of pairs."""
        words = np.bincount(self.token[self.learn], minlength=len(self.words))
        words[-1] = self.n_begin
        for kind, hashes, counts in ((1, self.words, words), (2, self.pair_hash, np.bincount(self.pair[self.learn], minlength=len(self.pair_hash)))):
            order = np.argsort(hashes)
            yield kind, order, hashes[order], counts[order]


def _ask(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, _, hashes, counts in _Slice(row).keys():
                    edges = np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32), np.arange(groups + 1))
                    cut = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(cut), pa.int32()),
                            pa.array([k for k, _, _ in cut], pa.int32()),
                            pa.array([row["slice"]] * len(cut), pa.int64()),
                            pa.array([row["deleted"]] * len(cut)),
                            pa.array([hashes[a:b].tobytes() for _, a, b in cut], pa.binary()),
                            pa.array([_blob(counts[a:b].astype("<u8")) for _, a, b in cut], pa.binary()),
                        ],
                        names=["kind", "part", "slice", "deleted", "hashes", "counts"],
                    )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Counts of one group's keys over all slices, given back to each slice in its own order."""
    hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    sizes = [len(x) for x in hashes]
    counts = [_unblob(x, "<u8", n).astype(np.int64) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]
    deleted = table.column("deleted").to_pylist()
    keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total, kept = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at = 0
    for n, own, gone in zip(sizes, counts, deleted, strict=True):
        total[place[at : at + n]] += own  # a slice has each key once
        if not gone:
            kept[place[at : at + n]] += own
        at += n
    word = table.column("kind")[0].as_py() == 1
    seen = [int((x > 0).sum()) - int((x[keys == _BEGIN] > 0).any()) if word else 0 for x in (total, kept)]
    out, at = {"all": [], "kept": []}, 0
    for n, gone in zip(sizes, deleted, strict=True):
        out["all"].append(_blob(total[place[at : at + n]]))
        out["kept"].append(_blob(kept[place[at : at + n]]) if gone else None)
        at += n
    rest = [0] * (len(sizes) - 1)
    return pa.table(
        {
            "slice": table.column("slice"),
            "kind": table.column("kind"),
            "part": table.column("part"),
            "size": pa.array(sizes, pa.int64()),
            "all": pa.array(out["all"], pa.binary()),
            "kept": pa.array(out["kept"], pa.binary()),
            "seen": pa.array([seen[0], *rest], pa.int64()),
            "seen_kept": pa.array([seen[1], *rest], pa.int64()),
        }
    )


def _counts(own: _Slice, answers: pa.Table, column: str) -> dict[int, np.ndarray]:
    rows = sorted(answers.select(["kind", "part", "size", column]).to_pylist(), key=lambda x: (x["kind"], x["part"]))
    found = {}
    for kind, order, _, _ in own.keys():
        values = np.concatenate([_unblob(x[column], "<i8", x["size"]) for x in rows if x["kind"] == kind])
        found[kind] = np.empty(len(order), np.int64)
        found[kind][order] = values
    return found


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


def _estimates(own: _Slice, counts: dict[int, np.ndarray], n: int, v: int) -> tuple[np.ndarray, ...]:
    """(bucket, pair, word and uniform estimate, word count) of every token."""
    context, word = counts[1][own.before], counts[1][own.token]
    pair = counts[2][own.pair] / np.maximum(context, 1)
    return bucket(context), pair, word / max(n, 1), np.full(len(word), 1.0 / (v + 1)), word


def expectation_maximisation(ratios: np.ndarray, weight: np.ndarray, steps: int = 200) -> np.ndarray:
    """Mixture weights that make held-out tokens likeliest.  ratios: a row for each kind of token, its three estimates up
    to a factor; weight: how many tokens are of that kind."""
    mixture = PRIOR.copy()
    for _ in range(steps):
        share = ratios * mixture
        share /= share.sum(axis=1, keepdims=True)
        after = (share * weight[:, None]).sum(axis=0) + PRIOR * PRIOR_TOKENS
        after /= after.sum()
        if np.abs(after - mixture).max() < 1e-7:
            return after
        mixture = after
    return mixture


def learn_weights(histogram: pd.DataFrame) -> np.ndarray:
    """Weights by bucket (rows) of the pair, word and uniform estimates, from held-out counts on a grid of ratios."""
    weights = np.tile(PRIOR, (BUCKETS, 1))
    for b in range(BUCKETS):
        own = histogram[histogram["bucket"] == b]
        if not len(own):
            weights[b] = weights[b - 1] if b else PRIOR
            continue
        ratio = np.ones((len(own), 3))
        for k, name in enumerate(("pair", "word")):
            step = own[name].to_numpy()
            ratio[:, k] = np.where(step == _NEVER, 0.0, np.exp2(step / GRID))
        weights[b] = expectation_maximisation(ratio, own["n"].to_numpy(float))
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]  # nothing follows a context never seen
    return weights


_NEVER = -(10**6)


def _grid(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.rint(np.log2(np.maximum(x, 1e-300)) * GRID), _NEVER).astype(np.int64)


def score_corpus(docs: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole text under a model learned from the rows that are not ``held_out``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; every text ends with one end token.  The model mixes three
    maximum-likelihood estimates: of the word after its predecessor, of the word, and uniform over the vocabulary and
    one unknown.  The weights depend on how often the predecessor occurs (by powers of two).  They come from expectation
    maximisation on the training rows that ``deleted`` names, whose counts are taken out for that step; the scores use
    the counts of all training rows.  Held-out ratios are counted on a grid of fixed size, which alone reaches the driver:
    ``GRID`` steps a factor of two, so each ratio is off by 2 ** (1 / 8), 9 %, at most while the weights are learned.

    Returns doc_id, held_out, n_tokens, n_known (tokens whose word occurs in training), train_tokens, base_score (an
    additive unigram model) and score.  A null text counts as empty: one end token.  A row whose ``held_out`` is null is
    held out.  Repeated rows all count and score alike; without training rows n_known is 0 and all words are unknown.
    """
    spark = docs.sparkSession
    unseen = F.coalesce(held_out, F.lit(True))
    role = F.when(unseen, UNSEEN).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(KEEP)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), role.alias("role"))
    kind = dict(source.dtypes)["doc_id"]
    schema = f"slice long, deleted boolean, doc_ids array<{kind}>, roles array<int>, sizes array<long>, vocab binary, n_vocab long, tokens binary, n_tokens long, n_train long"
    encoded = materialize(source.mapInArrow(_encode, schema), "lm-slices")
    sizes = encoded.groupBy("deleted").agg(F.sum("n_train").alias("train"), F.sum("n_tokens").alias("all")).collect()
    n = sum(r["train"] for r in sizes)
    n_kept = sum(r["train"] for r in sizes if not r["deleted"])
    groups = max(partitions(spark), -(-sum(r["all"] for r in sizes) // GROUP_KEYS))
    asked = encoded.mapInArrow(_ask(groups), "kind int, part int, slice long, deleted boolean, hashes binary, counts binary")
    answered = asked.groupBy("kind", "part").applyInArrow(_answer, "slice long, kind int, part int, size long, all binary, kept binary, seen long, seen_kept long")
    answered = materialize(answered, "lm-counts")
    v, v_kept = (int(x or 0) for x in answered.agg(F.sum("seen"), F.sum("seen_kept")).first())

    def ratios(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Slice(left.to_pylist()[0])
        b, pair, word, base, _ = _estimates(own, _counts(own, right, "kept"), n_kept, v_kept)
        kinds, counts = np.unique(np.stack([b, _grid(pair / base), _grid(word / base)]), axis=1, return_counts=True)
        return pa.table({"bucket": kinds[0], "pair": kinds[1], "word": kinds[2], "n": counts.astype(np.int64)})

    gone = encoded.where("deleted").groupBy("slice").cogroup(answered.where("kept IS NOT NULL").groupBy("slice"))
    seen = gone.applyInArrow(ratios, "bucket long, pair long, word long, n long").groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))
    weights = learn_weights(seen.toPandas())

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Slice(left.to_pylist()[0])
        b, pair, word, base, count = _estimates(own, _counts(own, right, "all"), n, v)
        w = weights[b]
        model = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] * base)
        plain = np.log10((count + BASE_ADD) / (n + BASE_ADD * (v + 1)))
        size = len(own.sizes)
        return pa.table(
            {
                "doc_id": left.column("doc_ids").combine_chunks().flatten(),
                "held_out": pa.array(np.array(left.column("roles")[0].as_py()) == UNSEEN),
                "n_tokens": pa.array(own.sizes),
                "n_known": pa.array(np.bincount(own.doc, count > 0, size).astype(np.int64)),
                "train_tokens": pa.array(np.full(size, n, np.int64)),
                "base_score": pa.array(np.bincount(own.doc, plain, size)),
                "score": pa.array(np.bincount(own.doc, model, size)),
            }
        )

    both = encoded.groupBy("slice").cogroup(answered.groupBy("slice"))
    return both.applyInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


__all__ = ["bucket", "discard", "expectation_maximisation", "learn_weights", "score_corpus"]
