"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import kept_columns, materialize

#: Labelled rows that the lexicon and its calibration are fitted on, at most: those of least hash of the id.
SAMPLE_ROWS = 12_000
#: Patterns that a lexicon has at most, the most telling first.
MAX_PATTERNS = 4_000
#: A learned pattern occurs in so many toxic texts at least, and so large a share of the texts that have it is toxic.
MIN_TEXTS, MIN_SHARE = 5, 0.85
#: A pattern is a candidate from this share on: exceptions may raise it.
LOOSE_SHARE = 0.3
#: A learned exception is a pair of words with a match in it that so many clean texts have at least, and of the texts that
#: have it at most this share is toxic.
EXCEPTION_TEXTS, EXCEPTION_SHARE = 3, 0.1
#: Exceptions that a lexicon learns at most, the most frequent first.
MAX_EXCEPTIONS = 1_000
#: Lengths of word beginnings that are tried as patterns, besides whole words.
PREFIXES = (4, 5, 6, 7, 8)

# Letters of other scripts, and digits and signs, that stand for a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {k: " " for k in range(128) if not chr(k).isalpha()}
    table |= {k: " " for k in (*range(0x2000, 0x200B), *range(0x2010, 0x2060), 0xA0, 0xAB, 0xBB, 0xBF, 0xA1, 0x3000, 0x3001, 0x3002)}
    table |= dict.fromkeys((0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF))  # invisible ones
    table |= {0xFF21 + k: chr(ord("a") + k) for k in range(26)} | {0xFF41 + k: chr(ord("a") + k) for k in range(26)}
    table |= {ord(a): b for a, b in {**HOMOGLYPHS, **SUBSTITUTES}.items()}
    return table


FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Lower case, homoglyphs and digit substitutions as Latin letters, all else but letters as one space each; a space at
    either end.  Composed accents stay letters of their own."""
    text = (text or "").lower()
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return f" {text.translate(FOLD)} "


def candidates(folded: str) -> set[str]:
    """Patterns that a text has: beginnings of words (with the space before) and whole words."""
    found = set()
    for word in set(folded.split()):
        size = len(word)
        found.update(f" {word[:k]}" for k in PREFIXES if k <= size)
        found.add(f" {word} ")
    return found


@dataclass
class Lexicon:
    """Patterns with weights over folded text, exception phrases, and the calibration of a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-4.0, 2.0, 2.0, 0.0)
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_machine": None}

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                machine.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                folded = " " + " ".join(fold(phrase).split()) + " "
                if folded not in self.weights:
                    machine.add_word(folded, (len(folded), None))
            if len(machine):
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every pattern outside the exception phrases."""
        if not len(self.machine):
            return []
        found, spared = [], []
        for last, (size, weight) in self.machine.iter(folded):
            span = (last + 1 - size, last + 1)
            if weight is None:
                spared.append(span)
            else:
                found.append((*span, weight))
        if spared:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in spared)]
        return found

    def contexts(self, folded: str) -> set[tuple[str, str]]:
        """(pattern, pair of words) of every match: with the word before and with the word behind."""
        out = set()
        text = folded.rstrip() + " "
        for a, b, _ in self.matches(text):
            last = text.find(" ", max(b - 1, a + 1))  # the space behind the matched word
            before, behind = text[:a].rsplit(" ", 1)[-1] if a else "", text[last + 1 : text.find(" ", last + 1)] if last + 1 < len(text) else ""
            word = text[a + 1 : last]
            out.update((text[a:b], pair) for pair in (f"{before} {word}" if before else "", f"{word} {behind}" if behind else "") if pair)
        return out

    def features(self, text: str | None) -> tuple[float, float, float, int]:
        """(log of the total weight, log of the weight per 100 words, log of the words, matches)."""
        folded = fold(text)
        found = self.matches(folded)
        words = len(folded.split())
        total = sum(x[2] for x in found)
        return float(np.log1p(total)), float(np.log1p(100 * total / max(words, 1))), float(np.log1p(words)), len(found)

    def probability(self, features: tuple[float, float, float, int]) -> float:
        a, b, c, d = self.coefficients
        if not features[3]:  # without a match the length alone says nothing
            return float(1 / (1 + np.exp(-min(a, 0.0))))
        return float(1 / (1 + np.exp(-(a + b * features[0] + c * features[1] + d * features[2]))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 40) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _prune(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds weights of the telling patterns; a pattern that begins with a kept one adds nothing and goes."""
    kept: dict[str, float] = {}
    for pattern, t, c in sorted(counts, key=lambda x: (len(x[0].rstrip()), x[0])):
        if not any(pattern[:k] in kept for k in range(2, len(pattern))):
            kept[pattern] = float(np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5)))
    return {k: w for k, w in kept.items() if w > 0}


def _by_label(sample: DataFrame, found, columns: str) -> DataFrame:
    """(``columns``, t, c): toxic and clean texts of ``sample`` that have each of what ``found`` sees in a folded text."""
    names = columns.split(", ")

    def emit(seen: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for label, counter in seen.items():
            n = list(counter.values())
            zero = [0] * len(n)
            keys = [k if isinstance(k, tuple) else (k,) for k in counter]
            yield pa.RecordBatch.from_arrays([*[pa.array([k[j] for k in keys], pa.string()) for j in range(len(names))], pa.array(n if label else zero, pa.int64()), pa.array(zero if label else n, pa.int64())], names=[*names, "t", "c"])
            counter.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("_text"), batch.column("_toxic"), strict=True):
                seen[label.as_py()].update(found(fold(text.as_py())))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield from emit(seen)
            yield from emit(seen)

    rows = sample.mapInArrow(count, ", ".join(f"{c} string" for c in names) + ", t long, c long")
    return rows.groupBy(*names).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit a lexicon on a bounded sample of the labelled rows (``sample_rows``, by least hash of the id, so the same rows
    on every run; an id that repeats counts as one row).  Two thirds of the sample choose and weigh patterns, the rest calibrates the score.

    Patterns that many toxic texts have are candidates.  Pairs of words around their matches that clean texts have and toxic
    ones hardly ever do become exceptions, beside those given; then the matches outside exceptions are counted anew, and
    the patterns whose texts are toxic by ``MIN_SHARE`` or more stay.

    Without labels of both kinds the lexicon is empty and every score is the base rate (0 without any label).
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
        .withColumn("_h", F.xxhash64("_id"))
        .orderBy("_h", "_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # an id that repeats gives one text, that of least hash, so the sample has as many rows as ids at most
    one = texts.groupBy("_id").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"), F.first("_toxic").alias("_toxic"), F.first("_h").alias("_h"))
    sample = materialize(one.select("_text", "_toxic", (F.pmod(F.shiftright("_h", 7), F.lit(3)) == 0).alias("_second")), "toxicity-sample")
    sizes = {(r["_second"], r["_toxic"]): r["count"] for r in sample.groupBy("_second", "_toxic").count().collect()}
    toxic, clean = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    if not toxic or not clean:
        share = sum(n for (_, t), n in sizes.items() if t) / max(1, sum(sizes.values()))
        return Lexicon({}, exceptions, (float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0.0, 0.0, 0.0))

    first = sample.where("NOT _second")
    counts = _by_label(first, candidates, "pattern")
    loose = counts.where((F.col("t") >= MIN_TEXTS) & (F.col("t") >= LOOSE_SHARE * (F.col("t") + F.col("c"))))
    rows = loose.orderBy(F.desc("t"), "pattern").limit(MAX_PATTERNS).collect()
    every = Lexicon({r["pattern"]: 1.0 for r in rows})
    pairs = _by_label(first, every.contexts, "pattern, pair").where((F.col("c") >= EXCEPTION_TEXTS) & (F.col("t") <= EXCEPTION_SHARE * (F.col("t") + F.col("c"))))
    harmless = pairs.groupBy("pair").agg(F.max("c").alias("c")).orderBy(F.desc("c"), "pair").limit(MAX_EXCEPTIONS).collect()
    every.exceptions = (*exceptions, *(r["pair"] for r in harmless))
    every._machine = None

    def outside(folded: str) -> set[str]:
        return {folded[a:b] for a, b, _ in every.matches(folded)}

    telling = _by_label(first, outside, "pattern").where((F.col("t") >= MIN_TEXTS) & (F.col("t") >= MIN_SHARE * (F.col("t") + F.col("c")))).orderBy("pattern").collect()
    lexicon = Lexicon(_prune([(r["pattern"], r["t"], r["c"]) for r in telling], toxic, clean))
    lexicon.exceptions = tuple(x for x in every.exceptions if x in exceptions or any(f" {x} ".find(p) >= 0 for p in lexicon.weights))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.float64()) for k in range(4)] + [batch.column("_toxic")], names=["a", "b", "c", "n", "y"])

    fitted = sample.where("_second").mapInArrow(describe, "a double, b double, c double, n double, y int").toPandas()  # at most sample_rows rows of five numbers
    if fitted["y"].nunique() == 2:
        hit = fitted[fitted["n"] > 0]
        base = max(1e-3, float(fitted[fitted["n"] == 0]["y"].mean() if (fitted["n"] == 0).any() else 0.01))
        # texts without a match anchor the constant: they must come out at their own rate
        x = np.column_stack([np.ones(len(fitted)), fitted["a"], fitted["b"], fitted["c"] * (fitted["n"] > 0)])
        w = _logistic(x, fitted["y"].to_numpy(float))
        w[0] = min(w[0], np.log(base / (1 - base))) if not len(hit) else w[0]
        lexicon.coefficients = tuple(map(float, w))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns in ``keep`` (all by default; not those that are called like a result), and score (0 to 1), predicted (1 from ``threshold`` up), n_matches.

    One pass over the partitions, no shuffle; the lexicon that is broadcast has ``MAX_PATTERNS`` patterns at most.
    A null or empty text has no match and gets the score of such texts; repeated rows score alike.
    """
    keep = kept_columns(docs.columns if keep is None else keep, ["score", "predicted", "n_matches"])
    source = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep], F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = [shared.value.features(t.as_py()) for t in part.column("_text")]
                p = [shared.value.probability(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f"_keep_{c}") for c in keep], pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([x[3] for x in found], pa.int32())],
                    names=[*keep, "score", "predicted", "n_matches"],
                )

    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*[f"`{c}` {types[f'_keep_{c}']}" for c in keep], "score double, predicted int, n_matches int"]))
