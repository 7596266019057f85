"""The corpus pipeline stage by stage, and the registered names."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from netlens.llm import queries

DATA = "/root/testdata/sf0.001"
#: With enough toxic documents to learn from.
LARGER = "/root/testdata/sf0.01"


def test_names():
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.queries() if k.startswith("op")} and "pipeline" in known
    assert set(queries.oracle_sql()) <= set(known)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= n, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        assert docs.where("n_chars <> length(text)").count() == 0
        n = left
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert tokens.count() == n and tokens.where("NOT round_trip").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_with_columns_of_any_name(spark):
    """Columns that are called like the operators' own results and helpers go through every stage unchanged."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "n_matches", "_k", "_id", "_key", "_text", "n_spans", "clean_text", "n_words", "contaminated", "n_items", "kept", "component_id", "_keep_lang", "hash", "with.dot", "_aside_1"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("*", *[F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")).alias(c) for c in names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        wrong = [F.col(f"`{c}`") != F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")) for c in names]
        assert docs.where(F.array_contains(F.array(*wrong), True)).count() == 0, name
        assert docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where("NOT round_trip").count() == 0


def test_stages_against_plain_code(spark, tmp_path):
    """Near duplicates, benchmark words and ids of the stages on a small table, compared row by row."""
    import random
    import re

    from netlens.llm import sentencepiece_codec

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, docs[i][1].upper()) for i in range(0, 30, 3)] + [(200, None), (201, "")]
    for i in range(5):
        own = docs[i + 20][1].split()
        own[len(own) // 2 : len(own) // 2 + 1] = ["other"]
        docs.append((300 + i, " ".join(own)))
    items = [(7, " ".join(docs[40][1].split()[5:20])), (8, "w1, W2; w3")]
    docs.append((400, f"Start. {items[0][1].upper()}! And W1 w2 W3 end"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = corpus_pipeline.near_dedup(spark, table, str(tmp_path))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i)

    def clean(text):
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))
        own, hit = [m[0] for m in found], set()
        for _, item in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower())
            n = min(10, len(w))
            for k in range(len(own) - n + 1):
                if any(own[k : k + n] == w[j : j + n] for j in range(len(w) - n + 1)):
                    hit.update(range(k, k + n))
        out, at = "", 0
        for k, m in enumerate(found):
            if k in hit and k - 1 not in hit:
                out += text[at : m.start()]
            if k in hit:
                at = m.end()
        return text if text is None else out + text[at:]

    cleaned = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, table, str(tmp_path)).collect()}
    assert cleaned == {i: clean(t) for i, t in docs} and cleaned[400] == "Start. ! And  end"
    pieces = sentencepiece_codec.load()
    ids = {r.doc_id: r.ids for r in corpus_pipeline.tokens(spark, table, str(tmp_path)).collect()}
    assert ids == {i: sentencepiece_codec.encode(t, pieces).tolist() for i, t in docs}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_toxicity_stage_against_plain_search(spark):
    """Scores, decisions and the stage's documents, from find() over every pattern and the fitted coefficients."""
    import math
    import zlib

    from netlens.llm import toxicity

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    train = labels[[zlib.crc32(str(i).encode()) % 3 != 1 for i in labels["doc_id"]]]
    lexicon = toxicity.learn(docs, spark.createDataFrame(train))
    phrases = [" " + " ".join(toxicity.fold(p).split()) + " " for p in lexicon.exceptions]

    def places(text, part):
        return [k for k in range(len(text) - len(part) + 1) if text.startswith(part, k)] if part in text else []

    def plain(text):
        folded = toxicity.fold(text)
        spared = [(k, k + len(p)) for p in phrases for k in places(folded, p)]
        weights = [w for p, w in lexicon.weights.items() for k in places(folded, p) if not any(a <= k and k + len(p) <= b for a, b in spared)]
        a, b, c, d = lexicon.coefficients
        if not weights:
            return 1 / (1 + math.exp(-min(a, 0.0)))
        words, total = len(folded.split()), sum(weights)
        return 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(100 * total / max(words, 1)) + d * math.log1p(words))))

    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert lexicon.weights and {i: r.score for i, r in got.items()} == pytest.approx(want)
    assert {i: r.predicted for i, r in got.items()} == {i: int(p >= 0.7) for i, p in want.items()}
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, LARGER).collect()}
    assert kept == {i for i, p in want.items() if p < 0.7} and len(kept) < len(want)
