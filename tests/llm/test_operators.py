"""Each operator against plain code, and with nulls, empty texts and tables, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netlens.llm import common, decontamination, lm_scoring, near_dedup, sentencepiece_codec, sharding, span_dedup, suffix_dedup, token_counts, topk_search, toxicity

#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, shard int, hash long, _key long, _text string, n long, score double, item_id string"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A b"), (None, "no id at all here"), (7, "same text twice " * 60), (7, "same text twice " * 60), (8, "same text twice " * 60), (9, "é ü ▁ 中文 \U0001f600 " * 5)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, 0.5, "z") for i, t in rows], CLASH)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 14))).capitalize() + rng.choice([". ", "! ", ".\n"])
    docs = [(i, "".join(sentence() for _ in range(rng.randint(1, 25)))) for i in range(120)]
    passage = "".join(sentence() for _ in range(12))
    for i in range(120, 140):
        docs.append((i, docs[i - 120][1] + passage + sentence()))
    for i in range(140, 150):
        own = docs[i - 120][1].split(" ")
        own[rng.randrange(len(own))] = "changed"
        docs.append((i, " ".join(own)))
    return docs + [(150, docs[0][1]), (151, None), (152, ""), (153, "one"), (154, "One"), (155, "two words")]


# ---------------------------------------------------------------- 1 language model


def test_lm_base_score_and_gain(spark, prose):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = {r.doc_id: r for r in lm_scoring.score_corpus(frame(spark, prose).repartition(3), crc % 10 == 0, F.floor(crc / 10) % 4 == 0).collect()}
    train = [d for d, _ in prose if zlib.crc32(str(d).encode()) % 10]
    tokens = {d: [*words(t), None] for d, t in prose}
    counts = Counter(w for d in train for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, own in tokens.items():
        r = got[d]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[w] > 0 for w in own), n, d not in train)
        assert math.isfinite(r.score)
    pairs, context = Counter(), Counter()
    for d in train:
        pairs.update(zip(["<", *tokens[d]], tokens[d], strict=False))
        context.update(["<", *tokens[d][:-1]])
    one = got[153]
    options = []
    for w0, w1, w2 in ((0, 1, 0), (1, 0, 0), (0, 0, 1)):
        options.append(sum(math.log10(max(1e-300, w0 * pairs[(a, b)] / max(1, context[a]) + w1 * counts[b] / n + w2 / (v + 1))) for a, b in zip(["<", "one"], ["one", None], strict=True)))
    assert min(options) <= one.score <= max(options)


def plain_lm(docs, held, deleted):
    """Scores of the mixture by counting words and pairs in dictionaries."""
    tokens = {d: [*words(t), None] for d, t in docs}

    def counts(part):
        word, pair, context = Counter(), Counter(), Counter()
        for d in part:
            word.update(tokens[d])
            pair.update(zip(["<", *tokens[d]], tokens[d], strict=False))
            context.update(["<", *tokens[d][:-1]])
        return word, pair, Counter({**word, "<": context["<"]}), sum(word.values()), len(word)

    def estimates(d, model):
        word, pair, context, n, v = model
        for a, b in zip(["<", *tokens[d]], tokens[d], strict=False):
            c = context[a]
            yield 0 if not c else min(23, 1 + int(math.log2(c))), pair[(a, b)] / max(1, c), word[b] / max(1, n), 1 / (v + 1)

    train = [d for d, _ in docs if d not in held]
    kept = counts([d for d in train if d not in deleted])
    grid = lambda x: round(math.log2(x) * lm_scoring.GRID) / lm_scoring.GRID if x > 0 else None
    seen = defaultdict(Counter)
    for d in deleted:
        for bucket, pair, word, base in estimates(d, kept):
            seen[bucket][grid(pair / base), grid(word / base)] += 1
    weights = []
    for bucket in range(24):
        if not seen[bucket]:
            weights.append(weights[-1] if bucket else lm_scoring.PRIOR)
            continue
        ratios = np.array([[0 if p is None else 2**p, 0 if w is None else 2**w, 1] for p, w in seen[bucket]])
        weights.append(lm_scoring.expectation_maximisation(ratios, np.array(list(seen[bucket].values()), float)))
    weights[0] = np.array([0, *(weights[0][1:] / weights[0][1:].sum())])
    whole = counts(train)
    return {d: sum(math.log10(weights[b] @ (p, w, u)) for b, p, w, u in estimates(d, whole)) for d, _ in docs}


def test_lm_score_against_plain_counts(spark, prose):
    docs = prose * 1 + [(1000 + i, prose[i][1]) for i in range(30)]
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 10 == 0}
    deleted = {d for d, _ in docs if zlib.crc32(str(d).encode()) // 10 % 4 == 0} - held
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = {r.doc_id: r.score for r in lm_scoring.score_corpus(frame(spark, docs).repartition(3), crc % 10 == 0, F.floor(crc / 10) % 4 == 0).collect()}
    assert got == pytest.approx(plain_lm(docs, held, deleted), rel=1e-6)


def test_lm_weights_find_the_better_estimate():
    ratios, weight = np.array([[100.0, 1.0, 1.0], [0.0, 50.0, 1.0]]), np.array([900.0, 100.0])
    w = lm_scoring.expectation_maximisation(ratios, weight)
    assert w.sum() == pytest.approx(1) and w[0] > 0.8
    likelihood = lambda m: (weight * np.log((ratios * m).sum(axis=1))).sum()
    assert all(likelihood(w) >= likelihood(np.array(m)) - 5 for m in ((0.5, 0.4, 0.1), (0.95, 0.04, 0.01), (0.7, 0.2, 0.1)))


def test_lm_edges(spark):
    rows = lm_scoring.score_corpus(frame(spark, EDGES), F.col("doc_id") == 4, F.col("doc_id") == 8).collect()
    assert len(rows) == len(EDGES) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    nothing = lm_scoring.score_corpus(frame(spark, EDGES), F.lit(True), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)}
    assert lm_scoring.score_corpus(frame(spark, []), F.lit(False), F.lit(False)).count() == 0


# ---------------------------------------------------------------- 2 SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.load()


def best_score(text, pieces):
    total = [0.0] + [-math.inf] * len(text)
    for i in range(1, len(text) + 1):
        for k in range(max(0, i - pieces.longest), i):
            known = pieces.scores.get(text[k:i])
            value = known[0] if known else pieces.worst if i - k == 1 else -math.inf
            total[i] = max(total[i], total[k] + value)
    return total[-1]


def id_score(ids, pieces):
    known, total, k = {v[1]: v[0] for v in pieces.scores.values()}, 0.0, 0
    while k < len(ids):
        if ids[k] in known:
            total, k = total + known[ids[k]], k + 1
        else:
            first = pieces.surface[ids[k]][0]
            total, k = total + pieces.worst, k + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
    return total


def test_viterbi_is_optimal_and_streams(pieces, prose):
    texts = [t for _, t in prose[:25]] + ["x" * 500, "中文 mixed 😀 text", "tabs\tand\r\nlines", "ends with spaces   ", "²³ 1st ½"]
    for text in texts:
        marked = "▁" + text.replace(" ", "▁")
        ids = list(sentencepiece_codec.encode(text, pieces))
        assert sentencepiece_codec.decode(np.array(ids), pieces) == text
        assert id_score(ids, pieces) == pytest.approx(best_score(marked, pieces))
        whole = [x for part in sentencepiece_codec.stream(marked, pieces) for x in part]
        chunks = [x for part in sentencepiece_codec.stream(iter([marked[k : k + 7] for k in range(0, len(marked), 7)]), pieces) for x in part]
        assert whole == chunks == ids
    assert len(list(sentencepiece_codec.stream("▁" + "word and " * 300, pieces))) > 10  # ids come before the end


def test_lanes_blocks_and_stream_agree(pieces, prose, monkeypatch):
    """Texts put together, cut into blocks, or searched one character after the other have the same ids."""
    texts = [t for _, t in prose] + ["▁ mark ▁▁", "a▁b", "\0 zero \0\0", "x" * 3000, "中文" * 400, " ", "ab " * 900]
    marked = lambda t: "▁" + sentencepiece_codec.marked(t)
    want = [[x for part in sentencepiece_codec.stream(marked(t), pieces) for x in part] if t else [] for t in texts]
    for block, text, lanes in ((1 << 18, 1 << 21, 512), (700, 1 << 21, 3), (100, 600, 512)):
        monkeypatch.setattr(sentencepiece_codec, "BLOCK_CHARS", block)
        monkeypatch.setattr(sentencepiece_codec, "TEXT_CHARS", text)
        monkeypatch.setattr(sentencepiece_codec, "LANES", lanes)
        ids, offsets = sentencepiece_codec.encode_many(texts, pieces)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
        raw, ends = sentencepiece_codec.decoded(ids, pieces)
        ends = np.append(0, ends)
        assert all(raw[ends[a] : ends[b]].tobytes().decode() == (" " + t if t else "") for t, a, b in zip(texts, offsets, offsets[1:], strict=False))


def test_lanes_commit_where_survivors_meet(pieces, prose):
    """Ids are committed by converging backpointers, every few words, and the window stays a few pieces wide."""
    text = " " + " ".join(t for _, t in prose if t)
    for lanes in (text, "".join(text.split(" "))[:20_000]):  # prose, and prose without a space
        codes, seen = pieces.trie.alphabet[np.frombuffer(lanes.encode("utf-32-le"), "<u4")], {}
        sentencepiece_codec._search(codes, pieces, seen)
        assert seen["commits"] > len(lanes) / 100 and seen["widest"] <= 12 * pieces.longest


def test_window_of_a_long_text_without_spaces(pieces):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    search, commits, ids = sentencepiece_codec.Stream(pieces), 0, 0
    for k in range(0, len(text), 4096):
        for part in search.feed(text[k : k + 4096]):
            commits, ids = commits + 1, ids + len(part)
    ids += sum(len(part) for part in search.feed("", final=True))
    assert commits > 10_000 and search.widest < 20 * pieces.longest and 200_000 < ids < 1_000_000


def test_codec_edges(spark):
    rows = sentencepiece_codec.encode_documents(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id: r.round_trip for r in rows}[1] is None and all(r.round_trip for r in rows if r.doc_id != 1)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in rows)
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(frame(spark, EDGES))).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in EDGES)
    assert sentencepiece_codec.encode_documents(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 3 toxicity


def test_folding():
    assert toxicity.fold("1d10t! СLОWN ｔｒａｓｈ m​oron").split() == ["idioti", "clown", "trash", "moron"]


def toxic_rows():
    rng = random.Random(3)
    plain = ["the", "house", "river", "walks", "slowly", "green", "table", "loses", "classic"]
    rows = []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "1diot", "IDIOT,", "zorkmid", "zorkbal"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    held = [(i, y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert lexicon.features("a clown fish by the trash can")[3] == 0


def test_toxicity_learns_exceptions(spark):
    """A pair of words that clean texts have around a toxic word is spared, without being given."""
    rng = random.Random(4)
    plain = ["the", "house", "river", "walks", "slowly", "green", "table"]
    rows = []
    for i in range(1200):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["zork", "Z0RK", "grumbo"])
        elif i % 4 == 1:
            text[rng.randrange(len(text))] = rng.choice(["zork fish", "grumbo bin"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels.where("doc_id % 5 <> 2"))
    assert {"zork fish", "grumbo bin"} <= set(lexicon.exceptions)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 2]
    assert np.mean([got[i] == y for i, y in held]) > 0.97
    assert lexicon.features("a zork fish by the river")[3] == 0 and lexicon.features("a zork by the river")[3] == 1


def test_toxicity_matching_against_plain_search():
    """Every place of every pattern, less those inside an exception, counted by find()."""
    rng = random.Random(8)
    words = ["ab", "abc", "bca", "cab", "b", "ca"]
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc ": 2.0, " ca": 0.5, " b ": 3.0}, ("abc cab", "b b"))
    for _ in range(300):
        text = rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        folded = toxicity.fold(text)
        spared = [(k, k + len(p)) for p in (" abc cab ", " b b ") for k in range(len(folded)) if folded.startswith(p, k)]
        found = [(k, k + len(p), w) for p, w in lexicon.weights.items() for k in range(len(folded)) if folded.startswith(p, k)]
        want = sorted(x for x in found if not any(a <= x[0] and x[1] <= b for a, b in spared))
        assert sorted(lexicon.matches(folded)) == want
        total = sum(w for _, _, w in want)
        assert lexicon.features(text) == pytest.approx((math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), math.log1p(len(folded.split())), len(want)))


def test_toxicity_exceptions_and_edges(spark):
    lexicon = toxicity.Lexicon({" clown ": 4.0, " trash": 3.0}, ("clown fish",))
    assert lexicon.features("The CL0WN ran")[3] == 1 and lexicon.features("a clown fish")[3] == 0
    rows = toxicity.score(frame(spark, EDGES).drop("score"), lexicon).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.learn(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(frame(spark, EDGES).drop("score"), none).collect()} == {0}
    assert toxicity.score(frame(spark, []).drop("score"), none).count() == 0


# ---------------------------------------------------------------- 4 suffix arrays


def removed(docs, length):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("letters, depth", [(1, 16), (2, 16), (4, 40), (26, 8)])
def test_two_stage_sort(letters, depth):
    rng = random.Random(letters)
    for _ in range(15):
        text = bytes(97 + rng.randrange(letters) for _ in range(rng.randint(1, 250)))
        text = np.frombuffer(text + text[5:60] + text[:30], np.uint8)
        wanted = np.array([rng.random() < 0.6 for _ in text])
        order, raw = suffix_dedup.sort_suffixes(text, wanted, depth), text.tobytes()
        assert sorted(order) == list(np.flatnonzero(wanted))
        assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in order)
        near = suffix_dedup.common_prefixes(text, order, depth)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            if same < min(len(a), len(b), depth):
                assert near[k] == same


@pytest.mark.parametrize("case", ["plain", "cut", "strings"])
def test_suffix_dedup(spark, prose, monkeypatch, case):
    if case == "cut":
        monkeypatch.setattr(suffix_dedup, "BIN_BYTES", 500)
    if case == "strings":
        monkeypatch.setattr(suffix_dedup, "SORTED_CONTEXTS", 3)
    docs = prose + [(d, t) for d, t in EDGES if d is not None and d > 6] + [(300, "ab" * 300)]
    got = suffix_dedup.suffix_dedup(frame(spark, docs), length=80, gram=24).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == removed(docs, 80)


@pytest.mark.parametrize("case", ["plain", "cut", "strings", "hot"])
def test_suffix_reports_shorter_repeats(spark, prose, monkeypatch, case):
    """n_repeated counts bytes of repeats of ``report`` bytes; what is removed stays that of ``length`` bytes."""
    if case == "cut":
        monkeypatch.setattr(suffix_dedup, "BIN_BYTES", 500)
    if case == "strings":
        monkeypatch.setattr(suffix_dedup, "SORTED_CONTEXTS", 3)
    if case == "hot":
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = prose + [(d, t) for d, t in EDGES if d is not None and d > 6] + [(300, "ab" * 300), (301, prose[120][1][-100:]), (302, prose[121][1][:70])]
    got = suffix_dedup.suffix_dedup(frame(spark, docs), length=80, gram=24, report=50).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == removed(docs, 80)
    reported = Counter((r.doc_id, r.n_repeated) for r in got)
    assert reported == Counter(eval(x)[:3:2] for x in removed(docs, 50))
    assert any(r.n_repeated > 0 == r.n_removed for r in got)


def test_suffix_edges(spark):
    got = suffix_dedup.suffix_dedup(frame(spark, EDGES), keep=["lang"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == removed(EDGES, 400)
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 near duplicates


def groups(docs, size=3, num=85, den=100):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = set(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("case", ["families", "template"])
def test_near_duplicates_of_large_clusters(spark, monkeypatch, case):
    """Families of near copies that share a passage, and texts of one template that are not linked, beyond one block."""
    monkeypatch.setattr(near_dedup, "LIST_PAIRS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = [word() for _ in range(150)]
    docs = []
    if case == "families":
        for family in range(3):
            own = passage + [word() for _ in range(60)]
            for _ in range((40, 25, 7)[family]):
                text = own[:]
                for _ in range(rng.randint(0, 6)):
                    text[rng.randrange(len(text))] = word()
                docs.append((len(docs), " ".join(text)))
    else:
        docs = [(i, " ".join([*passage, *(word() for _ in range(rng.choice([2, 25, 30])))])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == groups(docs)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates(spark, prose, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "LIST_PAIRS", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(140)]
    docs = list(prose)
    for i in range(200, 260):
        own = base[:]
        for _ in range(rng.randint(0, 10)):
            own[rng.randrange(140)] = f"w{rng.randrange(3000)}"
        docs.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == groups(docs)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    got = near_dedup.intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(40) for j in range(40) if i != j)


def test_near_edges(spark):
    rows = near_dedup.near_duplicates(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 7, 8: 7, 9: 9}
    left = near_dedup.drop_near_duplicates(frame(spark, EDGES))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 9])) and left.columns == frame(spark, []).columns[:5] + left.columns[5:]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0 and near_dedup.drop_near_duplicates(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 6 token counts


def test_separator_scan(spark):
    rng = random.Random(2)
    ids = [[rng.choice([9, 9, 0, 1, 2, 3]) for _ in range(n)] for n in (0, 1, 37, 200)]
    rows = [(k, b, np.array(x[b * 5 : b * 5 + 5], "<u2").tobytes()) for k, x in enumerate(ids) for b in range(-(-len(x) // 5))]
    rng.shuffle(rows)
    got = defaultdict(dict)
    for r in token_counts.count_tokens(spark.createDataFrame(rows, "file long, block int, tokens binary"), 9).collect():
        got[r.file][r.doc_no] = r.n_tokens
    for k, x in enumerate(ids):
        own, run = [], 0
        for t in x:
            if t == 9:
                own.append(run)
                run = 0
            else:
                run += 1
        own += [run] if run else []
        assert got[k] == dict(enumerate(own))


def test_flat_files(spark, tmp_path):
    np.array([5, 6, 2, 2, 7, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.count_tokens(token_counts.read_blocks(spark, str(tmp_path), block_tokens=2), 2).orderBy("doc_no").collect()
    assert [r.n_tokens for r in got] == [2, 0, 3]


def test_document_counts(spark, prose, pieces, monkeypatch):
    docs = prose + EDGES
    got = token_counts.document_token_counts(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), len(sentencepiece_codec.encode(t, pieces))) for d, t in docs)
    assert token_counts.document_token_counts(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 7 sharding


def test_sharding_law(spark):
    docs = frame(spark, [(1000 + i, f"text {i % 50}") for i in range(3000)] + EDGES)
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == 3000 + len(EDGES)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert 200 < sum(r.grown_shard == 8 for r in rows) < 480
    counts = Counter(r.shard for r in rows)
    assert min(counts.values()) > 280 and max(counts.values()) < 480
    by = {r.doc_id: r for r in rows}
    assert (by[1].size, by[1].text_crc32, by[2].size) == (1, 0, 1) and by[9].text_crc32 == zlib.crc32(EDGES[-1][1].encode())
    assert len({(r.doc_id, r.shard) for r in rows if r.doc_id == 7}) == 1
    again = sharding.shard_documents(docs.repartition(5), 8).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert sharding.shard_documents(frame(spark, []), 8).count() == 0


def test_movement_is_confined(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old = sharding.topology(8)
    new = [sharding.Leaf(x.shard, x.region, x.rack, x.weight, x.generation) for x in old] + [sharding.Leaf(8, 0, 1, 2.0, 1)]
    rows = keys.select(sharding.place(F.col("k"), old).alias("a"), sharding.place(F.col("k"), new).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {8} and 600 < len(moved) < 1000  # 2 of 10 parts
    gone = [x for x in new if x.shard != 3]
    rows = keys.select(sharding.place(F.col("k"), new).alias("a"), sharding.place(F.col("k"), gone).alias("b")).collect()
    assert all(r.a == r.b for r in rows if {x.shard: x.region for x in new}[r.a] != 0 and r.b // 4 != 0)


# ---------------------------------------------------------------- 8 sentence spans


def test_span_dedup(spark, prose):
    got = {r.doc_id: r for r in span_dedup.span_dedup(frame(spark, prose)).collect()}
    first = prose[120][1]
    assert got[0].n_removed == 0 and got[0].clean_text == prose[0][1]
    passage = first[len(prose[0][1]) :]
    for i in range(121, 140):
        own = prose[i][1]
        assert got[i].n_removed > 0 and len(got[i].clean_text) < len(own) - len(passage) // 2
    assert got[120].n_removed > 0 and len(got[120].clean_text) >= len(passage) // 2  # its own start stood in document 0
    assert got[150].n_removed > 0
    assert got[151].clean_text is None and got[152].clean_text == ""


def test_span_dedup_at_any_offset(spark):
    """Every repeated run of 50 words loses words wherever it stands, and no word that repeats in no run of 20 is lost."""
    rng = random.Random(3)
    fresh = iter(range(1 << 30))
    text = lambda n, ends: [f"w{next(fresh)}" + ("." if rng.random() < ends else "") for _ in range(n)]
    docs = []
    for ends in (0, 0.02, 0.08, 0.3):
        for length in (50, 55, 80, 200):
            passage = text(length, ends)
            for ahead in (0, 1, 2, 7, 13, 24, 25, 26, 40):
                docs.append((len(docs), [*text(ahead, ends), *passage, *text(rng.randint(0, 40), ends)], ahead))
    split = lambda own: "".join(w + rng.choice([" "] * 9 + ["\n"]) for w in own)
    got = {r.doc_id: r.clean_text for r in span_dedup.span_dedup(frame(spark, [(i, split(own)) for i, own, _ in docs])).collect()}
    runs = lambda own, n: [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]
    counts, seen = Counter(r for _, own, _ in docs for r in set(runs(own, 20))), set()
    for i, own, _ in docs:
        kept = set(got[i].split())
        for run in runs(own, 50):
            assert run not in seen or not kept.issuperset(run), (i, run)
        seen.update(runs(own, 50))
        lost = {w for r in runs(own, 20) if counts[r] > 1 for w in r}
        assert set(own) - kept <= lost
        assert [w for w in own if w in kept] == got[i].split()


def plain_pieces(data):
    """[start, end, first word, words, whether a sentence ends, whether words alone end it] of each piece of a text."""
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
    own = [lower(m[0].decode()).encode() for m in found]
    order = [int(common.SpanHash(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0]) for w in own]
    marks = [k == len(own) - 1 or w[-1:] in (b".", b"!", b"?") for k, w in enumerate(own)]
    ends = [m or b"\n" in data[found[k].end() : found[k + 1].start()] for k, m in enumerate(marks)]
    cuts = list(marks)
    for k in range(len(own) - 9):
        if not any(marks[k : k + 9]):
            least = min(range(k, k + 10), key=lambda j: (order[j], j))
            if least:
                cuts[least - 1] = True
    pieces, begin = [], 0
    for k in range(len(own)):
        if ends[k] or cuts[k]:
            pieces.append((found[begin].start(), found[k + 1].start() if k + 1 < len(own) else len(data), begin, own[begin : k + 1], ends[k], cuts[k]))
            begin = k + 1
    return pieces


def plain_span_dedup(docs):
    pieces = {i: plain_pieces((t or "").encode()) for i, t in docs}
    spans = defaultdict(list)
    for i, own in sorted(pieces.items()):
        for k in range(len(own)):
            for flag in (5, 4):
                if flag == 4 and k and not own[k - 1][4]:
                    continue
                for j in range(k, len(own)):
                    passage = [w for x in own[k : j + 1] for w in x[3]]
                    if own[j][flag] and len(passage) >= 20 and sum(x[flag] for x in own[k : j + 1]) >= 2:
                        spans[tuple(passage)].append((i, k, j))
                        break
        if own and not any(p[0] == i for places in spans.values() for p in places):
            spans[("whole text", *(w for x in own for w in x[3]))].append((i, 0, len(own) - 1))
    gone = defaultdict(set)
    for places in spans.values():
        for i, k, j in places:
            if (i, k) != min(p[:2] for p in places):
                gone[i].update(range(k, j + 1))
    clean = {}
    for i, text in docs:
        data = (text or "").encode()
        lead = data[: pieces[i][0][0]] if pieces[i] else data
        clean[i] = text and (lead + b"".join(data[x[0] : x[1]] for k, x in enumerate(pieces[i]) if k not in gone[i])).decode()
    return {i: (len(pieces[i]), len(gone[i]), clean[i]) for i, _ in docs}


def test_span_dedup_against_plain_code(spark, prose):
    rng = random.Random(11)
    endless = [re.sub(r"[.!\n]", "", t or "") for _, t in prose[100:140]]
    docs = prose + [(1000 + i, "".join(rng.choice(["", "one ", " more\n"])) + t) for i, t in enumerate(endless)]
    docs += [(2000, None), (2001, " \n "), (2002, "spam " * 120), (2003, "é ü 中文 A b\n" * 30)]
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.clean_text) for r in span_dedup.span_dedup(frame(spark, docs)).collect()}
    assert got == plain_span_dedup(docs)
    stage = corpus_pipeline.substring_dedup(spark, frame(spark, docs).select("doc_id", "text", "lang"), "")
    assert {r.doc_id: r.text for r in stage.collect()} == {i: clean for i, (_, _, clean) in got.items()}


def test_span_dedup_of_one_word_repeated(spark):
    rows = span_dedup.span_dedup(frame(spark, [(1, "spam " * 300), (2, "x " + "spam " * 90), (3, "ham eggs " * 200)])).collect()
    left = {r.doc_id: len(r.clean_text.split()) for r in rows}
    assert left[1] < 50 and left[2] < 25 and left[3] < 50


def test_span_dedup_tells_equal_hashes_apart(spark, prose, monkeypatch):
    """Where all spans have one 64-bit hash, only those of the same words are repeats."""
    plain = sorted(map(repr, span_dedup.span_dedup(frame(spark, prose)).collect()))

    class OneHash(common.SpanHash):
        def __call__(self, starts, ends):
            return np.full(len(starts), 5, np.uint64)

    monkeypatch.setattr(span_dedup, "token_hash", lambda words: OneHash(words | np.uint64(1)))
    assert sorted(map(repr, span_dedup.span_dedup(frame(spark, prose)).collect())) == plain


def test_span_dedup_of_short_texts(spark):
    docs = [(1, "Only a few words."), (2, "only  a few\nwords."), (3, "Only a few words. And more."), (4, "Only"), (5, "only")]
    left = {r.doc_id: r.clean_text.strip() for r in span_dedup.span_dedup(frame(spark, docs)).collect()}
    assert left == {1: "Only a few words.", 2: "", 3: "Only a few words. And more.", 4: "Only", 5: ""}


def test_span_dedup_with_hot_spans(spark, prose, monkeypatch):
    plain = sorted(map(repr, span_dedup.span_dedup(frame(spark, prose)).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    assert sorted(map(repr, span_dedup.span_dedup(frame(spark, prose)).collect())) == plain


def test_span_edges(spark):
    rows = span_dedup.span_dedup(frame(spark, EDGES), keep=["lang"]).collect()
    assert len(rows) == len(EDGES)
    seven = [r for r in rows if r.doc_id == 7]
    assert len(set(map(repr, seven))) == 1
    assert span_dedup.span_dedup(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 9 decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(docs, items, size=10):
    windows = defaultdict(set)
    for item, t in items:
        w = plain_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("join", [False, True])
def test_decontamination(spark, prose, join):
    items = [(1, prose[3][1]), (2, "two WORDS"), (10, " ".join(plain_words(prose[5][1])[:12]).upper()), (3, None), (4, "..."), (5, "é ü"), (6, prose[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = prose + EDGES
    got = decontamination.decontaminate(frame(spark, docs).drop("item_id"), bench, _force_join=join, keep=["lang"])
    assert sorted(repr(tuple(r)[:6]) for r in got.collect()) == contaminated(docs, items)
    by = {r.doc_id: r.clean_text for r in got.collect()}
    assert by[155] == "" and by[20] == dict(docs)[20] and by[1] == dict(prose)[1] or by[1] is None


def test_decontamination_by_join_compares_words(spark, monkeypatch):
    """Where all windows of a length have one hash, only those of the same words hit."""
    docs = [(1, " ".join(f"a{k}" for k in range(30))), (2, " ".join(f"b{k}" for k in range(30))), (3, "x, Y z"), (4, "x y y"), (5, None)]
    items = [(1, " ".join(f"A{k}" for k in range(5, 17))), (2, "X y z"), (3, " ".join(f"c{k}" for k in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "chain", lambda *parts: np.full(len(parts[0]), 7, np.uint64))
    got = decontamination.decontaminate(frame(spark, docs).drop("item_id"), bench, _force_join=True).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [(1, 12, 1), (2, 0, 0), (3, 3, 1), (4, 0, 0), (5, 0, 0)]


def test_decontamination_by_broadcast_compares_words(spark, monkeypatch):
    docs = [(1, " ".join(f"a{k}" for k in range(30))), (2, " ".join(f"b{k}" for k in range(30))), (3, "x, Y z"), (4, "x y y"), (5, None)]
    items = [(1, " ".join(f"A{k}" for k in range(5, 17))), (2, "X y z"), (3, " ".join(f"c{k}" for k in range(12))), (4, "x Y, Z")]
    windows = decontamination.build(items)
    for size, (keys, *rest) in windows.by_length.items():
        windows.by_length[size] = (np.full(len(keys), 7, np.uint64), *rest)
    monkeypatch.setattr(decontamination, "chain", lambda *parts: np.full(len(parts[0]), 7, np.uint64))
    data = [np.frombuffer((t or "").encode(), np.uint8) for _, t in docs]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    _, _, tokens, hit, named = decontamination.scan(np.concatenate(data), offsets, windows)
    assert [int(hit[a:b].sum()) for a, b in zip(tokens, tokens[1:], strict=False)] == [12, 0, 3, 0, 0]
    assert named == [{"1"}, set(), {"2", "4"}, set(), set()]
    assert windows.nbytes() < len(windows.blob) + sum(len(x[0]) for x in windows.by_length.values()) * (decontamination.WINDOW_BYTES + 8)


def test_decontamination_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.decontaminate(frame(spark, EDGES), empty).collect()
    assert len(rows) == len(EDGES) and not any(r.contaminated for r in rows)
    assert decontamination.decontaminate(frame(spark, []), empty).count() == 0


# ---------------------------------------------------------------- 10 exact search


@pytest.mark.parametrize("dims, common", [(64, 0), (20, 60), (3, 0)])
def test_topk(spark, dims, common):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(200, dims))
    vectors[:common] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(500, None), (None, [1.0] * dims)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).withColumn("rank", F.lit(2))
    got = defaultdict(list)
    for r in topk_search.topk_hamming(table, F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbor_id))
    bits = vectors > 0
    for q in (0, 50, 100, 150):
        assert got[q] == sorted((int((bits[q] != bits[i]).sum()), i) for i in range(200) if i != q)[:10]
    assert set(got) == {0, 50, 100, 150}


def test_topk_with_hot_segments(spark, monkeypatch):
    """Segment values that many codes share are dealt over parts; the answers stay, and the index is not shuffled again."""
    rng = np.random.default_rng(5)
    vectors = np.where(rng.random((300, 24)) < 0.15, 1.0, -1.0)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    search = lambda: sorted(map(tuple, topk_search.topk_hamming(table, F.col("vec_id") % 50 == 0, k=5, segment_bits=6).collect()))
    plain = search()
    monkeypatch.setattr(topk_search, "HOT_ROWS", 10)
    monkeypatch.setattr(topk_search, "HOT_KEYS", 1 << 40)
    assert search() == plain
    bits = vectors > 0
    for q in range(0, 300, 50):
        assert [(d, i) for a, _, i, d in plain if a == q] == sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300) if i != q)[:5]


def test_topk_edges(spark):
    few = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0]), (1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.topk_hamming(few, F.col("vec_id") == 0, k=5).collect())) == [(0, 1, 1, 0)]
    assert topk_search.topk_hamming(few.where("false"), F.lit(True)).count() == 0
