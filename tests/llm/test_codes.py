"""Fingerprints, fill-in-the-middle texts and vector codes against plain code, with odd rows and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm import fill_in_middle as fim
from netlens.llm import fingerprints as fp
from netlens.llm import vector_codes as vc
from netlens.llm.common import SpanHash

CLASH = "doc_id long, text string, n long, form string, digest string, h1 int, range int, guest int, k0 long, vector int, label string"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "Ab"), (None, "no id at all here"), (7, "same text twice " * 60), (7, "same text twice " * 60), (7, "other text of the id"), (8, "same text twice " * 60), (9, "é ü ▁ 中文 \U0001f600 " * 5)]
EDGES += [(10, "with <P> inside"), (11, "<S>"), (12, "x" * 3000), (13, "<P" + ">" * 3), (-4, "a negative id, and some more words"), (1 << 62, "a large id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "d", 2, 3, 4, 5, 6, "l") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200, 900])))) for k in range(90)]


# ---------------------------------------------------------------- 11 fingerprints


def plain_fingerprint(text):
    """Boundaries and signatures byte by byte, with the module's hashes."""
    data = np.frombuffer(text.encode(), np.uint8)
    n, block = len(data), 1
    while block * fp.CHUNKS < n:
        block *= 2
    parts = []
    for level in range(fp.LEVELS):
        width = block << level
        cuts, last = [], 0
        for at in range(1, n + 1):
            window = data[max(0, at - fp.WINDOW) : at]
            h = 0
            for v in fp._ROLL[window].tolist():
                h = (h * int(fp._BASE) + v) & 0xFFFFFFFF
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                h = (h ^ h >> shift) * factor & 0xFFFFFFFF
            h ^= h >> 16
            hit = h % width == 0 and at - last >= max(1, width // 4)
            if hit or at - last == 4 * width or at == n:
                cuts.append((last, at))
                last = at
        signs = [int(SpanHash(data)(np.array([min(a, max(0, b - fp.WINDOW))]), np.array([b]))[0]) >> 52 for a, b in cuts]
        parts.append("".join(chr(fp._DIGITS[s // 64]) + chr(fp._DIGITS[s % 64]) for s in signs))
    return f"{block}:" + ":".join(parts)


def test_fingerprints_equal_plain_code(spark, texts):
    rows = [(i, t) for i, t in texts if len(t) < 2500] + EDGES
    got = sorted(map(repr, map(tuple, fp.fingerprint_texts(frame(spark, rows).repartition(3)).collect())))
    assert got == sorted(repr((i, plain_fingerprint(t or ""))) for i, t in rows)


def test_edit_distance_and_likeness():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 90))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fp.edit_distance(a, b) == len(a) + len(b) - 2 * table[-1][-1]
    assert fp.likeness("1:::", "1:::") == 1.0
    assert fp.likeness("1:AAAB:AA:AA", "1:::") == 0.0
    assert fp.likeness("1:AAAB:AA:AC", "4:AC:AB:AB") == 1.0  # block size 4 is the one that both have
    assert fp.likeness("1:AAAB:AA:AA", "8:AA:AA:AA") == 0.0


def test_fingerprints_come_back_behind_an_edit(texts):
    def one(text):
        raw = text.encode()
        return fp.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    longer = [t for _, t in texts if len(t) > 800]
    for t, other in zip(longer[:-1], longer[1:], strict=True):
        at = len(t) // 2
        assert fp.likeness(one(t), one(t[:at] + "an insertion" + t[at:])) > 0.85
        assert fp.likeness(one(t), one(other)) < 0.15


def neighbours(rows):
    """Rows in descending order of ids, nulls last; rows of one id in any order that has equal rows side by side."""
    n = len(rows)
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % n][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, g, h = (plain_fingerprint(x) for x in (t, edited, after))
        out.append((i, len(t), edited, f, g, fp.likeness(f, g), fp.likeness(f, h)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours_equal_plain_code(spark, texts, parts):
    rows = [(i * 3, t) for i, t in texts if len(t) < 2500]
    got = fp.fingerprint_neighbours(frame(spark, rows).repartition(parts))
    want = neighbours(sorted(rows, reverse=True))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_neighbours_odd_rows(spark):
    got = [tuple(r) for r in fp.fingerprint_neighbours(frame(spark, EDGES).repartition(4)).collect()]
    assert sorted((repr(r[0]), r[1]) for r in got) == sorted((repr(i), len(t or "")) for i, t in EDGES)
    hashed = {t: h for t, h in frame(spark, EDGES).select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).collect()}
    order = sorted(EDGES, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1] or ""]))
    assert sorted(map(repr, got)) == sorted(map(repr, neighbours(order)))
    same = {r[3] for r in got if r[1] == 960}
    assert len(same) == 1  # equal texts have equal fingerprints
    assert fp.fingerprint_neighbours(frame(spark, [])).count() == 0
    (only,) = fp.fingerprint_neighbours(frame(spark, [(5, "one row alone")])).collect()
    assert only.edited == "one row" + "one ro" and only.near_next == 1.0


def test_one_id_of_many_rows_is_split(spark):
    rows = [(1, "x")] * 400 + [(2, f"text {k}") for k in range(100)]
    ranges = fp.in_descending_order(frame(spark, rows).repartition(8), "doc_id", "text").where("guest = 0").groupBy("range").count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 300
    assert fp.fingerprint_neighbours(frame(spark, rows).repartition(8)).count() == 500


# ---------------------------------------------------------------- 12 fill in the middle


def plain_fim(doc_id, text, seed):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, text = len(units), text or ""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 3, 64, fim.CHUNK_BYTES])
def test_fill_in_middle_equals_plain_code(spark, texts, chunk):
    rows = texts + EDGES + [(200 + k, "<" * k + "S>" + "<P" * k) for k in range(20)]
    for seed in (1, 2):
        made = fim.fill_in_middle(frame(spark, rows).repartition(3), seed=seed, chunk_bytes=chunk)
        made = made.select("*", fim.restore(F.col("output"), F.col("form")).alias("restored"))
        got = [tuple(r) for r in made.collect()]
        assert sorted(map(repr, got)) == sorted(repr((*plain_fim(i, t, seed), t or "")) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_only_owning_chunks_are_looked_at_again():
    raw = ("word, " * 5000).encode()
    chunks = fim.Chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 256)
    assert len(chunks.low) == math.ceil(len(raw) / 256) and int(chunks.totals()[0]) == 15000
    assert chunks.cut(0, (30, 12001), len(raw)) == [(60, 60), (24004, 24004)]
    assert chunks.rescanned == 2


def test_fill_in_middle_of_nothing_and_of_long_texts(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0
    long = "lorem ipsum, " * 250_000  # over three slices long
    (row,) = fim.fill_in_middle(frame(spark, [(3, long)])).collect()
    assert tuple(row) == plain_fim(3, long, 1)


# ---------------------------------------------------------------- 13 vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """Lloyd's rounds in integers, every distance computed."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[max(-vc.LARGEST, min(vc.LARGEST, math.floor(scale * c))) for c in v] for _, v, _ in kept]
    dims = len(x[0])
    cut = [(k * dims // parts, (k + 1) * dims // parts) for k in range(parts)]
    books = [[v[a:b] for v in x[:entries]] for a, b in cut]

    def assign():
        out = []
        for v in x:
            far = [min((sum((p - q) ** 2 for p, q in zip(v[a:b], e, strict=True)), j) for j, e in enumerate(book)) for (a, b), book in zip(cut, books, strict=True)]
            out.append(far)
        return out

    for _ in range(rounds):
        own = assign()
        for p, (a, b) in enumerate(cut):
            for j in range(len(books[p])):
                mine = [v[a:b] for v, o in zip(x, own, strict=True) if o[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = assign()
    totals = {}
    for (_, _, l), o in zip(kept, final, strict=True):
        totals[l] = totals.get(l, 0) + sum(d for d, _ in o)
    rows = [(i, l, "".join(f"{j:02x}" for _, j in o), sum(d for d, _ in o), totals[l]) for (i, _, l), o in zip(kept, final, strict=True)]
    return rows, books


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "c") for i, v, l in rows], "vec_id long, embedding array<double>, label int, error int, code string")


def equals_plain(spark, rows, parts=2, entries=4, rounds=6, scale=4096):
    coded, books = vc.encode_vectors(vectors(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds, scale=scale)
    got = [tuple(r) for r in vc.with_label_errors(coded).collect()]
    want, plain_books = plain_codes(rows, parts, entries, rounds, scale)
    assert [b.tolist() for b in books] == plain_books
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_codes_equal_plain_code(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(k % 3, 0.5) for _ in range(6)], k % 4 or None) for k in range(300)]
    equals_plain(spark, rows)
    equals_plain(spark, rows, parts=4, entries=16)  # parts of one or two components


def test_codes_of_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(k // 2, [float(rng.randint(-2, 2)) for _ in range(4)], 1) for k in range(200)] + [(7, [0.0] * 4, None)] * 100
    equals_plain(spark, rows, entries=16, scale=1)


def test_codes_of_odd_vectors(spark):
    good = [(5, [1.0, -1.0, 1e30, 2.0], 1), (None, [0.5, 0.25, -1e30, 0.0], None), (2, [-0.1, 0.1, 0.3, 9.0], 2)]
    odd = [(0, None, 1), (1, [1.0, None, 0.0, 0.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf"), 0.0, 0.0, 0.0], 1), (6, [1.0], 1), (8, [], 1)]
    coded, books = vc.encode_vectors(vectors(spark, good + odd), parts=2, entries=16)
    want, plain_books = plain_codes(good, 2, 16, 6, 4096)
    assert sorted(map(repr, map(tuple, vc.with_label_errors(coded).collect()))) == sorted(map(repr, want))
    assert [b.tolist() for b in books] == plain_books
    assert vc.codebooks_sha256(books) == hashlib.sha256(",".join(str(v) for b in plain_books for e in b for v in e).encode()).hexdigest()
    nothing, books = vc.encode_vectors(vectors(spark, odd[:4]))
    assert nothing.columns == ["vec_id", "label", "code", "error"] and nothing.count() == 0 and books == []
    assert vc.with_label_errors(nothing).count() == 0


def test_bounds_spare_distances():
    """Clustered points: most groups are never scanned after the first round, and the codes are those of a full search."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    books = [[x[:16].copy()]]
    groups = [vc.group_entries(books[0][0], 4)]
    seen = {}
    for _ in range(6):
        own, best = vc.Fit([(0, 8)], books, groups).assign(x, 0)
        full = ((x[:, None] - books[-1][0]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (best == full.min(1)).all()
        books.append([np.stack([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else books[-1][0][j] for j in range(16)])])
    vc.Fit([(0, 8)], books, groups).assign(x, 0, seen)
    assert seen["computed"] < 0.5 * seen["full"]


def test_squared_is_exact_for_large_components():
    x = np.array([[vc.LARGEST, -vc.LARGEST], [3, 4]], np.int64)
    assert vc.squared(x, -x).tolist() == [[sum((int(a) + int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in x] for p in x]


# ---------------------------------------------------------------- earlier operators


@pytest.mark.parametrize("kind, ids, names", [("string", [None, "b", "a"], ["null", "b", "a"]), ("boolean", [True, None, False], ["true", "null", "false"]), ("double", [1.0, 2.5, None], ["1.0", "2.5", "null"]), ("long", [3, 20, None], ["3", "20", "null"])])
def test_item_ids_of_any_kind_on_both_paths(spark, kind, ids, names):
    from netlens.llm.decontamination import decontaminate

    items = ["one two three four", "five six seven", "eight"]
    bench = spark.createDataFrame(list(zip(ids, items, strict=True)) + [(ids[1], None), (ids[0], "")], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["say one two three four, five six seven", "EIGHT!", "nothing", None])], "doc_id long, text string")
    for join in (False, True):
        got = {r.doc_id: r for r in decontaminate(docs, bench, _force_join=join).collect()}
        digest = lambda found: hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert [got[k].items_sha256 for k in range(4)] == [digest(names[:2]), digest(names[2:]), digest([]), digest([])], join
        assert [got[k].n_hit for k in range(4)] == [7, 1, 0, 0]


def test_sample_of_labels_is_bounded_by_rows(spark, monkeypatch):
    from netlens.llm import toxicity

    seen = []
    keep = toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    docs = spark.createDataFrame([(k % 40, f"text {k} {'bad' if k % 2 else 'good'} words") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(80)], "doc_id long, toxic int")
    toxicity.learn(docs, labels, sample_rows=35)
    assert seen[0].count() == 35


def test_results_win_over_kept_columns(spark):
    from netlens.llm import decontamination, span_dedup, toxicity

    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, score string, clean_text string")
    assert toxicity.score(docs, toxicity.Lexicon({})).columns == ["doc_id", "text", "clean_text", "score", "predicted", "n_matches"]
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    for join in (False, True):
        (row,) = decontamination.decontaminate(docs, bench, keep=["score", "clean_text"], _force_join=join).collect()
        assert (row.clean_text, row.score) == ("a  c", "x")
    assert span_dedup.span_dedup(docs, keep=["score", "clean_text"]).first().score == "x"
