"""DuckDB SQL of the operators that SQL can express, by brute force over whole tables."""

from __future__ import annotations

from netlens.llm.sharding import Leaf, topology

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words between white space, and words of letters, digits and what is not ASCII.
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+')"
PLAIN_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _crc_table() -> list[int]:
    """Table of CRC-32, from its polynomial."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = 0xEDB88320 ^ (k >> 1) if k & 1 else k >> 1
        out.append(k)
    return out


def crc32(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


#: Sign codes compared bit by bit.
OP10_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

#: Every pair of texts that share a shingle, and links followed as far as they reach.
OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, COUNT(*) AS shared FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""

#: Every window of words as text.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {PLAIN_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS v FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON iw.n = dw.n AND iw.v = dw.v),
hits AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
items AS (SELECT doc_id, COUNT(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def _clock(name: str, weight: float) -> str:
    return f"(-ln((CAST('0x' || substr(md5('{name}/' || k), 1, 13) AS BIGINT) + 1.0) / 4503599627370496.0) / {weight})"


def place(leaves: list[Leaf]) -> str:
    """The shard of key ``k``: at each level the child of the least clock, as nested CASE."""
    names = [lambda x: f"region{x.region}.{x.generation}", lambda x: f"rack{x.region}-{x.rack}.{x.generation}", lambda x: f"shard{x.shard}"]

    def level(nodes: list[Leaf], depth: int) -> str:
        if depth == len(names):
            return str(nodes[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for x in nodes:
            groups.setdefault(names[depth](x), []).append(x)
        if len(groups) == 1:
            return level(nodes, depth + 1)
        clocks = {name: _clock(name, sum(x.weight for x in own)) for name, own in sorted(groups.items())}
        least = f"least({', '.join(clocks.values())})"
        return "CASE " + " ".join(f"WHEN {clock} = {least} THEN {level(groups[name], depth + 1)}" for name, clock in clocks.items()) + " END"

    return f"CAST({level(leaves, 0)} AS INTEGER)"


OP7_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
p AS (SELECT *, {place(topology(8, 8))} AS shard, {place(topology(9, 8))} AS grown_shard, CAST('0x' || substr(md5('slot/' || k || '/' || text_crc32), 1, 3) AS INTEGER) % 1024 AS bucket FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM p
"""

#: The base model's columns of op1; its mixture is beyond SQL.
LM_BASE_SQL = f"""
WITH d AS (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 10 = 0 AS held_out, list_append({WORDS}, '') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, COUNT(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
m AS (SELECT CAST(SUM(c) AS BIGINT) AS n, COUNT(*) AS v FROM c)
SELECT doc_id, held_out, COUNT(*) AS n_tokens, COUNT(c.c) AS n_known, m.n AS train_tokens, round(SUM(log10((coalesce(c.c, 0) + 0.1) / (m.n + 0.1 * (m.v + 1)))), 6) AS base_score
FROM t LEFT JOIN c ON c.word = t.word CROSS JOIN m GROUP BY doc_id, held_out, m.n
"""

#: Every cut text, from lists of all units.
OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

#: Lengths and edited texts of fingerprints.
FINGERPRINT_EDITS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(text, n - n // 2) || left(next, n // 2)) AS edited_sha256 FROM n
"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """Every distance of every round, for vectors of ``parts`` x ``width`` components."""
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096.0 * x) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS nth FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT nth, p, v[{width} * p + 1:{width} * p + {width}] AS v FROM k CROSS JOIN (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, nth - 1 AS e, v FROM x WHERE nth <= {entries})",
    ]
    apart = "list_sum(list_transform(list_zip(x.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT nth, x.p, MIN(CAST({apart} AS BIGINT) * {entries} + e) AS best FROM x JOIN b{r} b ON x.p = b.p GROUP BY 1, 2)")
        if r < rounds:
            means = ", ".join(f"CAST((SUM(x.v[{i}]) - ((SUM(x.v[{i}]) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT)" for i in range(1, width + 1))
            steps.append(f"m{r} AS (SELECT x.p, best % {entries} AS e, [{means}] AS v FROM x JOIN a{r} a ON a.nth = x.nth AND a.p = x.p GROUP BY 1, 2)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"c AS (SELECT nth, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(SUM(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    books = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds})"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM k JOIN c ON c.nth = k.nth"


OP13_SQL = _codes_sql()
