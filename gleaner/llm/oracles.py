"""DuckDB SQL for the queries that SQL can express, written from their contracts over the whole tables.

Left out: op2 and op6 (trained models), op4 and op9 (tokenizers), op5 (a seeded choice among equally good ones) and op10 (an
approximate search); tests/llm holds those against brute force, round trips or held-out rows.
"""

from __future__ import annotations

from . import licenses

SPACED = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The smallest id that each node reaches along the links of `link (a, b)`, which holds every link both ways; `node (id)` holds all.
REACH = """
reach (id, seen) AS (
  SELECT id, id FROM node
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.seen
), component AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

OP1 = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SPACED}') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM worded
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)
), node AS (SELECT DISTINCT doc_id AS id FROM documents), {REACH}
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, component_id
FROM documents d JOIN component ON component.id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id"""

OP3 = f"""
WITH RECURSIVE vector AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vector x JOIN vector y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), node AS (SELECT DISTINCT vec_id AS id FROM embeddings), {REACH}
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component ON component.id = e.vec_id"""

#: Kind, pattern, group and its least length.  A run of access or hex is as long as it can be, so its least length may stand in the pattern.
KINDS = (
    (
        "assign",
        "(" + "|".join("_?".join("".join(f"[{c}{c.upper()}]" for c in part) for part in word.split("_?")) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
FOUND = " UNION ALL ".join(
    f"""
  SELECT k, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
    string_split_regex(t, '{pattern}') AS gap, {least} AS least FROM texts WHERE regexp_matches(t, '{pattern}')"""
    for rank, (kind, pattern, group, least) in enumerate(KINDS)
)
OP7 = f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({FOUND}),
hit AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
span AS (
  SELECT k, kind, rank, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS low,
    length(m[i]) AS n FROM hit WHERE length(g[i]) >= least
), digest AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', low::BIGINT, ':', (low + n)::BIGINT), ',' ORDER BY low, rank) AS spans FROM span GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN digest USING (k)"""

OP8 = f"""
WITH worded AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
starts AS (
  SELECT k, doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s, unnest(range(1, len(w) - 11)) AS i
  FROM worded WHERE len(w) >= 13
), judged AS (SELECT k, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM starts),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS i FROM judged WHERE again),
word AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM worded),
kept AS (SELECT k, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (k)"""

OP11 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.k, a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other, b.label, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT k, anchor_id, own, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, other) AS r
  FROM s WHERE label = own QUALIFY r <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY k, r ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (k) WHERE s.label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def _assignment(n: int) -> str:
    """The nearest entry of book{n} for every part, and the floors of the means that make book{n + 1}."""
    return f"""code{n} AS MATERIALIZED (
  SELECT k, p, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT * 64 + e) AS m FROM part JOIN book{n} USING (p) GROUP BY k, p
), sum{n} AS (
  SELECT p, m % 64 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM part JOIN code{n} USING (k, p), generate_series(1, len(x)) t(i) GROUP BY ALL
), mean{n} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM sum{n} GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN mean{n} USING (p, e))"""


OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (SELECT k, p, q[p * len(q) // 16 + 1:(p + 1) * len(q) // 16] AS x FROM v, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, k - 1 AS e, x AS c FROM part WHERE k <= 64),
{_assignment(0)}, {_assignment(1)}, {_assignment(2)},
name AS (SELECT sha256(string_agg(z, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS z FROM book2)),
done AS (SELECT k, string_agg(lower(printf('%02x', m % 64)), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM code2 GROUP BY k)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN done USING (k), name"""


def _template_rows() -> str:
    k, rows = licenses.K, []
    for t, template in enumerate(licenses.TEMPLATES):
        w = template.words
        rows += [f"({t}, {i}, '{' '.join(w[i : i + k])}', {len(w) - k + 1}, {template.base}, '{template.label}')" for i in range(len(w) - k + 1)]
    return ", ".join(rows)


OP13 = rf"""
WITH template (t, pos, gram, grams, base, label) AS (VALUES {_template_rows()}),
worded AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{licenses.WORD}') AS w FROM documents
), gram AS (
  SELECT k, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS gram FROM worded WHERE len(w) >= 3
), vote AS (SELECT k, t, grams, base, label, pos, i, i - pos AS d FROM gram JOIN template USING (gram)),
new AS (SELECT *, CASE WHEN d - lag(d) OVER o > CASE WHEN base THEN 0 ELSE {licenses.GAP} END THEN 1 ELSE 0 END AS n FROM vote WINDOW o AS (PARTITION BY k, t ORDER BY d, pos)),
run AS (SELECT *, sum(n) OVER (PARTITION BY k, t ORDER BY d, pos) AS r FROM new),
span AS (
  SELECT k, label, base, min(i) AS low, count(DISTINCT pos) / grams AS share, max(i) + 3 - min(i) <= {licenses.STRETCH} * (grams + 2) AS fits FROM run GROUP BY k, t, grams, base, label, r
), judged AS (SELECT *, fits AND share >= CASE WHEN base THEN 1 ELSE {licenses.LEAST} END AS ok FROM span),
found AS (
  SELECT k, count(*) FILTER (ok AND base) AS n_base, min(low) FILTER (ok AND base) AS first_word, max(low) FILTER (ok AND base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (ok AND base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (ok)), ',') AS labels, max(share) AS score
  FROM judged GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score FROM worded LEFT JOIN found USING (k)"""

ORACLE_SQL = {"op1_jaccard_join": OP1, "op3_near_vectors": OP3, "op7_secrets": OP7, "op8_substring_dedup": OP8, "op11_hard_negatives": OP11, "op12_vector_codes": OP12, "op13_licenses": OP13}
