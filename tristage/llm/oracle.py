"""SQL for DuckDB that gives the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from . import secrets

#: Words as the contracts cut them: A-Z in lower case, white space is space and tab to carriage return.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Forty hex digits are 160 bits; every five bits are a digit of base 32.
OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
 d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h FROM p),
 b AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4),
   lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, g * 5 + 1, 5))::BIGINT >> (15 - 5 * k)) & 31) AS INTEGER) + 1, 1)), '')), '') AS payload_digest FROM d),
 t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM b)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS verified FROM t"""

#: Exact join on shingles of distinct sets; the components by reachability.
OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
 c AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
 t AS (SELECT id, n, unnest(s) AS t FROM c),
 e AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 r AS (SELECT id, id AS root FROM c UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
 m AS (SELECT id, min(root) AS component FROM r GROUP BY id)
 SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.id = c.id"""

#: Exact join on runs of five words of distinct lines; a place is doc_id and number of the line in one number.
OP6 = """WITH l AS (SELECT doc_id, unnest(string_split(translate(text, chr(9) || chr(11) || chr(12) || chr(13), '    '), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
 p AS (SELECT line, pos, doc_id::HUGEINT * 1000000000 + pos AS place FROM l),
 f AS (SELECT line, min(place) AS first, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM p GROUP BY line),
 c AS (SELECT line, first, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM f WHERE len(w) > 0),
 t AS (SELECT first AS id, len(s) AS n, unnest(s) AS t FROM c),
 e AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 k AS (SELECT x, count(*) AS n_links, min(y) AS y FROM e GROUP BY x),
 m AS (SELECT place, pos, coalesce(n_links, 0) AS n_links, least(first, coalesce(y, first)) AS earliest FROM p JOIN c USING (line) LEFT JOIN k ON x = first),
 g AS (SELECT CAST(place // 1000000000 AS BIGINT) AS doc_id, list(CAST(pos AS INTEGER) ORDER BY pos) FILTER (place > earliest) AS removed, list(CAST(earliest // 1000000000 AS BIGINT) ORDER BY pos) FILTER (place > earliest) AS matched, sum(n_links) AS n_links FROM m GROUP BY 1)
 SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, coalesce(removed, []) AS removed, coalesce(matched, []) AS matched, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM documents LEFT JOIN g USING (doc_id)"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: what stands between matches tells where they begin."""
    p = pattern.replace("'", "''").replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'start': list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0), 'n': length(hits[i]), 'ok': length(held[i]) >= {least}}})) AS s
 FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{p}') AS gaps, regexp_extract_all(coalesce(text, ''), '{p}') AS hits, regexp_extract_all(coalesce(text, ''), '{p}', {group}) AS held FROM documents WHERE regexp_matches(coalesce(text, ''), '{p}'))"""


_COUNTS = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in secrets.BASE)
_BASE = ", ".join(f"'{k}'" for k in secrets.BASE)
OP10 = (
    "WITH a AS ("
    + " UNION ALL ".join(_spans(i, *rule) for i, rule in enumerate(secrets.RULES))
    + f"""), b AS (SELECT doc_id, kind, rank, CAST(s.start AS BIGINT) AS s, CAST(s.start + s.n AS BIGINT) AS e FROM a WHERE s.ok),
 c AS (SELECT doc_id, {_COUNTS}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IN ({_BASE})) AS base FROM b GROUP BY doc_id)
 SELECT doc_id, """
    + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)
    + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN c USING (doc_id)"
)

#: Sources up to their limit come first in order of size over weight; words before a document in order of its key.
OP11 = """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS BIGINT) AS size, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
 w AS (SELECT source, n, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * n AS cap FROM s),
 t AS (SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS weights, coalesce(sum(cap) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS passed FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, (3 * total - 2 * before) * w >= cap * 2 * (weights - passed) AS held FROM t),
 g AS (SELECT coalesce(sum(cap) FILTER (held), 0) AS taken, coalesce(sum(w) FILTER (held), 0) AS out FROM f),
 x AS (SELECT source, n, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE CAST(w * (3 * total - 2 * taken) AS DOUBLE) / CAST(2 * greatest(weights - out, 1) AS DOUBLE) END AS target FROM f, g),
 y AS (SELECT doc_id, size, n AS source_size, target, CAST(floor(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
 z AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM y)
 SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs FROM z"""


def _vectors(factor: int, more: str = "") -> str:
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more})"""


#: Rounded down: what is over the next multiple goes off first.
_MEAN = "CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x"


def _lloyd(i: int) -> str:
    return f""", a{i} AS MATERIALIZED (SELECT vec_id, k, d FROM (SELECT p.vec_id, c.k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{i} c USING (j) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),
 c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, {_MEAN} FROM c{i} c LEFT JOIN (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN p USING (vec_id) GROUP BY k, j) USING (k, j))"""


OP13 = (
    _vectors(64, " AND len(embedding) = 64")
    + """, p AS MATERIALIZED (SELECT vec_id, generate_subscripts(e, 1) AS j, unnest(e) AS x FROM v),
 c0 AS MATERIALIZED (SELECT k, j, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM v QUALIFY k < 16) JOIN p USING (vec_id))"""
    + "".join(map(_lloyd, range(4)))
    + """, h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY k)
 SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN h USING (k)"""
)


def _product(i: int) -> str:
    return f""", a{i} AS MATERIALIZED (SELECT vec_id, g, k, d FROM (SELECT p.vec_id, p.g, c.k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{i} c USING (g, j) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id, g ORDER BY d, k) = 1),
 c{i + 1} AS MATERIALIZED (SELECT c.g, c.k, c.j, {_MEAN} FROM c{i} c LEFT JOIN (SELECT g, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN p USING (vec_id, g) GROUP BY ALL) USING (g, k, j))"""


OP12 = (
    _vectors(256)
    + """, p AS MATERIALIZED (SELECT vec_id, (j - 1) // w AS g, (j - 1) % w AS j, x FROM (SELECT vec_id, len(e) // 16 AS w, generate_subscripts(e, 1) AS j, unnest(e) AS x FROM v)),
 c0 AS MATERIALIZED (SELECT g, k, j, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64) JOIN p USING (vec_id))"""
    + "".join(map(_product, range(3)))
    + """, r AS (SELECT vec_id, string_agg(lower(printf('%02x', k)), '' ORDER BY g) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY g, k, j)) FROM c2) AS codebooks_sha256 FROM r JOIN v USING (vec_id)"""
)

ORACLE_SQL = {"op1_warc": OP1, "op4_minhash": OP4, "op6_line_dedup": OP6, "op10_secret_scans": OP10, "op11_mixing": OP11, "op12_vector_codes": OP12, "op13_clustering": OP13}
