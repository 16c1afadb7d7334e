"""DuckDB SQL that states the results of the queries that SQL can express."""

from __future__ import annotations

CONVERSATION_TRIE = """
WITH numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id AS c, list({'r': role, 't': text} ORDER BY p) AS turns,
           list_reduce(
               list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                   lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END
           ) AS crc
    FROM numbered GROUP BY conv_id),
headed AS (SELECT c, turns, xor(crc, 4294967295::BIGINT) % 9 AS h FROM convs),
rebuilt AS MATERIALIZED (
    SELECT o.c, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS s
    FROM headed o LEFT JOIN headed b ON b.c = o.c - o.c % 5),
members AS MATERIALIZED (
    SELECT c, s, d::BIGINT AS depth, s[1:d] AS node FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
    SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CASE WHEN len(s) = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends,
           (count(*) - 1) * coalesce(strlen(node[depth].t), 0) AS own
    FROM members GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS MATERIALIZED (
    SELECT n.*, coalesce(k.n, 0) AS n_children
    FROM nodes n LEFT JOIN children k ON k.depth = n.depth AND k.node = n.node),
upward AS (
    SELECT node[1:d] AS node, d::BIGINT AS depth, own, n_children
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted)),
subtrees AS (
    SELECT node, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM upward GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n
JOIN subtrees s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""

SOURCE_MIXING = r"""
WITH sized AS MATERIALIZED (
    SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
summed AS (
    SELECT *, 3 * s::HUGEINT AS cap,
           sum(3 * s::HUGEINT) OVER o AS caps, sum(w) OVER o AS ws, sum(s) OVER () AS total, sum(w) OVER () AS weights
    FROM sources WINDOW o AS (ORDER BY s / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
reach AS (SELECT *, total - (caps - cap) AS rest, weights - (ws - w) AS shared FROM summed),
level AS (
    SELECT rest, shared FROM reach WHERE rest * w <= cap * shared ORDER BY s / w, source IS NULL, source LIMIT 1),
aimed AS (
    SELECT r.source, r.s, CASE WHEN l.rest * r.w > r.cap * l.shared THEN r.cap::DOUBLE
                               ELSE l.rest::DOUBLE * r.w::DOUBLE / l.shared::DOUBLE END AS target
    FROM reach r, level l),
expected AS (
    SELECT d.*, a.s, a.target, CASE WHEN a.s > 0 THEN floor(least(3.0, a.target / a.s) * 4294967296) ELSE 0 END::HUGEINT AS e,
           ('0x' || substr(md5('42:' || coalesce('=' || d.source, '')), 1, 8))::BIGINT AS o
    FROM sized d JOIN aimed a ON a.source IS NOT DISTINCT FROM d.source),
placed AS (
    SELECT *, o + sum(e) OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST, text ROWS UNBOUNDED PRECEDING) AS upto FROM expected)
SELECT doc_id, size, s AS source_size, target,
       ((upto::HUGEINT // 4294967296 - (upto - e)::HUGEINT // 4294967296) * size)::BIGINT AS taken
FROM placed
"""


def vector_codes(rounds: int = 6) -> str:
    floor_mean = "(sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*)"
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT vec_id, part, min(d * 16 + entry) AS best
    FROM (SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d
          FROM parts c JOIN b{i} b ON b.part = c.part AND b.place = c.place GROUP BY ALL) GROUP BY ALL)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v
    FROM b{i} b LEFT JOIN (
        SELECT c.part, a.best % 16 AS entry, c.place, ({floor_mean})::HUGEINT AS v
        FROM parts c JOIN a{i} a ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY ALL
    ) m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)"""
            )
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS number FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT vec_id, number, i // (n // 8) AS part, i % (n // 8) AS place, floor(4096 * e[i + 1]::DOUBLE)::HUGEINT AS v
    FROM (SELECT vec_id, number, e, len(e) AS n, unnest(range(0, len(e))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, number AS entry, place, v FROM parts WHERE number < 16),
{", ".join(steps)},
coded AS (
    SELECT vec_id, string_agg(printf('%02x', (best % 16)::BIGINT), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error
    FROM a{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM b{rounds})
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.h AS codebooks_sha256
FROM kept k JOIN coded c ON c.vec_id = k.vec_id, digest d
"""


VECTOR_CODES = vector_codes()
