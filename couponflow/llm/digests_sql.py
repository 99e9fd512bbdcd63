"""SQL of the queries over digests, packed pieces and conversation prefixes."""

from __future__ import annotations


def crc32(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"


def _field(value: str) -> str:
    return f"CASE WHEN ({value}) IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _record(text: str) -> str:
    return " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text))


_TAMPERED = f"""CASE WHEN ({crc32("doc_id::VARCHAR")}) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"""

MERKLE = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, *, {_TAMPERED} AS claim FROM documents),
leaves AS (SELECT r, doc_id, source, sha256({_record("text")}) AS leaf, sha256({_record("claim")}) AS claimed FROM docs),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
    SELECT source, 0 AS level, place, leaf AS digest, n FROM placed
    UNION ALL
    SELECT source, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 15) // 16)
    FROM tree WHERE n > 1 GROUP BY source, level, place // 16),
subroots AS (
    SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, place, digest, n FROM subroots
    UNION ALL
    SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 15) // 16)
    FROM top WHERE n > 1 GROUP BY level, place // 16),
-- One row for each step from a leaf to the root.
steps AS (
    SELECT l.r, t.level AS step, coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place < l.place // (16 ** t.level)::BIGINT), '') AS before,
           coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place > l.place // (16 ** t.level)::BIGINT), '') AS behind
    FROM placed l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source AND t.n > 1
        AND t.place // 16 = l.place // (16 ** (t.level + 1))::BIGINT
    GROUP BY l.r, t.level
    UNION ALL
    SELECT l.r, 1000 + t.level, coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place < s.place // (16 ** t.level)::BIGINT), ''),
           coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place > s.place // (16 ** t.level)::BIGINT), '')
    FROM placed l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
    JOIN top t ON t.n > 1 AND t.place // 16 = s.place // (16 ** (t.level + 1))::BIGINT
    GROUP BY l.r, t.level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM steps),
folded AS (
    SELECT r, 0 AS k, claimed AS digest FROM leaves
    UNION ALL
    SELECT f.r, f.k + 1, sha256(n.before || f.digest || n.behind) FROM folded f JOIN numbered n ON f.r = n.r AND n.k = f.k + 1),
ends AS (SELECT r, arg_max(digest, k) AS folded_root FROM folded GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       e.folded_root, e.folded_root = t.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
JOIN (SELECT digest FROM top WHERE n = 1) t ON true JOIN ends e USING (r) LEFT JOIN proofs p USING (r)"""


TRIE = f"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, max(k) AS n, ({crc32("c::VARCHAR")}) % 6 AS h, c - c % 100 AS b FROM own GROUP BY c),
rebuilt AS (
    SELECT v.c, o.k AS d, o.role, o.text FROM convs v JOIN own o ON o.c = v.b AND o.k <= v.h
    UNION ALL
    SELECT v.c, least(v.h, coalesce(w.n, 0)) + o.k - v.h, o.role, o.text
    FROM convs v JOIN own o ON o.c = v.c AND o.k > v.h LEFT JOIN convs w ON w.c = v.b),
members AS (
    SELECT c, 0 AS d, '' AS node, 0 AS chars FROM convs
    UNION ALL
    SELECT c, d, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d),
           length(text) FROM rebuilt),
steps AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS above, max(d) OVER (PARTITION BY c) AS last FROM members),
nodes AS (
    SELECT d, node, any_value(above) AS above, min(c) AS owner, count(*) AS n, any_value(chars) AS chars, bool_and(d = last) AS leaf,
           sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (d = last), '')) AS ends
    FROM steps GROUP BY d, node),
-- A node lies below another when its smallest member is one of the other's.
sums AS (
    SELECT m.d, m.node, sum((w.n - 1) * w.chars) AS saved, count(*) FILTER (w.leaf) AS leaves
    FROM members m JOIN nodes w ON w.owner = m.c AND w.d >= m.d GROUP BY m.d, m.node),
children AS (SELECT d - 1 AS d, above AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL)
SELECT x.owner AS conv_id, x.d::BIGINT AS depth, p.owner AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums s USING (d, node) LEFT JOIN children k USING (d, node)
LEFT JOIN nodes p ON p.d = x.d - 1 AND p.node = x.above"""
