"""SQL for DuckDB of the queries on manifests and periodic runs."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: bit by bit, each byte followed by eight steps."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_prepend(ascii(({text})[i])::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))"
    return f"xor(4294967295::BIGINT, list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END, 4294967295::BIGINT))"


#: All pairs of equal words at most a third of the text apart; stretches of starts with one distance; the least distance of each stretch.
PERIODIC_RUNS = f"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w)::BIGINT AS n, {crc32("doc_id::VARCHAR")} AS h FROM c),
p AS (SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
t AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
words AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM t WHERE n > 0),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (
    SELECT r, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs)
    GROUP BY r, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY ALL),
listed AS (
    SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
best AS (
    SELECT r, start, length, period, length * 1000 // period AS exponent_milli
    FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (y.length * x.period > x.length * y.period
        OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, i, word FROM words ANTI JOIN gone USING (r, i)) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def tree(name: str, leaves: str) -> str:
    """CTEs ``name`` (every node with the number of nodes of its level) and ``name_up`` (every leaf's way to the top: the node as
    given, the node of the changed leaf, the digests beside it) of ``leaves`` (tree, i, digest, n, who, changed)."""
    return f"""
{name} AS (
    SELECT tree, 0 AS level, i, digest, n FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_up AS (
    SELECT tree, 0 AS level, i, n, who, changed, beside FROM {leaves}
    UNION ALL
    SELECT u.tree, u.level + 1, u.i // 3, (u.n + 2) // 3, u.who,
        sha256(string_agg(CASE WHEN s.i = u.i THEN u.changed ELSE s.digest END, '' ORDER BY s.i)),
        u.beside || string_agg(CASE WHEN s.i = u.i THEN '' ELSE s.digest END, '' ORDER BY s.i)
    FROM {name}_up u JOIN {name} s ON s.tree = u.tree AND s.level = u.level AND s.i // 3 = u.i // 3
    WHERE u.n > 1 GROUP BY u.tree, u.level, u.i, u.n, u.who, u.changed, u.beside)"""


def part(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS altered, {crc32("doc_id::VARCHAR")} % 2 = 0 AS hit FROM documents),
l AS (
    SELECT coalesce('s' || source, '') AS tree, doc_id, leaf AS digest, CASE WHEN hit THEN altered ELSE leaf END AS changed, '' AS beside,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
    FROM d),
leaves AS MATERIALIZED (SELECT *, tree || '/' || i AS who FROM l),
{tree("a", "leaves")},
tops AS (SELECT tree, digest FROM a WHERE n = 1),
roots AS MATERIALIZED (
    SELECT 'root' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, digest, count(*) OVER () AS n, tree AS own FROM tops),
second AS MATERIALIZED (
    SELECT r.tree, r.i, r.n, r.own, u.who, u.changed, u.beside FROM roots r JOIN a_up u ON u.tree = r.own WHERE u.n = 1),
b AS (
    SELECT tree, 0 AS level, i, digest, n FROM roots
    UNION ALL
    SELECT tree, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY tree, level, i // 3, n),
b_up AS (
    SELECT 0 AS level, i, n, who, changed, beside FROM second
    UNION ALL
    SELECT u.level + 1, u.i // 3, (u.n + 2) // 3, u.who, sha256(string_agg(CASE WHEN s.i = u.i THEN u.changed ELSE s.digest END, '' ORDER BY s.i)),
        u.beside || string_agg(CASE WHEN s.i = u.i THEN '' ELSE s.digest END, '' ORDER BY s.i)
    FROM b_up u JOIN b s ON s.level = u.level AND s.i // 3 = u.i // 3
    WHERE u.n > 1 GROUP BY u.level, u.i, u.n, u.who, u.changed, u.beside)
SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, top.digest AS root, sha256(x.beside) AS proof_sha256, x.changed AS folded_root, x.changed = top.digest AS verified
FROM b_up x JOIN leaves l ON l.who = x.who JOIN roots r ON r.own = l.tree JOIN b top ON top.n = 1
WHERE x.n = 1
"""
