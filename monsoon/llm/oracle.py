"""SQL for the corpus queries that SQL can express, run by DuckDB on the same tables."""

from __future__ import annotations

_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 places AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
 windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS n FROM places),
 inside AS (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM windows WHERE n > 1),
 repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM inside GROUP BY 1),
 facts AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_upper,
   [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS filled,
   CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN repeated r USING (doc_id)),
 lines AS (SELECT * EXCLUDE (filled), CAST(len(filled) AS BIGINT) AS n_lines,
   CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines FROM facts),
 base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM lines)
SELECT *, NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 4 * word_chars OR 2 * n_dup_lines > n_lines
  OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words) AS kept FROM base"""

_OP9 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
   + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

#: crc32 of a text by its definition: a list of table values, one step a byte.
_CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS tab
  FROM (SELECT unnest(range(256)) AS b))"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text; ``tab`` of the table crc has to be in scope."""
    digits = f"hex(encode({text}))"
    octets = f"[CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length({digits}) // 2)]"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"


_OP11 = f"""
WITH {_CRC_TABLE},
 t AS (SELECT CAST(conv_id AS BIGINT) AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
   FROM conversations WHERE conv_id IS NOT NULL),
 own AS (SELECT c, list(turn ORDER BY i) AS turns FROM t GROUP BY c),
 heads AS (SELECT c, turns, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM own, crc),
 rebuilt AS (SELECT x.c, list_concat(coalesce(b.turns[1:x.h], []), x.turns[x.h + 1:]) AS s FROM heads x LEFT JOIN own b ON b.c = x.c - x.c % 100),
 steps AS (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt),
 nodes AS (SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
   string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(s) = d) AS ends FROM steps GROUP BY 1, 2),
 kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
 facts AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[n.d].text) END AS saved
   FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
 above AS (SELECT p, unnest(range(d + 1)) AS e, n_children, saved FROM facts),
 sums AS (SELECT p[1:e] AS p, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
 CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM facts f JOIN sums s ON s.d = f.d AND s.p = f.p LEFT JOIN nodes u ON u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]"""


def _shrunk(name: str, groups: str, above: str, columns: str) -> str:
    """Two tables of SQL: ``name`` has the groups with their prior's mean, name_m their posterior mean and the strength."""
    return f"""{name} AS (SELECT g.*, a.m AS prior FROM ({groups}) g JOIN {above} a USING ({columns})),
 {name}_s AS (SELECT least(greatest(coalesce((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior)))
   / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 1e-4), 1e-4), 0.999) AS alike FROM {name} WHERE n > 0),
 {name}_m AS (SELECT g.*, (1 - alike) / alike AS strength, (bad + (1 - alike) / alike * prior) / (n + (1 - alike) / alike) AS m
   FROM {name} g, {name}_s)"""


_LAST_TWO = "array_to_string(string_split(host, '.')[-2:], '.')"
_TWO_LABELS = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in')"

_OP12 = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 o AS (SELECT page_id, CAST(toxic = 1 OR quality = 0 AS INT) AS bad
   FROM (SELECT DISTINCT page_id, try_cast(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM p)
   JOIN labels USING (doc_id)),
 labelled AS (SELECT page_id, count(bad) AS n, sum(bad) AS bad FROM o WHERE bad IS NOT NULL GROUP BY 1),
 hosts AS (SELECT host, CASE WHEN {_LAST_TWO} IN {_TWO_LABELS} THEN {_LAST_TWO} ELSE string_split(host, '.')[-1] END AS suffix,
   CASE WHEN regexp_matches(host, '^[0-9.:]*$') THEN host WHEN {_LAST_TWO} IN {_TWO_LABELS}
     THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {_LAST_TWO} END AS domain,
   coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN labelled USING (page_id) GROUP BY 1),
 every AS (SELECT 1 AS one, (sum(bad) + 1.0) / (sum(n) + 2.0) AS m FROM hosts),
 {_shrunk("suffixes", "SELECT 1 AS one, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2", "every", "one")},
 {_shrunk("domains", "SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2", "suffixes_m", "suffix")},
 {_shrunk("known", "SELECT * FROM hosts", "domains_m", "suffix, domain")},
 beta AS (SELECT host, n, bad, bad + strength * prior AS a, n - bad + strength * (1 - prior) AS b FROM known_m),
 bounds AS (SELECT host, n, bad, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM beta),
 ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
   WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, CAST(n AS BIGINT) AS host_labels, CAST(bad AS BIGINT) AS host_bad,
  round(bound, 6) AS bound FROM ruled JOIN bounds USING (host)"""

_OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
 runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 counted AS (SELECT doc, run, count(*) AS k FROM runs GROUP BY 1, 2),
 hashed AS (SELECT run, k, {_crc32("doc || ':' || run")} AS h FROM counted, crc),
 slipped AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
 v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
 cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
 holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS hole FROM cuts),
 pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
   UNION SELECT a.word, b.word, b.n FROM holes a JOIN v b ON b.word = a.hole
   UNION SELECT b.word, a.word, a.n FROM holes a JOIN v b ON b.word = a.hole),
 best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
   row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM pairs),
 judged AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
   CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
 chain AS (SELECT word, word AS root, form AS further FROM judged
   UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON j.word = c.further)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word AND c.further IS NULL"""

ORACLE_SQL: dict[str, str] = {
    "op6_quality_cascade": _OP6,
    "op9_chat_events": _OP9,
    "op11_sequence_trie": _OP11,
    "op12_host_reputation": _OP12,
    "op13_spelling_index": _OP13,
}
