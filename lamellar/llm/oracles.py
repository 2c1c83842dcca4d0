"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lamellar.llm import quality as Q

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_FOLDED = _WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: {{'i': i, 's': array_to_string(w[i:i + 34], ' ')}}), recursive := true) FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM h, range(35) AS t(k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
CASE WHEN n >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND last > page_id THEN last END AS refers_to
FROM r
"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 's': array_to_string(w[i:i + 7], ' ')}}), recursive := true) FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(8) AS t(k) GROUP BY 1),
l AS (SELECT doc_id, line, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
own AS (SELECT doc_id, line, lw, count(*) - 1 AS again, CAST(len(lw) AS BIGINT) AS n FROM l WHERE len(lw) > 0 GROUP BY ALL),
judged AS (SELECT doc_id, again, n,
 length(regexp_replace(line, '[^{Q.SYMBOLS}]+', '', 'g')) * 100 > n * {Q.SYMBOL_PERCENT}
 OR (n < {Q.NAVIGATION_WORDS} AND NOT regexp_matches(line, {_text(Q.SENTENCE_END)}))
 OR (n >= 3 AND regexp_matches(line, {_text(Q.SHOUTING)}) AND NOT regexp_matches(line, {_text(Q.CALM)}))
 OR (n <= {Q.BOILERPLATE_WORDS} AND regexp_matches(line, {_text(Q.BOILERPLATE)}))
 OR (n >= {Q.MANY_WORDS} AND len(list_distinct(lw)) ** 2 < n * {Q.DIFFERENT_SQUARE}) AS fails FROM own),
s AS (SELECT doc_id, sum(again) AS again, coalesce(sum(n) FILTER (NOT fails), 0) AS kept FROM judged GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^{Q.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(again, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(kept, 0) AS kept_words
 FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words * 100 >= n_words * {Q.KEEP_PERCENT} AS kept FROM f
"""

_GRAMS = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {_FOLDED} AS w FROM documents)),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM d),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k)),
t AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT d.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.b AS component_id FROM d JOIN (SELECT a, min(b) AS b FROM t GROUP BY 1) m ON d.doc_id = m.a
"""

#: Every benchmark item has at least five words.
CONTAINMENT = f"""
WITH d AS (SELECT doc_id, unnest({_GRAMS}) AS x FROM (SELECT doc_id, {_FOLDED} AS w FROM documents) WHERE len(w) >= 5),
i AS (SELECT item_id, {_GRAMS} AS g FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark)),
j AS (SELECT item_id, len(g) AS n, unnest(g) AS x FROM i)
SELECT doc_id, item_id, CAST(any_value(n) AS BIGINT) AS n_shingles, count(*) AS n_found, count(*) / any_value(n) AS containment
FROM d JOIN j USING (x) GROUP BY 1, 2 HAVING count(*) >= any_value(n) * 0.8 - 1e-9
"""
