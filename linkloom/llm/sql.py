"""DuckDB SQL of the queries that SQL can express on whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op2(templates: dict[str, str]) -> str:
    """Shingle containment of every template in every text, without retrieval."""
    rows = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(templates.items()))
    shingles = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
    return f"""
WITH t AS (
  SELECT template_id, w, least(3, len(w)) AS k FROM (SELECT template_id, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM (VALUES {rows}) v(template_id, text)) WHERE len(w) > 0
), s AS (
  SELECT DISTINCT template_id, k, {shingles} AS g FROM t
), n AS (
  SELECT template_id, count(*) AS all_ FROM s GROUP BY 1
), d AS (
  SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT DISTINCT doc_id, text, regexp_extract_all({_LOWER}, '{_ITEM_WORDS}') AS w FROM documents)
), p AS (
  SELECT r, doc_id, k, unnest(range(0, len(w) - k + 1)) AS at_, {shingles} AS g FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k
), f AS (
  SELECT r, doc_id, template_id, count(DISTINCT g) AS inside, min(at_) AS place FROM p JOIN s USING (k, g) GROUP BY ALL
)
SELECT doc_id, template_id, inside / all_ AS containment, CAST(place AS INT) AS place FROM f JOIN n USING (template_id) WHERE 100 * inside >= 80 * all_
"""


OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), c AS (
  SELECT min(doc_id) AS rep, s FROM s WHERE len(s) > 0 GROUP BY s
), e AS (
  SELECT rep, len(s) AS n, unnest(s) AS g FROM c
), links AS (
  SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least_of AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN least_of l ON l.x = c.rep
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win ON win.n = p.n AND win.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: length(x))) AS chars FROM d
), grams AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM d, (SELECT unnest([5, 7, 10]) AS n) WHERE len(w) >= n
), many AS (
  SELECT r, n, unnest(places) AS i FROM (SELECT r, n, list(i) AS places FROM grams GROUP BY r, n, g HAVING count(*) > 1)
), inside AS (
  SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM many
), cover AS (
  SELECT r, coalesce(sum(chars) FILTER (n = 5), 0) AS c5, coalesce(sum(chars) FILTER (n = 7), 0) AS c7, coalesce(sum(chars) FILTER (n = 10), 0) AS c10, count(*) FILTER (n = 5) AS repeat
  FROM inside JOIN words USING (r, i) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
), repeated AS (
  SELECT r, count(*) AS c, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line HAVING count(*) > 1
), dup AS (
  SELECT r, sum(c - 1) AS n_dup, sum(c * chars) AS chars FROM repeated GROUP BY r
), f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup, coalesce(repeat, 0) AS repeat, coalesce(dup.chars, 0) AS cl, coalesce(c5, 0) AS c5, coalesce(c7, 0) AS c7, coalesce(c10, 0) AS c10
  FROM d LEFT JOIN cover USING (r) LEFT JOIN dup USING (r)
), s AS (
  SELECT *, n_words < 10 OR 100 * repeat > 20 * n_words AS base_failed, CAST(cl AS DOUBLE) / greatest(word_chars, 1) AS line_cover,
    CAST(c5 AS DOUBLE) / greatest(word_chars, 1) AS cover_5, CAST(c7 AS DOUBLE) / greatest(word_chars, 1) AS cover_7, CAST(c10 AS DOUBLE) / greatest(word_chars, 1) AS cover_10
  FROM f
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines,
  CAST(repeat AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND line_cover <= 0.25 AND cover_5 <= 0.20 AND cover_7 <= 0.18 AND cover_10 <= 0.16 AS kept,
  line_cover, cover_5, cover_7, cover_10
FROM s
"""
