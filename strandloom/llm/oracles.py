"""The queries of this subpackage in SQL, for those (or their counting parts) that SQL can express."""

from __future__ import annotations

from . import licenses, minhash, pii, quality

_BLANKLESS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets, all links from shared shingles, and reachability; equal sets are one node.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANKLESS}') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {minhash.SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {minhash.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {minhash.SHINGLE - 1}], ' ')) END)) AS s FROM words),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT node, n, unnest(s) AS t FROM nodes),
linked AS (SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n
    HAVING 100 * count(*) >= {minhash.PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT node, node AS seen FROM nodes UNION SELECT l.b, r.seen FROM reach r JOIN linked l ON l.a = r.node),
named AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN named USING (node)
"""

EDITED_TEXTS = """
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER d, first(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS f,
    lead(doc_id) OVER d IS NOT NULL AND lead(text) OVER d IS NULL AS void FROM documents WINDOW d AS (ORDER BY doc_id DESC))
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, CAST(length(t) - length(t) // 2 AS BIGINT)) || CASE WHEN void THEN '' ELSE left(f, CAST(length(t) // 2 AS BIGINT)) END) AS edited_sha256 FROM o
"""


def license_places() -> str:
    phrases = ", ".join(f"{{'words': {p.split()!r}, 'label': {label!r}}}" for p, label in licenses.PHRASES.items())
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT unnest([{phrases}]) AS p),
places AS (SELECT doc_id, p.label AS label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p.words)] = p.words)) AS pos FROM words, phrases)
SELECT doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(pos) AS n_base, CAST(min(pos) AS BIGINT) AS first_word, CAST(max(pos) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM words LEFT JOIN places USING (doc_id) GROUP BY doc_id
"""


QUALITY_COUNTS = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLANKLESS}') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANKLESS}')) AS x FROM words),
windows AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos:pos + {quality.WINDOW - 1}]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS pos FROM words)),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + {quality.WINDOW})) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counted
"""


#: Conversation -7 and the rows of op10, in SQL: the formatted length counts one backslash for each control string.
CONVERSATIONS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, ': ', ''))) // 2
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + 4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE length(role) + 1 END + 2 + 8 AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(before, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND last(role ORDER BY turn, role, text) IN ('user', 'assistant') AS valid
FROM m GROUP BY conv_id
"""


def personal_data() -> str:
    """Base spans from the pieces between matches, pairs of entity and term recounted, and marked wherever they stand."""
    spans = "\n  UNION ALL ".join(
        f"SELECT row, doc_id, {k} AS nth, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, list_transform(regexp_split_to_array(text, '{p}'), lambda x: length(x)) AS gaps, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i, regexp_extract_all(text, '{p}') AS ms FROM docs"
        for k, (kind, p) in enumerate(pii.PATTERNS.items())
    )
    word = r"[\p{L}\p{M}0-9]+(?:[''’][\p{L}\p{M}0-9]+)*"
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, text IS NULL AS void FROM documents),
matches AS ({spans}),
placed AS (SELECT row, doc_id, nth, kind, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(gaps[1:i + 1]) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS BIGINT) AS s FROM matches),
base AS MATERIALIZED (SELECT *, s + length(m) AS e, kind || ':' || CASE kind WHEN 'email' THEN lower(m) WHEN 'ip' THEN m ELSE digits END AS entity FROM placed WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(reverse(digits)[k] AS INTEGER) ELSE 2 * CAST(reverse(digits)[k] AS INTEGER) - CASE WHEN CAST(reverse(digits)[k] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
told AS (SELECT row, text, regexp_extract_all(text, '{word}') AS ws, list_transform(regexp_split_to_array(text, '{word}'), lambda x: length(x)) AS gaps FROM docs WHERE row IN (SELECT row FROM base)),
counted AS (SELECT row, ws, gaps, unnest(range(1, len(ws) + 1)) AS k FROM told),
sized AS (SELECT row, k, ws[k] AS w, gaps[k] AS gap FROM counted),
words AS MATERIALIZED (SELECT row, k, w, lower(replace(w, '’', '''')) AS term, CAST(e - length(w) AS BIGINT) AS s, CAST(e AS BIGINT) AS e
  FROM (SELECT *, sum(gap + length(w)) OVER (PARTITION BY row ORDER BY k) AS e FROM sized)),
free AS MATERIALIZED (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND w.s < b.e AND b.s < w.e)),
ends AS (SELECT b.row, b.entity, count(w.k) FILTER (WHERE w.e <= b.s) AS before, count(w.k) FILTER (WHERE w.s < b.e) AS upto FROM base b LEFT JOIN words w ON w.row = b.row GROUP BY b.row, b.entity, b.s, b.e),
near AS (SELECT DISTINCT text, entity, term FROM ends JOIN free USING (row) JOIN docs USING (row)
  WHERE (k > before - {pii.NEAR} AND k <= before) OR (k > upto AND k <= upto + {pii.NEAR})),
entities AS (SELECT entity, count(DISTINCT text) AS n_entity FROM base JOIN docs USING (row) GROUP BY entity),
pairs AS (SELECT entity, term, count(*) AS n_both FROM near GROUP BY entity, term),
vocabulary AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '{word}'), lambda x: lower(replace(x, '’', ''''))))) AS term
  FROM (SELECT DISTINCT text FROM docs WHERE NOT void)) GROUP BY term),
total AS (SELECT CAST(count(DISTINCT text) AS DOUBLE) AS n FROM docs WHERE NOT void),
reveal AS (SELECT entity, term FROM pairs JOIN entities USING (entity) JOIN vocabulary USING (term), total
  WHERE n_entity < n AND n_term <= (n_both * pow(n / n_entity, CAST(1 AS DOUBLE) - CAST({pii.DISCLOSURE} AS DOUBLE)) - {pii.SMOOTHING}) * (1 + CAST(1e-12 AS DOUBLE))),
added AS (SELECT DISTINCT f.row, CASE WHEN regexp_matches(w, '[0-9]') THEN 'number' WHEN regexp_matches(w, '^\p{{Lu}}') AND regexp_matches(w, '\p{{Ll}}') THEN 'name' ELSE 'term' END AS kind, f.s, f.e
  FROM free f JOIN (SELECT DISTINCT row, entity FROM base) b ON b.row = f.row JOIN reveal r ON r.entity = b.entity AND r.term = f.term),
shown AS (SELECT row, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY nth, s) AS own, count(*) FILTER (WHERE nth = 0) AS n_email, count(*) FILTER (WHERE nth = 1) AS n_ip,
  count(*) FILTER (WHERE nth = 2) AS n_card, count(*) FILTER (WHERE nth = 3) AS n_phone FROM base GROUP BY row),
more AS (SELECT row, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY kind, s) AS other FROM added GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(own, '')) AS base_sha256,
  concat_ws(',', own, other) AS spans FROM docs LEFT JOIN shown USING (row) LEFT JOIN more USING (row)
"""
