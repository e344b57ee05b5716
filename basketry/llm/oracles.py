"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_mix"] = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
-- fill from the source whose cap is reached first: k sources clamped
r AS (
  SELECT *, row_number() OVER o AS k, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS size_to,
         sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS w_to
  FROM s WINDOW o AS (ORDER BY size::DOUBLE / w, source NULLS LAST)),
t AS (SELECT sum(size) AS size, sum(w) AS w FROM s),
levels AS (
  SELECT r.k - 1 AS clamped, 3 * t.size - 4 * (r.size_to - r.size) AS p, 2 * (t.w - (r.w_to - r.w)) AS q,
         r.size AS next_size, r.w AS next_w
  FROM r, t),
level AS (SELECT * FROM levels WHERE p * next_w <= 2 * next_size * q ORDER BY clamped LIMIT 1),
g AS (
  SELECT r.source, r.size AS source_size,
         CASE WHEN l.p IS NULL OR r.k <= l.clamped THEN (2 * r.size)::DOUBLE
              ELSE (r.w * l.p)::DOUBLE / l.q::DOUBLE END AS target
  FROM r LEFT JOIN level l ON true),
x AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN (2 * start + size)::DOUBLE < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM x
"""

ORACLES["op10_exact_dedup"] = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op3_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle
  FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 1 THEN words
                              ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)
               AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["op6_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i AS start, sha256(array_to_string(words[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
later AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, start + k AS i FROM later, range(0, 20) r(k)),
words AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op9_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM g
"""


def _license_sql() -> str:
    from basketry.llm.license_scan import PHRASES, TEMPLATES, make_templates

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, {t.label!r}, {list(t.words)!r}, {t.needed}, {t.window})"
                          for k, t in enumerate(make_templates(TEMPLATES, 0.9)))
    return rf"""
WITH phrases(words, label) AS (VALUES {phrases}),
templates(t, label, words, needed, reach) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS r, doc_id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower
      FROM documents),
w AS (SELECT r, doc_id, lower, regexp_extract_all(lower, '{word}') AS words FROM d),
places AS (
  SELECT r, label, unnest(list_filter(range(len(w.words)), lambda i: w.words[i + 1:i + len(p.words)] = p.words)) AS place
  FROM w, phrases p),
base AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
         FROM places GROUP BY r),
hits AS (
  SELECT r, t, reach, needed, i, word
  FROM (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w)
  JOIN (SELECT t, reach, needed, unnest(words) AS word FROM templates) USING (word)),
firsts AS (
  SELECT a.r, a.t, a.needed, a.i AS lo, a.word AS head, b.word, min(b.i) AS i
  FROM hits a JOIN hits b ON a.r = b.r AND a.t = b.t AND b.i BETWEEN a.i AND a.i + a.reach - 1 GROUP BY ALL),
runs AS (
  SELECT r, t, lo, head, count(*) AS common, max(i) AS hi FROM firsts GROUP BY r, t, lo, head, needed HAVING count(*) >= needed),
matches AS (
  SELECT r, label, len(words) AS length, common, lo, hi FROM runs JOIN templates USING (t)
  WHERE NOT EXISTS (FROM hits h WHERE h.r = runs.r AND h.t = runs.t AND h.word = head AND h.i > lo AND h.i <= hi)),
found AS (
  SELECT r, list(DISTINCT label) AS labels, max(common / length) AS score FROM matches m
  WHERE NOT EXISTS (
    FROM matches o WHERE o.r = m.r AND o.label <> m.label AND o.lo <= m.hi AND o.hi >= m.lo
      AND (o.common * m.length > m.common * o.length OR o.common * m.length = m.common * o.length AND o.length > m.length))
  GROUP BY r)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base,
       base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
       coalesce(list_aggregate(list_sort(base.labels), 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list_distinct(list_concat(base.labels, found.labels))), 'string_agg', ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


ORACLES["op8_license_scan"] = _license_sql()

ORACLES["op11_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
p AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS head,
         regexp_replace(role, '([<\[])(\\*)(@)', '\1\\\2\3', 'g') AS e_role,
         regexp_replace(text, '([<\[])(\\*)(@)', '\1\\\2\3', 'g') AS e_text
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(e_text) + CASE WHEN head THEN length('<|im_start|><|im_sep|><|im_end|>') + length(e_role)
                            ELSE length('<|im_more|>') END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
""".replace("@", r"\|im_(?:start|sep|more|end)\|>|/?s>|/?INST\]|/?SYS>>|\|endoftext\|>|\|begin_of_text\|>|\|end_of_text\|>"
                 r"|\|start_header_id\|>|\|end_header_id\|>|\|eot_id\|>")

ORACLES["op12_prefix_trie"] = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')))
           - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id, bit by bit
h AS (
  SELECT conv_id, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1),
                                                            lambda i: ascii(substr(conv_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
           lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)),
                                    lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)),
         4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
k AS (SELECT h.*, least(h.h, (SELECT count(*) FROM o WHERE o.conv_id = h.conv_id - h.conv_id % 20)) AS k FROM h),
t AS (
  SELECT k.conv_id, o.p, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id - k.conv_id % 20 AND o.p < k.k
  UNION ALL
  SELECT k.conv_id, o.p - k.h + k.k, o.role, o.text FROM k JOIN o USING (conv_id) WHERE o.p >= k.h),
-- the path to a node: one digest a turn, behind one another; the root's is empty
s AS (
  SELECT conv_id, p + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY p) AS path
  FROM t
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
last AS (SELECT conv_id, max(depth) AS depth FROM s GROUP BY conv_id),
n AS (
  SELECT path, any_value(s.depth) AS depth, min(s.conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
         sha256(coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (WHERE last.depth = s.depth), ''))
           AS ends_sha256
  FROM s JOIN last USING (conv_id) GROUP BY path),
c AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c USING (path)),
sub AS (
  SELECT x.path, sum((m.n_children = 0)::INTEGER) AS n_leaves, sum((m.n - 1) * m.words) AS saved
  FROM m JOIN (SELECT DISTINCT s.path AS below, x.path FROM s JOIN s x ON x.conv_id = s.conv_id AND x.depth <= s.depth) x
    ON m.path = x.below
  GROUP BY x.path)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children,
       sub.n_leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN sub USING (path) LEFT JOIN m u ON m.depth > 0 AND u.path = left(m.path, length(m.path) - 32)
"""

ORACLES["op13_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM t, c GROUP BY term),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i)
  GROUP BY item_id, text, term),
s AS (
  SELECT q.item_id, q.text, d.doc_id, d.r,
         sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * len(d.terms) * c.n_docs) // c.n_terms))))
           ::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (r), c
  GROUP BY q.item_id, q.text, d.doc_id, d.r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s WHERE score > 0)
WHERE rank <= 10
"""
