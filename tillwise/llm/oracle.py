"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# Patterns without the run guards of the operator: RE2 has neither look-behind nor possessive runs.
PII = r"""
WITH cut AS (
  SELECT doc_id, kind, pos,
         regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS s
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents),
       (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
               (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
               (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
               (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
               (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b')) AS k(pos, kind, pattern)
),
matched AS (
  SELECT doc_id, kind, pos, i, m[i] AS match, s[i] AS before, s[i + 1] AS after,
         length(array_to_string(s[1:i], '')) + length(array_to_string(m[1:i], '')) AS stop
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)
),
judged AS (
  SELECT doc_id, kind, pos, stop - length(match) AS start, stop,
         right(before, 40) || ' ' || left(after, 40) AS near,
         CASE kind
           WHEN 'email' THEN true
           WHEN 'ip' THEN len(list_filter(string_split(match, '.'), lambda p: length(ltrim(p, '0')) < 4 AND coalesce(TRY_CAST(p AS HUGEINT), 999) <= 255)) = 4
           WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i:
             CASE WHEN i % 2 = 1 THEN (2 * CAST(digits[length(digits) - i] AS INT)) // 10 + (2 * CAST(digits[length(digits) - i] AS INT)) % 10
                  ELSE CAST(digits[length(digits) - i] AS INT) END)) % 10 = 0
           WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
           ELSE list_reduce(list_prepend(0, list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c: ascii(c))),
                            lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1
         END AS ok
  FROM (SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS digits, replace(match, ' ', '') AS plain FROM matched)
),
scored AS (
  SELECT *, CASE kind WHEN 'email' THEN 0.8 WHEN 'ip' THEN 0.6 WHEN 'card' THEN 0.7 WHEN 'phone' THEN 0.6 ELSE 0.8 END
    + CASE WHEN regexp_matches(near, CASE kind
        WHEN 'email' THEN '(?i)\b(e-?mail|mail|contact|write|reply)\b'
        WHEN 'ip' THEN '(?i)\b(ip|address|host|server|login)\b'
        WHEN 'card' THEN '(?i)\b(card|credit|debit|visa|payment|account)\b'
        WHEN 'phone' THEN '(?i)\b(phone|tel|telephone|call|mobile|fax)\b'
        ELSE '(?i)\b(iban|bank|account|transfer)\b' END) THEN 0.2 ELSE 0 END AS score
  FROM judged WHERE ok
)
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       count(*) FILTER (kind = 'iban') AS n_iban,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY pos, start) FILTER (kind <> 'iban'), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY pos, start), '') AS spans,
       coalesce(string_agg(CAST(CAST(score AS DOUBLE) AS VARCHAR), ',' ORDER BY pos, start), '') AS scores
FROM documents LEFT JOIN scored USING (doc_id) GROUP BY doc_id
"""

CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>' || role || chr(10) || '</s>')
                + CASE WHEN role = 'user' THEN length('[INST]  [/INST]') ELSE 0 END
                + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS key
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM (SELECT *, least(len(w), 13) AS n FROM i) WHERE n > 0)
),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, key)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
phrases AS (
  SELECT lang, m, w[k:k + m - 1] AS words, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k
        FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS sizes(m) WHERE len(w) >= m)
  GROUP BY lang, m, words HAVING count(*) >= 100
),
cuts AS (
  SELECT p.lang, p.words, p.m, k, p.f AS a, l.f AS l, r.f AS r, n,
         CAST((1000 * CAST(p.f AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM phrases) p
  JOIN phrases l ON l.lang = p.lang AND l.words = p.words[1:k]
  JOIN phrases r ON r.lang = p.lang AND r.words = p.words[k + 1:]
  JOIN totals t ON t.lang = p.lang
),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM cuts),
kept AS (
  SELECT * FROM worst c
  WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM phrases p
    WHERE p.lang = c.lang AND p.m > c.m AND 100 * p.f >= 100 * c.a
      AND contains(' ' || array_to_string(p.words, ' ') || ' ', ' ' || array_to_string(c.words, ' ') || ' '))
),
ranks AS (
  SELECT *, array_to_string(words, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks WHERE rank <= 2000
"""

SQL = {"op5_decontamination": DECONTAMINATION, "op7_pii": PII, "op9_chat": CHAT, "op10_exact_dedup": EXACT_DEDUP, "op12_collocations": COLLOCATIONS}
