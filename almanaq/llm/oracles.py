"""DuckDB SQL of the operators that SQL can express; the others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

OP2 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM n WINDOW w AS (PARTITION BY sha ORDER BY len DESC, doc_id)
"""

#: Every contiguous phrase of up to four words inside a piece, counted in full. DuckDB's integers have 128 bits here.
OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words WHERE len(w) > 0),
grams AS (SELECT lang, w[s : s + k - 1] AS p FROM starts, (VALUES (1), (2), (3), (4)) AS v(k) WHERE s + k - 1 <= len(w)),
counts AS (SELECT lang, p, count(*) AS c FROM grams GROUP BY lang, p HAVING count(*) >= 30),
candidates AS (SELECT lang, p, c AS a FROM counts WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.c AS l, r.c AS r, (2000000 * c.a::HUGEINT) // (l.c + r.c) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.p = c.p[1 : c.k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.k + 1 :]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
spans AS (SELECT lang, p, a, s, e FROM candidates, (VALUES (1), (2), (3)) AS v(s), (VALUES (2), (3), (4)) AS u(e) WHERE e > s AND e <= len(p) AND e - s + 1 < len(p)),
around AS (SELECT lang, p[s : e] AS p, max(a) AS longer FROM spans GROUP BY ALL),
free AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.p = b.p WHERE o.longer IS NULL OR 100 * o.longer::HUGEINT < 80 * b.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

#: Scores every document for every item.
OP13 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
whole AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
posting AS (SELECT doc_id, n, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
impact AS (
  SELECT doc_id, term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS w
  FROM posting JOIN df USING (term), whole),
scores AS (SELECT item_id, doc_id, sum(w)::BIGINT AS score FROM q JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(w) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2, "op12_collocations": OP12, "op13_lexical_search": OP13}
