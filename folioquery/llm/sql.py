"""DuckDB SQL for those of the subpackage's queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

PHRASES = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words
    FROM documents)),
w AS (SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS spot FROM pieces),
three AS (SELECT lang, w AS w1, lead(w) OVER (PARTITION BY piece ORDER BY spot) AS w2, lead(w, 2) OVER (PARTITION BY piece ORDER BY spot) AS w3 FROM w),
one AS (SELECT lang, w1, count(*) AS f FROM three GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
pairs AS (SELECT lang, w1, w2, count(*) AS f FROM three WHERE w2 IS NOT NULL GROUP BY ALL),
triples AS (SELECT lang, w1, w2, w3, count(*) AS f FROM three WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM triples UNION ALL SELECT lang, w2, w3, f FROM triples) GROUP BY ALL),
kept AS (SELECT p.* FROM pairs p LEFT JOIN longer x USING (lang, w1, w2) WHERE p.f >= 10 AND (x.f IS NULL OR 100 * x.f < 50 * p.f)),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS cut, p.f AS a, x.f AS l, y.f AS r
  FROM kept p JOIN one x ON x.lang = p.lang AND x.w1 = p.w1 JOIN one y ON y.lang = p.lang AND y.w1 = p.w2
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM triples t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN pairs y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM triples t JOIN pairs x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
sized AS (SELECT row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
stats AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM sized),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
weighed AS (SELECT item, item_id, term, times * floor(1000 * ln((2 * total + 2) / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), stats),
m AS (SELECT row, doc_id, 100 - 25 + (25 * n * total) // length AS m FROM sized, stats),
scored AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM weighed JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": EXACT_DEDUP, "op11_phrases": PHRASES, "op13_search": SEARCH}
