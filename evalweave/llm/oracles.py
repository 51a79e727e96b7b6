"""DuckDB SQL for the rows of the queries that SQL can express.

The others need XXH64, tokenizers, suffixes beyond counting, eigenvectors or trained models; tests hold
those against brute force.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# An exact join of shingle sets, and the least document that links lead to.
OP3_SQL = f"""WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({FOLDED}, '{WORD}'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""

# Repeated grams of eight words, grown word by word as long as they stay repeated.
OP4_SQL = f"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM texts)),
three AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS times FROM (
  SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
  WHERE pos <= n - 2),
twice AS (SELECT doc_id, count(DISTINCT pos + k) AS words FROM three, range(0, 3) x(k) WHERE times > 1 GROUP BY doc_id),
grams AS (
  SELECT doc_id, pos, n, length, gram FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (
    SELECT doc_id, pos, n, 8 AS length, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS gram
    FROM words) WHERE pos + 7 <= n) WHERE times > 1
  UNION ALL
  SELECT doc_id, pos, n, length, gram FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (
    SELECT g.doc_id, g.pos, g.n, g.length + 1 AS length, md5(g.gram || ' ' || w.word) AS gram
    FROM grams g JOIN words w ON w.doc_id = g.doc_id AND w.pos = g.pos + g.length)) WHERE times > 1),
repeats AS (SELECT doc_id, count(DISTINCT pos + k) AS covered FROM grams, range(0, 8) x(k) WHERE length = 8 GROUP BY doc_id),
longest AS (SELECT doc_id, max(length) AS longest FROM grams GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
measured AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
  coalesce(t.words, 0)::BIGINT AS n_repeat_words, coalesce(covered, 0)::BIGINT AS covered_words, coalesce(longest, 0)::BIGINT AS longest_repeat
  FROM texts LEFT JOIN counted USING (doc_id) LEFT JOIN doubled d USING (doc_id) LEFT JOIN twice t USING (doc_id)
    LEFT JOIN repeats USING (doc_id) LEFT JOIN longest USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * covered_words > 40 * n_words OR longest_repeat > 100) AS kept
FROM measured"""

# The draws by MD5, the water filling over sources, and prefix sums in the order of the keys.
OP6_SQL = f"""WITH sized AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
named AS (SELECT *, md5(coalesce(md5(doc_id::VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS identity FROM sized),
numbered AS (SELECT *, row_number() OVER (PARTITION BY identity) - 1 AS copy FROM named),
drawn AS (SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('0:' || identity || ':' || copy), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / (CASE WHEN size < 50 THEN 0.5 ELSE 1 END::DOUBLE
      * CASE WHEN coalesce(length(text), 0) / greatest(size, 1) BETWEEN 3 AND 12 THEN 1 ELSE 0.5 END::DOUBLE) AS key
  FROM numbered),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
    (3 * source_size)::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS FIRST)),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed"""


def _whole_vectors(table: str = "embeddings") -> str:
    """Rows with an id and a vector of finite parts, the parts scaled and floored."""
    return f"""SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, label
      FROM {table} WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


OP10_SQL = f"""WITH rows AS ({_whole_vectors()}),
  asked AS (SELECT DISTINCT vec_id, v FROM rows WHERE vec_id % 50 = 0),
  scored AS (SELECT q.vec_id AS query_id, q.v, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
    FROM asked q JOIN rows d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5"""

OP11_SQL = f"""WITH rows AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
    FROM ({_whole_vectors()}) WHERE label IS NOT NULL),
  asked AS (SELECT DISTINCT vec_id, v, label FROM rows WHERE vec_id % 100 = 0),
  scored AS (SELECT q.vec_id AS anchor_id, q.v, q.label, d.vec_id, q.label = d.label AS same,
      list_inner_product(q.v, d.v)::BIGINT AS score
    FROM asked q JOIN rows d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
  best AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, v, label ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same),
  inside AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
      n.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.v, p.label, p.place ORDER BY n.score DESC, n.vec_id) AS place
    FROM best p JOIN scored n ON p.anchor_id = n.anchor_id AND p.v = n.v AND p.label = n.label AND NOT n.same
      AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    WHERE p.place <= 5)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
FROM inside WHERE place <= 10"""

ORACLES = {
    "op3_tensored_minhash": OP3_SQL,
    "op4_suffix_repetition": OP4_SQL,
    "op6_exponential_mix": OP6_SQL,
    "op10_cover_tree_search": OP10_SQL,
    "op11_slot_hard_negatives": OP11_SQL,
}
