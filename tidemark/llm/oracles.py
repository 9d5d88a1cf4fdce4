"""DuckDB SQL for the operators that SQL can express, over the same tables.

Encoding with a vocabulary file, extraction, packing, pseudonyms, planes and the
fitted severity model are compared with brute-force versions in ``tests/llm``.
"""

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS.format(text="text")} AS words FROM documents
), windows AS (
  SELECT r, i, words[i:i + 4] AS gram FROM d, unnest(range(1, len(words) - 3)) AS t(i)
), repeated AS (
  SELECT w.r, w.i FROM windows w JOIN (SELECT r, gram FROM windows GROUP BY r, gram HAVING count(*) > 1) g USING (r, gram)
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM repeated, unnest(range(0, 5)) AS t(o) GROUP BY r
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), dup AS (
  SELECT r, sum(n - 1) AS n FROM lines GROUP BY r
), counts AS (
  SELECT r, doc_id, source, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)
), tested AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 10 * n_symbols > 3 * n_words AS symbols,
    n_dup_lines >= 5 AS dup_lines, n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS word_length
  FROM counts
), hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS f
  FROM (UNPIVOT tested ON base, symbols, dup_lines, word_length INTO NAME rule VALUE failed) WHERE source IS NOT NULL
  GROUP BY source, rule
), moments AS (
  SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(f) / sum(n)::DOUBLE AS mean,
    sum(n::DOUBLE * n) AS docs_squared, sum(f::DOUBLE * f / n) AS rate_squared FROM hosts GROUP BY rule
), spread AS (
  SELECT *, mean * (1 - mean) AS s, docs - docs_squared / docs AS room FROM moments
), strength AS (
  SELECT rule, mean, CASE WHEN s <= 0 OR room <= 0 THEN 1e6
    ELSE 1 / least(greatest((rate_squared - docs * mean * mean - (hosts - 1) * s) / room / s, 1 / (1e6 + 1)), 0.5) - 1 END AS k
  FROM spread
), rejected AS (
  SELECT DISTINCT source FROM hosts JOIN strength USING (rule) WHERE (f + mean * k) / (n + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM tested
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, html, first, CAST(unhex(sha1(html)) AS BIT)::VARCHAR AS bits FROM p JOIN firsts USING (html))
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_sum(list_transform(range(5), lambda b: CASE WHEN substr(bits, (5 * i + b + 1)::INT, 1) = '1' THEN 1 << (4 - b)::INT ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d
"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), valid AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b
)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM v JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) ON id = vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
"""

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, words[i:i + 4] AS gram FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM documents JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) ON id = documents.doc_id
LEFT JOIN sizes ON sizes.doc_id = documents.doc_id
"""

ORACLES = {"op1_host_quality": OP1, "op6_warc_bundles": OP6, "op7_vector_tiles": OP7, "op10_ngram_join": OP10}
