"""SQL twin of the quality rules (the verdict does not depend on the cascade's order)."""

RULE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) shift(s) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper
  FROM docs JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR word_chars > 12 * n_words
    OR 2 * word_chars < 5 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 40 * word_chars) AS kept
FROM m
"""
