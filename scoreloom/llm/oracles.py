"""SQL that DuckDB can run for the queries that SQL can express."""

OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT row, i, array_to_string(words[i:i+7], ' ') AS key
  FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT row, key FROM windows GROUP BY row, key HAVING count(*) > 1
), repeated AS (
  SELECT row, count(DISTINCT i + j) AS n
  FROM windows JOIN twice USING (row, key), range(0, 8) AS r(j) GROUP BY row
), m AS (
  SELECT w.doc_id,
         CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
  FROM w LEFT JOIN repeated USING (row)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 10 * n_dup_lines > 4 * n_lines
            OR 10 * n_letter_words < 6 * n_words
            OR 10 * n_upper > 4 * n_letters
            OR 10 * n_stutters > 2 * n_words) AS kept
FROM b
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang
), runs AS (
  SELECT lang, k, array_to_string(words[i:i+k-1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS s(k) WHERE len(words) >= k)
), f AS (
  SELECT lang, k AS words, phrase, CAST(count(*) AS HUGEINT) AS a FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 100
), inner_phrases AS (
  SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i+m-1], ' ') AS phrase
  FROM (SELECT lang, phrase, words, a, m, unnest(range(1, words - m + 2)) AS i FROM f, range(2, 5) AS s(m) WHERE m < words)
), around AS (
  SELECT lang, phrase, max(a) AS around FROM inner_phrases GROUP BY lang, phrase
), cuts AS (
  SELECT f.lang, f.phrase, f.a, k, array_to_string(string_split(f.phrase, ' ')[1:k], ' ') AS l_phrase, array_to_string(string_split(f.phrase, ' ')[k+1:], ' ') AS r_phrase
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1) AS f LEFT JOIN around USING (lang, phrase)
  WHERE around IS NULL OR 100 * around < 100 * f.a
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.a * n) // (l.a * r.a), k) AS cut
  FROM cuts AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = c.l_phrase
  JOIN f AS r ON r.lang = c.lang AND r.phrase = c.r_phrase
  JOIN totals AS t ON t.lang = c.lang
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE cut = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
