"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

P1_TERMS = rf"""
WITH rows AS (
  SELECT DISTINCT hit_id, doc_id, hits, trim(regexp_replace(translate(lower(text), '‘’', ''''''), '[{_WS}]+', ' ', 'g')) AS term
  FROM ngram_hits WHERE text IS NOT NULL),
docs AS (SELECT count(DISTINCT doc_id) AS n FROM rows),
counts AS (SELECT term, CAST(sum(hits) AS BIGINT) AS freq, count(DISTINCT doc_id) AS doc_freq FROM rows WHERE term <> '' GROUP BY term)
SELECT term, freq, doc_freq, CASE WHEN freq < 5 OR doc_freq < 3 THEN 'rare' WHEN doc_freq > 0.2 * n THEN 'common' END AS mark
FROM counts, docs
"""

P1_FOUND = f"SELECT term, mark FROM ({P1_TERMS}) WHERE mark IS NOT NULL"

_STATS = rf"""
WITH t AS (SELECT doc_id, text AS t FROM documents WHERE regexp_matches(text, '[^{_WS}]')),
w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w,
  list_filter(list_transform(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS l,
  length(regexp_replace(t, '[{_WS}]+', '', 'g')) AS ink, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS alnum FROM t),
c AS (SELECT array_agg(word) AS common FROM common_words),
f AS (SELECT doc_id, ink, alnum, len(w) AS nw, len(list_filter(w, lambda x: list_contains(common, x))) AS nc,
  list_sum(list_transform(w, lambda x: length(x))) AS wc, len(l) AS nl, list_sum(list_transform(l, lambda x: length(x))) AS lc,
  len(list_filter(l, lambda x: regexp_matches(x, '[.!?…]["''”’)\]]*$'))) AS ended FROM w, c)
"""

P2_FOUND = (
    _STATS
    + """
SELECT doc_id FROM f WHERE (ink - alnum) > 0.22 * ink OR (nl >= 4 AND lc / nl < 45 AND ended / nl < 0.3)
  OR (nw >= 20 AND nc / nw < 0.15) OR (nw >= 5 AND (wc / nw < 2.5 OR wc / nw > 9.5))
"""
)

P2_METRICS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, length(t) AS n, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS w,
  list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WS}]')) AS l FROM t)
SELECT doc_id, CAST(n AS INT) AS decoded_chars, CAST(len(w) AS INT) AS decoded_words,
  CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS INT) AS unique_words,
  CASE WHEN len(w) > 0 THEN round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w), 6) ELSE 0.0 END AS unique_word_ratio,
  CASE WHEN n > 0 THEN round(length(regexp_replace(t, '[^\x00-\x7f]+', '', 'g')) / n, 6) ELSE 0.0 END AS ascii_ratio,
  CASE WHEN n > 0 THEN round(length(regexp_replace(t, '[^{_WS}]+', '', 'g')) / n, 6) ELSE 0.0 END AS whitespace_ratio,
  CASE WHEN n > 0 THEN round(length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) / n, 6) ELSE 0.0 END AS digit_ratio,
  CASE WHEN n > 0 THEN round((n - length(regexp_replace(t, '[^\p{{L}}\p{{N}}{_WS}]+', '', 'g'))) / n, 6) ELSE 0.0 END AS punctuation_ratio,
  CASE WHEN n > 0 THEN round(length(regexp_replace(regexp_replace(t, '[^\p{{C}}\p{{Z}}]+', '', 'g'), '[{_WS}]+', '', 'g')) / n, 6) ELSE 0.0 END AS non_printable_ratio,
  CAST(len(regexp_extract_all(t, '(?i)https?://|www\.')) AS INT) AS url_hits, CAST(len(regexp_extract_all(t, '<[^>]+>')) AS INT) AS html_hits,
  CAST(len(l) AS INT) AS line_count,
  CASE WHEN len(l) > 0 THEN round(list_sum(list_transform(l, lambda x: length(x))) / len(l), 6) ELSE 0.0 END AS avg_line_length
FROM w
"""

P3_FOUND = rf"""
WITH t AS (SELECT doc_id, text AS t, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE regexp_matches(text, '[^{_WS}]')),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) >= 30),
phrases AS (SELECT doc_id FROM g GROUP BY doc_id HAVING count(*) - count(DISTINCT g) >= 0.25 * count(*)),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM t),
r AS (SELECT doc_id, c, i, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM c WHERE NOT regexp_matches(c, '^[{_WS}]+$')),
l AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, c, run HAVING count(*) >= 5),
runs AS (SELECT doc_id FROM l JOIN t USING (doc_id) GROUP BY doc_id, t HAVING sum(n) >= 0.15 * length(t))
SELECT doc_id FROM phrases UNION SELECT doc_id FROM runs
"""

P4_FOUND = r"""
WITH once AS (SELECT * FROM shard_summaries QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY loaded_at NULLS LAST) = 1),
p AS (SELECT shard_id * 1000 + i - 1 AS k, regexp_extract(lower(shard_name), '_(train|val|test)_', 1) AS split,
  regexp_extract_all(lower(sample_previews[i]), '[\p{L}\p{N}]+') AS w
  FROM once, unnest(generate_series(1, len(sample_previews))) AS u(i)),
s AS (SELECT k, split, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM p WHERE len(w) >= 8 AND split <> ''),
g AS (SELECT k, split, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT t.k AS tk, e.k AS ek, t.n AS tn, e.n AS en, count(*) AS c
  FROM g t JOIN g e ON t.g = e.g AND t.split = 'train' AND e.split <> 'train' GROUP BY ALL)
SELECT least(tk, ek) AS preview_a, greatest(tk, ek) AS preview_b FROM pairs WHERE 2 * c >= tn + en - c
"""

P4_REPORT = r"""
WITH once AS (SELECT * FROM shard_summaries QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY loaded_at NULLS LAST) = 1),
p AS (SELECT shard_id * 1000 + i - 1 AS k, regexp_extract(lower(shard_name), '_(train|val|test)_', 1) AS split, lower(trim(source)) AS source,
  regexp_extract_all(lower(sample_previews[i]), '[\p{L}\p{N}]+') AS w FROM once, unnest(generate_series(1, len(sample_previews))) AS u(i)),
s AS (SELECT k, split, source, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM p WHERE len(w) >= 8 AND split <> ''),
g AS (SELECT k, split, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT t.k AS tk, e.k AS ek, t.n AS tn, e.n AS en, count(*) AS c FROM g t JOIN g e ON t.g = e.g AND t.split = 'train' AND e.split <> 'train' GROUP BY ALL),
best AS (SELECT ek AS k, max(c / (tn + en - c)) AS similarity FROM pairs WHERE 2 * c >= tn + en - c GROUP BY ek)
SELECT split, coalesce(source, 'unknown') AS source, count(*) AS previews, count(similarity) AS found, count(*) FILTER (similarity = 1) AS identical, round(max(similarity), 6) AS best_similarity
FROM s LEFT JOIN best USING (k) WHERE split <> 'train' GROUP BY 1, 2
"""

_P5 = r"""
WITH parsed AS (
  SELECT cand_id, CASE WHEN record IS NOT NULL THEN CAST(record->>'$.n' AS INT) ELSE n END AS n,
    CASE WHEN record IS NOT NULL THEN CAST(record->'$.ids' AS INT[]) ELSE ids END AS ids,
    CASE WHEN record IS NOT NULL THEN CAST(record->>'$.freq' AS BIGINT) ELSE freq END AS freq,
    CASE WHEN record IS NOT NULL THEN record->>'$.class' ELSE class END AS class,
    regexp_replace(lower(CASE WHEN record IS NOT NULL THEN record->>'$.text' ELSE text END), '[^\p{L}\p{N}]+', '', 'g') AS canon
  FROM merge_candidates_final_v1),
groups AS (SELECT n, ids, freq, class, canon, min(cand_id) AS keep_id, count(*) AS n_copies, array_agg(cand_id) AS members FROM parsed GROUP BY ALL)
"""

P5_FOUND = _P5 + "SELECT keep_id, copy_id FROM (SELECT keep_id, unnest(members) AS copy_id FROM groups) WHERE keep_id <> copy_id"
P5_KEPT = _P5 + "SELECT keep_id, n_copies FROM groups"
