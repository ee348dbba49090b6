"""SQL shared by several queries: the greedy tokenization of all documents as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.cluster import documents, table
from lexmill.operators.curation import parsed

#: Vocabulary variants, as conditions that Spark and DuckDB both read.
VARIANTS = {"full": "true", "short": "kind = 'byte' OR length(piece) <= 3", "led": "kind = 'byte' OR piece LIKE ' %'"}


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d)


def candidates_of(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The candidates that have a text, those that came as raw JSON included."""
    return parsed(table(spark, d, "merge_candidates_final_v1"), *more).where("text is not null")


def variant(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, "vocab").where(VARIANTS[name])


def matches(name: str = "full", prefix: str = "", source: str = "documents") -> str:
    """CTEs lit, m (doc_id, shard_name, ix, x, id): greedy matches, id null where bytes stand in."""
    return rf"""
{prefix}lit AS (SELECT piece, min(id) AS id FROM vocab WHERE NOT regexp_matches(piece, '^<0x[0-9A-Fa-f]{{2}}>$') AND ({VARIANTS[name]}) GROUP BY piece),
{prefix}pat AS (SELECT string_agg(regexp_escape(piece), '|' ORDER BY length(piece) DESC, piece) || '|(?s:.)' AS p FROM {prefix}lit),
{prefix}cut AS (SELECT doc_id, shard_name, regexp_extract_all(coalesce(text, ''), (SELECT p FROM {prefix}pat)) AS m FROM {source}),
{prefix}m AS (SELECT c.doc_id, c.shard_name, c.ix, c.x, l.id FROM (SELECT doc_id, shard_name, unnest(m) AS x, generate_subscripts(m, 1) AS ix FROM {prefix}cut) c LEFT JOIN {prefix}lit l ON c.x = l.piece)"""


def counts(name: str = "full", prefix: str = "") -> str:
    """matches() and a CTE n: the token counts of each document."""
    return rf"""{matches(name, prefix)},
{prefix}n AS (SELECT d.doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT AS n_bytes,
  coalesce(sum(CASE WHEN x IS NULL THEN 0 WHEN id IS NULL THEN octet_length(encode(x)) ELSE 1 END), 0)::BIGINT AS n_tokens,
  coalesce(sum(CASE WHEN x IS NOT NULL AND id IS NULL THEN octet_length(encode(x)) ELSE 0 END), 0)::BIGINT AS fallback_tokens,
  count(*) FILTER (x IS NOT NULL AND id IS NULL AND (before_at IS NULL OR before_id IS NOT NULL))::BIGINT AS fallback_runs
  FROM documents d LEFT JOIN (SELECT *, lag(id) OVER w AS before_id, lag(ix) OVER w AS before_at FROM {prefix}m WINDOW w AS (PARTITION BY doc_id ORDER BY ix)) q USING (doc_id) GROUP BY d.doc_id, d.text)"""


TOKENS = rf"""{matches()},
tok AS (SELECT doc_id, shard_name, ix, 0 AS byte_no, id, x AS piece, false AS is_byte FROM m WHERE id IS NOT NULL
  UNION ALL SELECT doc_id, shard_name, ix, b.i AS byte_no, v.id, '<0x' || substr(hex(encode(x)), 2 * b.i + 1, 2) || '>' AS piece, true AS is_byte
  FROM m, unnest(range(octet_length(encode(x)))) AS b(i) JOIN vocab v ON upper(v.piece) = '<0X' || substr(hex(encode(x)), 2 * b.i + 1, 2) || '>' WHERE m.id IS NULL)"""


_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def metrics_sql(key: str) -> str:
    """CTEs over t(key, t): `measured` holds the figures of each text."""
    kept = lambda c: f"length(regexp_replace(t, '[^{c}]+', '', 'g'))"
    part = lambda c: f"CASE WHEN n > 0 THEN round({c} / n, 6) ELSE 0.0 END"
    odd = r"length(regexp_replace(regexp_replace(t, '[^\p{C}\p{Z}]+', '', 'g'), '[" + _WS + "]+', '', 'g'))"
    unique = "len(list_distinct(list_transform(w, lambda x: lower(x))))"
    return rf"""cut AS (SELECT {key}, t, length(t) AS n, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS w, string_split(t, '') AS c, list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WS}]')) AS l FROM t),
measured AS (SELECT {key}, n::INT AS decoded_chars, len(w)::INT AS decoded_words, {unique}::INT AS unique_words, CASE WHEN len(w) > 0 THEN round({unique} / len(w), 6) ELSE 0.0 END AS unique_word_ratio,
  {part(kept(r"\x00-\x7f"))} AS ascii_ratio, {part(kept(_WS))} AS whitespace_ratio, {part(kept(r"\p{Nd}"))} AS digit_ratio, {part("(n - " + kept(r"\p{L}\p{N}" + _WS) + ")")} AS punctuation_ratio, {part(odd)} AS non_printable_ratio,
  len(regexp_extract_all(t, '(?i)https?://|www\.'))::INT AS url_hits, len(regexp_extract_all(t, '<[^>]+>'))::INT AS html_hits,
  len(list_filter(range(1, n + 1), lambda i: c[i] <> chr(10) AND (i = 1 OR c[i - 1] <> c[i]) AND c[i + 1] = c[i] AND c[i + 2] = c[i] AND c[i + 3] = c[i] AND c[i + 4] = c[i]))::INT AS repeated_char_hits,
  len(l)::INT AS line_count, CASE WHEN len(l) > 0 THEN round(list_sum(list_transform(l, lambda x: length(x))) / len(l), 6) ELSE 0.0 END AS avg_line_length FROM cut)"""
