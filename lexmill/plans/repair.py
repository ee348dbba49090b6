"""Repair of a vocabulary from the documents it segments worst, and the predicates of the repair.

The SQL states the rules in literals of its own; nothing is taken over from the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.operators import refine
from lexmill.operators.tokens import greedy_counts
from lexmill.plans.common import counts, docs_of, variant

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOK = r"[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*|[,:;.!?()/%&]+"
_LABELS = "('Chapter','Section','Volume','Act','Scene','Article','Part','Book','Page','Terms','Conditions','Summary','Introduction','Appendix','Table','Figure','Transcript','Episode','NEWS','THE','Text')"
_GLUE = "('the','and','is','to','of','in','on','for','a','an','or','as','at','by','be','with','from','that','this','these','those','it','its','he','she','they','we','you')"
_STARTERS = "('This is','There is','There are','If you','I have','We have','It is','When the','What is','How to','In this')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _heading(s: str) -> str:
    up, al = (f"length(regexp_replace({s}, '[^\\p{{{c}}}]+', '', 'g'))" for c in ("Lu", "L"))
    return f"(length({s}) >= 4 AND ((regexp_matches({s}, '\\p{{Lu}}') AND NOT regexp_matches({s}, '[\\p{{Ll}}\\p{{Lt}}]')) OR ({al} >= 4 AND {up} >= {al} * 0.55)))"


# x: piece, s (stripped), t (tokens), first -> the predicates
_TESTS = rf"""tests AS (SELECT *, (al + dg >= 4 AND al >= 2) AS has_signal,
  starts_with(piece, chr(10)) AND (coalesce(first, '') IN {_LABELS} OR (regexp_matches(first, '[A-Z]') AND NOT regexp_matches(first, '[a-z]') AND length(first) >= 3)) AS is_structural_break,
  array_to_string(t[1:2], ' ') IN {_STARTERS} AS is_sentence_start, len(t) = 1 AND regexp_matches(first, '^[A-Z]') AND first NOT IN {_LABELS} AS is_proper_noun, {_heading("s")} AS heading
  FROM (SELECT *, t[1] AS first, length(regexp_replace(s, '[^\p{{L}}]+', '', 'g')) AS al, length(regexp_replace(s, '[^\p{{Nd}}]+', '', 'g')) AS dg FROM (SELECT *, {_strip("piece")} AS s, regexp_extract_all(piece, '{_TOK}') AS t FROM x))),
told AS (SELECT *, length(s) < 4 OR lower(s) IN {_GLUE} OR lower(s) IN ('ing','ed','er','ly','s','es','ion','tion','ment') OR regexp_matches(s, '^[a-z]{{1,2}}\s[a-z]{{1,2}}$') OR contains(s, '  ') OR NOT has_signal
  OR is_sentence_start OR coalesce(is_proper_noun, false) OR (len(t) >= 4 AND NOT coalesce(is_structural_break, false) AND NOT heading) AS says_little FROM tests)"""


@query(
    "piece_predicates",
    f"WITH x AS (SELECT id, piece FROM vocab), {_TESTS} SELECT id, piece, has_signal, coalesce(is_structural_break, false) AS is_structural_break, is_sentence_start, coalesce(is_proper_noun, false) AS is_proper_noun, says_little FROM told",
)
def piece_predicates(spark: SparkSession, d: str) -> DataFrame:
    return refine.piece_predicates(table(spark, d, "vocab").select("id", "piece"))


_WORST = f"""{counts("full", "a_")}, {counts("short", "b_")},
worst AS (SELECT doc_id, b_n.n_tokens - a_n.n_tokens AS delta FROM a_n JOIN b_n USING (doc_id) WHERE delta > 0 ORDER BY delta DESC, doc_id LIMIT 300)"""
_SPANS = rf"""ln AS (SELECT doc_id, delta, line, regexp_extract_all(line, '{_TOK}') AS t FROM (SELECT doc_id, delta, {_strip("line")} AS line FROM (SELECT doc_id, delta, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents JOIN worst USING (doc_id)))),
st AS (SELECT *, {_heading("line")} OR t[1] IN {_LABELS} OR (regexp_matches(t[1], '[A-Z]') AND NOT regexp_matches(t[1], '[a-z]')) AS structural FROM ln WHERE len(t) > 0),
c AS (SELECT doc_id, delta, 5 AS w, array_to_string(t[1:n], ' ') AS p FROM st, range(1, 6) r(n) WHERE n <= len(t)
  UNION ALL SELECT doc_id, delta, 2, array_to_string(t[i:i + n - 1], ' ') FROM (SELECT doc_id, delta, t, unnest(range(1, len(t) + 1)) AS i FROM st), range(2, 5) r(n) WHERE i + n - 1 <= len(t)
  UNION ALL SELECT doc_id, delta, 4, unnest(regexp_extract_all(array_to_string(t, ' '), '[,:;]\s+[A-Za-z][A-Za-z0-9''’\-]+(?:\s+[A-Za-z0-9''’\-]+){{0,2}}')) FROM st
  UNION ALL SELECT doc_id, delta, 8, chr(10) || array_to_string(t[1:n], ' ') FROM st, range(1, 5) r(n) WHERE structural AND n <= len(t)
  UNION ALL SELECT doc_id, delta, 6, array_to_string(t[1:n], ' ') AS p FROM st, range(2, 5) r(n) WHERE n <= len(t) AND array_to_string(t[1:n], ' ') IN ('is the', 'with a', 'have been', 'into the', 'through the', 'of the', 'and the')),
g AS (SELECT substr(p, 1, 24) AS piece, sum(w * greatest(1, floor(sqrt(delta))))::BIGINT AS raw_count, count(DISTINCT doc_id) AS doc_hits FROM c GROUP BY 1),
x AS (SELECT *, greatest(1, floor(raw_count * greatest(length(piece) - 1, 1) / 10))::BIGINT AS est_savings FROM g WHERE doc_hits >= 3)"""
_SCORED = rf"""WITH {_WORST}, {_SPANS}, {_TESTS}, scored AS (SELECT piece, raw_count, doc_hits, est_savings, round(est_savings + 2.5 * doc_hits + 0.08::DOUBLE * length(piece)
  + CASE WHEN is_structural_break THEN 12 WHEN contains(piece, chr(10)) THEN -8 ELSE 0 END + CASE WHEN heading THEN 7 ELSE 0 END + CASE WHEN NOT coalesce(is_structural_break, false) AND regexp_matches(s, '^\p{{Lu}}') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(s, '\S\s+\S') THEN 3 ELSE 0 END + CASE WHEN dg > 0 THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(piece, '[:;,.!?()\[\]{{}}''"/\-]') THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(s, '^[a-z]{{4,8}}$') THEN 6 ELSE 0 END - CASE WHEN lower(s) IN {_GLUE} THEN 12 ELSE 0 END - CASE WHEN is_sentence_start THEN 20 ELSE 0 END - CASE WHEN is_proper_noun THEN 20 ELSE 0 END, 4)::DOUBLE AS weighted_score
  FROM told WHERE length(piece) BETWEEN 4 AND 24 AND NOT says_little AND piece NOT IN (SELECT piece FROM vocab WHERE kind = 'byte' OR length(piece) <= 3))"""


def _worst(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, delta of the 300 documents that lose most under the shorter vocabulary."""
    docs = docs_of(spark, d)
    n = [greedy_counts(docs, variant(spark, d, v)).select("doc_id", F.col("n_tokens").alias(v)) for v in ("full", "short")]
    worst = n[0].join(n[1], "doc_id").withColumn("delta", F.col("short") - F.col("full")).where("delta > 0").orderBy(F.desc("delta"), "doc_id").limit(300).select("doc_id", "delta")
    return keep(docs.join(F.broadcast(worst), "doc_id").select("doc_id", "text", "delta"), "worst")


@query("worst_doc_candidates", f"{_SCORED} SELECT * FROM scored")
def worst_doc_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that would shorten the documents that lose most, by all five kinds of candidates."""
    return refine.scored_candidates(_worst(spark, d), variant(spark, d, "short"))


_REMOVALS = rf"""SELECT id, piece, round(length(piece) * 1.1::DOUBLE + CASE WHEN contains(piece, ' ') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, '\S\s+\S') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(s, '^\p{{Ll}}') THEN 1 ELSE 0 END + CASE WHEN length(piece) >= 8 THEN 2 ELSE 0 END, 4)::DOUBLE AS score
FROM (SELECT id, piece, kind, {_strip("piece")} AS s FROM vocab) WHERE NOT regexp_matches(piece, '^<0x[0-9A-Fa-f]{{2}}>$') AND NOT contains(piece, chr(10)) AND length(piece) > 2 AND NOT regexp_matches(s, '^[A-Za-z]{{1,4}}$')
  AND piece NOT IN ('ing','ion','tion','ed','er','re','th','in',' the',' of',' and',', and',' to',' is','The','This',' of the',' and the','is the','with a','have been','into the','through the')"""


@query("removal_candidates", _REMOVALS)
def removal_candidates(spark: SparkSession, d: str) -> DataFrame:
    return refine.removal_candidates(table(spark, d, "vocab"))


@query(
    "vocabulary_repair",
    f"""{_SCORED}, a AS (SELECT *, row_number() OVER (ORDER BY weighted_score DESC, est_savings DESC, doc_hits DESC, length(piece) DESC, piece) AS place FROM scored), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM ({_REMOVALS})),
sw AS (SELECT r.id, r.piece AS replaced, a.piece AS added FROM a JOIN r USING (place) WHERE place <= 10) SELECT v.id, coalesce(added, v.piece) AS piece, replaced FROM vocab v LEFT JOIN sw USING (id)""",
)
def vocabulary_repair(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary with ten swaps: the best candidates of the worst documents for the pieces that go first."""
    vocab = table(spark, d, "vocab")
    scored = keep(refine.scored_candidates(_worst(spark, d), variant(spark, d, "short")), "scored")
    return refine.repaired(vocab, refine.swaps(scored, refine.removal_candidates(vocab)))
