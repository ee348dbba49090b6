"""Candidate curation over the whole candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.operators import curation as cu
from lexmill.plans.common import candidates_of, docs_of


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _or(column: str, pattern: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"{column} LIKE '" + pattern.format(v.replace("'", "''")) + "'" for v in values) + ")"


_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = r"[A-Za-z]+(?:[’''][A-Za-z]+)?"
# of the compatibility characters only these two occur in the tables
_NORM = f"trim(regexp_replace(translate(replace(replace(text, chr(160), ' '), '…', '...'), '’‘', ''''''), '{_WS}+', ' ', 'g'))"
_SHARES = r"""length(regexp_replace(t, '[^\p{Nd}]+', '', 'g')) / length(t) AS digits, (length(t) - length(regexp_replace(t, '[^\p{L}\p{N}\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', '', 'g'))) / length(t) AS puncts,
  length(regexp_replace(t, '[^\p{L}]+', '', 'g')) / length(t) AS alphas, len(regexp_extract_all(t, '[A-Za-z]+')) AS n, lower(t) AS low"""
#: Candidates from their columns, or from the raw record where there is one.
_READ = """SELECT cand_id, coalesce(try_cast(record AS JSON)->>'$.text', text) AS text, coalesce(try_cast(try_cast(record AS JSON)->>'$.freq' AS BIGINT), freq) AS freq, coalesce(try_cast(record AS JSON)->>'$.class', class) AS class FROM merge_candidates_final_v1"""
_TEXTS = f"SELECT cand_id, text FROM ({_READ}) WHERE text IS NOT NULL"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates_of(spark, d).select("cand_id", "text")


@query(
    "bigram_classes",
    f"""SELECT cand_id, CASE WHEN length(t) = 0 THEN 'reject_empty' WHEN t IN {_in(cu.CONTRACTIONS + cu.ALLOWED_BIGRAMS)} OR low IN {_in(cu.GOOD_PHRASES)} THEN 'keep_allowlist' WHEN {_or("t", "%{}%", cu.BAD_SUBSTRINGS)} THEN 'reject_bad_substring'
  WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 'reject_no_letters' WHEN digits >= 0.2 THEN 'reject_numeric_heavy' WHEN puncts >= 0.25 THEN 'reject_punct_heavy' WHEN n = 0 THEN 'reject_no_words' WHEN n > 2 THEN 'reject_too_many_words'
  WHEN n = 1 AND NOT regexp_matches(t, '^{_W}$') THEN 'reject_non_clean_single' WHEN n = 1 AND length(t) < 3 THEN 'reject_too_short_single' WHEN n = 1 THEN 'keep_single_word' WHEN NOT regexp_matches(t, '^{_W} {_W}$') THEN 'reject_non_clean_phrase'
  WHEN split_part(low, ' ', 1) IN {_in(cu.BOUNDARY_LETTERS)} OR split_part(low, ' ', 2) IN {_in(cu.BOUNDARY_LETTERS)} THEN 'reject_boundary_artifact' WHEN length(split_part(low, ' ', 1)) = 1 OR length(split_part(low, ' ', 2)) = 1 THEN 'reject_single_char_word' ELSE 'keep_phrase' END AS label
FROM (SELECT *, {_SHARES} FROM (SELECT cand_id, {_NORM} AS t FROM ({_TEXTS})))""",
)
def bigram_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("cand_id", cu.normalized(F.col("text")).alias("t"))
    return rows.select("cand_id", cu.bigram_class(F.col("t")).alias("label"))


@query(
    "trigram_classes",
    f"""SELECT cand_id, CASE WHEN length(t) = 0 THEN 'reject_empty' WHEN t IN {_in(cu.CONTRACTIONS)} THEN 'keep_contraction' WHEN {_or("t", "%{}%", cu.BAD_SUBSTRINGS)} THEN 'reject_bad_substring'
  WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 'reject_no_letters' WHEN digits >= 0.25 THEN 'reject_numeric_heavy' WHEN puncts >= 0.3 THEN 'reject_punct_heavy' WHEN length(t) < 3 THEN 'reject_too_short'
  WHEN len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '')) >= 4 THEN 'reject_too_many_words' WHEN {_or("t", "{}%", cu.PUNCTUATION_LED)} THEN 'reject_punct_led_phrase'
  WHEN regexp_matches(t, '^{_W}$') THEN 'keep_full_word' WHEN regexp_matches(t, '^{_W}(?: {_W}){{1,2}}$') THEN 'keep_short_phrase' WHEN safe AND n = 1 AND alphas >= 0.75 THEN 'keep_subword' WHEN safe AND n IN (2, 3) AND alphas >= 0.7 THEN 'keep_phrase_like' ELSE 'reject_other' END AS label
FROM (SELECT *, {_SHARES}, regexp_matches(t, '^[A-Za-z .''\\-’]+$') AS safe FROM (SELECT cand_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM ({_TEXTS})))""",
)
def trigram_classes(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("cand_id", cu.trigram_class(F.col("text")).alias("label"))


@query(
    "candidate_buckets",
    f"""SELECT cand_id, CASE WHEN contains(t, '''') AND (regexp_matches(t, '^{_W}(?: {_W}){{1,2}}$') OR regexp_matches(t, '^[A-Za-z]+(?:[''’][A-Za-z]+)+$')) THEN 'contractions' WHEN contains(t, ' ') THEN CASE WHEN regexp_matches(t, '^{_W}(?: {_W}){{1,2}}$') THEN 'phrases' END WHEN regexp_matches(t, '^[A-Za-z]+$') THEN 'subwords' END AS bucket
FROM (SELECT cand_id, {_NORM} AS t FROM ({_TEXTS}))""",
)
def candidate_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("cand_id", cu.normalized(F.col("text")).alias("t"))
    return rows.select("cand_id", cu.bucket(F.col("t")).alias("bucket"))


_P = _in(cu.PREFIX_STEMS)
_SCORED = f"""SELECT *, CASE WHEN length(t) = 0 OR NOT regexp_matches(t, '^[A-Za-z]+(?:''[A-Za-z]+)?$') OR length(t) < 4 OR low IN {_in(cu.BAD_FRAGMENTS)} THEN -999 ELSE
  CASE WHEN low IN {_in(cu.FULL_WORDS)} THEN 7 ELSE 0 END + CASE WHEN low IN {_P} THEN 6 ELSE 0 END + CASE WHEN low IN {_in(cu.SUFFIX_STEMS)} THEN 3 ELSE 0 END + CASE WHEN length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) / length(t) >= 0.98 THEN 2 ELSE 0 END + CASE WHEN v BETWEEN 0.22 AND 0.62 THEN 2 ELSE 0 END + CASE WHEN length(t) >= 6 THEN 1 ELSE 0 END
  + CASE WHEN length(t) BETWEEN 4 AND 9 AND (low IN {_P} OR (NOT {_or("low", "{}%", cu.BAD_STARTS)} AND substr(low, 1, 1) NOT IN ('h', 'v') AND v >= 0.2)) THEN 3 ELSE 0 END + CASE WHEN {_or("low", "%{}", cu.SUFFIX_STEMS)} THEN 1 ELSE 0 END
  - CASE WHEN {_or("low", "{}%", cu.BAD_STARTS)} THEN 5 ELSE 0 END - CASE WHEN {_or("low", "%{}", cu.BAD_ENDS)} THEN 4 ELSE 0 END - CASE WHEN {_or("low", "%{}", cu.TAILS)} AND low NOT IN {_in(cu.SUFFIX_STEMS)} THEN 2 ELSE 0 END
  - CASE WHEN length(t) BETWEEN 4 AND 5 AND low NOT IN {_in(cu.FULL_WORDS + cu.PREFIX_STEMS + cu.SUFFIX_STEMS)} THEN 1 ELSE 0 END END AS score
FROM (SELECT cand_id, t, lower(t) AS low, length(regexp_replace(lower(t), '[^aeiou]+', '', 'g')) / length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS v FROM (SELECT cand_id, {_NORM} AS t FROM ({_TEXTS})))"""


@query("subword_scores", f"SELECT cand_id, score, CASE WHEN score >= 7 THEN 'keep' WHEN score >= 4 THEN 'review_keep' ELSE 'drop' END AS action FROM ({_SCORED})")
def subword_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("cand_id", cu.normalized(F.col("text")).alias("t"))
    scored = rows.select("cand_id", cu.subword_score(F.col("t"))[0].alias("score"))
    return scored.select("cand_id", "score", cu.action(F.col("score")).alias("action"))


@query("subword_reasons")
def subword_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("cand_id", cu.normalized(F.col("text")).alias("t"))
    return rows.select("cand_id", F.explode(cu.subword_score(F.col("t"))[1]).alias("reason")).groupBy("reason").agg(F.count("*").alias("candidates"))


@query("candidate_dedupe")
def candidate_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First-wins by ids or normalized text, in order of cand_id; held against a sequential pass in the tests."""
    rows = candidates_of(spark, d).select(F.col("cand_id").alias("ord"), "ids", F.lower(cu.normalized(F.col("text"))).alias("norm"))
    return cu.first_wins(rows)


_CLASSES = ["keep_short_phrase", "keep_long_phrase"]
_FORCED = f"""SELECT text, 'PHRASE_' || regexp_replace(regexp_replace(upper(text), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS placeholder, freq, class FROM (
  SELECT trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS text, coalesce(freq, 0) AS freq, class FROM ({_READ}) WHERE class IN {_in(_CLASSES)} AND text IS NOT NULL)
  WHERE length(text) >= 4 QUALIFY row_number() OVER (PARTITION BY text ORDER BY freq DESC, class) = 1"""


@query("forced_phrases", _FORCED)
def forced_phrases(spark: SparkSession, d: str) -> DataFrame:
    return cu.forced_phrases(candidates_of(spark, d), _CLASSES)


@query("boost_corpus")
def boost_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The boosted terms with forced phrases substituted, 80 times each; tested on small tables."""
    return cu.boost_corpus(cu.boost_terms(candidates_of(spark, d)), _marks(spark, d))


_BOOST = ["keep_full_word", "keep_contraction", "keep_allowlist", "keep_phrase", "keep_short_phrase"]


@query(
    "boost_terms",
    f"""WITH b AS (SELECT cand_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS text, coalesce(freq, 0) AS freq, class FROM ({_READ}) WHERE text IS NOT NULL AND class IN {_in(_BOOST + ["keep_subword", "curated_subword_auto_v2"])}),
s AS (SELECT cand_id FROM ({_SCORED}) WHERE score >= 10)
SELECT text, freq, class FROM (SELECT * FROM b WHERE length(text) >= 2 AND NOT contains(text, '  ') AND (length(text) >= 4 OR contains(text, ' ')) AND (class IN {_in(_BOOST)} OR cand_id IN (SELECT cand_id FROM s)) QUALIFY row_number() OVER (PARTITION BY text ORDER BY freq DESC, cand_id) = 1) ORDER BY freq DESC, cand_id LIMIT 300""",
)
def boost_terms(spark: SparkSession, d: str) -> DataFrame:
    return cu.boost_terms(candidates_of(spark, d))


@query("training_corpus")
def training_corpus(spark: SparkSession, d: str) -> DataFrame:
    return cu.training_corpus(docs_of(spark, d), cu.boost_terms(candidates_of(spark, d)), _marks(spark, d))


def _marks(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return cu.distinct_marks(cu.forced_phrases(candidates_of(spark, d), _CLASSES))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    return cu.round_trip(docs_of(spark, d), _marks(spark, d))


@query("phrase_usage")
def phrase_usage(spark: SparkSession, d: str) -> DataFrame:
    """How often, and in how many documents, each forced phrase occurs; held against brute force in the tests."""
    return cu.phrase_usage(docs_of(spark, d), cu.forced_phrases(candidates_of(spark, d), _CLASSES))


@query("phrase_round_trip", "SELECT count(*) AS docs, count(*) AS restored FROM documents")
def phrase_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text comes back from substitution and restoration of all forced phrases, up to case and spacing of the phrases."""
    return _round_trip(spark, d).agg(F.count("*").alias("docs"), F.count_if("restored").alias("restored"))


@query("phrase_round_trip_touched")
def phrase_round_trip_touched(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a forced phrase is substituted, and how many of these come back; tested on small tables."""
    return _round_trip(spark, d).agg(F.count("*").alias("docs"), F.count_if("touched").alias("touched"), F.count_if(F.col("touched") & F.col("restored")).alias("touched_restored"))
