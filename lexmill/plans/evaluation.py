"""Comparisons of tokenizations over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.operators import evaluation as ev
from lexmill.operators import segmentation
from lexmill.operators.tokens import greedy_counts
from lexmill.plans.common import counts, docs_of, variant


def _greedy_pair(spark: SparkSession, d: str, base: str = "short", custom: str = "full") -> DataFrame:
    """Per document the greedy counts under two vocabularies."""
    docs = docs_of(spark, d)
    a = greedy_counts(docs, variant(spark, d, base)).select("doc_id", F.col("n_tokens").alias("base_tokens"))
    b = greedy_counts(docs, variant(spark, d, custom)).withColumnRenamed("n_tokens", "custom_tokens")
    return keep(a.join(b, "doc_id"), "greedy-pair")


_PAIR = f"""WITH {counts("short", "a_")}, {counts("full", "b_")},
p AS (SELECT doc_id, b_n.n_bytes, a_n.n_tokens AS base_tokens, b_n.n_tokens AS custom_tokens, b_n.fallback_tokens, b_n.fallback_runs, b_n.n_tokens - a_n.n_tokens AS delta_tokens FROM a_n JOIN b_n USING (doc_id))
"""


@query("full_val_summary")
def full_val_summary(spark: SparkSession, d: str) -> DataFrame:
    """Greedy against boundary segmentation on whole texts; held against a naive segmentation in the tests."""
    return ev.summary(segmentation.compared(docs_of(spark, d), table(spark, d, "vocab")))


@query("min_against_boundary")
def min_against_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of the two optimal segmentations; they differ in fallback only."""
    return ev.delta_histogram(segmentation.compared(docs_of(spark, d), table(spark, d, "vocab"), "min_tokens", "boundary"))


@query("boundary_counts")
def boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.encoded(docs_of(spark, d), table(spark, d, "vocab"))


@query("greedy_doc_counts", f"WITH {counts()} SELECT * FROM n")
def greedy_doc_counts(spark: SparkSession, d: str) -> DataFrame:
    return greedy_counts(docs_of(spark, d), table(spark, d, "vocab"))


@query(
    "greedy_val_summary",
    _PAIR
    + """SELECT * FROM (SELECT count(*) AS docs, sum(n_bytes)::BIGINT AS n_bytes, sum(base_tokens)::BIGINT AS base_tokens, sum(custom_tokens)::BIGINT AS custom_tokens, sum(delta_tokens)::BIGINT AS delta_tokens,
  round(sum(base_tokens) / sum(n_bytes), 6) AS base_tokens_per_byte, round(sum(custom_tokens) / sum(n_bytes), 6) AS custom_tokens_per_byte, round(sum(delta_tokens) / sum(n_bytes), 6) AS delta_tokens_per_byte,
  round(sum(n_bytes) / sum(base_tokens), 6) AS base_bytes_per_token, round(sum(n_bytes) / sum(custom_tokens), 6) AS custom_bytes_per_token FROM p), (SELECT sum(fallback_tokens)::BIGINT AS fallback_tokens, sum(fallback_runs)::BIGINT AS fallback_runs FROM p)""",
)
def greedy_val_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(_greedy_pair(spark, d))


@query("delta_histogram", _PAIR + "SELECT delta_tokens, count(*) AS doc_count FROM p GROUP BY 1")
def delta_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ev.delta_histogram(_greedy_pair(spark, d))


@query(
    "worst_docs",
    _PAIR
    + r"SELECT doc_id, -delta_tokens AS delta_tokens, n_bytes, custom_tokens AS base_tokens, base_tokens AS custom_tokens, replace(substr(coalesce(text, ''), 1, 220), chr(10), '\n') AS text_preview FROM p JOIN documents USING (doc_id) WHERE p.delta_tokens < 0 ORDER BY p.delta_tokens, p.base_tokens DESC, doc_id LIMIT 200",
)
def worst_docs(spark: SparkSession, d: str) -> DataFrame:
    return ev.worst_documents(_greedy_pair(spark, d, "full", "short"), docs_of(spark, d))


@query(
    "score_card",
    _PAIR
    + """, s AS (SELECT count(*) AS docs, sum(base_tokens)::BIGINT AS base_tokens, sum(custom_tokens)::BIGINT AS custom_tokens, sum(fallback_tokens)::BIGINT AS fallback_tokens,
  count(*) FILTER (delta_tokens < 0) AS improved, count(*) FILTER (delta_tokens > 0) AS worse, count(*) FILTER (delta_tokens = 0) AS same, avg(delta_tokens) AS mean_delta,
  quantile_cont(delta_tokens, 0.5) AS median_delta, quantile_cont(delta_tokens, 0.95) AS p95_delta, quantile_cont(delta_tokens, 0.99) AS p99_delta FROM p),
w AS (SELECT avg(delta_tokens) AS worst_mean FROM (SELECT delta_tokens FROM p ORDER BY delta_tokens DESC, doc_id LIMIT 100)),
q AS (SELECT *, custom_tokens / base_tokens AS token_ratio, fallback_tokens / custom_tokens AS fallback_share, improved / docs AS improved_share, worse / docs AS worse_share FROM s, w)
SELECT docs, base_tokens, custom_tokens, fallback_tokens, improved, worse, same, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, round(p95_delta, 6) AS p95_delta, round(p99_delta, 6) AS p99_delta, round(worst_mean, 6) AS worst_mean,
  round(token_ratio, 6) AS token_ratio, round(fallback_share, 6) AS fallback_share, round(improved_share, 6) AS improved_share, round(worse_share, 6) AS worse_share,
  round(-1000 * (token_ratio - 1) - 3000 * fallback_share - 50 * mean_delta - 100 * p95_delta - 150 * p99_delta - 200 * worst_mean + 50 * improved_share - 50 * worse_share, 4) AS score FROM q""",
)
def score_card(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_card(_greedy_pair(spark, d))


_VARIANTS = f"""WITH {counts("full", "f_")}, {counts("short", "s_")}, {counts("led", "l_")},
v AS (SELECT 'short' AS variant, * FROM s_n UNION ALL SELECT 'led', * FROM l_n),
p AS (SELECT variant, doc_id, v.n_bytes, f_n.n_tokens AS base_tokens, v.n_tokens AS custom_tokens, v.fallback_tokens, v.n_tokens - f_n.n_tokens AS delta_tokens FROM v JOIN f_n USING (doc_id)),
t AS (SELECT variant, count(*) AS docs, sum(base_tokens)::BIGINT AS base_tokens, sum(custom_tokens)::BIGINT AS custom_tokens, round(sum(custom_tokens) / sum(base_tokens), 6) AS ratio, round(sum(fallback_tokens) / sum(custom_tokens), 6) AS fallback_share,
  count(*) FILTER (delta_tokens < 0) AS wins, count(*) FILTER (delta_tokens > 0) AS losses, count(*) FILTER (delta_tokens = 0) AS ties, (sum(base_tokens) - sum(custom_tokens))::BIGINT AS abs_saved, round((sum(base_tokens) - sum(custom_tokens)) * 100 / sum(base_tokens), 6) AS pct_saved,
  round(sum(delta_tokens) / sum(n_bytes), 6) AS delta_per_byte, greatest(max(-delta_tokens), 0) AS best_win, CASE WHEN min(delta_tokens) < 0 THEN arg_min(doc_id, delta_tokens * 1000000000000::HUGEINT + doc_id) END AS best_win_doc,
  greatest(max(delta_tokens), 0) AS worst_loss, CASE WHEN max(delta_tokens) > 0 THEN arg_min(doc_id, -delta_tokens * 1000000000000::HUGEINT + doc_id) END AS worst_loss_doc FROM p GROUP BY variant)
"""


def _variant_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d)
    base = greedy_counts(docs, variant(spark, d, "full")).select("doc_id", F.col("n_tokens").alias("base_tokens"))
    parts = {name: greedy_counts(docs, variant(spark, d, name)).withColumnRenamed("n_tokens", "custom_tokens") for name in ("short", "led")}
    return ev.union_variants(parts).join(base, "doc_id")


@query("variant_ranking", _VARIANTS + "SELECT *, row_number() OVER (ORDER BY delta_per_byte, custom_tokens, variant) AS place FROM t")
def variant_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ev.ranked(ev.variant_totals(_variant_rows(spark, d)), "delta_per_byte", "custom_tokens", "variant")


@query("grid_evaluation", _VARIANTS + "SELECT variant, base_tokens, custom_tokens, abs_saved, pct_saved, wins, losses, ties, row_number() OVER (ORDER BY abs_saved DESC, custom_tokens, losses, wins DESC, variant) AS place FROM t")
def grid_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.variant_totals(_variant_rows(spark, d)).select("variant", "base_tokens", "custom_tokens", "abs_saved", "pct_saved", "wins", "losses", "ties")
    return ev.ranked(rows, F.desc("abs_saved"), "custom_tokens", "losses", F.desc("wins"), "variant")


_N_DOCS = 50_000  # documents behind the recorded statistics

_FIRST = """SELECT * FROM token_stats WHERE source = '{0}' QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY freq DESC NULLS LAST, doc_freq DESC NULLS LAST, piece NULLS LAST) = 1"""
_ADD = f"""SELECT token_id, piece, coalesce(freq, 0) AS freq, coalesce(doc_freq, 0) AS doc_freq, round(1.5 * ln(1 + coalesce(freq, 0)) + 200 * coalesce(doc_coverage_ratio, 0) + 2 * ln(1 + coalesce(context_diversity, 0)) + 5 * greatest(0.0, coalesce(compression_credit, 0)), 6) AS priority
FROM ({_FIRST.format("sp")}) WHERE coalesce(in_custom, 0) <> 1 AND piece IS NOT NULL"""
_REMOVE = f"""SELECT token_id, piece, coalesce(freq, 0) AS freq, coalesce(doc_freq, 0) AS doc_freq, round(5000 / greatest(1, coalesce(freq, 0)) + 5 * (1 - coalesce(doc_coverage_ratio, 0)) + 5 * greatest(0.0, -coalesce(compression_credit, 0)) + 0.25 * coalesce(num_parts, 0), 6) AS weakness
FROM ({_FIRST.format("custom")}) WHERE coalesce(in_sp, 0) <> 1 AND piece IS NOT NULL"""


@query(
    "token_verdicts",
    f"""SELECT DISTINCT token_id, piece, CASE WHEN coalesce(in_sp, 0) = 1 THEN 'overlap_keep' WHEN coalesce(freq, 0) < 20 AND c < 0.002 THEN 'weak_remove' WHEN coalesce(compression_credit, 0) < 0 AND c < 0.01 THEN 'weak_remove'
  WHEN coalesce(num_parts, 0) >= 3 AND coalesce(non_byte_parts, 0) >= 2 AND coalesce(freq, 0) < 200 THEN 'possibly_overmerged' WHEN coalesce(compression_credit, 0) > 0 AND c > 0.01 AND coalesce(context_diversity, 0) > 20 THEN 'custom_keep'
  WHEN coalesce(piece, '') LIKE ' %' AND coalesce(freq, 0) > 100 AND c > 0.005 THEN 'custom_keep' ELSE 'review' END AS verdict FROM (SELECT *, coalesce(doc_freq, 0) / {_N_DOCS}.0::DOUBLE AS c FROM token_stats WHERE source = 'custom')""",
)
def token_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return ev.token_verdicts(table(spark, d, "token_stats"), _N_DOCS)


@query("add_priority", _ADD)
def add_priority(spark: SparkSession, d: str) -> DataFrame:
    return ev.add_priority(table(spark, d, "token_stats"))


@query("removal_weakness", _REMOVE)
def removal_weakness(spark: SparkSession, d: str) -> DataFrame:
    return ev.removal_weakness(table(spark, d, "token_stats"))


@query(
    "replacement_map",
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY weakness DESC, token_id) AS place FROM ({_REMOVE})), n AS (SELECT *, row_number() OVER (ORDER BY priority DESC, token_id) AS place FROM ({_ADD}))
SELECT place, o.token_id AS remove_id, o.piece AS remove_piece, o.freq AS remove_freq, n.token_id AS add_id, n.piece AS add_piece, n.freq AS add_freq FROM o JOIN n USING (place) WHERE place <= 200""",
)
def replacement_map(spark: SparkSession, d: str) -> DataFrame:
    return ev.replacement_map(table(spark, d, "token_stats"))


@query("vocabulary_overlap", "SELECT count(*) FILTER (s AND c) AS shared, count(*) FILTER (s AND NOT c) AS only_sp, count(*) FILTER (c AND NOT s) AS only_custom FROM (SELECT piece, bool_or(source = 'sp') AS s, bool_or(source = 'custom') AS c FROM token_stats WHERE piece IS NOT NULL GROUP BY piece)")
def vocabulary_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ev.vocabulary_overlap(table(spark, d, "token_stats"))
