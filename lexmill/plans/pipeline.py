"""Shard profiles, export layout, batches, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, shared_dir, table
from lexmill.operators import shards as sh
from lexmill.operators.segmentation import encoded
from lexmill.operators.tokens import greedy_counts, token_arrays
from lexmill.plans.common import TOKENS, counts, docs_of, metrics_sql
from lexmill.plans.mining import stream
from lexmill.sources import token_shards


def _shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return keep(sh.id_counts(token_arrays(docs_of(spark, d), table(spark, d, "vocab"), "shard_name")), "id-counts")


@query(
    "shard_profile",
    f"WITH {TOKENS} SELECT *, round(unique_token_count / token_count, 6) AS unique_token_ratio FROM (SELECT shard_name, count(*) AS token_count, min(id) AS min_token, max(id) AS max_token, round(avg(id), 6) AS mean_token, round(stddev_pop(id), 6) AS std_token, count(DISTINCT id) AS unique_token_count FROM tok GROUP BY shard_name)",
)
def shard_profile(spark: SparkSession, d: str) -> DataFrame:
    return sh.profile(_shard_counts(spark, d))


@query("shard_top_tokens", f"WITH {TOKENS}, e AS (SELECT shard_name, id, count(*) AS uses FROM tok GROUP BY 1, 2) SELECT shard_name, place::INT AS place, id, round(uses / all_uses, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY shard_name ORDER BY uses DESC, id) AS place, sum(uses) OVER (PARTITION BY shard_name) AS all_uses FROM e) WHERE place <= 20")
def shard_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sh.top_tokens(_shard_counts(spark, d))


_ONCE = "o AS (SELECT * FROM shard_summaries QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY loaded_at NULLS LAST) = 1)"
_SHOWN = ("decoded_chars", "unique_words", "unique_word_ratio", "ascii_ratio", "digit_ratio", "punctuation_ratio", "non_printable_ratio", "url_hits", "html_hits", "repeated_char_hits", "avg_line_length")
_SAMPLED = f"{_ONCE}, each AS (SELECT shard_name, unnest(sample_previews) AS text FROM o), t AS (SELECT shard_name, text AS t FROM each WHERE text IS NOT NULL), {metrics_sql('shard_name')}, sm AS (SELECT shard_name, count(*) AS sample_count, {', '.join(f'avg({c}) AS mean_{c}' for c in _SHOWN)} FROM measured GROUP BY shard_name)"


@query("shard_metrics", f"WITH {_SAMPLED} SELECT shard_name, sample_count, {', '.join(f'round(mean_{c}, 6) AS mean_{c}' for c in _SHOWN)} FROM sm")
def shard_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the sampled texts of each shard, computed anew and averaged."""
    return sh.sample_averages(table(spark, d, "shard_summaries")).select("shard_name", "sample_count", *(F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in _SHOWN))


def _z(c: str) -> str:
    return f"coalesce(CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 0)"


@query(
    "shard_scores",
    f"""WITH {_SAMPLED}, r AS (SELECT o.shard_name, std_token, unique_token_count::DOUBLE AS unique_token_count, sm.* EXCLUDE (shard_name) FROM o LEFT JOIN sm USING (shard_name) WHERE contains(o.shard_name, '_train_')),
s AS (SELECT *, round({_z("mean_unique_word_ratio")} * 0.45::DOUBLE + {_z("mean_unique_words")} * 0.25::DOUBLE + {_z("unique_token_count")} * 0.15::DOUBLE + {_z("std_token")} * 0.15::DOUBLE, 6) AS score_diversity,
  round({_z("mean_url_hits")} * 0.30::DOUBLE + {_z("mean_html_hits")} * 0.30::DOUBLE + {_z("mean_repeated_char_hits")} * 0.20::DOUBLE + {_z("mean_non_printable_ratio")} * 0.10::DOUBLE + {_z("mean_digit_ratio")} * 0.10::DOUBLE, 6) AS score_noise,
  round({_z("mean_ascii_ratio")} * 0.25::DOUBLE + {_z("mean_unique_word_ratio")} * 0.25::DOUBLE + {_z("mean_unique_words")} * 0.20::DOUBLE - {_z("mean_digit_ratio")} * 0.10::DOUBLE - {_z("mean_url_hits")} * 0.10::DOUBLE - {_z("mean_html_hits")} * 0.10::DOUBLE, 6) AS score_clean_prose FROM r),
p AS (SELECT *, round(score_clean_prose * 0.55::DOUBLE + score_diversity * 0.45::DOUBLE - score_noise * 0.35::DOUBLE, 6) AS score_priority FROM s)
SELECT shard_name, score_diversity, score_noise, score_clean_prose, score_priority, """
    + ", ".join(f"rank() OVER (ORDER BY round({c}, 6) DESC NULLS LAST)::INT AS rank_{c}_desc" for c in ("score_diversity", "score_noise", "score_clean_prose", "score_priority", "mean_unique_word_ratio", "mean_unique_words", "mean_ascii_ratio", "unique_token_count", "std_token"))
    + ", "
    + ", ".join(f"rank() OVER (ORDER BY round({c}, 6) NULLS LAST)::INT AS rank_{c}_asc" for c in ("mean_url_hits", "mean_html_hits", "mean_repeated_char_hits", "mean_non_printable_ratio", "mean_digit_ratio"))
    + " FROM p",
)
def shard_scores(spark: SparkSession, d: str) -> DataFrame:
    return sh.shard_scores(table(spark, d, "shard_summaries"))


@query(
    "shard_sample_windows",
    f"""WITH {TOKENS}, q AS (SELECT coalesce(shard_name, '') AS scope, id, row_number() OVER (PARTITION BY coalesce(shard_name, '') ORDER BY doc_id, ix, byte_no) - 1 AS pos FROM tok), z AS (SELECT scope, count(*) AS n FROM q GROUP BY scope),
st AS (SELECT scope, i AS sample, CASE WHEN n <= 512 THEN 0 ELSE floor(i * ((n - 512)::DOUBLE / 7))::BIGINT END AS start FROM z, range(8) t(i) WHERE n > 512 OR i = 0)
SELECT scope, sample::INT AS sample, count(*) AS tokens, count(DISTINCT id) AS distinct_tokens, min(pos) AS first_pos FROM q JOIN st USING (scope) WHERE pos >= start AND pos < start + 512 GROUP BY scope, sample""",
)
def shard_sample_windows(spark: SparkSession, d: str) -> DataFrame:
    return sh.sample_windows(stream(spark, d)).groupBy("scope", "sample").agg(F.count("*").alias("tokens"), F.count_distinct("id").alias("distinct_tokens"), F.min("pos").alias("first_pos"))


_SHARD = 20_000


def _ordered_counts(spark: SparkSession, d: str) -> DataFrame:
    """ord, doc_id, n_tokens (with an end token) of every document with text, in order of doc_id."""
    docs = docs_of(spark, d).where("text is not null and text <> ''")
    rows = greedy_counts(docs, table(spark, d, "vocab")).select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"))
    from lexmill.cluster import running_total

    return running_total(rows.withColumn("one", F.lit(1)), ["doc_id"], "one", "ord").drop("one")


def _layout_sql(most: int | None) -> str:
    room = "n_tokens" if most is None else f"greatest(0, least(o + n_tokens, {_SHARD} * CASE WHEN split = 'val' THEN least(vs, {most}) ELSE greatest({most} - vs, 0) END) - o)"
    return f"""WITH {counts()}, c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, n_tokens + 1 AS n_tokens FROM n JOIN documents USING (doc_id) WHERE text IS NOT NULL AND text <> ''),
s AS (SELECT *, CASE WHEN ord < 100 THEN 'val' ELSE 'train' END AS split FROM c), f AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, ceil(sum(CASE WHEN split = 'val' THEN n_tokens ELSE 0 END) OVER () / {_SHARD})::BIGINT AS vs FROM s),
w AS (SELECT *, ({room})::BIGINT AS written FROM f),
l AS (SELECT ord, doc_id, split, o AS "offset", n_tokens, written, CASE WHEN written > 0 THEN o // {_SHARD} END AS first_shard, CASE WHEN written > 0 THEN (o + written - 1) // {_SHARD} END AS last_shard FROM w)"""


@query("export_layout", _layout_sql(None) + " SELECT * FROM l")
def export_layout(spark: SparkSession, d: str) -> DataFrame:
    return sh.export_layout(_ordered_counts(spark, d), 100, _SHARD)


_STATS = "st AS (SELECT split, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, sum(written)::BIGINT AS written, coalesce(max(last_shard) + 1, 0) AS shards, sum(written) < sum(n_tokens) AS stopped_early FROM l GROUP BY split)"


@query("export_capped", _layout_sql(12) + f", {_STATS} SELECT * FROM st")
def export_capped(spark: SparkSession, d: str) -> DataFrame:
    return sh.export_stats(sh.export_layout(_ordered_counts(spark, d), 100, _SHARD, 12), _SHARD)


@query("export_manifest", _layout_sql(None) + f", {_STATS} SELECT '{{\"name\":\"corpus\",\"tokenizer_kind\":\"piece\",\"vocab_size\":1024,\"splits\":[' || string_agg(printf('{{\"split\":\"%s\",\"docs\":%d,\"tokens\":%d,\"written\":%d,\"shards\":%d}}', split, docs, tokens, written, shards), ',' ORDER BY split) || ']}}' AS manifest FROM st")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sh.manifest(sh.export_stats(sh.export_layout(_ordered_counts(spark, d), 100, _SHARD), _SHARD), "corpus", 1024)


@query("training_batches", _layout_sql(None) + ", t AS (SELECT split, sum(written)::BIGINT AS tokens FROM l GROUP BY split) SELECT split, tokens, greatest(0, (tokens - 1) // 256) AS sequences, CASE WHEN (tokens - 1) // 256 > 0 THEN (tokens - 1) // 256 * 256 + 1 ELSE 0 END AS usable_tokens, greatest(0, (tokens - 1) // 256) // 8 AS steps FROM t")
def training_batches(spark: SparkSession, d: str) -> DataFrame:
    return sh.batches(sh.export_layout(_ordered_counts(spark, d), 100, _SHARD), 256, 8)


@query("shard_round_trip")
def shard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Boundary-segmented documents written as binary token shards and read again: tokens per shard."""
    token_shards.register(spark)
    rows = encoded(docs_of(spark, d).where("text is not null and text <> ''"), table(spark, d, "vocab"), ids=True)
    placed = sh.export_layout(rows.select(F.col("doc_id").alias("ord"), "doc_id", "n_tokens"), 0, _SHARD).select("doc_id", "offset")
    flat = rows.join(placed, "doc_id").select(F.posexplode("ids").alias("k", "token_id"), "offset")
    tokens = flat.select(F.format_string("train_%06d", F.floor((F.col("offset") + F.col("k")) / _SHARD)).alias("shard"), ((F.col("offset") + F.col("k")) % _SHARD).alias("pos"), "token_id")
    folder = f"{shared_dir(spark).removeprefix('file://')}/{spark.sparkContext.applicationId}/shards-{abs(hash(d)) % 10**9}"
    token_shards.write(tokens, folder)
    return token_shards.read(spark, folder).groupBy("shard").agg(F.count("*").alias("tokens"), F.min("token_id").alias("least"), F.max("token_id").alias("greatest"))


#: Lines in the format of the training logs.
_LOG = [
    ("run_a", 1, "step:0/20000 val_loss:6.93 val_bpb:4.10 train_time:0ms step_avg:0.01ms"),
    ("run_a", 2, "step:1000/20000 val_loss:2.31 val_bpb:1.3651 train_time:52000ms step_avg:52.10ms"),
    ("run_a", 3, "stopping_early: wallclock_cap train_time:600000ms step:11000/20000"),
    ("run_a", 4, "step:11000/20000 val_loss:2.09 val_bpb:1.2377 train_time:600000ms step_avg:51.88ms"),
    ("run_b", 1, "step:500/1000 val_loss:2.50 val_bpb:1.4801 step_avg:74.99ms"),
    ("run_b", 2, "step:1000/1000 val_loss:2.04 val_bpb:1.2070 step_avg:75.20ms"),
    ("run_c", 1, "nothing to see"),
]


@query(
    "run_log_summary",
    "WITH t(run, line_no, line) AS (VALUES " + ", ".join(str(x) for x in _LOG) + r"""), f AS (SELECT run, line_no, nullif(regexp_extract(line, 'step:(\d+)/', 1), '') AS step, nullif(regexp_extract(line, 'val_loss:([0-9.]+)', 1), '') AS val_loss, nullif(regexp_extract(line, 'val_bpb:([0-9.]+)', 1), '') AS val_bpb,
  nullif(regexp_extract(line, 'step_avg:([0-9.]+)ms', 1), '') AS step_ms, line LIKE 'stopping!_early%' ESCAPE '!' AS stopped FROM t),
o AS (SELECT run, arg_max(step, line_no) FILTER (step IS NOT NULL)::INT AS step, arg_max(val_loss, line_no) FILTER (val_loss IS NOT NULL)::DOUBLE AS val_loss, arg_max(val_bpb, line_no) FILTER (val_bpb IS NOT NULL)::DOUBLE AS val_bpb, arg_max(step_ms, line_no) FILTER (step_ms IS NOT NULL)::DOUBLE AS step_ms, bool_or(stopped) AS stopped_early FROM f GROUP BY run)
SELECT run, (row_number() OVER (ORDER BY val_bpb NULLS LAST, run))::INT AS place, step, val_loss, val_bpb, step_ms, stopped_early, round(val_bpb - min(val_bpb) OVER (), 6) AS behind FROM o""",
)
def run_log_summary(spark: SparkSession, d: str) -> DataFrame:
    return sh.run_summaries(spark.createDataFrame(_LOG, "run string, line_no int, line string"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return sh.export_stats(sh.export_layout(_ordered_counts(spark, d), 100, _SHARD), _SHARD)


@query("chunk_plan", _layout_sql(None) + f", {_STATS}, u AS (SELECT split, written // 256 * 256 AS usable FROM st) SELECT split, i AS chunk, least(65536, usable - i * 65536)::BIGINT AS tokens FROM u, range(10000) r(i) WHERE i * 65536 < usable")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of each split in chunks of whole sequences."""
    return sh.chunk_plan(_stats(spark, d), 256, 65_700)


@query("rank_batches", _layout_sql(None) + f""", {_STATS}, g AS (SELECT split, written, s AS step, r AS rank, (s * 8 + r) * 2049 AS o FROM st, range(400) x(s), range(8) y(r) WHERE written > 0)
SELECT split, step::INT AS step, rank::INT AS rank, o % written AS first, (o + 2048) % written AS last, o % written + 2049 > written AS wraps FROM g""")
def rank_batches(spark: SparkSession, d: str) -> DataFrame:
    """Where each of 8 ranks reads in the token stream at each of 400 steps."""
    return sh.rank_batches(_stats(spark, d), 8, 256, 8, 400)
