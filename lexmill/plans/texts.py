"""Text features over all documents and lines, and closer looks at segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.functions import lines as ln
from lexmill.functions.metrics import text_metrics
from lexmill.operators import building, inspection
from lexmill.operators import curation as cu
from lexmill.operators import tokens as tk
from lexmill.plans.common import candidates_of, counts, docs_of, matches, metrics_sql, variant
from lexmill.plans.vocabularies import _build, built

_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(
    "doc_previews",
    rf"SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[{_WS}]+', ' ', 'g')), 1, 240) AS preview, replace(substr(coalesce(text, ''), 1, 220), chr(10), '\n') AS escaped, CASE WHEN length(coalesce(text, '')) <= 80 THEN coalesce(text, '') ELSE substr(text, 1, 77) || '...' END AS short FROM documents",
)
def doc_previews(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs_of(spark, d).select("doc_id", ln.preview(t).alias("preview"), ln.escaped_preview(t).alias("escaped"), ln.shortened(t).alias("short"))


@query(
    "doc_ratios",
    rf"""SELECT doc_id, CASE WHEN n = 0 THEN 1 ELSE round(length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) / n, 6) END AS digit_share, CASE WHEN n = 0 THEN 1 ELSE round((n - length(regexp_replace(t, '[^\p{{L}}\p{{N}}{_WS}]+', '', 'g'))) / n, 6) END AS punct_share,
  CASE WHEN n = 0 THEN 0 ELSE round(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) / n, 6) END AS alpha_share, len(regexp_extract_all(t, '[A-Za-z]+'))::INT AS ascii_words FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)""",
)
def doc_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = docs_of(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("doc_id", *(F.round(f(F.col("t")), 6).alias(n) for n, f in (("digit_share", cu.digit_share), ("punct_share", cu.punct_share), ("alpha_share", cu.alpha_share))), cu.word_count(F.col("t")).alias("ascii_words"))


_LINES = rf"l AS (SELECT doc_id, i - 1 AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS x FROM documents), unnest(generate_series(1, len(x))) AS u(i) WHERE regexp_matches(x[i], '[^{_WS}]'))"


@query(
    "line_features",
    rf"""WITH {_LINES}, f AS (SELECT *, length(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) AS upper FROM l)
SELECT doc_id, line_no::INT AS line_no, len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+(?:[''’-][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_{_WS}]+'))::INT AS tokens, len(regexp_extract_all(line, '[A-Za-z]+'))::INT AS ascii_words,
  length(regexp_replace(line, '^[{_WS}]+|[{_WS}]+$', '', 'g')) >= 4 AND letters > 0 AND (upper = letters OR (letters >= 4 AND upper >= letters * 0.55)) AS is_heading, CASE WHEN length(line) <= 80 THEN line ELSE substr(line, 1, 77) || '...' END AS shown FROM f""",
)
def line_features(spark: SparkSession, d: str) -> DataFrame:
    return ln.line_features(docs_of(spark, d))


@query(
    "mined_additions",
    r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), ' ?\p{L}{3,}')) AS span FROM documents)
SELECT span, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq, (6 * count(*) + 30 * count(DISTINCT doc_id) + 3 * (length(span) - 1) + 2 * (octet_length(encode(span)) - 1))::BIGINT AS score FROM s WHERE span NOT IN (SELECT piece FROM vocab) GROUP BY span HAVING count(*) >= 3""",
)
def mined_additions(spark: SparkSession, d: str) -> DataFrame:
    return ln.mined_additions(docs_of(spark, d), table(spark, d, "vocab"))


_LINE_DOCS = "ld AS (SELECT {'d': doc_id, 'n': line_no} AS doc_id, '' AS shard_name, line AS text FROM l)"


@query(
    "line_head_to_head",
    f"""WITH {_LINES}, {_LINE_DOCS}, {matches("short", "a_", "ld")}, {matches("full", "b_", "ld")},
a AS (SELECT doc_id, sum(CASE WHEN id IS NULL THEN octet_length(encode(x)) ELSE 1 END) AS n FROM a_m GROUP BY doc_id), b AS (SELECT doc_id, sum(CASE WHEN id IS NULL THEN octet_length(encode(x)) ELSE 1 END) AS n FROM b_m GROUP BY doc_id)
SELECT CASE WHEN b.n < a.n THEN 'improved' WHEN b.n > a.n THEN 'worse' ELSE 'same' END AS outcome, count(*) AS lines, sum(a.n)::BIGINT AS base_tokens, sum(b.n)::BIGINT AS custom_tokens FROM a JOIN b USING (doc_id) GROUP BY 1""",
)
def line_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """Lines that one vocabulary segments better than another, over all lines."""
    rows = ln.line_rows(docs_of(spark, d)).select(F.struct("doc_id", "line_no").alias("doc_id"), F.col("line").alias("text"))
    a = tk.greedy_counts(rows, variant(spark, d, "short")).select("doc_id", F.col("n_tokens").alias("base_tokens"))
    both = a.join(tk.greedy_counts(rows, variant(spark, d, "full")).select("doc_id", F.col("n_tokens").alias("custom_tokens")), "doc_id")
    outcome = F.when(F.col("custom_tokens") < F.col("base_tokens"), "improved").when(F.col("custom_tokens") > F.col("base_tokens"), "worse").otherwise("same")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("lines"), F.sum("base_tokens").alias("base_tokens"), F.sum("custom_tokens").alias("custom_tokens"))


def _spelled(prefix: str) -> str:
    return f"{prefix}p AS (SELECT doc_id, CASE WHEN id IS NULL THEN '<bytes>' ELSE x END AS piece FROM {prefix}m)"


@query(
    "piece_gains_and_losses",
    f"""WITH {matches("short", "a_")}, {matches("full", "b_")}, {_spelled("a_")}, {_spelled("b_")}, x AS (SELECT doc_id, piece, count(*) AS n FROM a_p GROUP BY 1, 2), y AS (SELECT doc_id, piece, count(*) AS n FROM b_p GROUP BY 1, 2),
z AS (SELECT coalesce(x.piece, y.piece) AS piece, coalesce(y.n, 0) - coalesce(x.n, 0) AS more FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.piece = y.piece)
SELECT piece, sum(greatest(more, 0))::BIGINT AS gained, sum(greatest(-more, 0))::BIGINT AS lost FROM z GROUP BY piece HAVING gained > 0 OR lost > 0""",
)
def piece_gains_and_losses(spark: SparkSession, d: str) -> DataFrame:
    def pieces(name: str) -> DataFrame:
        vocab = variant(spark, d, name)
        known = tk.literal_pieces(vocab)
        each = tk.greedy_pieces(docs_of(spark, d), vocab).select("doc_id", F.explode_outer("m").alias("x")).where("x is not null")
        return each.select("doc_id", F.when(F.col("x").isin(known), F.col("x")).otherwise("<bytes>").alias("piece"))

    return inspection.gains_and_losses(pieces("short"), pieces("full"))


@query("vocabulary_changes", f"WITH b AS ({_build((500, 60, 120))}) SELECT v.id, v.piece AS old_piece, b.piece AS new_piece FROM vocab v JOIN b USING (id) WHERE v.piece <> b.piece")
def vocabulary_changes(spark: SparkSession, d: str) -> DataFrame:
    return inspection.vocabulary_changes(table(spark, d, "vocab"), keep(built(spark, d, (500, 60, 120)), "built"))


_EDGE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]"
_BARE = f"regexp_replace(piece, '^{_EDGE}+|{_EDGE}+$', '', 'g')"
_MARKS = [".", ",", ":", ";", "!", "?", "'", '"', "`", "’", "“", "”", "(", ")", "[", "]", "{", "}", "-", "–", "—", "/", "\\", "&", "%", "$", "#", "@", "*", "+", "=", "_", "|", "<", ">"]
_ENDS = ["'s", "’s", "'t", "’t", "'re", "’re", "'ve", "’ve", "'ll", "’ll", "'m", "’m", "'d", "’d", " s", " t", " re", " ve", " ll", " m", " d", "’", "'"]
_listed = lambda values: "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
_PROT = f"((starts_with(piece, '<0x') AND ends_with(piece, '>')) OR {_BARE} IN {_listed(_MARKS + _ENDS)} OR piece IN {_listed(_ENDS)} OR regexp_matches({_BARE}, '^[\\p{{L}}\\p{{Nd}}]$') OR (piece <> '' AND {_BARE} = ''))"


@query("protected_pieces", f"SELECT id, piece, {_PROT} AS protected FROM vocab")
def protected_pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab").select("id", "piece", ln.is_protected(F.col("piece")).alias("protected"))


@query(
    "safe_swaps",
    f"""WITH st AS (SELECT * FROM token_stats QUALIFY row_number() OVER (PARTITION BY source, token_id ORDER BY freq DESC NULLS LAST, doc_freq DESC NULLS LAST, piece NULLS LAST) = 1),
r AS (SELECT token_id, piece, row_number() OVER (ORDER BY round(coalesce(freq, 0) + 2.0::DOUBLE * coalesce(doc_freq, 0) + 0.5::DOUBLE * coalesce(context_diversity, 0) + 5.0::DOUBLE * greatest(0, coalesce(compression_credit, 0)), 6), token_id) AS place FROM st WHERE source = 'sp' AND token_id NOT IN (0, 1, 2, 3) AND piece IS NOT NULL AND NOT {_PROT}),
a AS (SELECT piece, max(round(2.0::DOUBLE * sqrt(coalesce(freq, 0)) + 3.0::DOUBLE * sqrt(coalesce(doc_freq, 0)) + sqrt(coalesce(context_diversity, 0)) + 4.0::DOUBLE * greatest(0, coalesce(compression_credit, 0)) + CASE WHEN starts_with(piece, ' ') THEN 1 ELSE 0 END + CASE WHEN length({_BARE}) >= 2 THEN 0.5::DOUBLE ELSE 0 END, 6)) AS add_score
  FROM st WHERE piece IS NOT NULL AND coalesce(in_sp, 0) <> 1 AND in_custom = 1 AND coalesce(freq, 0) >= 20 AND coalesce(doc_freq, 0) >= 5 AND NOT {_PROT} AND piece NOT IN (SELECT piece FROM st WHERE source = 'sp' AND piece IS NOT NULL) GROUP BY piece),
n AS (SELECT piece, row_number() OVER (ORDER BY add_score DESC, piece) AS place FROM a)
SELECT r.place::INT AS place, r.token_id AS remove_id, r.piece AS remove_piece, n.piece AS add_piece FROM r JOIN n USING (place) WHERE r.place <= 10""",
)
def safe_swaps(spark: SparkSession, d: str) -> DataFrame:
    """The base's pieces that are missed least against the strongest pieces of the other vocabulary, protected ones left alone."""
    return building.safe_swaps(table(spark, d, "token_stats"), 10, 20, 5)


@query("text_metrics", f"WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {metrics_sql('doc_id')} SELECT * FROM measured")
def every_text_metric(spark: SparkSession, d: str) -> DataFrame:
    """The recorded figures of a text, computed anew from every whole text."""
    return text_metrics(docs_of(spark, d), "doc_id")


@query("mode_totals")
def mode_totals(spark: SparkSession, d: str) -> DataFrame:
    """All four ways to segment, with round trips; held against naive segmentations in the tests."""
    return inspection.mode_totals(docs_of(spark, d), table(spark, d, "vocab"))


@query("tokenizer_parity", f"WITH {counts()} SELECT count(*) AS docs, 0 AS different FROM n")
def tokenizer_parity(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose greedy counts differ between the pattern in the JVM and the segmenter in Python: none may."""
    from lexmill.operators.segmentation import encoded

    a = tk.greedy_counts(docs_of(spark, d), table(spark, d, "vocab"))
    b = encoded(docs_of(spark, d), table(spark, d, "vocab"), "greedy")
    both = a.join(b.select("doc_id", F.struct("n_bytes", "n_tokens", "fallback_tokens").alias("b")), "doc_id")
    return both.agg(F.count("*").alias("docs"), F.count_if(F.struct("n_bytes", "n_tokens", "fallback_tokens") != F.col("b")).cast("int").alias("different"))


@query("piece_decomposition")
def piece_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return inspection.decomposed(table(spark, d, "vocab"))


@query("segmentation_differences")
def segmentation_differences(spark: SparkSession, d: str) -> DataFrame:
    return inspection.differences(docs_of(spark, d), table(spark, d, "vocab"))


@query("candidate_merge")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of several files merged by priority of the file, then by place: first by ids or text wins."""
    rows = candidates_of(spark, d, "source_file")
    rank = F.dense_rank().over(building.Window.orderBy(F.col("source_file").asc_nulls_last()))
    files = rows.select("source_file").distinct().withColumn("file_rank", rank)
    keyed = rows.join(F.broadcast(files), rows.source_file.eqNullSafe(files.source_file)).select((F.col("file_rank") * 10**15 + F.col("cand_id")).alias("ord"), "ids", F.lower(cu.normalized(F.col("text"))).alias("norm"))
    return cu.first_wins(keyed)
