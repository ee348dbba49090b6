"""Reports that compare tokenizations: totals, histograms, score cards, rankings, token verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def over(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def summary(docs: DataFrame) -> DataFrame:
    """One row over base_tokens, custom_tokens, n_bytes, fallback_tokens, fallback_runs of all documents."""
    total = docs.agg(F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in ("n_bytes", "base_tokens", "custom_tokens", "fallback_tokens", "fallback_runs")))
    c = F.col
    return total.select(
        "docs",
        "n_bytes",
        "base_tokens",
        "custom_tokens",
        (c("custom_tokens") - c("base_tokens")).alias("delta_tokens"),
        r6(over(c("base_tokens"), c("n_bytes"))).alias("base_tokens_per_byte"),
        r6(over(c("custom_tokens"), c("n_bytes"))).alias("custom_tokens_per_byte"),
        r6(over(c("custom_tokens") - c("base_tokens"), c("n_bytes"))).alias("delta_tokens_per_byte"),
        r6(over(c("n_bytes"), c("base_tokens"))).alias("base_bytes_per_token"),
        r6(over(c("n_bytes"), c("custom_tokens"))).alias("custom_bytes_per_token"),
        "fallback_tokens",
        "fallback_runs",
    )


def with_delta(docs: DataFrame) -> DataFrame:
    return docs.withColumn("delta_tokens", F.col("custom_tokens") - F.col("base_tokens"))


def delta_histogram(docs: DataFrame) -> DataFrame:
    return with_delta(docs).groupBy("delta_tokens").agg(F.count("*").alias("doc_count"))


def worst_documents(docs: DataFrame, texts: DataFrame, most: int = 200, preview: int = 220) -> DataFrame:
    """The documents with the greatest positive delta; previews are fetched for those only."""
    top = with_delta(docs).where("delta_tokens > 0").orderBy(F.desc("delta_tokens"), F.desc("custom_tokens"), "doc_id").limit(most)
    shown = F.replace(F.substring(F.coalesce("text", F.lit("")), 1, preview), F.lit("\n"), F.lit("\\n"))
    return texts.select("doc_id", shown.alias("text_preview")).join(F.broadcast(top), "doc_id").select("doc_id", "delta_tokens", "n_bytes", "base_tokens", "custom_tokens", "text_preview")


def score_card(docs: DataFrame, worst: int = 100) -> DataFrame:
    """Totals, shares of better and worse documents, exact percentiles of the delta, mean of the worst, scalar score."""
    d = F.col("delta_tokens")
    rows = with_delta(docs)
    tail = rows.select("delta_tokens", "doc_id").orderBy(F.desc("delta_tokens"), "doc_id").limit(worst).agg(F.avg("delta_tokens").alias("worst_mean"))
    one = rows.agg(
        F.count("*").alias("docs"),
        F.sum("base_tokens").alias("base_tokens"),
        F.sum("custom_tokens").alias("custom_tokens"),
        F.sum("fallback_tokens").alias("fallback_tokens"),
        F.count_if(d < 0).alias("improved"),
        F.count_if(d > 0).alias("worse"),
        F.count_if(d == 0).alias("same"),
        F.avg(d).alias("mean_delta"),
        *(F.percentile(d, F.lit(q)).alias(n) for n, q in (("median_delta", 0.5), ("p95_delta", 0.95), ("p99_delta", 0.99))),
    )
    c = F.col
    wide = one.join(F.broadcast(tail)).withColumns({"token_ratio": over(c("custom_tokens"), c("base_tokens")), "fallback_share": over(c("fallback_tokens"), c("custom_tokens")), "improved_share": over(c("improved"), c("docs")), "worse_share": over(c("worse"), c("docs"))})
    score = -1000 * (c("token_ratio") - 1) - 3000 * c("fallback_share") - 50 * c("mean_delta") - 100 * c("p95_delta") - 150 * c("p99_delta") - 200 * c("worst_mean") + 50 * c("improved_share") - 50 * c("worse_share")
    counts = ("docs", "base_tokens", "custom_tokens", "fallback_tokens", "improved", "worse", "same")
    shares = ("mean_delta", "median_delta", "p95_delta", "p99_delta", "worst_mean", "token_ratio", "fallback_share", "improved_share", "worse_share")
    return wide.select(*counts, *(r6(c(n)).alias(n) for n in shares), F.round(score, 4).alias("score"))


def variant_totals(rows: DataFrame) -> DataFrame:
    """Per variant: totals, ratio, wins, losses and ties, greatest win of either side (the first document on ties)."""
    d = F.col("delta_tokens")
    each = with_delta(rows)
    total = each.groupBy("variant").agg(
        F.count("*").alias("docs"),
        F.sum("base_tokens").alias("base_tokens"),
        F.sum("custom_tokens").alias("custom_tokens"),
        F.sum("fallback_tokens").alias("fallback_tokens"),
        F.sum("n_bytes").alias("n_bytes"),
        F.count_if(d < 0).alias("wins"),
        F.count_if(d > 0).alias("losses"),
        F.count_if(d == 0).alias("ties"),
        F.max(F.struct((-d).alias("by"), (-F.col("doc_id")).alias("doc"))).alias("win"),
        F.max(F.struct(d.alias("by"), (-F.col("doc_id")).alias("doc"))).alias("loss"),
    )
    c = F.col
    saved = c("base_tokens") - c("custom_tokens")
    return total.select(
        "variant", "docs", "base_tokens", "custom_tokens", r6(over(c("custom_tokens"), c("base_tokens"))).alias("ratio"), r6(over(c("fallback_tokens"), c("custom_tokens"))).alias("fallback_share"), "wins", "losses", "ties",
        saved.alias("abs_saved"), r6(over(saved * 100, c("base_tokens"))).alias("pct_saved"), r6(over(-saved, c("n_bytes"))).alias("delta_per_byte"),
        F.when(c("win.by") > 0, c("win.by")).otherwise(0).alias("best_win"), F.when(c("win.by") > 0, -c("win.doc")).alias("best_win_doc"), F.when(c("loss.by") > 0, c("loss.by")).otherwise(0).alias("worst_loss"), F.when(c("loss.by") > 0, -c("loss.doc")).alias("worst_loss_doc"),
    )


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with their place in an order; for reports of few rows (variants, configurations)."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def union_variants(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.withColumn("variant", F.lit(name)) for name, df in parts.items()))


# --- tokens of two vocabularies, from recorded statistics --------------------------------------


def token_verdicts(stats: DataFrame, n_docs: int) -> DataFrame:
    """source, token_id and what to do with a piece of the custom vocabulary; the order of the rules counts."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    coverage = c("doc_freq") / F.lit(float(n_docs))
    verdict = (
        F.when(c("in_sp") == 1, "overlap_keep")
        .when((c("freq") < 20) & (coverage < 0.002), "weak_remove")
        .when((c("compression_credit") < 0) & (coverage < 0.01), "weak_remove")
        .when((c("num_parts") >= 3) & (c("non_byte_parts") >= 2) & (c("freq") < 200), "possibly_overmerged")
        .when((c("compression_credit") > 0) & (coverage > 0.01) & (c("context_diversity") > 20), "custom_keep")
        .when(F.coalesce("piece", F.lit("")).startswith(" ") & (c("freq") > 100) & (coverage > 0.005), "custom_keep")
        .otherwise("review")
    )
    return stats.where("source = 'custom'").select("token_id", "piece", verdict.alias("verdict")).distinct()


def _first_stats(stats: DataFrame, source: str) -> DataFrame:
    order = Window.partitionBy("token_id").orderBy(F.col("freq").desc_nulls_last(), F.col("doc_freq").desc_nulls_last(), F.col("piece").asc_nulls_last())
    return stats.where(F.col("source") == source).withColumn("nth", F.row_number().over(order)).where("nth = 1")


def add_priority(stats: DataFrame) -> DataFrame:
    """Pieces only in the reference vocabulary, by how much they would add."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    score = 1.5 * F.log1p(c("freq")) + 200 * c("doc_coverage_ratio") + 2 * F.log1p(c("context_diversity")) + 5 * F.greatest(F.lit(0.0), c("compression_credit"))
    rows = _first_stats(stats, "sp").where("coalesce(in_custom, 0) <> 1 and piece is not null")
    return rows.select("token_id", "piece", c("freq").alias("freq"), c("doc_freq").alias("doc_freq"), F.round(score, 6).alias("priority"))


def removal_weakness(stats: DataFrame) -> DataFrame:
    """Pieces only in the custom vocabulary, by how little would be lost."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    score = 5000 / F.greatest(F.lit(1), c("freq")) + 5 * (1 - c("doc_coverage_ratio")) + 5 * F.greatest(F.lit(0.0), -c("compression_credit")) + 0.25 * c("num_parts")
    rows = _first_stats(stats, "custom").where("coalesce(in_sp, 0) <> 1 and piece is not null")
    return rows.select("token_id", "piece", c("freq").alias("freq"), c("doc_freq").alias("doc_freq"), F.round(score, 6).alias("weakness"))


def replacement_map(stats: DataFrame, most: int = 200) -> DataFrame:
    """The weakest custom-only pieces against the best reference-only pieces, place by place."""
    out = ranked(removal_weakness(stats), F.desc("weakness"), "token_id").where(F.col("place") <= most)
    new = ranked(add_priority(stats), F.desc("priority"), "token_id").where(F.col("place") <= most)
    o = out.select("place", F.col("token_id").alias("remove_id"), F.col("piece").alias("remove_piece"), F.col("freq").alias("remove_freq"))
    return o.join(new.select("place", F.col("token_id").alias("add_id"), F.col("piece").alias("add_piece"), F.col("freq").alias("add_freq")), "place")


def vocabulary_overlap(stats: DataFrame) -> DataFrame:
    """Numbers of pieces in both vocabularies and in one only."""
    a, b = (stats.where((F.col("source") == s) & F.col("piece").isNotNull()).select("piece").distinct().withColumn(s, F.lit(1)) for s in ("sp", "custom"))
    both = a.join(b, "piece", "full")
    return both.agg(F.count_if(F.col("sp").isNotNull() & F.col("custom").isNotNull()).alias("shared"), F.count_if(F.col("custom").isNull()).alias("only_sp"), F.count_if(F.col("sp").isNull()).alias("only_custom"))
