"""Profiles and scores of shards, layout of exported shards, batches, training logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.cluster import keep, running_total
from lexmill.functions.metrics import METRICS, text_metrics
from lexmill.operators.evaluation import r6


def id_counts(arrays: DataFrame) -> DataFrame:
    """shard_name, id, uses: all that a profile needs, combined before the shuffle."""
    return arrays.select("shard_name", F.explode("ids").alias("id")).groupBy("shard_name", "id").agg(F.count("*").alias("uses"))


def profile(counts: DataFrame) -> DataFrame:
    """Per shard_name of id_counts: token count, least, greatest, mean, population deviation, distinct ids and their share."""
    one = counts.groupBy("shard_name").agg(F.sum("uses").alias("token_count"), F.min("id").alias("min_token"), F.max("id").alias("max_token"), (F.sum(F.col("id").cast("double") * F.col("uses")) / F.sum("uses")).alias("mean"), F.count("*").alias("unique_token_count"))
    off = counts.alias("c").join(one.alias("o"), F.col("c.shard_name").eqNullSafe(F.col("o.shard_name"))).select("o.*", "uses", (F.col("id") - F.col("mean")).alias("off"))
    spread = off.groupBy(*one.columns).agg(F.sqrt(F.sum(F.col("uses") * F.col("off") * F.col("off")) / F.col("token_count")).alias("std"))
    return spread.select("shard_name", "token_count", "min_token", "max_token", r6(F.col("mean")).alias("mean_token"), r6(F.col("std")).alias("std_token"), "unique_token_count", r6(F.col("unique_token_count") / F.col("token_count")).alias("unique_token_ratio"))


def top_tokens(counts: DataFrame, most: int = 20) -> DataFrame:
    """Per shard of id_counts its most frequent ids with their share; equal counts in order of id."""
    whole = Window.partitionBy("shard_name")
    ranked = counts.withColumns({"place": F.row_number().over(whole.orderBy(F.desc("uses"), "id")), "all_uses": F.sum("uses").over(whole)})
    return ranked.where(F.col("place") <= most).select("shard_name", "place", "id", r6(F.col("uses") / F.col("all_uses")).alias("share"))


def once_per_shard(summaries: DataFrame) -> DataFrame:
    order = Window.partitionBy("shard_id").orderBy(F.col("loaded_at").asc_nulls_last())
    return summaries.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def z_scores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with z_<column>: distance from the mean in population deviations; 0 where the deviation is 0 or unknown."""
    facts = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    wide = rows.join(F.broadcast(facts))
    z = {f"z_{c}": F.coalesce(F.when(F.col(f"sd_{c}") > 1e-12, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")), F.lit(0.0)) for c in columns}
    return wide.withColumns(z).drop(*(f"{n}_{c}" for c in columns for n in ("mean", "sd")))


# Weights of the shard scores, and the measures that are ranked.
DIVERSITY = {"mean_unique_word_ratio": 0.45, "mean_unique_words": 0.25, "unique_token_count": 0.15, "std_token": 0.15}
NOISE = {"mean_url_hits": 0.30, "mean_html_hits": 0.30, "mean_repeated_char_hits": 0.20, "mean_non_printable_ratio": 0.10, "mean_digit_ratio": 0.10}
CLEAN_PROSE = {"mean_ascii_ratio": 0.25, "mean_unique_word_ratio": 0.25, "mean_unique_words": 0.20, "mean_digit_ratio": -0.10, "mean_url_hits": -0.10, "mean_html_hits": -0.10}
PRIORITY = {"score_clean_prose": 0.55, "score_diversity": 0.45, "score_noise": -0.35}
BEST_HIGH = ["score_diversity", "score_noise", "score_clean_prose", "score_priority", "mean_unique_word_ratio", "mean_unique_words", "mean_ascii_ratio", "unique_token_count", "std_token"]
BEST_LOW = ["mean_url_hits", "mean_html_hits", "mean_repeated_char_hits", "mean_non_printable_ratio", "mean_digit_ratio"]


def _weighted(weights: dict[str, float], prefix: str = "z_") -> Column:
    return F.round(reduce(lambda a, b: a + b, (F.col(prefix + c) * w for c, w in weights.items())), 6)


def sample_averages(summaries: DataFrame) -> DataFrame:
    """Per shard_name: sample_count and the means of the text measures of its sampled texts."""
    texts = once_per_shard(summaries).select("shard_name", F.explode("sample_previews").alias("text")).where("text is not null")
    each = text_metrics(texts, "shard_name")
    return each.groupBy("shard_name").agg(F.count("*").alias("sample_count"), *(F.avg(c).alias(f"mean_{c}") for c in METRICS))


def shard_scores(summaries: DataFrame) -> DataFrame:
    """Diversity, noise, prose and priority scores of the training shards, and the ranks of all scored measures.

    The measures are those of the sampled texts; a shard without samples ranks last in them.
    """
    train = once_per_shard(summaries).where(F.col("shard_name").contains("_train_")).select("shard_name", "std_token", F.col("unique_token_count").cast("double").alias("unique_token_count"))
    rows = keep(train.join(sample_averages(summaries), "shard_name", "left"), "shard-measures")  # one row per shard
    z = z_scores(rows, sorted({*DIVERSITY, *NOISE, *CLEAN_PROSE}))
    scored = z.withColumns({"score_diversity": _weighted(DIVERSITY), "score_noise": _weighted(NOISE), "score_clean_prose": _weighted(CLEAN_PROSE)})
    scored = scored.withColumn("score_priority", _weighted(PRIORITY, ""))
    ranks = {f"rank_{c}_desc": F.rank().over(Window.orderBy(F.round(c, 6).desc_nulls_last())) for c in BEST_HIGH} | {f"rank_{c}_asc": F.rank().over(Window.orderBy(F.round(c, 6).asc_nulls_last())) for c in BEST_LOW}
    return scored.withColumns(ranks).select("shard_name", *PRIORITY, "score_priority", *ranks)


def sample_windows(stream: DataFrame, width: int = 512, samples: int = 8) -> DataFrame:
    """The tokens of evenly spaced windows of a stream (mining.linked): scope, sample, pos, id; one window where it is shorter.

    Only the stretches of documents that windows reach into are written out.
    """
    sizes = stream.groupBy("scope").agg(F.sum("n").alias("n_scope"))
    last = (F.col("n_scope") - width).cast("double")
    many = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.struct(i.alias("sample"), F.floor(i * (last / (samples - 1))).alias("begin")))
    starts = sizes.select("scope", F.when(F.col("n_scope") <= width, F.array(F.struct(F.lit(0).alias("sample"), F.lit(0).cast("bigint").alias("begin")))).otherwise(many).alias("windows"))
    placed = stream.join(starts, "scope")
    low = lambda w: F.greatest(w["begin"], F.col("start"))
    high = lambda w: F.least(w["begin"] + width, F.col("start") + F.col("n"))
    met = placed.select("scope", "a", "start", F.explode(F.filter(F.transform("windows", lambda w: F.struct(w["sample"].alias("sample"), low(w).alias("low"), high(w).alias("high"))), lambda w: w["low"] < w["high"])).alias("w"))
    cut = F.slice("a", (F.col("w.low") - F.col("start") + 1).cast("int"), (F.col("w.high") - F.col("w.low")).cast("int"))
    return met.select("scope", "w.sample", "w.low", F.posexplode(cut).alias("k", "id")).select("scope", "sample", (F.col("low") + F.col("k")).alias("pos"), "id")


def export_layout(counts: DataFrame, val_docs: int, shard_tokens: int, most_shards: int | None = None) -> DataFrame:
    """Place of every document in the export: split, offset in it, first and last shard, tokens written.

    counts: ord (from 0, unique), doc_id, n_tokens. The first val_docs documents are validation; a
    document may straddle shards; with most_shards (over both splits), what lies beyond is cut.
    """
    split = F.when(F.col("ord") < val_docs, "val").otherwise("train")
    rows = running_total(counts.select("ord", "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), split.alias("split")), ["ord"], "n_tokens", "whole")
    val = rows.agg(F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("n_tokens"))), F.lit(0)).alias("val_tokens"))
    placed = rows.join(F.broadcast(val)).withColumn("offset", F.when(F.col("split") == "val", F.col("whole")).otherwise(F.col("whole") - F.col("val_tokens")))
    val_shards = F.ceil(F.col("val_tokens") / shard_tokens)
    stop = F.col("offset") + F.col("n_tokens")
    if most_shards is None:
        written = F.col("n_tokens")
    else:
        room = F.when(F.col("split") == "val", F.least(val_shards, F.lit(most_shards))).otherwise(F.greatest(F.lit(most_shards) - val_shards, F.lit(0))) * shard_tokens
        written = F.greatest(F.lit(0).cast("bigint"), F.least(stop, room) - F.col("offset"))
    made = placed.withColumn("written", written.cast("bigint"))
    first = F.floor(F.col("offset") / shard_tokens)
    last = F.floor((F.col("offset") + F.col("written") - 1) / shard_tokens)
    return made.select("ord", "doc_id", "split", "offset", "n_tokens", "written", F.when(F.col("written") > 0, first).alias("first_shard"), F.when(F.col("written") > 0, last).alias("last_shard"))


def export_stats(layout: DataFrame, shard_tokens: int) -> DataFrame:
    """Per split: documents, tokens seen and written, shards."""
    s = layout.groupBy("split").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum("written").alias("written"), (F.coalesce(F.max("last_shard") + 1, F.lit(0))).alias("shards"))
    return s.withColumn("stopped_early", F.col("written") < F.col("tokens"))


def manifest(stats: DataFrame, name: str, vocab_size: int) -> DataFrame:
    """One row with the export's description as JSON; splits in order of name."""
    splits = F.array_sort(F.collect_list(F.struct("split", "docs", "tokens", "written", "shards")))
    return stats.agg(F.to_json(F.struct(F.lit(name).alias("name"), F.lit("piece").alias("tokenizer_kind"), F.lit(vocab_size).alias("vocab_size"), splits.alias("splits"))).alias("manifest"))


def batches(layout: DataFrame, seq_len: int, ranks: int) -> DataFrame:
    """Per split: whole sequences of seq_len + 1 shifted by seq_len, usable tokens, steps of all ranks together."""
    s = layout.groupBy("split").agg(F.sum("written").alias("tokens"))
    n = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / seq_len))
    return s.select("split", "tokens", n.alias("sequences"), F.when(n > 0, n * seq_len + 1).otherwise(0).alias("usable_tokens"), F.floor(n / ranks).alias("steps"))


def chunk_plan(stats: DataFrame, seq_len: int, most_chunk_tokens: int) -> DataFrame:
    """split, chunk (from 0), tokens of stats(split, written): whole sequences, cut into chunks of whole sequences.

    Fails where a split has less than one sequence.
    """
    usable = F.floor(F.col("written") / seq_len) * seq_len
    checked = F.when(usable > 0, usable).otherwise(F.raise_error(F.lit(f"token budget too small for seq_len={seq_len}")).cast("bigint"))
    size = max(most_chunk_tokens // seq_len * seq_len, seq_len)
    rows = stats.select("split", checked.alias("usable")).select("split", "usable", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("usable") - 1) / size))).alias("chunk"))
    return rows.select("split", "chunk", F.least(F.col("usable") - F.col("chunk") * size, F.lit(size).cast("bigint")).alias("tokens"))


def rank_batches(stats: DataFrame, seqs: int, seq_len: int, ranks: int, steps: int) -> DataFrame:
    """split, step, rank, first, last, wraps of stats(split, written): the span + 1 tokens that each rank reads at each step.

    The stream is read in a circle; inputs are the span's first tokens, targets the same shifted by one.
    """
    span = seqs * seq_len + 1
    grid = stats.where("written > 0").select("split", "written", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).select("split", "written", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
    at = (F.col("step").cast("bigint") * ranks + F.col("rank")) * span
    first = F.pmod(at, F.col("written"))
    return grid.select("split", "step", "rank", first.alias("first"), F.pmod(at + span - 1, F.col("written")).alias("last"), (first + span > F.col("written")).alias("wraps"))


def scheduled_scales(steps: DataFrame, until: int, before: dict[str, float], after: dict[str, float]) -> DataFrame:
    """steps(step) with the gradient scale of each token class: those of `before` up to a step, then those of `after`."""
    return steps.select("step", *(F.when(F.col("step") < until, F.lit(before[k])).otherwise(F.lit(after[k])).alias(f"{k}_scale") for k in before))


def run_summaries(lines: DataFrame) -> DataFrame:
    """One row per run of training-log lines (run, line_no, line): the last value of each figure, rank by bits per byte."""
    l = F.col("line")  # noqa: E741
    figures = {"step": r"step:(\d+)/", "val_loss": r"val_loss:([0-9.]+)", "val_bpb": r"val_bpb:([0-9.]+)", "step_ms": r"step_avg:([0-9.]+)ms"}
    found = lines.select("run", "line_no", *(F.when(l.rlike(p), F.regexp_extract(l, p, 1)).cast("double").alias(n) for n, p in figures.items()), l.startswith("stopping_early").alias("stopped"))
    one = found.groupBy("run").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in figures), F.max("stopped").alias("stopped_early"))
    best = one.agg(F.min("val_bpb").alias("best"))
    ranked = one.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("val_bpb"), "run")))
    return ranked.join(F.broadcast(best)).select("run", "place", F.col("step").cast("int").alias("step"), "val_loss", "val_bpb", "step_ms", "stopped_early", F.round(F.col("val_bpb") - F.col("best"), 6).alias("behind"))
