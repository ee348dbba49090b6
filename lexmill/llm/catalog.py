"""Named queries of this package: QUERIES and ORACLES, as in lexmill.catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.cluster import documents, table
from lexmill.functions.metrics import text_metrics
from lexmill.llm import copies, mixing, overlap, packing, pii, quality, repetition, sql, term_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("p1_found", sql.P1_FOUND)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "ngram_hits")).where("mark is not null").select("term", "mark")


@query("p1_terms", sql.P1_TERMS)
def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "ngram_hits")).select("term", "freq", "doc_freq", "mark")


@query("p2_found", sql.P2_FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.structural_documents(documents(spark, d), table(spark, d, "common_words")).select("doc_id")


@query("p2_metrics", sql.P2_METRICS)
def p2_metrics(spark: SparkSession, d: str) -> DataFrame:
    return text_metrics(documents(spark, d), "doc_id").drop("repeated_char_hits")


@query("p2_scores")
def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored_documents(documents(spark, d), table(spark, d, "common_words"))


@query("p3_found", sql.P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive_documents(documents(spark, d)).select("doc_id")


@query("p3_profile")
def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    stops = quality.common_word_list(table(spark, d, "common_words"))
    return repetition.repetition_profile(documents(spark, d), stops).drop("text")


@query("p4_found", sql.P4_FOUND)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_pairs(table(spark, d, "shard_summaries"))


@query("p4_report", sql.P4_REPORT)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "shard_summaries"))


@query("p5_found", sql.P5_FOUND)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.candidate_copies(table(spark, d, "merge_candidates_final_v1"))


@query("p5_kept", sql.P5_KEPT)
def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return copies.kept_candidates(table(spark, d, "merge_candidates_final_v1"))


@query("p6_packed")
def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(documents(spark, d), table(spark, d, "pack_plans"))


@query("p6_fill")
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(documents(spark, d), table(spark, d, "pack_plans"))


@query("p7_mixed")
def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, d), table(spark, d, "mix_targets"))


@query("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(documents(spark, d), table(spark, d, "mix_targets"))


def _pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_mentions(documents(spark, d), table(spark, d, "name_lexicon"), table(spark, d, "common_words"))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d).select("doc_id", "pii_kind", "start_char")


@query("p8_redacted")
def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(documents(spark, d), _pii(spark, d))
