"""Records that differ only in how they are written (problem 5).

A record is put into one canonical form (raw JSON and columns alike: field order and JSON style go,
letters are folded to one case, everything but letters and digits goes), which is hashed to 128
bits. Counts are aggregated per hash with map-side combining. A third, independent hash is
aggregated beside them: where a group holds two, two forms share the 128 bits, and such groups are
then grouped by the form itself.

Defined results for odd input
    null fields      two nulls are equal, a null and a value are not
    null text        equal to a null text only, not to an empty one
    broken JSON      the record's own columns stand (all null if they are)
    repeated rows    each row is a copy; rows of the same cand_id count once
    empty table      no rows
    extra columns    ignored, unless passed as keep_fields
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.cluster import hot_lookup, keep
from lexmill.functions.text import ALNUM
from lexmill.operators.curation import parsed


def canonical_text(text: Column) -> Column:
    """Letters and digits in order, case folded (ß and SS are one, as upper case has no ß)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.upper(text)), "ß", "ss"), f"[^{ALNUM}]+", "")


def canonical_form() -> Column:
    """One string per record; equal exactly when the records are the same."""
    return F.to_json(F.struct("n", "ids", "freq", "class", canonical_text(F.col("text")).alias("text")), {"ignoreNullFields": "false"})


def copy_groups(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows cand_id, h1, h2; groups h1, h2, keep_id, n_copies (members, the kept one included)."""
    form = parsed(candidates).select("cand_id", canonical_form().alias("form"))
    hashed = form.select("cand_id", F.xxhash64("form").alias("h1"), F.xxhash64(F.lit("second"), "form").alias("h2"), F.xxhash64(F.lit("third"), "form").alias("h3"), "form")
    counted = keep(_counted(hashed.select("cand_id", "h1", "h2", "h3"), ["h1", "h2"]), "copies")
    if counted.where("min_h3 <> max_h3").isEmpty():
        return hashed.select("cand_id", "h1", "h2"), counted.select("h1", "h2", "keep_id", "n_copies")
    clash = counted.where("min_h3 <> max_h3").select("h1", "h2").withColumn("clash", F.lit(True))
    told = hashed.join(clash, ["h1", "h2"], "left").withColumn("h2", F.when(F.col("clash"), F.xxhash64("h3", "h2")).otherwise(F.col("h2")))
    rows = keep(told.select("cand_id", "h1", "h2", "h3"), "copies-told")
    return rows.select("cand_id", "h1", "h2"), _counted(rows, ["h1", "h2"]).select("h1", "h2", "keep_id", "n_copies")


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("cand_id").alias("keep_id"), F.count("*").alias("n_copies"), F.min("h3").alias("min_h3"), F.max("h3").alias("max_h3"))


def kept_candidates(candidates: DataFrame) -> DataFrame:
    """One row per group: keep_id and n_copies."""
    return copy_groups(candidates)[1].select("keep_id", "n_copies")


def candidate_copies(candidates: DataFrame) -> DataFrame:
    """keep_id and copy_id of every candidate that is a copy of another."""
    rows, groups = copy_groups(candidates)
    pairs = hot_lookup(rows, groups.where("n_copies > 1"), ["h1", "h2"], "n_copies")
    return pairs.where("cand_id <> keep_id").select("keep_id", F.col("cand_id").alias("copy_id")).distinct()
