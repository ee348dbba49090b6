"""Building vocabularies: staged slots, grids of configurations, local search, swaps, reserved slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.lines import is_protected
from lexmill.functions.text import strip_space

SLOTS = 1024
BYTE_SLOTS = 256


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """Vocabulary-sized rows numbered from 1 in an order."""
    return rows.withColumn("nth", F.row_number().over(Window.orderBy(*order)))


def staged(stages: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Pieces of several stages (piece, priority), each with a kind and a budget; the first stage with a piece has it.

    Within a stage: priority descending, then shorter, then by text. Then all byte pieces, then
    reserved slots up to SLOTS; ids in that order.
    """
    parts = [df.where("piece is not null and piece <> ''").groupBy("piece").agg(F.max("priority").cast("double").alias("priority")).select("piece", "priority", F.lit(kind).alias("kind"), F.lit(k).alias("stage"), F.lit(budget).alias("budget")) for k, (df, kind, budget) in enumerate(stages)]
    every = reduce(DataFrame.unionByName, parts)
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("piece").orderBy("stage"))).where("n = 1")
    order = (F.desc_nulls_last("priority"), F.char_length("piece"), "piece")
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("stage").orderBy(*order))).where("n <= budget and stage is not null")
    spark = every.sparkSession
    room = SLOTS - BYTE_SLOTS
    literal = chosen.withColumn("slot", F.row_number().over(Window.orderBy("stage", "n"))).where(F.col("slot") <= room).select("slot", "piece", "kind", "priority")
    reserved = spark.range(1, room + 1).select(F.col("id").cast("int").alias("slot"), F.format_string("<RESERVED_%d>", F.col("id")).alias("piece"), F.lit("reserved").alias("kind"), F.lit(None).cast("double").alias("priority"))
    filled = literal.unionByName(reserved.join(literal.select("slot"), "slot", "left_anti"))
    bytes_ = spark.range(BYTE_SLOTS).select((F.col("id") + room + 1).cast("int").alias("slot"), F.format_string("<0x%02X>", F.col("id")).alias("piece"), F.lit("byte").alias("kind"), F.lit(None).cast("double").alias("priority"))
    return filled.unionByName(bytes_).select((F.col("slot") - 1).alias("id"), "piece", "kind", "priority")


def grid(options: dict[str, list]) -> list[dict]:
    out: list[dict] = [{}]
    for name, values in options.items():
        out = [{**config, name: v} for config in out for v in values]
    return out


def configurations(spark, options: dict[str, list]) -> DataFrame:
    """Every combination of options, as rows; options are lists written in a program, not data."""
    rows = grid(options)
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(options))


def neighbours(seeds: DataFrame, deltas: DataFrame, bounds: dict[str, tuple[int, int]], room: int) -> DataFrame:
    """Configurations around ranked seeds: every delta on every seed, within bounds and room, each once (best seed first).

    seeds: seed_rank and the columns of bounds; deltas: gen and d_<column> of each. Both are short.
    """
    moved = seeds.crossJoin(F.broadcast(deltas)).select("seed_rank", "gen", *((F.col(c) + F.col(f"d_{c}")).alias(c) for c in bounds))
    inside = reduce(lambda a, b: a & b, (F.col(c).between(*b) for c, b in bounds.items()))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in bounds))
    order = Window.partitionBy(*bounds).orderBy("seed_rank", "gen")
    return moved.where(inside & (total <= room)).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def removal_families(usage: DataFrame, locked: int = 64) -> DataFrame:
    """Places of the removable pieces in three orders: little use, little coverage, weak overall."""
    rows = usage.where((F.col("id") >= locked) & ~F.col("piece").rlike("^<0x[0-9A-Fa-f]{2}>$"))
    orders = {"low_usage": ("use_count", "doc_count", "id"), "low_coverage": ("doc_count", "use_count", "id"), "weak_overall": ("removal_score", "use_count", "id")}
    return reduce(DataFrame.unionByName, (_numbered(rows, *o).select(F.lit(name).alias("family"), F.col("nth").alias("place"), "id", "piece") for name, o in orders.items()))


def windows_of(family: DataFrame, size: int) -> DataFrame:
    """Consecutive windows of `size` places; a window that is not full is left out."""
    rows = family.withColumn("variant", F.floor((F.col("place") - 1) / size).cast("int"))
    full = rows.groupBy("family", "variant").agg(F.count("*").alias("n")).where(F.col("n") == size).select("family", "variant")
    return rows.join(full, ["family", "variant"])


def swapped(vocab: DataFrame, remove: DataFrame, add: DataFrame) -> DataFrame:
    """vocab with the i-th removed id (in order of id) given to the i-th added piece; fails where the numbers differ."""
    out = _numbered(remove.select("id"), "id")
    new = _numbered(add.select("piece", "place"), "place").select("nth", F.col("piece").alias("new_piece"))
    n = out.agg(F.count("*").alias("a")).join(F.broadcast(new.agg(F.count("*").alias("b"))))
    check = n.select(F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.lit("as many pieces must be added as removed")).cast("boolean")).alias("ok"))
    pairs = out.join(new, "nth").join(F.broadcast(check)).where("ok")
    return vocab.select("id", "piece").join(pairs.select("id", "new_piece"), "id", "left").select("id", F.coalesce("new_piece", "piece").alias("piece"), F.when(F.col("new_piece").isNotNull(), F.col("piece")).alias("replaced"))


def fill_reserved(vocab: DataFrame, add: DataFrame) -> DataFrame:
    """vocab with the first reserved slots, in order of id, given to added pieces that it does not have yet."""
    free = _numbered(vocab.where(F.col("piece").startswith("<RESERVED_")).select("id"), "id")
    new = _numbered(add.join(vocab.select("piece"), "piece", "left_anti"), "place").select("nth", F.col("piece").alias("new_piece"))
    pairs = free.join(new, "nth").select("id", "new_piece")
    return vocab.join(pairs, "id", "left").select("id", F.coalesce("new_piece", "piece").alias("piece"), F.when(F.col("new_piece").isNotNull(), "filled").otherwise(F.col("kind")).alias("kind"))


# Ids that no swap removes, and the usual least counts of an added piece.
SPECIAL_IDS, LEAST_FREQ, LEAST_DOC_FREQ = [0, 1, 2, 3], 500, 200


def safe_swaps(stats: DataFrame, most: int, least_freq: int = LEAST_FREQ, least_doc_freq: int = LEAST_DOC_FREQ) -> DataFrame:
    """place, remove_id, remove_piece, add_piece: pieces of the base ('sp') that are missed least, and the strongest that it lacks.

    stats: one report row per source and token; of repeated rows the one with the highest counts.
    """
    order = Window.partitionBy("source", "token_id").orderBy(F.col("freq").desc_nulls_last(), F.col("doc_freq").desc_nulls_last(), F.col("piece").asc_nulls_last())
    rows = stats.withColumn("nth", F.row_number().over(order)).where("nth = 1 and piece is not null").drop("nth")
    c = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double")
    p, credit, free = F.col("piece"), F.greatest(F.lit(0.0), c("compression_credit")), ~is_protected(F.col("piece"))
    base = rows.where("source = 'sp'")
    missed = F.round(c("freq") + 2.0 * c("doc_freq") + 0.5 * c("context_diversity") + 5.0 * credit, 6)
    out = _numbered(base.where(free & ~F.col("token_id").isin(SPECIAL_IDS)).withColumn("missed", missed), "missed", "token_id")
    bonus = F.when(p.startswith(" "), 1.0).otherwise(0.0) + F.when(F.char_length(strip_space(p)) >= 2, 0.5).otherwise(0.0)
    strength = F.round(2.0 * F.sqrt(c("freq")) + 3.0 * F.sqrt(c("doc_freq")) + F.sqrt(c("context_diversity")) + 4.0 * credit + bonus, 6)
    new = rows.where(free & (c("in_sp") != 1) & (F.col("in_custom") == 1) & (c("freq") >= least_freq) & (c("doc_freq") >= least_doc_freq)).join(F.broadcast(base.select("piece")), "piece", "left_anti")
    best = _numbered(new.groupBy("piece").agg(F.max(strength).alias("strength")), F.desc("strength"), "piece")
    old = out.where(F.col("nth") <= most).select("nth", F.col("token_id").alias("remove_id"), F.col("piece").alias("remove_piece"))
    return old.join(best.select("nth", F.col("piece").alias("add_piece")), "nth").withColumnRenamed("nth", "place")
