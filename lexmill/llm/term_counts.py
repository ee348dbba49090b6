"""Frequency of every distinct term over a global integer dictionary (problem 1).

Every distinct term gets an integer identifier before anything is counted: identifiers are cut into
ranges of about RANGE by hash, and a term's identifier is its range and its slot in it. Rows are
encoded with them, blocks of encoded rows accumulate count arrays over the slots of each range, for
occurrences and for presence in documents, and the arrays are then summed range by range.

Rows travel with a 128-bit code of their term instead of the term. The dictionary is checked for two
terms of one code; should there be any, it is built anew with another seed.

Defined results for odd input
    null text        the row is left out altogether
    blank text       counts as a row (its documents are among all documents), is never a term
    repeated hit_id  counts once; where copies differ, the smallest non-null doc_id and hits, and of
                     the terms that with the smallest code (one of them, the same in every run)
    null hit_id      cannot be told from others, so every such row counts
    null doc_id      counts towards freq, not towards doc_freq
    null hits        counts as 0
    empty table      no rows
    extra columns    ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.cluster import HOT_KEYS, keep
from lexmill.functions.text import collapse_space

#: Identifiers per range, on average; count arrays have about this length.
RANGE = 16_384
#: Identifiers set aside for a range; hashing fills none of them to that.
RANGE_IDS = 8 * RANGE
#: Rows after which a block gives its arrays away, so that its memory has a bound.
BLOCK_PAIRS = 1_000_000
#: Rows of one term that are encoded and counted in one task before the term is salted by document.
SALT_ROWS = 100_000

_PARTS = "part_no int, kind int, slots array<int>, freq array<bigint>, docs array<bigint>, terms array<string>"
_COUNTS = "term_id bigint, term string, freq bigint, doc_freq bigint"


def term_of(text: Column) -> Column:
    """Lower case, straight apostrophes, single spaces, trimmed."""
    return collapse_space(F.translate(F.lower(text), "‘’", "''"))


def _codes(term: Column, seed: int) -> dict[str, Column]:
    return {"h1": F.xxhash64(F.lit(seed), term), "h2": F.xxhash64(F.lit(seed + 1), term)}


def term_dictionary(rows: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """(dictionary, number of ranges, seed of its codes).

    dictionary: part_no, slot, term, h1, h2, n_rows (rows that hold the term); identifiers are
    part_no * RANGE_IDS + slot. No two terms have the same code.
    """
    raw = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("raw")).agg(F.count("*").alias("n_rows"))
    terms = keep(raw.groupBy(term_of(F.col("raw")).alias("term")).agg(F.sum("n_rows").alias("n_rows")), "terms")
    n_parts, seed = max(1, -(-terms.count() // RANGE)), 42
    while True:
        coded = terms.withColumns(_codes(F.col("term"), seed)).withColumn("part_no", F.pmod("h1", F.lit(n_parts)).cast("int"))
        order = Window.partitionBy("part_no").orderBy("h1", "h2")
        same = (F.lag("h1").over(order) == F.col("h1")) & (F.lag("h2").over(order) == F.col("h2"))
        placed = keep(coded.select("part_no", (F.row_number().over(order) - 1).alias("slot"), "term", "h1", "h2", "n_rows", F.coalesce(same, F.lit(False)).alias("same")), "dictionary")
        if placed.where("same").isEmpty():
            return placed.drop("same"), n_parts, seed
        seed += 2


def encoded(once: DataFrame, dictionary: DataFrame) -> DataFrame:
    """once(h1, h2, doc_id, ..) with part_no, slot and salt; one shuffle, by term and salt.

    A term of very many rows is salted by document, so that all rows of a term and a document still
    meet in one task. There can be at most HOT_KEYS such terms, and only their codes are broadcast.
    """
    total = dictionary.agg(F.sum("n_rows")).first()[0] or 0
    most = max(SALT_ROWS, -(-total // HOT_KEYS))
    salts = F.ceil(F.col("n_rows") / most).cast("int")
    hot = dictionary.where(F.col("n_rows") > most).select("h1", "h2", salts.alias("salts")).limit(HOT_KEYS)
    marked = once.join(F.broadcast(hot), ["h1", "h2"], "left")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")
    salted = dictionary.select("h1", "h2", "part_no", "slot", F.explode(F.sequence(F.lit(0), F.when(F.col("n_rows") > most, salts - 1).otherwise(0))).alias("salt"))
    return marked.withColumn("salt", salt).drop("salts").join(salted.hint("shuffle_hash"), ["h1", "h2", "salt"])


def _block_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded rows (part_no, slot, hits, known), one per term, document and salt -> count arrays per block and range."""

    def arrays(part, slot, hits, known) -> pa.RecordBatch:
        ids, inverse = np.unique(part.astype(np.int64) * RANGE_IDS + slot, return_inverse=True)
        freq, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(freq, inverse, hits)
        np.add.at(docs, inverse, known)
        parts, at = np.unique(ids // RANGE_IDS, return_index=True)
        offsets = pa.array(np.r_[at, len(ids)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((ids % RANGE_IDS).astype(np.int32), freq, docs)]
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.ones(n, np.int32)), *lists, pa.nulls(n, pa.list_(pa.string()))], ["part_no", "kind", "slots", "freq", "docs", "terms"])

    held, n = [], 0
    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        n += b.num_rows
        if n >= BLOCK_PAIRS:
            yield arrays(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield arrays(*map(np.concatenate, zip(*held)))


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range, first its terms by slot (kind 0), then count arrays of blocks (kind 1) -> the sums."""
    part, freq, docs, terms = None, None, None, None

    def out():
        ids = np.int64(part) * RANGE_IDS + np.arange(len(terms))
        return pa.RecordBatch.from_arrays([pa.array(ids), terms, pa.array(freq), pa.array(docs)], ["term_id", "term", "freq", "doc_freq"])

    for b in batches:
        kinds, parts = b.column("kind").to_pylist(), b.column("part_no").to_pylist()
        lists = {k: b.column(k) for k in ("slots", "freq", "docs", "terms")}
        for i, kind in enumerate(kinds):
            if kind == 0:
                if part is not None:
                    yield out()
                part, terms = parts[i], lists["terms"][i].values
                freq, docs = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
                continue
            if parts[i] != part:
                raise ValueError(f"counts of range {parts[i]}, which has no dictionary")
            slots = lists["slots"][i].values.to_numpy()  # each at most once in an array
            freq[slots] += lists["freq"][i].values.to_numpy()
            docs[slots] += lists["docs"][i].values.to_numpy()
    if part is not None:
        yield out()


def term_counts(hits: DataFrame) -> DataFrame:
    """term_id, term, freq, doc_freq of every distinct term of hits(hit_id, text, doc_id, hits)."""
    rows = hits.select("hit_id", "text", "doc_id", F.col("hits").cast("bigint").alias("hits")).where("text is not null")
    dictionary, _, seed = term_dictionary(rows)
    coded = rows.select("hit_id", F.when(F.col("hit_id").isNull(), F.monotonically_increasing_id()).alias("row_no"), "doc_id", "hits", *(c.alias(k) for k, c in _codes(term_of(F.col("text")), seed).items()))
    # h2 of the row with the least h1: a code that some term has, and buffers that a hash aggregate can hold
    once = coded.groupBy("hit_id", "row_no").agg(F.min("h1").alias("h1"), F.min_by("h2", "h1").alias("h2"), F.min("doc_id").alias("doc_id"), F.min("hits").alias("hits"))
    # the join has put all rows of a term, document and salt into one task: no shuffle here
    pairs = encoded(once.select("h1", "h2", "doc_id", "hits"), dictionary).groupBy("h1", "h2", "salt", "part_no", "slot", "doc_id").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    blocks = pairs.select("part_no", "slot", "hits", F.col("doc_id").isNotNull().cast("bigint").alias("known")).mapInArrow(_block_arrays, _PARTS)
    none = {"slots": "array<int>", "freq": "array<bigint>", "docs": "array<bigint>"}
    terms = F.transform(F.array_sort(F.collect_list(F.struct("slot", "term"))), lambda e: e["term"])
    listed = dictionary.groupBy("part_no").agg(terms.alias("terms")).select("part_no", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(k) for k, t in none.items()), "terms")
    ranges = listed.unionByName(blocks).repartition("part_no").sortWithinPartitions("part_no", "kind")
    return ranges.mapInArrow(_sum_ranges, _COUNTS).where("term <> ''")


def mark_terms(counts: DataFrame, n_docs: int, min_freq: int = 5, min_docs: int = 3, max_share: float = 0.2) -> DataFrame:
    """mark: 'rare' below min_freq or min_docs, else 'common' in more than max_share of n_docs, else null."""
    rare = (F.col("freq") < min_freq) | (F.col("doc_freq") < min_docs)
    return counts.withColumn("mark", F.when(rare, "rare").when(F.col("doc_freq") > F.lit(max_share) * n_docs, "common"))


def marked_terms(hits: DataFrame) -> DataFrame:
    """term_counts of hits with marks set against all documents of the rows with text."""
    n_docs = hits.where("text is not null").agg(F.count_distinct("doc_id")).first()[0]
    return mark_terms(term_counts(hits), n_docs)
