"""Evaluation records that also stand in the training split, exactly or nearly (problem 4).

Exact prefix-filter join of two sides. Every record becomes the set of its distinct word shingles.
Shingles are ordered: those of one side only first, then rare ones before common ones. Of each set,
only a prefix can decide whether it reaches the similarity with another: the evaluation prefixes
are the index, the training prefixes probe it. Sizes, places and signatures drop matches that cannot
reach the similarity; the rest is verified on the sets. Records of a side with equal sets are one
class, known by its least key.

Any order of the shingles that is the same for all sets gives the same pairs. So the order is taken
from counts in at most 2 ** CELL_BITS cells by hash, which are small enough to be sent along; shingles
that share a cell share its counts, which costs candidates and loses none. No shingle is shuffled
for the order: kept are the records' words, as codes, and shuffled the entries of the prefixes, in
rounds by shingle, so that a round holds at most ROUND_SHARE entries a word.

A signature has a bit for each of 128 hash values, set if an odd number of the set's shingles has it.
Two sets' signatures differ in at most as many bits as there are shingles in one set only.

A shingle with many sets on either side is salted on both, so that SALT_ROWS x SALT_ROWS pairs at
most meet under one key. Classes are expanded to pairs of records in blocks of BLOCK_ROWS members.

Defined results for odd input
    null or blank records   no shingles, never a case
    fewer than min_words    never a case
    repeated delivery       the same shard_id counts once (the earliest loaded_at)
    null shard_name         belongs to no split, never a case
    equal sets              one class; the pairs of its members are given, or the class with counts
    empty table             no rows
    extra columns           ignored
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.cluster import attached, hot_lookup, keep
from lexmill.functions.text import words

#: Sets of one side under one shingle that meet those of the other side in one task.
SALT_ROWS = 2_000
#: Members of a class in one block.
BLOCK_ROWS = 1_000
#: Most cells, as a power of two, over which shingles are counted; two bytes each in the driver and in every worker.
CELL_BITS = 24
#: Cells, as a power of two, whose counts one block holds.
BLOCK_BITS = 16
#: Bits, as a power of two, of the bitmap of the sets to be verified, and of one block of it (given by bitmap_construct_agg).
FILTER_BITS, BITMAP_BITS = 27, 15
#: Classes, those with the most members, of which only one member goes into the counts and entries.
REPEATED = 50_000
#: Entries a word that are shuffled in one round.
ROUND_SHARE = 0.15
#: Words from which on the entries are counted beforehand, on one in SAMPLED records.
FEW_WORDS, SAMPLED = 1_000_000, 32
#: Entries that a worker makes at once when salts repeat them.
BATCH_ENTRIES = 500_000

_CELLS = "block int, is_train boolean, cells binary, n binary"
_SUMS = "block int, is_train boolean, levels binary"
_ENTRIES = "k bigint, c1 bigint, sig_1 bigint, sig_2 bigint, size int, at int"
_CODES = "key bigint, split string, source string, is_train boolean, c1 bigint, c2 bigint"
_SETS = "set_id bigint, s array<bigint>"


def split_of(shard_name: Column) -> Column:
    return F.regexp_extract(F.lower(shard_name), "_(train|val|test)_", 1)


def previews(shards: DataFrame) -> DataFrame:
    """One row per preview: key (shard_id * 1000 + place), split, source, text."""
    order = Window.partitionBy("shard_id").orderBy(F.col("loaded_at").asc_nulls_last())
    once = shards.where("shard_id is not null").select("shard_id", "shard_name", "source", "loaded_at", "sample_previews").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    source = F.lower(F.trim("source"))
    rows = once.select("shard_id", split_of(F.col("shard_name")).alias("split"), source.alias("source"), F.posexplode("sample_previews").alias("place", "text"))
    return rows.where("split <> '' and text is not null").select((F.col("shard_id") * 1000 + F.col("place")).alias("key"), "split", "source", "text")


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; every step of it is kept, and none is run again from an earlier shuffle."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_codes(rows: DataFrame, n: int, min_words: int) -> DataFrame:
    """key, split, source, is_train, w (the codes of the words in order) of the rows with enough words."""
    long_enough = rows.select("key", "split", "source", words(F.col("text")).alias("w")).where(F.size("w") >= max(min_words, n))
    return long_enough.select("key", "split", "source", (F.col("split") == "train").alias("is_train"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))


def _shingles(w: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(g, row, starts, size): the distinct shingles of each row, sorted within it; every row has n words or more."""
    lengths = w.value_lengths().to_numpy(zero_copy_only=False)
    codes = w.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(w)), lengths)
    g, last = np.zeros(len(codes) - n + 1, np.uint64), len(codes) - n + 1
    for i in range(n):
        g = _seeded(g ^ codes[i : last + i], i + 1)
    within = row[:last] == row[n - 1 :]
    g, row = g[within], row[:last][within]
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    size = np.bincount(row, minlength=len(w))
    return g, row, np.cumsum(size) - size, size


def _code(g: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    return _seeded(np.add.reduceat(_seeded(g, seed), starts) + size.astype(np.uint64), seed)


def _signature(g: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _seeded(g, 101)
    bit, first = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) == 0
    return tuple(np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts) for half in (first, ~first))


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def _repeated(classes: DataFrame) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """Per side the first codes, in order, of the REPEATED classes with the most members, and their least keys."""
    most = classes.where("n_members > 1").orderBy(F.desc("n_members"), "c1", "c2", "is_train").limit(REPEATED).groupBy("c1", "is_train").agg(F.min("set_id"), F.count("*").alias("n"))
    most = most.where("n = 1").drop("n").toArrow()
    codes, train, keys = (most.column(c).to_numpy() for c in most.column_names)
    order = np.argsort(codes.view(np.uint64))
    return {side: (codes.view(np.uint64)[order][train[order] == side], keys[order][train[order] == side]) for side in (True, False)}


def _distinct(b: pa.RecordBatch, n: int, repeated: Broadcast) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...], np.ndarray]:
    """(b, its shingles, its first codes), of the repeated classes only the member of the least key."""
    sets = _shingles(b.column("w"), n)
    c1 = _code(sets[0], sets[2], sets[3], 11)
    held, key, train = np.ones(b.num_rows, bool), b.column("key").to_numpy(), b.column("is_train").to_numpy(zero_copy_only=False)
    for side, (codes, keys) in repeated.value.items():
        if len(codes):
            at = np.minimum(np.searchsorted(codes, c1), len(codes) - 1)
            held &= (train != side) | (codes[at] != c1) | (keys[at] == key)
    if held.all():
        return b, sets, c1
    g, row, _, size = sets
    row, g, size = (np.cumsum(held) - 1)[row[held[row]]], g[held[row]], size[held]
    return b.filter(pa.array(held)), (g, row, np.cumsum(size) - size, size), c1[held]


def _cell_counts(rows: DataFrame, n: int, bits: int, repeated: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Of the training side and of the evaluation side, the level of the number of sets per cell.

    Level 0: none; else the number is at most 2 ** ((level - 1) / 4), and about that.
    """
    wide = min(bits, BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (g, row, _, _), _ in (_distinct(b, n, repeated) for b in _full(batches)):
            if not b.num_rows:
                continue
            cell, side = (g >> np.uint64(64 - bits)).astype(np.int64), b.column("is_train").to_numpy(zero_copy_only=False)[row]
            out = []
            for is_train in (True, False):
                cells, found = np.unique(cell[side == is_train], return_counts=True)
                blocks, at = np.unique(cells >> wide, return_index=True)
                low, found = (cells & ((1 << wide) - 1)).astype("<u2"), found.astype("<u4")
                for block, x, y in zip(blocks.tolist(), at.tolist(), [*at[1:].tolist(), len(cells)]):
                    out.append((block, is_train, low[x:y].tobytes(), found[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["block", "is_train", "cells", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, bool], np.ndarray] = {}
        for b in batches:
            for block, is_train, cells, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                held = sums.setdefault((block, is_train), np.zeros(1 << wide, np.int64))
                held[np.frombuffer(cells, "<u2")] += np.frombuffer(found, "<u4")  # a cell stands in a row once
        for (block, is_train), held in sums.items():
            levels = np.where(held > 0, 1 + np.ceil(4 * np.log2(np.maximum(held, 1)) - 1e-9), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([is_train]), pa.array([levels.tobytes()], pa.binary())], ["block", "is_train", "levels"])

    levels = {side: np.zeros(1 << bits, np.uint8) for side in (True, False)}
    parts = rows.select("key", "is_train", "w").mapInArrow(count, _CELLS).repartition("block", "is_train").mapInArrow(add, _SUMS)
    for r in parts.collect():  # 2 ** (CELL_BITS + 1) bytes at most
        levels[r["is_train"]][r["block"] << wide : (r["block"] + 1) << wide] = np.frombuffer(r["levels"], np.uint8)
    return levels[True], levels[False]


def _needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """Least overlap of a set of that size with any set at the similarity."""
    return np.ceil(size * threshold - 1e-9).astype(np.int64)


def _entry_maker(n: int, bits: int, threshold: float, counted: Broadcast, repeated: Broadcast, salt_rows: int, rounds: int, nth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function from key, is_train, w to _ENTRIES: those in the prefixes, of shingles that both sides may have, of one round."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.r_[0, 2.0 ** (np.arange(255) / 4)]
        for b, (g, row, starts, size), c1 in (_distinct(b, n, repeated) for b in _full(batches)):
            if not b.num_rows:
                continue
            sig_1, sig_2 = _signature(g, starts)
            cell = (g >> np.uint64(64 - bits)).astype(np.int64)
            n_t, n_e = (numbers[levels[cell]] for levels in counted.value)
            both = (n_t > 0) & (n_e > 0)
            rank = np.where(both, 1 + np.ceil(8 * np.log2(np.maximum(n_t + n_e, 1))), 0).astype(np.uint64)
            # the sort is stable, and the shingles of a row come sorted
            order = np.lexsort(((rank << np.uint64(48)) | (g >> np.uint64(16)), row))
            at = np.arange(len(g)) - starts[row]
            held = (at <= (size - _needed(size, threshold))[row]) & both[order] & (g[order] % np.uint64(rounds) == nth)
            at, order = at[held], order[held]
            g, row, train = g[order], row[order], b.column("is_train").to_numpy(zero_copy_only=False)[row[order]]
            salts_t, salts_e = (np.ceil(x[order] / salt_rows).astype(np.int64) for x in (n_t, n_e))
            mine = (c1[row] % np.where(train, salts_t, salts_e).astype(np.uint64)).astype(np.int64)
            others = np.where(train, salts_e, salts_t)
            for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(others) // BATCH_ENTRIES)) + 1):
                each, r = np.repeat(part, others[part]), row[np.repeat(part, others[part])]
                other = np.arange(len(each)) - np.repeat(np.cumsum(others[part]) - others[part], others[part])
                salt = np.where(train[each], mine[each] << 32 | other, other << 32 | mine[each])
                k = _mixed(g[each] ^ _seeded(salt.astype(np.uint64), 12))
                longs = [pa.array(x.view(np.int64)) for x in (k, c1[r], sig_1[r], sig_2[r])]
                yield pa.RecordBatch.from_arrays([*longs, pa.array(size[r].astype(np.int32)), pa.array(at[each].astype(np.int32))], ["k", "c1", "sig_1", "sig_2", "size", "at"])

    return make


def _met(probe: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """e, t (first codes) of the sets that meet under an entry and may reach the similarity."""
    t, e = (side.select("k", *(F.col(c).alias(f"{name}_{c}") for c in side.columns[1:])) for name, side in (("t", probe), ("e", index)))
    t_size, e_size = F.col("t_size"), F.col("e_size")
    near = (t_size >= e_size * threshold - 1e-9) & (e_size >= t_size * threshold - 1e-9)
    need = F.ceil((t_size + e_size) * F.lit(threshold / (1 + threshold)) - 1e-9)
    # what a pair can have in common before, at and after a match
    reach = F.least("t_at", "e_at") + F.least(t_size - F.col("t_at"), e_size - F.col("e_at"))
    apart = F.bit_count(F.col("t_sig_1").bitwiseXOR(F.col("e_sig_1"))) + F.bit_count(F.col("t_sig_2").bitwiseXOR(F.col("e_sig_2")))
    return t.join(e, "k").where(near & (reach >= need) & (apart <= t_size + e_size - 2 * need)).select(F.col("e_c1").alias("e"), F.col("t_c1").alias("t")).distinct()


def _candidates(rows: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """e, t: first codes of the pairs of classes whose prefixes, sizes and signatures allow the similarity."""
    spark = rows.sparkSession
    n_words = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    bits = min(CELL_BITS, max(BLOCK_BITS, n_words.bit_length() - 1))
    repeated = spark.sparkContext.broadcast(_repeated(classes))
    counted = spark.sparkContext.broadcast(_cell_counts(rows, n, bits, repeated))

    def entries(of: DataFrame, rounds: int, nth: int) -> DataFrame:
        return of.select("key", "is_train", "w").mapInArrow(_entry_maker(n, bits, threshold, counted, repeated, SALT_ROWS, rounds, nth), _ENTRIES)

    rounds = 1
    if n_words >= FEW_WORDS:
        some = entries(rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0), 1, 0).count() * SAMPLED
        rounds = max(1, math.ceil(some / (ROUND_SHARE * n_words)))
    found = []
    for nth in range(rounds):
        probe, index = (entries(rows.where(side), rounds, nth) for side in ("is_train", "not is_train"))
        found.append(keep(_met(probe, index, threshold), "met"))
    pairs = found[0] if rounds == 1 else keep(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    counted.destroy()
    repeated.destroy()
    return pairs


def _coded(rows: DataFrame, n: int) -> DataFrame:
    """key, split, source, is_train and the two codes of the set, which tell the classes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _full(batches):
            g, _, starts, size = _shingles(b.column("w"), n)
            codes = [pa.array(_code(g, starts, size, seed).view(np.int64)) for seed in (11, 13)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *codes], ["key", "split", "source", "is_train", "c1", "c2"])

    return rows.select("key", "split", "source", "is_train", "w").mapInArrow(code, _CODES)


def _sets(rows: DataFrame, touched: DataFrame, n: int) -> DataFrame:
    """set_id, s (the sorted distinct shingles) of the touched classes and of few others.

    The rows are held against a bitmap of hash values, not joined: their words stay where they are.
    """
    n_bits = 1 << min(FILTER_BITS, max(BITMAP_BITS, 4 + touched.count().bit_length()))
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(n_bits))
    bits, blocks = np.zeros(n_bits // 8, np.uint8), touched.select(place("set_id").alias("p"))
    blocks = blocks.groupBy(F.shiftright("p", BITMAP_BITS).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << BITMAP_BITS) - 1)).alias("bits"))
    for r in blocks.collect():  # 2 ** (FILTER_BITS - 3) bytes at most
        at = r["block"] << BITMAP_BITS - 3
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    known = rows.sparkSession.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _full(batches):
            p = b.column("p").to_numpy()
            held = b.filter(pa.array((known.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            if held.num_rows:
                g, _, starts, _ = _shingles(held.column("w"), n)
                s = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(g)].astype(np.int32)), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([held.column("set_id"), s], ["set_id", "s"])

    return rows.select(F.col("key").alias("set_id"), place("key").alias("p"), "w").mapInArrow(make, _SETS)


def _links(rows: DataFrame, pairs: DataFrame, touched: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs of classes, e of the evaluation side and t of the training side: e, t, e_n, t_n (their members), similarity."""
    wanted = keep(_sets(rows, touched, n).join(touched, "set_id"), "wanted")
    whole = pairs
    for name, side in (("e", "not is_train"), ("t", "is_train")):
        sets = wanted.where(side).select(F.col("c1").alias(name), F.col("set_id").alias(f"{name}_id"), F.col("n_members").alias(f"{name}_n"), F.col("s").alias(f"{name}_s"))
        whole = attached(whole, sets, [name])
    common = F.size(F.array_intersect("e_s", "t_s"))
    told = whole.withColumn("similarity", common / (F.size("e_s") + F.size("t_s") - common))
    return told.where(F.col("similarity") >= threshold - 1e-12).select(F.col("e_id").alias("e"), F.col("t_id").alias("t"), "e_n", "t_n", "similarity")


def cross_split(shards: DataFrame, n: int = 3, threshold: float = 0.5, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, links): members key, split, source, is_train, set_id, n_members (the last two null for what is in no candidate); links between classes of the two sides."""
    with _shuffles_freed(shards.sparkSession):
        rows = keep(word_codes(previews(shards), n, min_words), "words")
        coded = keep(_coded(rows, n), "coded")
        classes = keep(coded.groupBy("c1", "c2", "is_train").agg(F.min("key").alias("set_id"), F.count("*").alias("n_members")), "classes")
        pairs = _candidates(rows, classes, n, threshold)
        sides = pairs.select(F.col("e").alias("c1"), F.lit(False).alias("is_train")).unionByName(pairs.select(F.col("t").alias("c1"), F.lit(True).alias("is_train")))
        touched = keep(classes.join(keep(sides.distinct(), "sides"), ["c1", "is_train"], "left_semi"), "touched")
        links = keep(_links(rows, pairs, touched, n, threshold), "links")
        members = keep(hot_lookup(coded, touched, ["c1", "c2", "is_train"], "n_members", "left").drop("c1", "c2"), "members")
    return members, links


def overlapping_pairs(shards: DataFrame) -> DataFrame:
    """Every pair of an evaluation and a training preview that are the same or nearly so."""
    members, links = cross_split(shards)
    n_blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("bigint")
    blocked = members.where("set_id is not null").withColumn("block", F.pmod(F.xxhash64("key"), n_blocks("n_members")))
    blocks = keep(blocked.groupBy("set_id", "block").agg(F.collect_set("key").alias("keys")), "blocks")
    each = links.select("e", "t", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks("e_n") - 1)).alias("e_block"), "t_n")
    each = each.select("e", "e_block", "t", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks("t_n") - 1)).alias("t_block"))
    for side in ("e", "t"):
        each = attached(each, blocks.select(F.col("set_id").alias(side), F.col("block").alias(f"{side}_block"), F.col("keys").alias(f"{side}_keys")), [side, f"{side}_block"])
    pairs = each.select(F.explode("e_keys").alias("e_key"), "t_keys").select("e_key", F.explode("t_keys").alias("t_key"))
    return pairs.select(F.least("e_key", "t_key").alias("preview_a"), F.greatest("e_key", "t_key").alias("preview_b"))


def overlap_report(shards: DataFrame) -> DataFrame:
    """Per evaluation split and source: previews, how many of them stand in training, best similarity."""
    members, links = cross_split(shards)
    best = links.groupBy(F.col("e").alias("set_id")).agg(F.max("similarity").alias("similarity"))
    e = members.where("not is_train").join(best, "set_id", "left")
    return e.groupBy("split", F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("previews"), F.count("similarity").alias("found"), F.count_if(F.col("similarity") == 1).alias("identical"), F.round(F.max("similarity"), 6).alias("best_similarity")
    )
