"""Filling sequences of fixed capacity with texts of varying length (problem 6).

Pattern packing by non-negative least squares. Of the lengths that occur, patterns of few lengths
that fill a sequence exactly are enumerated; how often to use each is fitted to the histogram of
lengths by non-negative least squares and rounded; the residual lengths are packed best fit, longest
first. All of it works on the histogram, whose size has the capacity as its bound, so that the
driver never holds texts. A text's place follows from its rank among the texts of its length: ranks
are counted per block and shifted by the blocks before, so that no length passes through one task.

Defined results for odd input
    null, empty text   0 tokens: a row with part_no 0 and seq_id null; takes no space
    text > capacity    divided into parts of the capacity and a rest, the only case of a division
    null source        belongs to no source filter, but to plans without one
    repeated rows      each row is packed
    null capacity      (or below 1) the plan packs nothing
    empty tables       no rows
    extra columns      ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.cluster import keep
from lexmill.llm.sizes import TOKENIZER, token_sizes

#: Most patterns fitted at once.
PATTERNS = 40_000
#: Most plans; they are read to the driver and become part of the plan.
MOST_PLANS = 1000
#: Documents of a block, within which ranks are counted.
BLOCK_DOCS = 500_000


@dataclass
class Layout:
    """Segments in order of (length, start): the items of ranks start.. go to bins base + (rank - start) // each."""

    length: np.ndarray
    start: np.ndarray
    each: np.ndarray
    base: np.ndarray
    n_bins: int
    n_exact: int


def patterns(hist: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of at most three lengths that fill the capacity exactly: lengths (P, 3) and multiplicities."""
    present = np.flatnonzero(hist)
    present = present[(present > 0) & (present < capacity)]
    if not len(present):
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    has = hist > 0
    most = capacity // present
    heads = [np.stack([present[most >= k], np.full((most >= k).sum(), k)]) for k in (1, 2, 3)]
    heads += [np.stack([present[most - d > 3], (most - d)[most - d > 3]]) for d in (0, 1, 2)]
    a, k = np.concatenate(heads, axis=1)
    rest = capacity - a * k
    found = [np.stack([a, k, np.zeros_like(a), np.zeros_like(a)], 1)[rest == 0]]
    one = (rest > 0) & has[rest]
    found.append(np.stack([a, k, rest, np.zeros_like(a)], 1)[one])
    n_fillers = int(np.clip(PATTERNS // max(1, len(a)), 2, 256))
    for b in present[np.argsort(-hist[present], kind="stable")][:n_fillers]:
        c = rest - b
        ok = (c >= b) & has[np.clip(c, 0, capacity)]
        found.append(np.stack([a, k, np.full_like(a, b), c], 1)[ok])
    rows = np.concatenate(found)
    lengths = np.stack([rows[:, 0], rows[:, 2], rows[:, 3]], 1)
    times = np.stack([rows[:, 1], (rows[:, 2] > 0).astype(np.int64), (rows[:, 3] > 0).astype(np.int64)], 1)
    return lengths, times


def fit_counts(hist: np.ndarray, lengths: np.ndarray, times: np.ndarray, steps: int = 120) -> np.ndarray:
    """x >= 0 that brings sum x * pattern near the histogram: weighted least squares, projected and accelerated."""
    n, flat, t = len(hist), lengths.ravel(), times.astype(float)
    per_row = np.maximum(np.bincount(flat, weights=t.ravel(), minlength=n), 1e-9)
    per_column = t.sum(1)
    x = y = np.zeros(len(lengths))
    momentum = 1.0
    for _ in range(steps):
        used = np.bincount(flat, weights=(t * y[:, None]).ravel(), minlength=n)
        used[0] = hist[0]
        pull = ((hist - used) / per_row)[lengths]
        nxt = np.maximum(0.0, y + (t * pull).sum(1) / per_column)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = np.maximum(0.0, nxt + (momentum - 1) / after * (nxt - x))
        x, momentum = nxt, after
    return x


def residual(avail: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, for all items of a length at once: [(pattern as (length, times), bins)]."""
    open_: dict[int, list[tuple[list, int]]] = {}
    filled = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: list, bins: int) -> None:
        if bins:
            open_.setdefault(room, []).append((pattern, bins))
            filled[room] = True

    for length in np.flatnonzero(avail)[::-1].tolist():
        n = int(avail[length])
        while n:
            room = length + int(filled[length:].argmax())
            if not filled[room]:
                k = capacity // length
                put(capacity - k * length, [(length, k)], n // k)
                if n % k:
                    put(capacity - n % k * length, [(length, n % k)], 1)
                break
            pattern, bins = open_[room].pop()
            filled[room] = bool(open_[room])
            k = room // length
            full = min(bins, n // k)
            put(room - k * length, [*pattern, (length, k)], full)
            n -= full * k
            if full < bins:
                if n:
                    put(room - n * length, [*pattern, (length, n)], 1)
                    bins -= 1
                    n = 0
                put(room, pattern, bins - full)
    return [group for groups in open_.values() for group in groups]


def layout(hist: np.ndarray, capacity: int) -> Layout:
    """Bins for hist[length] items of each length (0 < length <= capacity)."""
    avail = hist.astype(np.int64).copy()
    avail[0] = 0
    groups: list[tuple[list[tuple[int, int]], int]] = []
    if avail[capacity]:
        groups.append(([(capacity, 1)], int(avail[capacity])))
        avail[capacity] = 0
    lengths, times = patterns(avail, capacity)
    if len(lengths):
        x = fit_counts(avail.astype(float), lengths, times)
        for wanted in (np.rint(x), np.ceil(x)):  # what rounding down left goes to patterns that got part of a bin
            for p in np.argsort(-x, kind="stable"):
                if wanted[p] < 1:
                    break
                items: dict[int, int] = {}
                for one, k in zip(lengths[p].tolist(), times[p].tolist()):
                    if k:
                        items[one] = items.get(one, 0) + k
                n = min(int(wanted[p]), *(int(avail[one]) // k for one, k in items.items()))
                if n > 0:
                    groups.append((list(items.items()), n))
                    for one, k in items.items():
                        avail[one] -= n * k
    n_exact = sum(n for _, n in groups)
    groups += residual(avail, capacity)
    rows, seen, base = [], {}, 0
    for pattern, bins in groups:
        for one, k in pattern:
            start = seen.get(one, 0)
            rows.append((one, start, k, base))
            seen[one] = start + k * bins
        base += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Layout(*table.T, base, n_exact)


def _plans(plans: DataFrame) -> list[tuple[int, int, str | None]]:
    rows = plans.where("capacity_tokens >= 1").select("plan_id", "capacity_tokens", F.lower(F.trim("src_filter"))).distinct().limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    return sorted(map(tuple, rows))


def _parts(sizes: DataFrame, plans: list[tuple[int, int, str | None]]) -> DataFrame:
    """One row per plan, text and part of it: plan_id, doc_id, part_no, start_token, length."""
    offers = F.array(*(F.struct(F.lit(p).alias("plan_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(s).cast("string").alias("only")) for p, c, s in plans))
    rows = sizes.select("doc_id", "source", "n_tokens", F.explode(offers).alias("o")).where("o.only is null or o.only = source")
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("n_tokens") / F.col("o.capacity")) - 1)
    cut = rows.select("o.plan_id", "o.capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part_no"))
    start = F.col("part_no") * F.col("capacity")
    return cut.select("plan_id", "doc_id", "part_no", start.alias("start_token"), F.least(F.col("n_tokens") - start, F.col("capacity")).alias("length"))


def _ranked(parts: DataFrame, n_docs: int) -> DataFrame:
    """parts with their rank (from 0) among the parts of the same plan and length."""
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))
    blocked = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(n_blocks)))
    within = blocked.withColumn("rank", F.row_number().over(Window.partitionBy("plan_id", "length", "block").orderBy("doc_id", "part_no")) - 1)
    if n_blocks == 1:
        return within.drop("block")
    sizes = blocked.groupBy("plan_id", "length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("plan_id", "length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("plan_id", "length", "block", F.coalesce(before, F.lit(0)).alias("shift"))
    return within.join(shifts, ["plan_id", "length", "block"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("block", "shift")


def _prepared(docs: DataFrame, plans: DataFrame, tokenizer: str):
    sizes = keep(token_sizes(docs, tokenizer), "sizes")
    wanted = _plans(plans)
    if not wanted:
        wanted = [(-1, 1, "")]  # no source is empty after trimming, so nothing is packed
    parts = _parts(sizes, wanted)
    counts: dict[int, np.ndarray] = {p: np.zeros(c + 1, np.int64) for p, c, _ in wanted}
    for plan_id, length, n in parts.where("length > 0").groupBy("plan_id", "length").count().collect():  # at most the sum of the capacities
        counts[plan_id][length] += n
    return sizes, wanted, parts, {p: layout(h, len(h) - 1) for p, h in counts.items()}, counts


def packed_documents(docs: DataFrame, plans: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """plan_id, doc_id, part_no, start_token, n_tokens, seq_id of every text of every plan."""
    sizes, _, parts, layouts, _ = _prepared(docs, plans, tokenizer)
    shared = sizes.sparkSession.sparkContext.broadcast({p: (x.length, x.start, x.each, x.base) for p, x in layouts.items()})  # its bound is the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {p: (x[0] << 40) | x[1] for p, x in shared.value.items()}
        for b in batches:
            plan, length, rank = (b.column(i).to_numpy() for i in (0, 4, 5))
            seq = np.full(len(plan), -1, np.int64)
            for p in np.unique(plan):
                at = (plan == p) & (length > 0)
                _, start, each, base = shared.value[p]
                seg = np.searchsorted(keys[p], (length[at].astype(np.int64) << 40) | rank[at], "right") - 1
                if len(seg):
                    seq[at] = base[seg] + (rank[at] - start[seg]) // each[seg]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq, mask=seq < 0)], ["plan_id", "doc_id", "part_no", "start_token", "n_tokens", "seq_id"])

    ranked = _ranked(parts, sizes.count()).select("plan_id", "doc_id", "part_no", "start_token", "length", F.col("rank").cast("bigint").alias("rank"))
    return ranked.mapInArrow(place, "plan_id int, doc_id bigint, part_no bigint, start_token bigint, n_tokens bigint, seq_id bigint")


def packing_report(docs: DataFrame, plans: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per plan: sequences, those filled by patterns, least possible sequences, tokens, fill."""
    sizes, wanted, _, layouts, counts = _prepared(docs, plans, tokenizer)
    rows = []
    for p, c, s in wanted:
        if p >= 0:
            tokens = int((counts[p] * np.arange(c + 1)).sum())
            bins = layouts[p].n_bins
            rows.append((p, c, s, tokens, bins, layouts[p].n_exact, -(-tokens // c), round(tokens / (bins * c), 6) if bins else None))
    return sizes.sparkSession.createDataFrame(rows, "plan_id int, capacity_tokens int, src_filter string, tokens bigint, sequences bigint, by_pattern bigint, least_sequences bigint, fill double")
