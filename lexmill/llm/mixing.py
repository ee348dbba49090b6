"""Mixing sources to target shares of the total size (problem 7).

Poisson replication. The total is the largest at which no source must repeat a document more than
its max_repeats on average; that gives each source a mean repetition rate. A document's count is
found by inverting a Poisson distribution, cut off at max_repeats, at a uniform number hashed from
its id; the distribution's mean is first solved for the rate, then corrected until the counts drawn
reach the target size. Each document is exploded by its count, and all copies are put into one
random order by a range partitioning on a hash.

Defined results for odd input
    absent source      reaches share 0; the others keep their ratios to one another
    null source        a document without source is in no mix
    null max_repeats   (or below 1) counts as 1
    null target_share  (or not above 0) counts as 0: no document of the source is taken
    null, empty text   0 tokens: never taken
    repeated doc_id    each row is a document of its own, with the same count
    empty tables       no rows
    extra columns      ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.cluster import keep
from lexmill.llm.sizes import TOKENIZER, token_sizes

SEED = 17
#: Most targets; they are read to the driver and broadcast.
MOST_TARGETS = 10_000
#: Means tried at once when the drawn size is corrected.
TRIES = 64


def cut_poisson(mean: float, most: int) -> list[float]:
    """P(count <= k) for k = 0 .. most - 1; a hashed u in [0, 1) has the count of entries below or at u."""
    if math.isinf(mean):
        return [0.0] * most
    if mean <= 0:
        return [1.0] * most
    total, out, log = 0.0, [], math.log(mean)
    for k in range(most):
        total += math.exp(k * log - mean - math.lgamma(k + 1))  # in logarithms, as exp(-mean) alone would vanish
        out.append(min(total, 1.0))
    return out


def _cut_mean(mean: float, most: int) -> float:
    return sum(1 - p for p in cut_poisson(mean, most))


def mean_for(rate: float, most: int) -> float:
    """The Poisson mean at which the count, cut off at most, is rate on average."""
    if rate >= most:
        return math.inf
    low, high = 0.0, max(1.0, rate)
    while _cut_mean(high, most) < rate and high < 1e12:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _cut_mean(mid, most) < rate else (low, mid)
    return (low + high) / 2


def rates(targets: list[tuple[int, str, float, int]], sizes: dict[str, int]) -> dict[tuple[int, str], tuple[float, int]]:
    """(mix, source) -> (target tokens, max_repeats), for the sources that have documents."""
    out = {}
    for mix in {t[0] for t in targets}:
        own = [(s, w, m) for i, s, w, m in targets if i == mix and w > 0 and sizes.get(s)]
        if own:
            total = min(m * sizes[s] / w for s, w, m in own)
            out |= {(mix, s): (w * total, m) for s, w, m in own}
    return out


def _targets(targets: DataFrame) -> list[tuple[int, str, float, int]]:
    rows = targets.where("mix_id is not null and source is not null").groupBy("mix_id", F.lower(F.trim("source")).alias("source")).agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))))
    found = rows.limit(MOST_TARGETS + 1).collect()
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return sorted(map(tuple, found))


def _offered(sizes: DataFrame, wanted: dict) -> DataFrame:
    """One row per mix that takes a document's source, with the document's u."""
    offers = sizes.sparkSession.createDataFrame([(m, s) for m, s in wanted], "mix_id int, source string")
    rows = sizes.where("n_tokens > 0").join(F.broadcast(offers), "source")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "mix_id", "doc_id"), 11) * F.lit(2.0**-53)
    return rows.select("mix_id", "source", "doc_id", "n_tokens", u.alias("u"))


def _drawn(rows: DataFrame, tries: dict[tuple[int, str], list[list[float]]]) -> dict[tuple[int, str], np.ndarray]:
    """Tokens drawn in each (mix, source) under each distribution tried."""

    listed = {k: np.array(v, dtype=float) for k, v in tries.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for b in batches:
            coded = b.column(1).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            key, u = b.column(0).to_numpy().astype(np.int64) * len(names) + code, b.column(3).to_numpy()
            order = np.lexsort((u, key))  # the batch is sorted once; each group is then a run with ascending u
            key, u, n = key[order], u[order], b.column(2).to_numpy()[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            for a, z in zip(starts, [*starts[1:], len(key)]):
                k = (int(key[a]) // len(names), names[int(key[a]) % len(names)])
                if (cuts := listed.get(k)) is not None:
                    from_top = np.r_[np.cumsum(n[a:z][::-1])[::-1], 0]  # tokens of documents at or above each u
                    drawn = from_top[np.searchsorted(u[a:z], cuts, "left")].sum(axis=1).astype(np.int64)
                    total[k] = total.get(k, 0) + drawn
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([total[k].tolist() for k in keys], pa.list_(pa.int64()))], ["mix_id", "source", "drawn"])

    parts = rows.select("mix_id", "source", "n_tokens", "u").mapInArrow(sums, "mix_id int, source string, drawn array<bigint>")
    each = parts.select("mix_id", "source", F.posexplode("drawn").alias("k", "v")).groupBy("mix_id", "source", "k").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, str], np.ndarray] = {k: np.zeros(len(v), np.int64) for k, v in tries.items()}
    for mix, source, k, v in each.collect():  # targets times TRIES numbers
        out[mix, source][k] = v
    return out


def _distributions(rows: DataFrame, wanted: dict, sizes: dict[str, int]) -> dict[tuple[int, str], list[float]]:
    means = {k: mean_for(tokens / sizes[k[1]], most) for k, (tokens, most) in wanted.items()}
    spread = {k: (m * 0.6, m * 1.5 + 1e-9) for k, m in means.items() if not math.isinf(m)}
    for _ in range(2):
        grid = {k: np.linspace(*ends, TRIES) for k, ends in spread.items()}
        if not grid:
            break
        drawn = _drawn(rows, {k: [cut_poisson(m, wanted[k][1]) for m in g] for k, g in grid.items()})
        for k, g in grid.items():
            near = int(np.abs(drawn[k] - wanted[k][0]).argmin())
            means[k] = float(g[near])
            spread[k] = (float(g[max(0, near - 1)]), float(g[min(TRIES - 1, near + 1)]))
    return {k: cut_poisson(m, wanted[k][1]) for k, m in means.items()}


def _counted(docs: DataFrame, targets: DataFrame, tokenizer: str):
    sizes = keep(token_sizes(docs, tokenizer), "sizes")
    asked = _targets(targets)
    totals = {r[0]: r[1] for r in sizes.where(F.col("source").isin(sorted({t[1] for t in asked}))).groupBy("source").agg(F.sum("n_tokens")).collect()} if asked else {}
    wanted = rates(asked, totals)
    rows = _offered(sizes, wanted)
    cuts = _distributions(rows, wanted, totals)
    table = sizes.sparkSession.createDataFrame([(m, s, c) for (m, s), c in cuts.items()], "mix_id int, source string, cuts array<double>")
    copies = F.size(F.filter("cuts", lambda c: c <= F.col("u")))
    return rows.join(F.broadcast(table), ["mix_id", "source"]).select("mix_id", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0"), asked


def mixed_documents(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """mix_id, doc_id, copy_no, source, n_tokens, in global random order (by order_key)."""
    counted, _ = _counted(docs, targets, tokenizer)
    copies = counted.select("mix_id", "doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    keyed = copies.withColumn("order_key", F.xxhash64(F.lit(SEED + 1), "mix_id", "doc_id", "copy_no"))
    return keyed.repartitionByRange("order_key").sortWithinPartitions("order_key")


def mixture_report(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per mix and source: target_share and reached_share, documents, copies, tokens, most copies of one."""
    counted, asked = _counted(docs, targets, tokenizer)
    reached = counted.groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    asked_df = counted.sparkSession.createDataFrame(asked, "mix_id int, source string, target_share double, max_repeats int")
    whole = reached.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    rows = asked_df.join(reached, ["mix_id", "source"], "left").join(F.broadcast(whole), "mix_id", "left")
    return rows.select("mix_id", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("reached_share"), "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("most_copies", "documents", "copies", "tokens")))
