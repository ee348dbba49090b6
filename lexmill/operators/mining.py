"""N-grams of token ids: counts, contexts, association, merge savings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.cluster import keep

#: Distinct neighbours of an n-gram count up to this.
MOST_CONTEXTS = 256


#: Longest n-gram: its ids are packed into one integer.
MOST_IDS = 3


def linked(arrays: DataFrame, scope: str | None = None) -> DataFrame:
    """arrays(doc_id, ids, scope column) as streams: scope, doc_id, a, n, prev, start.

    a: the document's n ids and the MOST_IDS that follow in the stream; prev: the id before; start:
    its place in the stream. N-grams run over documents, never over streams. One row per document
    is sorted, not its tokens; without a scope every document is a stream of its own.
    """
    rows = arrays.where("size(ids) > 0")
    if scope is None:
        return rows.select(F.col("doc_id").cast("string").alias("scope"), "doc_id", F.col("ids").alias("a"), F.size("ids").alias("n"), F.lit(None).cast("int").alias("prev"), F.lit(0).cast("bigint").alias("start"))
    w = Window.partitionBy("scope").orderBy("doc_id")
    follow = F.flatten(F.collect_list(F.slice("ids", 1, MOST_IDS)).over(w.rowsBetween(1, MOST_IDS)))
    start = F.coalesce(F.sum(F.size("ids")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = rows.withColumn("scope", F.coalesce(F.col(scope).cast("string"), F.lit("")))
    return own.select("scope", "doc_id", F.concat("ids", F.slice(follow, 1, MOST_IDS)).alias("a"), F.size("ids").alias("n"), F.lag(F.element_at("ids", -1)).over(w).alias("prev"), start.alias("start"))


def _rows(stream: DataFrame, n: int, *more: str) -> DataFrame:
    """One row per place of an n-gram: key, and of `more` what is asked: scope, scope_code, pos, before, after.

    Shifted copies of a document's array are zipped and written out, which stays in generated code.
    """
    if not 1 <= n <= MOST_IDS:
        raise ValueError(f"n: 1 to {MOST_IDS}")
    a, size = F.col("a"), F.col("n")
    columns = {f"i{k}": F.slice(a, k + 1, size) for k in range(n)}
    columns |= {"before": F.slice(F.concat(F.array("prev"), a), 1, size)} if "before" in more else {}
    columns |= {"after": F.slice(a, n + 1, size)} if "after" in more else {}
    columns |= {"pos": F.sequence(F.col("start"), F.col("start") + size - 1)} if "pos" in more else {}
    named = stream.select("scope", F.xxhash64("scope").alias("scope_code"), *(c.alias(k) for k, c in columns.items()))
    zipped = named.select(*(c for c in ("scope", "scope_code") if c in more), F.inline(F.arrays_zip(*columns)))
    return zipped.where(f"i{n - 1} is not null").select(_packed(n).alias("key"), *more)


def _packed(n: int) -> Column:
    """Up to three 16-bit ids in one integer, the first in the highest place."""
    return reduce(lambda a, b: F.shiftleft(a, 16).bitwiseOR(b), (F.col(f"i{k}").cast("bigint") for k in range(n)))


def _unpacked(key: Column, n: int) -> Column:
    return F.concat_ws(" ", *(F.shiftright(key, 16 * (n - 1 - k)).bitwiseAND(F.lit(0xFFFF)).cast("string") for k in range(n)))


def gram_counts(stream: DataFrame, n: int, least: int = 1) -> DataFrame:
    """n, gram, occurrences, streams it occurs in, capped numbers of distinct neighbours on both sides.

    Distinct pairs of n-gram and neighbour, packed into one integer, are found with map-side combining
    before they are counted, so that no frequent n-gram meets in one task.
    """
    scopes = _rows(stream, n, "scope_code").groupBy("key", "scope_code").agg(F.count("*").alias("c"))
    often = keep(scopes.groupBy("key").agg(F.sum("c").alias("freq"), F.count("*").alias("shard_count")).where(F.col("freq") >= least), "often")
    rows = often
    for side in ("before", "after"):
        pairs = _rows(stream, n, side).where(F.col(side).isNotNull())
        found = pairs.select(F.shiftleft("key", 16).bitwiseOR(F.col(side).cast("bigint")).alias("pair")).distinct().groupBy(F.shiftrightunsigned("pair", 16).alias("key")).agg(F.least(F.count("*"), F.lit(MOST_CONTEXTS)).alias(f"{side}_contexts"))
        rows = rows.join(found, "key", "left")
    return rows.select(F.lit(n).alias("n"), _unpacked(F.col("key"), n).alias("gram"), "freq", "shard_count", *(F.coalesce(f"{side}_contexts", F.lit(0).cast("bigint")).alias(f"{side}_contexts") for side in ("before", "after")))


def merge_values(stream: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 20) -> DataFrame:
    """gram_counts with pointwise mutual information and the value of merging."""
    single = keep(_rows(stream, 1).groupBy(F.col("key").cast("int").alias("id")).agg(F.count("*").alias("f")), "single")  # one row per piece
    total = single.agg(F.sum("f").alias("total"))
    out = []
    for n in sizes:
        rows = gram_counts(stream, n, least).join(F.broadcast(total))
        product = F.lit(1.0)
        for k in range(n):
            one = single.select(F.col("id").cast("string").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
            rows = rows.withColumn(f"w{k}", F.element_at(F.split("gram", " "), k + 1)).join(one, f"w{k}").drop(f"w{k}")
            product = product * (F.col(f"f{k}") / F.col("total"))
        p = F.col("freq") / (F.col("total") - F.lit(n - 1))
        pmi = F.ln(F.greatest(p / F.greatest(product, F.lit(1e-18)), F.lit(1e-12)))
        value = F.col("freq") * (n - 1) * F.greatest(pmi, F.lit(0.0)) * (1 + F.ln(1.0 + F.col("before_contexts") + F.col("after_contexts")))
        saved = (F.col("freq") * (n - 1)).alias("tokens_saved")
        out.append(rows.select("n", "gram", "freq", "shard_count", "before_contexts", "after_contexts", saved, F.round(pmi, 6).alias("pmi"), F.round(value, 3).alias("merge_value")))
    return reduce(DataFrame.unionByName, out)


def decoded(rows: DataFrame, vocab: DataFrame, most: int) -> DataFrame:
    """The `most` best rows, with their text; pieces are joined on after the cut."""
    top = rows.orderBy(F.desc("merge_value"), "n", "gram").limit(most)
    parts = top.select("n", "gram", F.posexplode(F.split("gram", " ")).alias("k", "w"))
    named = parts.join(vocab.select(F.col("id").cast("string").alias("w"), "piece"), "w").groupBy("n", "gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return top.join(named, ["n", "gram"])


def candidate_grams(candidates: DataFrame, n: int) -> DataFrame:
    """Distinct grams of the candidates of length n: gram, freq (the greatest of its rows)."""
    rows = candidates.where(F.col("ids").isNotNull() & (F.size("ids") == n))
    return rows.groupBy(F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("gram")).agg(F.max("freq").alias("recorded_freq"))


def naive_savings(stream: DataFrame, candidates: DataFrame, n: int = 3) -> DataFrame:
    """Occurrences of each candidate and what merging all of them would save, overlaps not considered."""
    found = _rows(stream, n).groupBy("key").agg(F.count("*").alias("occurrences"))
    return candidate_grams(candidates, n).join(found.select(_unpacked(F.col("key"), n).alias("gram"), "occurrences"), "gram").select("gram", "recorded_freq", "occurrences", (F.col("occurrences") * (n - 1)).alias("naive_saved"))


def greedy_merges(stream: DataFrame, candidates: DataFrame, n: int = 3) -> DataFrame:
    """Per stream: tokens, merges of a left-to-right pass that never overlaps, tokens saved.

    Places where a candidate begins fall into islands: runs of places less than n apart. No merge
    reaches from one island into the next, so the pass runs within islands, not over the stream.
    """
    ids = [F.split("gram", " ")[k].cast("int").alias(f"i{k}") for k in range(n)]
    keys = candidate_grams(candidates, n).select(*ids).select(_packed(n).alias("key")).distinct()
    marked = _rows(stream, n, "scope", "pos").join(keys, "key", "left_semi")
    w = Window.partitionBy("scope").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(w) >= n, F.lit(True))
    islands = marked.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w))
    passed = F.aggregate(
        F.array_sort(F.collect_list(F.col("pos").cast("bigint"))),
        F.struct(F.lit(0).cast("bigint").alias("free"), F.lit(0).cast("bigint").alias("merges")),
        lambda a, p: F.when(p >= a["free"], F.struct((p + n).alias("free"), (a["merges"] + 1).alias("merges"))).otherwise(a),
        lambda a: a["merges"],
    )
    merged = islands.groupBy("scope", "island").agg(passed.alias("merges")).groupBy("scope").agg(F.sum("merges").alias("merges"))
    sizes = stream.groupBy("scope").agg(F.sum("n").alias("tokens"))
    counted = sizes.join(merged, "scope", "left").withColumn("merges", F.coalesce("merges", F.lit(0)))
    return counted.select("scope", "tokens", "merges", (F.col("merges") * (n - 1)).alias("saved"))


def greedy_longest_merges(stream: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per stream: tokens, merges and tokens saved of a left-to-right pass that takes a trigram where it can, else a bigram.

    As in greedy_merges the pass runs within islands of places, which no merge reaches across.
    """
    marks = []
    for n in (3, 2):
        ids = [F.split("gram", " ")[k].cast("int").alias(f"i{k}") for k in range(n)]
        keys = candidate_grams(candidates, n).select(*ids).select(_packed(n).alias("key")).distinct()
        marks.append(_rows(stream, n, "scope", "pos").join(keys, "key", "left_semi").select("scope", "pos", F.lit(n).alias("size")))
    longest = marks[0].unionByName(marks[1]).groupBy("scope", "pos").agg(F.max("size").alias("size"))
    w = Window.partitionBy("scope").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(w) >= 3, F.lit(True))
    islands = longest.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w))
    none = F.lit(0).cast("bigint")
    passed = F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", F.col("size").cast("bigint").alias("size")))),
        F.struct(none.alias("free"), none.alias("merges"), none.alias("saved")),
        lambda a, p: F.when(p["pos"] >= a["free"], F.struct((p["pos"] + p["size"]).alias("free"), (a["merges"] + 1).alias("merges"), (a["saved"] + p["size"] - 1).alias("saved"))).otherwise(a),
    )
    each = islands.groupBy("scope", "island").agg(passed.alias("p")).groupBy("scope").agg(F.sum("p.merges").alias("merges"), F.sum("p.saved").alias("saved"))
    sizes = stream.groupBy("scope").agg(F.sum("n").alias("tokens"))
    return sizes.join(each, "scope", "left").select("scope", "tokens", F.coalesce("merges", F.lit(0)).alias("merges"), F.coalesce("saved", F.lit(0)).alias("saved"))


def savings_report(per_stream: DataFrame) -> DataFrame:
    one = per_stream.agg(F.sum("tokens").alias("tokens"), F.sum("merges").alias("merges"), F.sum("saved").alias("saved"), F.count_if(F.col("saved") > 0).alias("streams_with_merges"))
    return one.withColumn("percent_saved", F.round(F.try_divide(F.col("saved") * 100.0, F.col("tokens")), 6))
