"""Greedy tokenization without leaving the JVM, and relations over rows of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.vocabulary import Index, collected, longest_match_pattern, piece_bytes


def literal_pieces(vocab: DataFrame) -> list[str]:
    return sorted({p for _, p in collected(vocab) if p and not (len(p) == 6 and p.startswith("<0x") and p.endswith(">"))})


def greedy_pieces(docs: DataFrame, vocab: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named, m: the text cut into longest pieces, single characters where no piece matches."""
    pattern = longest_match_pattern(literal_pieces(vocab))
    return docs.select("doc_id", *more, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)).alias("m"))


def greedy_counts(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fallback_tokens, fallback_runs of the greedy tokenization."""
    pieces = literal_pieces(vocab)
    known = lambda x: x.isin(pieces) if pieces else F.lit(False)
    flagged = greedy_pieces(docs, vocab).select("doc_id", "m", F.transform("m", known).alias("k"))
    lost = F.filter("m", lambda x: ~known(x))
    lost_bytes = F.octet_length(F.array_join(lost, ""))
    first = F.transform("k", lambda x, i: ~x & ((i == 0) | F.get(F.col("k"), i - 1)))
    return flagged.select(
        "doc_id",
        F.octet_length(F.array_join("m", "")).cast("bigint").alias("n_bytes"),
        (F.size(F.filter("k", lambda x: x)) + lost_bytes).cast("bigint").alias("n_tokens"),
        lost_bytes.cast("bigint").alias("fallback_tokens"),
        F.size(F.filter(first, lambda x: x)).cast("bigint").alias("fallback_runs"),
    )


def token_rows(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per greedy token: doc_id, at, byte_no, id, piece, is_byte; (at, byte_no) is the order in the document."""
    # the outer form, as the plain one makes Spark cut every text a second time to drop empty ones first
    rows = greedy_pieces(docs, vocab).select("doc_id", F.posexplode_outer("m").alias("at", "x")).where("x is not null")
    literal = vocab.where(~F.col("piece").rlike("^<0x[0-9A-Fa-f]{2}>$")).groupBy("piece").agg(F.min("id").alias("id"))
    known = rows.join(literal, rows.x == literal.piece, "left")
    pairs = F.regexp_extract_all(F.hex(F.encode("x", "utf-8")), F.lit(".."), F.lit(0))
    spelled = F.when(F.col("id").isNotNull(), F.array("x")).otherwise(F.transform(pairs, lambda h: F.concat(F.lit("<0x"), h, F.lit(">"))))
    each = known.select("doc_id", "at", "id", F.posexplode(spelled).alias("byte_no", "piece"))
    by_byte = vocab.where(F.col("piece").rlike("^<0x[0-9A-Fa-f]{2}>$")).select(F.upper("piece").alias("spelled"), F.col("id").alias("byte_id"))
    joined = each.join(F.broadcast(by_byte.limit(256)), F.col("id").isNull() & (F.upper("piece") == F.col("spelled")), "left")
    return joined.select("doc_id", "at", "byte_no", F.coalesce("id", "byte_id").alias("id"), "piece", F.col("id").isNull().alias("is_byte"))


def token_arrays(docs: DataFrame, vocab: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named, ids: the greedy tokens of each document in order, characters without a piece as their bytes.

    Texts are cut in the JVM; ids are looked up a batch at a time. All that follows from a token's
    neighbours is then a matter of places in an array, without a shuffle or sort of tokens.
    """
    index = Index.of(collected(vocab))
    pieces = pa.array(list(index.ids), pa.string())
    numbers, bytes_ = np.array([*index.ids.values(), -1], np.int32), np.array(index.byte_ids, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(b.num_columns - 1)
            values, offsets = m.flatten(), np.diff(m.offsets.to_numpy())
            at = pc.fill_null(pc.index_in(values, pieces), -1).to_numpy()
            lost = at < 0
            sizes = np.ones(len(at), np.int64)
            spelled = values.filter(pa.array(lost)).cast(pa.binary())
            sizes[lost] = pc.binary_length(spelled).to_numpy(zero_copy_only=False)
            ids = np.repeat(numbers[at], sizes)
            if lost.any():
                ids[np.repeat(lost, sizes)] = bytes_[np.frombuffer(b"".join(spelled.to_pylist()), np.uint8)]
            ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(offsets)]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], [*b.schema.names[:-1], "ids"])

    cut = greedy_pieces(docs, vocab, *more)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    return cut.mapInArrow(run, f"{kinds}, ids array<int>")


def unigrams(arrays: DataFrame) -> DataFrame:
    return arrays.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("freq"))


def _doc_counts(arrays: DataFrame) -> DataFrame:
    return arrays.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.count("*").alias("doc_freq"))


def usage(arrays: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per vocabulary id, those never used included: use_count, doc_count and the score of leaving it out."""
    used = unigrams(arrays).join(_doc_counts(arrays), "id").select("id", F.col("freq").alias("use_count"), F.col("doc_freq").alias("doc_count"))
    rows = vocab.select("id", "piece").join(used, "id", "left").select("id", "piece", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("use_count", "doc_count")))
    score = 5 * F.col("use_count") + 50 * F.col("doc_count") + 10 * F.greatest(F.lit(0), F.char_length("piece") - 1) + 5 * F.greatest(F.lit(0), piece_bytes(F.col("piece")) - 1)
    return rows.withColumn("removal_score", score.cast("bigint"))


def inventory(arrays: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per vocabulary id: freq, doc_freq, distinct neighbours on both sides, piece_bytes.

    Pairs of neighbours are counted with map-side combining, as many as there are distinct ones.
    """
    pairs = arrays.where("size(ids) > 1").select(F.explode(F.transform("ids", lambda x, i: F.struct(F.get(F.col("ids"), i - 1).alias("before"), x.alias("id")))).alias("p")).select("p.*").where("before is not null")
    distinct = pairs.distinct()
    left = distinct.groupBy("id").agg(F.count("*").alias("left_diversity"))
    right = distinct.groupBy(F.col("before").alias("id")).agg(F.count("*").alias("right_diversity"))
    rows = vocab.select("id", "piece")
    for stats in (unigrams(arrays), _doc_counts(arrays), left, right):
        rows = rows.join(stats, "id", "left")
    counts = ("freq", "doc_freq", "left_diversity", "right_diversity")
    return rows.select("id", "piece", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts), piece_bytes(F.col("piece")).cast("bigint").alias("piece_bytes"))


def _by_id(vocab: DataFrame, *facts: Column) -> DataFrame:
    """One row: arrays of the named facts, in which the entry after id is that of the piece."""
    names = [f"f{i}" for i in range(len(facts))]
    rows = vocab.select("id", *(f.alias(n) for f, n in zip(facts, names)))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("id", *names))).alias("a"))
    return one.select(*(F.col(f"a.{n}").alias(n) for n in names))


def context_windows(arrays: DataFrame, vocab: DataFrame, target: Column, width: int = 3, most: int = 5) -> DataFrame:
    """The first `most` places of each target piece, with the pieces around them, the target in brackets.

    Only places of targets leave the arrays; their surroundings are written out for those kept.
    """
    wanted = [r.id for r in vocab.where(target).select("id").limit(65_536).collect()]
    around = F.transform("ids", lambda x, i: F.when(x.isin(wanted), F.struct(x.alias("id"), i.alias("i"), F.slice(F.col("ids"), F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width))).alias("left"), F.slice(F.col("ids"), i + 2, width).alias("right"))))
    order = Window.partitionBy("id").orderBy("doc_id", "i")
    hits = arrays.select("doc_id", F.explode(F.filter(around, lambda h: h.isNotNull())).alias("h")).select("doc_id", "h.*")
    kept = hits.withColumn("hit", F.row_number().over(order)).where(F.col("hit") <= most)
    sides = kept.select("id", "hit", "doc_id", F.explode_outer(F.concat(F.transform("left", lambda x, k: F.struct(F.lit(0).alias("side"), k.alias("k"), x.alias("w"))), F.transform("right", lambda x, k: F.struct(F.lit(1).alias("side"), k.alias("k"), x.alias("w"))))).alias("x"))
    named = sides.join(F.broadcast(vocab.select(F.col("id").alias("w"), F.col("piece").alias("spelled"))), F.col("x.w") == F.col("w"), "left")
    text = lambda side: F.array_join(F.transform(F.filter("parts", lambda p: p["side"] == side), lambda p: p["spelled"]), "")
    one = named.groupBy("id", "hit", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("x.side", "x.k", "spelled")))).alias("parts"))
    return one.join(F.broadcast(vocab.select("id", "piece")), "id").select("piece", "hit", "doc_id", F.concat(text(0), F.lit("["), "piece", F.lit("]"), text(1)).alias("context"))


def bigram_buckets(arrays: DataFrame, buckets: int = 4096) -> DataFrame:
    """How many token pairs fall into each hash bucket; a document's first token follows 0."""

    def bucket(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("ids"), i - 1), F.lit(0)).cast("bigint")
        return F.pmod((before * F.lit(1315423911)).bitwiseXOR(x.cast("bigint") * F.lit(2654435761)), F.lit(buckets))

    return arrays.select(F.explode(F.transform("ids", bucket)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("pairs"))


def byte_accounting(arrays: DataFrame, lookup: DataFrame) -> DataFrame:
    """Per document with tokens: their number and the bytes they stand for; a leading space counts unless the token before is a boundary.

    lookup: id (from 0 without gaps), base_bytes, has_leading_space, is_boundary.
    """
    facts = _by_id(lookup, F.col("base_bytes"), F.col("has_leading_space"), F.col("is_boundary"))  # one row

    def size(x: Column, i: Column) -> Column:
        spaced = F.get(F.col("f1"), x) & (i > 0) & ~F.coalesce(F.get(F.col("f2"), F.get(F.col("ids"), i - 1)), F.lit(True))
        return (F.get(F.col("f0"), x) + spaced.cast("int")).cast("bigint")

    rows = arrays.where("size(ids) > 0").join(F.broadcast(facts))
    counted = F.aggregate(F.transform("ids", size), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), counted.alias("counted_bytes"))
