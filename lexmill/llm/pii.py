"""Personal details in free text, found by bootstrapped contextual extraction (problem 8).

One pass over the texts gives mentions that are certain by their shape and candidates that are not
(a name among capitalised words, plain or oddly grouped digits, an unlabelled number, a number beside
capitalised words), each with the lexical contexts around it. Seeds (certain mentions, and the name lexicon) give contexts a score, contexts
give candidates and their words a score, and so on for ROUNDS rounds, all as aggregates and joins
over the graph of contexts and instances. Contexts of high confidence then admit candidates that no
list knows.

Defined results for odd input
    null or blank text    no mention; redacted text null or the blank text itself
    overlapping mentions  the earlier one stands, of two at one place the longer
    repeated doc_id       mentions of each distinct (doc_id, place) once; each row is redacted
    empty lexicon         names come from contexts only, that is, none without seeds
    null doc_id           its mentions are found but belong to no document; its text is kept
    empty tables          no rows
    extra columns         ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.cluster import keep, salted
from lexmill.llm.pii_shapes import fold, mentions

ROUNDS = 3
#: A context counts from this many distinct instances that speak for it, and is trusted from this share.
LEAST_INSTANCES = 3
TRUST = 0.6
#: Most entries of the lexicon and of the common words (both are handed to every task).
MOST_ENTRIES = 100_000

_CANDIDATES = "doc_id bigint, kind string, start int, stop int, sure boolean, given string, family string, turned boolean, contexts array<string>"


def _listed(df: DataFrame, column: str) -> frozenset[str]:
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    return frozenset(fold(r[0]) for r in rows)


def candidates(docs: DataFrame, lexicon: DataFrame, common: DataFrame) -> DataFrame:
    """Mentions and candidates of all documents (kept: the texts are read once)."""
    given, family = (_listed(lexicon.where(F.col("name_part") == p), "name") for p in ("given", "family"))
    words = _listed(common, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for m in mentions(t, given, family, words)]
            columns = list(zip(*rows)) or [()] * 9
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "kind", "start", "stop", "sure", "given", "family", "turned", "contexts"])

    return keep(docs.select("doc_id", "text").mapInArrow(run, _CANDIDATES), "candidates")


def _context_scores(graph: DataFrame) -> DataFrame:
    """kind, context, score: the share of its distinct instances that are believed. graph: kind, context, instance, believed."""
    each = graph.groupBy("kind", "context", "instance").agg(F.max(F.col("believed").cast("int")).alias("b"))
    scored = each.groupBy("kind", "context").agg(F.sum("b").alias("hits"), F.count("*").alias("n"))
    return scored.where(F.col("hits") >= LEAST_INSTANCES).select("kind", "context", (F.col("hits") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= 0.3)


_PLACE = ["doc_id", "kind", "start", "stop"]


class _Edges:
    """The edges from candidates to their contexts, salted once for all rounds."""

    def __init__(self, cand: DataFrame, name: str):
        edges = cand.select(*_PLACE, F.explode("contexts").alias("context"))
        rows, self.spread = salted(edges, ["kind", "context"], ["doc_id", "start"])
        self.rows = keep(rows, f"{name}-edges")

    def support(self, scores: DataFrame) -> DataFrame:
        """doc_id, kind, start, stop, support: the best score among a candidate's contexts."""
        return self.rows.join(self.spread(scores), ["kind", "context", "__salt"]).groupBy(*_PLACE).agg(F.max("score").alias("support"))


class _Names:
    """Candidates for names, whose words are looked up in every round; frequent words are salted once."""

    def __init__(self, cand: DataFrame):
        # an initial is no word that could be known; its rows get keys of their own
        own = F.when(F.col("given") == ".", F.concat_ws(" ", F.lit("."), "doc_id", "start")).otherwise(F.col("given"))
        rows, self.spread_given = salted(cand.withColumn("given_key", own), ["given_key"], ["doc_id", "start"])
        rows, self.spread_family = salted(rows.withColumnRenamed("__salt", "given_salt"), ["family"], ["doc_id", "start"])
        self.rows = keep(rows.withColumnRenamed("__salt", "family_salt"), "names")

    def known(self, words: DataFrame) -> DataFrame:
        """The candidates with g and f: whether their given and family part are known as such."""
        g = self.spread_given(words.where("role = 'given'").select(F.col("word").alias("given_key"), F.lit(True).alias("g")).distinct()).withColumnRenamed("__salt", "given_salt")
        f = self.spread_family(words.where("role = 'family'").select(F.col("word").alias("family"), F.lit(True).alias("f")).distinct()).withColumnRenamed("__salt", "family_salt")
        out = self.rows.join(g, ["given_key", "given_salt"], "left").join(f, ["family", "family_salt"], "left")
        return out.withColumns({"g": F.coalesce("g", F.lit(False)), "f": F.coalesce("f", F.lit(False)), "initial": F.col("given") == "."})


def _name_rounds(names: _Names, edges: _Edges, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, context scores) after ROUNDS rounds over the graph of names and contexts."""
    words = seeds
    scores = None
    for round_no in range(ROUNDS):
        known = names.known(words)
        instance = F.concat_ws(" ", "given", "family")
        graph = known.select("kind", F.explode("contexts").alias("context"), instance.alias("instance"), (F.col("g") | F.col("f")).alias("believed"))
        scores = keep(_context_scores(graph), f"contexts-{round_no}")
        told = known.join(edges.support(scores), _PLACE, "left").withColumn("good", F.coalesce(F.col("support") >= TRUST, F.lit(False)))
        both = told.where("not turned").select(  # in turned order any word before a comma would pass for a family name
            F.explode(F.array(F.struct(F.lit("given").alias("role"), F.col("given").alias("word"), F.col("family").alias("partner"), F.col("f").alias("by")), F.struct(F.lit("family").alias("role"), F.col("family").alias("word"), F.col("given").alias("partner"), F.col("g").alias("by")))).alias("w"), "good").select("w.*", "good")
        each = both.where("word <> '.'").groupBy("role", "word", "partner").agg(F.max((F.col("by") & F.col("good")).cast("int")).alias("firm"), F.max((F.col("by") | F.col("good")).cast("int")).alias("b"))
        learned = each.groupBy("role", "word").agg(F.sum("b").alias("hits"), F.sum("firm").alias("firm"), F.count("*").alias("n"))
        learned = learned.where("(hits >= 3 or firm >= 1 and hits >= 2) and hits >= 0.5 * n").select("word", "role")
        words = keep(seeds.unionByName(learned).distinct(), f"words-{round_no}")
    return words, scores


def _number_rounds(other: DataFrame) -> DataFrame:
    """doc_id, kind, start, stop of the uncertain numbers and addresses that contexts admit after ROUNDS rounds.

    What shapes are certain of is the seed; what a round admits speaks for contexts in the next one.
    """
    rows = other.where("kind <> 'email'").select(*_PLACE, "sure", "contexts")
    edges = _Edges(rows.where("not sure"), "numbers")
    admitted = None
    for round_no in range(ROUNDS):
        told = rows if admitted is None else rows.join(admitted.withColumn("told", F.lit(True)), _PLACE, "left").withColumn("sure", F.col("sure") | F.coalesce("told", F.lit(False)))
        graph = told.select("kind", F.explode("contexts").alias("context"), F.concat_ws(":", "doc_id", "start").alias("instance"), F.col("sure").alias("believed"))
        scores = keep(_context_scores(graph), f"number-contexts-{round_no}")
        admitted = keep(edges.support(scores).where(F.col("support") >= TRUST).select(*_PLACE), f"admitted-{round_no}")
    return admitted


def _apart(rows: DataFrame) -> DataFrame:
    """Drops mentions that overlap a stronger neighbour, then those that overlap an earlier or longer one."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), "pii_kind")
    weaker = F.lit(False)
    for step in (-1, 1):
        start, stop, strength = (F.lag(c, -step).over(order) for c in ("start", "stop", "strength"))
        weaker = weaker | F.coalesce((start < F.col("stop")) & (F.col("start") < stop) & (strength > F.col("strength")), F.lit(False))
    strong = rows.withColumn("weaker", weaker).where("not weaker").drop("weaker")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return strong.withColumn("before", before).where("before is null or start >= before").drop("before")


def found_mentions(docs: DataFrame, lexicon: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, pii_kind, start_char, stop_char of every mention."""
    cand = candidates(docs, lexicon, common)
    seeds = lexicon.where("name is not null and name_part is not null").select(F.translate(F.lower("name"), "’", "'").alias("word"), F.col("name_part").alias("role")).distinct()
    names, edges = _Names(cand.where("kind = 'name'")), _Edges(cand.where("kind = 'name'"), "names")
    words, name_scores = _name_rounds(names, edges, seeds)
    supported = names.known(words).join(edges.support(name_scores), _PLACE, "left")
    support = F.coalesce("support", F.lit(0.0))
    believed: Column = (F.col("f") & (F.col("g") | F.col("initial"))) | (~F.col("turned") & (((support >= TRUST) & ~F.col("initial")) | ((support >= 0.4) & (F.col("f") | F.col("g")))))
    strength = F.when(F.col("f") & F.col("g"), 3).when(F.col("f") & F.col("initial"), 2).otherwise(1)
    good_names = supported.where(believed).select("doc_id", "kind", "start", "stop", strength.alias("strength"))
    other = cand.where("kind <> 'name'")
    admitted = _number_rounds(other)
    rest = other.where("sure").unionByName(admitted, allowMissingColumns=True).select("doc_id", "kind", "start", "stop", F.lit(4).alias("strength"))
    return _apart(good_names.unionByName(rest).withColumnRenamed("kind", "pii_kind").distinct()).select("doc_id", "pii_kind", F.col("start").alias("start_char"), F.col("stop").alias("stop_char"))


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text with a typed placeholder in place of each mention, n_mentions; all else unchanged."""
    marks = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "stop_char", "pii_kind"))).alias("marks"))
    rows = docs.select("doc_id", "text").join(marks, "doc_id", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walk = F.aggregate(
        F.coalesce("marks", F.array().cast("array<struct<start_char:int,stop_char:int,pii_kind:string>>")),
        start,
        lambda acc, m: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["start_char"] - acc["at"]), F.lit("["), F.upper(m["pii_kind"]), F.lit("]")).alias("out"), m["stop_char"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))),
    )
    return rows.select("doc_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(walk).alias("text"), F.coalesce(F.size("marks"), F.lit(0)).alias("n_mentions"))
