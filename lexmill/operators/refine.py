"""Vocabulary repair from the documents that are segmented worst: candidate pieces, their scores, removals and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.cluster import keep
from lexmill.functions.lines import is_heading, stripped, unix_lines
from lexmill.operators.vocabulary import STRUCTURE_WORDS, is_byte_piece

# Word lists, weights and points of the repair.
GLUE = [
    "the", "and", "is", "to", "of", "in", "on", "for", "a", "an", "or", "as", "at", "by", "be", "with", "from", "that", "this", "these", "those",
    "it", "its", "he", "she", "they", "we", "you",
]
SUFFIXES = ["ing", "ed", "er", "ly", "s", "es", "ion", "tion", "ment"]
STARTERS = ["This is", "There is", "There are", "If you", "I have", "We have", "It is", "When the", "What is", "How to", "In this"]
KNOWN_CONNECTORS = ["is the", "with a", "have been", "into the", "through the", "of the", "and the"]
NEVER_REMOVED = [
    "ing", "ion", "tion", "ed", "er", "re", "th", "in", " the", " of", " and", ", and", " to", " is", "The", "This", " of the", " and the",
    "is the", "with a", "have been", "into the", "through the",
]
WEIGHTS = {"prefix": 5, "inner": 2, "connector": 4, "line_start": 8, "known": 6}
LEAST_CHARS, MOST_CHARS, LEAST_DOCS = 4, 24, 3

_TOKEN = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*|[,:;.!?()/%&]+"


def lexed(text: Column) -> Column:
    """Words of ASCII letters and digits (with inner apostrophes and hyphens) and runs of punctuation, in order."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _capital(token: Column) -> Column:
    return token.rlike("[A-Z]") & ~token.rlike("[a-z]")


def has_signal(piece: Column) -> Column:
    letters, digits = (F.regexp_count(stripped(piece), F.lit(c)) for c in (r"\p{L}", r"\p{Nd}"))
    return (letters + digits >= 4) & (letters >= 2)


def is_structural_break(piece: Column) -> Column:
    """A piece after a line break that begins with a structure word or one of three capitals and more."""
    first = F.coalesce(F.get(lexed(piece), F.lit(0)), F.lit(""))
    return piece.startswith("\n") & (first.isin(STRUCTURE_WORDS) | (_capital(first) & (F.char_length(first) >= 3)))


def is_sentence_start(piece: Column) -> Column:
    return F.array_join(F.slice(lexed(piece), 1, 2), " ").isin(STARTERS)


def is_proper_noun(piece: Column) -> Column:
    """A single token with a capital that is no structure word."""
    t = lexed(piece)
    only = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
    return (F.size(t) == 1) & only.rlike("^[A-Z]") & ~only.isin(STRUCTURE_WORDS)


def says_little(piece: Column) -> Column:
    """Too short, glue, a suffix, two scraps, double blanks, no signal, a sentence start, a name, or a long plain snippet."""
    p = stripped(piece)
    long_ = (F.size(lexed(p)) >= 4) & ~is_structural_break(piece) & ~is_heading(p)
    return (F.char_length(p) < LEAST_CHARS) | F.lower(p).isin(GLUE + SUFFIXES) | p.rlike(r"^[a-z]{1,2}\s[a-z]{1,2}$") | p.contains("  ") | ~has_signal(p) | is_sentence_start(p) | is_proper_noun(p) | long_


def is_candidate(piece: Column) -> Column:
    return ~is_byte_piece(piece) & F.char_length(piece).between(LEAST_CHARS, MOST_CHARS) & ~says_little(piece)


def piece_predicates(pieces: DataFrame) -> DataFrame:
    """pieces with the five predicates of the repair."""
    p = F.col("piece")
    return pieces.withColumns({"has_signal": has_signal(p), "is_structural_break": is_structural_break(p), "is_sentence_start": is_sentence_start(p), "is_proper_noun": is_proper_noun(p), "says_little": says_little(p)})


def doc_weight(delta: Column) -> Column:
    """Documents count by the root of what they lose."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(F.greatest(delta, F.lit(1)))))


def _starts(t: Column, least: int, most: int) -> Column:
    runs = F.transform(F.sequence(F.lit(least), F.least(F.size(t), F.lit(most))), lambda n: F.array_join(F.slice(t, 1, n), " "))
    return F.when(F.size(t) >= least, runs).otherwise(F.array().cast("array<string>"))


def _spans(t: Column, least: int, most: int) -> Column:
    """Every run of least..most tokens of an array, joined by blanks."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.when(F.size(t) >= n, _runs(t, n)).otherwise(none) for n in range(least, most + 1)))


def _runs(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))


def line_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, delta, piece, weight of docs(doc_id, text, delta): the five kinds, cut to MOST_CHARS.

    Beginnings of every line, spans inside it, words after punctuation, beginnings of structural
    lines after a break, and known connectors that a line begins with.
    """
    lines = docs.select("doc_id", "delta", F.explode(F.split(unix_lines(F.col("text")), "\n")).alias("line"))
    base = keep(lines.select("doc_id", "delta", stripped(F.col("line")).alias("line")).select("doc_id", "delta", "line", lexed(F.col("line")).alias("t")).where("size(t) > 0"), "lines")
    t, none = F.col("t"), F.array().cast("array<string>")
    first = F.get(t, F.lit(0))
    structural = is_heading(F.col("line")) | first.isin(STRUCTURE_WORDS) | _capital(first)
    kinds = {
        "prefix": _starts(t, 1, 5),
        "inner": _spans(t, 2, 4),
        "connector": F.regexp_extract_all(F.array_join(t, " "), F.lit(r"[,:;]\s+[A-Za-z][A-Za-z0-9'’\-]+(?:\s+[A-Za-z0-9'’\-]+){0,2}"), F.lit(0)),
        "line_start": F.when(structural, F.transform(_starts(t, 1, 4), lambda s: F.concat(F.lit("\n"), s))).otherwise(none),
        "known": F.filter(_starts(t, 2, 4), lambda s: s.isin(KNOWN_CONNECTORS)),
    }
    each = base.select("doc_id", "delta", F.explode(F.array(*(F.struct(F.lit(WEIGHTS[k]).alias("weight"), v.alias("pieces")) for k, v in kinds.items()))).alias("k"))
    return each.select("doc_id", "delta", "k.weight", F.explode("k.pieces").alias("piece")).withColumn("piece", F.substring("piece", 1, MOST_CHARS))


def scored_candidates(docs: DataFrame, vocab: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """piece, raw_count, doc_hits, est_savings, weighted_score of candidates that the vocabulary lacks.

    Pieces are counted first and tested once each.
    """
    rows = line_candidates(docs).withColumn("w", F.col("weight") * doc_weight(F.col("delta")))
    each = rows.groupBy("piece", "doc_id").agg(F.sum("w").alias("w")).groupBy("piece").agg(F.sum("w").cast("bigint").alias("raw_count"), F.count("*").alias("doc_hits"))
    new = each.where(F.col("doc_hits") >= least_docs).where(is_candidate(F.col("piece"))).join(F.broadcast(vocab.select("piece")), "piece", "left_anti")
    p = F.col("piece")
    s, n = stripped(p), F.char_length(p)
    saved = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("raw_count") * F.greatest(n - 1, F.lit(1)) / 10))
    points = [
        (is_structural_break(p), 12.0),
        (~is_structural_break(p) & p.contains("\n"), -8.0),
        (is_heading(s), 7.0),
        (~is_structural_break(p) & s.rlike(r"^\p{Lu}"), 1.0),
        (s.rlike(r"\S\s+\S"), 3.0),
        (s.rlike(r"\p{Nd}"), 1.5),
        (p.rlike(r"""[:;,.!?()\[\]{}'"/-]"""), 2.0),
        (s.rlike("^[a-z]{4,8}$"), -6.0),
        (F.lower(s).isin(GLUE), -12.0),
        (is_sentence_start(p), -20.0),
        (is_proper_noun(p), -20.0),
    ]
    score = saved + 2.5 * F.col("doc_hits") + 0.08 * n
    for test, value in points:
        score = score + F.when(test, value).otherwise(0.0)
    return new.select("piece", "raw_count", "doc_hits", saved.alias("est_savings"), F.round(score, 4).alias("weighted_score"))


def removal_candidates(vocab: DataFrame) -> DataFrame:
    """id, piece, score of pieces that may go, the best to remove highest: no bytes, breaks, short words or fixed pieces."""
    p = F.col("piece")
    s, n = stripped(p), F.char_length(p)
    rows = vocab.where(~is_byte_piece(p) & ~p.isin(NEVER_REMOVED) & ~p.contains("\n") & (n > 2) & ~s.rlike("^[A-Za-z]{1,4}$"))
    yes = lambda test, value: F.when(test, value).otherwise(0.0)
    score = n * 1.1 + yes(p.contains(" "), 3.0) + yes(s.rlike(r"\S\s+\S"), 4.0) + yes(s.rlike(r"^\p{Ll}"), 1.0) + yes(n >= 8, 2.0)
    return rows.select("id", "piece", F.round(score, 4).alias("score"))


def swaps(scored: DataFrame, removals: DataFrame, most: int = 10) -> DataFrame:
    """The best candidates against the pieces that go first: place, id, old_piece, new_piece and the candidate's figures.

    Fails where there are fewer than `most` of either.
    """
    new = scored.orderBy(F.desc("weighted_score"), F.desc("est_savings"), F.desc("doc_hits"), F.desc(F.char_length("piece")), "piece").limit(most).collect()
    old = removals.orderBy(F.desc("score"), "id").limit(most).collect()
    if len(new) < most or len(old) < most:
        raise ValueError(f"{len(new)} additions and {len(old)} removals, {most} needed")
    rows = [(i + 1, o.id, o.piece, a.piece, a.doc_hits, a.raw_count, a.est_savings, a.weighted_score) for i, (a, o) in enumerate(zip(new, old))]
    return scored.sparkSession.createDataFrame(rows, "place int, id int, old_piece string, new_piece string, doc_hits bigint, raw_count bigint, est_savings bigint, weighted_score double")


def repaired(vocab: DataFrame, swapped: DataFrame) -> DataFrame:
    """vocab's ids and pieces with the swaps made: id, piece, replaced (the old piece, or null)."""
    new = swapped.select("id", F.col("new_piece"), F.col("old_piece").alias("replaced"))
    return vocab.select("id", "piece").join(F.broadcast(new), "id", "left").select("id", F.coalesce("new_piece", "piece").alias("piece"), "replaced")
