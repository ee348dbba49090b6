"""Share of a document that repeats earlier content of the same document (problem 3).

A table of thresholds over length, symbol, stop-word, line and phrase ratios is compiled into one
Spark projection, without user functions. Phrases are compared by a 64-bit hash first; what passes
on hashes is counted again on the phrases themselves.

Defined results for odd input
    null or blank text   all ratios 0, never repetitive
    fewer than 5 words   no phrase, phrase ratio 0
    null doc_id          kept as it is; rows are not grouped by it
    empty table          no rows
    extra columns        ignored
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.cluster import where_computed
from lexmill.functions.text import ALNUM, LINE_BREAK, WHITESPACE, count_of, is_blank, ratio, strip_space, words

#: Words of a phrase.
PHRASE = 5

#: rule -> (length the document needs, in which measure; ratio; bound that it must reach).
THRESHOLDS = {
    "phrases": ("n_words", 30, "phrase_repeat", 0.25),
    "char_runs": ("n_chars", 1, "run_share", 0.15),
}
#: Further ratios that are reported beside the rules, with their bounds.
REPORTED = {
    "lines": ("n_lines", 4, "line_repeat", 0.30),
    "symbols": ("n_chars", 20, "symbol_ratio", 0.30),
    "few_words": ("n_words", 30, "word_repeat", 0.80),
    "no_stop_words": ("n_words", 30, "content_ratio", 0.98),
}


def _share_repeated(n: Column, distinct: Column) -> Column:
    return ratio(n - distinct, n)


def _phrases(w: Column, make) -> Column:
    return F.when(F.size(w) >= PHRASE, F.transform(F.sequence(F.lit(1), F.size(w) - (PHRASE - 1)), lambda i: make([F.element_at(w, i + k) for k in range(PHRASE)]))).otherwise(F.array())


def repetition_ratios(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """doc_id, text and the ratios of THRESHOLDS and REPORTED, phrases compared by hash."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", t.alias("t"), is_blank(F.col("text")).alias("blank"), words(t).alias("w"), F.filter(F.transform(F.split(t, LINE_BREAK), strip_space), lambda x: x != "").alias("lines"))
    hashed = base.select("*", F.when(F.size("w") >= PHRASE, _phrases(F.col("w"), lambda k: F.xxhash64(*k))).alias("p"))
    n_words, n_lines, n_chars = F.size("w"), F.size("lines"), F.char_length("t")
    runs = n_chars - F.char_length(F.regexp_replace("t", f"([^{WHITESPACE}])\\1{{4,}}", ""))
    stops = F.size(F.filter("w", lambda x: x.isin(stop_words))) if stop_words else F.lit(0)
    return hashed.select(
        "doc_id",
        F.col("t").alias("text"),
        n_chars.alias("n_chars"),
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
        F.when(F.col("p").isNotNull(), _share_repeated(F.size("p"), F.size(F.array_distinct("p")))).otherwise(F.lit(0.0)).alias("phrase_repeat"),
        F.when(F.col("blank"), F.lit(0.0)).otherwise(ratio(runs, n_chars)).alias("run_share"),
        F.regexp_count("t", F.lit("(?d)(.)\\1{4,}")).alias("repeated_char_hits"),
        _share_repeated(n_lines, F.size(F.array_distinct("lines"))).alias("line_repeat"),
        _share_repeated(n_words, F.size(F.array_distinct("w"))).alias("word_repeat"),
        ratio(F.size(F.array_distinct("w")), n_words).alias("unique_word_ratio"),
        ratio(n_chars - count_of(F.col("t"), ALNUM + WHITESPACE), n_chars).alias("symbol_ratio"),
        ratio(n_words - stops, n_words).alias("content_ratio"),
    )


def _holds(rule: tuple[str, int, str, float]) -> Column:
    size, least, share, bound = rule
    return (F.col(size) >= least) & (F.col(share) >= bound)


def repetition_profile(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """The ratios with one flag per rule, and repetitive: whether a rule of THRESHOLDS holds."""
    rules = {**THRESHOLDS, **REPORTED}
    flagged = repetition_ratios(docs, stop_words).withColumns({f"is_{k}": _holds(v) for k, v in rules.items()})
    return flagged.withColumn("repetitive", reduce(lambda a, b: a | b, (F.col(f"is_{k}") for k in THRESHOLDS)))


def repetitive_documents(docs: DataFrame) -> DataFrame:
    """The documents for which a rule of THRESHOLDS holds, exactly: equal hashes are compared as words."""
    holds = _holds(THRESHOLDS["phrases"]) | _holds(THRESHOLDS["char_runs"])
    found = where_computed(repetition_ratios(docs, []), holds)
    exact = found.withColumn("w", words(F.col("text"))).withColumn("p", _phrases(F.col("w"), lambda k: F.concat_ws(" ", *k)))
    again = exact.withColumn("phrase_repeat", _share_repeated(F.size("p"), F.size(F.array_distinct("p"))))
    return where_computed(again, holds).drop("w", "p")
