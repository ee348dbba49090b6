"""Candidate pieces: classification, buckets, scores, first-wins dedupe, forced phrases."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import LINE_BREAK, WHITESPACE, collapse_space, strip_space

# Word lists, prefixes and suffixes of the classification and scoring rules.
BAD_SUBSTRINGS = ["�", "://", "www.", "http", "•"]
CONTRACTIONS = ["n't", "n’t", "I'm", "I’m", "It's", "It’s"]
ALLOWED_BIGRAMS = ["of the", "in the", "to the", "on the", "for the", "to be", "it is", "as a", "is a", "was a", "are the"]
GOOD_PHRASES = [
    "of the", "in the", "to the", "on the", "for the", "to be", "it is", "is a", "was a", "as a", "at the", "by the", "from the", "with the",
    "that the", "and the", "or the", "will be", "can be", "more than", "one of", "such as", "going to", "a lot", "a few",
]
BOUNDARY_LETTERS = ["s", "c", "p", "m", "d", "t", "w", "f", "r", "b", "l", "g", "n"]
PUNCTUATION_LED = [". ", ", ", "; ", ": ", "! ", "? "]
FULL_WORDS = [
    "different", "between", "program", "little", "market", "open", "always", "available", "effect", "custom", "important", "direct", "problem", "number",
    "public", "social", "quality", "possible", "success", "support", "control", "system", "network", "energy", "policy", "research", "project", "history",
    "future", "family", "people", "country", "question", "example", "consider", "personal", "include",
]
PREFIX_STEMS = [
    "techn", "govern", "educ", "organiz", "profess", "individ", "develop", "environ", "electr", "financ", "commun", "differ", "general", "public",
    "social", "research", "project", "support", "success", "control", "system", "network", "policy", "quality", "possib", "person", "econom", "histor",
    "cultu", "quest", "exampl", "market", "program", "avail", "custom",
]
SUFFIX_STEMS = ["tion", "ment", "ness", "able", "less", "ship", "ward", "ally", "ical", "ious", "ence", "ance", "ity", "ism", "ist"]
BAD_FRAGMENTS = [
    "somet", "omething", "ross", "gener", "terest", "chnolog", "vernment", "owever", "alread", "umber", "ording", "meric", "ffectiv", "quired",
    "ticle", "lieve", "selv", "nology", "ological", "utiful", "ecut", "ccess",
]
BAD_STARTS = ["ther", "omething", "ross", "umber", "ording", "lread", "owe", "ecut", "chn", "ver", "meric", "ticle", "ffect", "quired", "lieve", "selv"]
BAD_ENDS = ["ments", "olog", "ever", "read", "ross", "meric", "ticle", "lieve", "selv"]
TAILS = ["ment", "tion", "ness", "able", "less"]

#: Classes of boosted terms, and those of which only well scored subwords are boosted.
BOOST_CLASSES = ["keep_full_word", "keep_contraction", "keep_allowlist", "keep_phrase", "keep_short_phrase"]
BOOST_SUBWORDS = ["keep_subword", "curated_subword_auto_v2"]

_WORD = r"[A-Za-z]+(?:[’'][A-Za-z]+)?"

#: The fields of a candidate, which come as columns or in the raw JSON of `record`.
FIELDS = {"n": "int", "ids": "array<int>", "freq": "bigint", "text": "string", "class": "string"}
_JSON = "n int, ids array<int>, freq bigint, text string, normalized_text string, class string"


def parsed(candidates: DataFrame, *more: str) -> DataFrame:
    """cand_id, FIELDS and the columns named in `more`; fields are read from the raw record where there is one."""
    raw = F.from_json("record", _JSON, {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    rows = candidates.select("cand_id", *more, raw.alias("raw"), *(F.col(f"`{k}`").cast(kind).alias(k) for k, kind in FIELDS.items()))
    return rows.select("cand_id", *more, *(F.coalesce(F.col(f"raw.`{k}`"), F.col(f"`{k}`")).alias(k) for k in FIELDS))


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII texts, which are their own, are passed by."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(_nfkc(F.when(~text.rlike(r"^[\x00-\x7f]*$"), text)))


def normalized(text: Column) -> Column:
    return collapse_space(F.translate(nfkc(text), "’‘", "''"))


def _share(text: Column, char_class: str, empty: float) -> Column:
    return F.when(F.char_length(text) == 0, F.lit(empty)).otherwise(F.char_length(F.regexp_replace(text, f"[^{char_class}]+", "")) / F.char_length(text))


def digit_share(text: Column) -> Column:
    return _share(text, r"\p{Nd}", 1.0)


def punct_share(text: Column) -> Column:
    letters = F.char_length(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{WHITESPACE}]+", ""))
    return F.when(F.char_length(text) == 0, F.lit(1.0)).otherwise((F.char_length(text) - letters) / F.char_length(text))


def alpha_share(text: Column) -> Column:
    return _share(text, r"\p{L}", 0.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def _any_of(test, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (test(v) for v in values))


def _cascade(rules: list[tuple[Column, str]], last: str) -> Column:
    out = F.when(*_pair(rules[0]))
    for rule in rules[1:]:
        out = out.when(*_pair(rule))
    return out.otherwise(F.lit(last))


def _pair(rule: tuple[Column, str]) -> tuple[Column, Column]:
    return rule[0], F.lit(rule[1])


def bigram_class(t: Column) -> Column:
    """Label of a normalized text of two tokens; the first rule that holds decides."""
    low, n = F.lower(t), word_count(t)
    one, two = F.get(F.split(low, " "), F.lit(0)), F.get(F.split(low, " "), F.lit(1))
    return _cascade(
        [
            (F.char_length(t) == 0, "reject_empty"),
            (t.isin(CONTRACTIONS + ALLOWED_BIGRAMS) | low.isin(GOOD_PHRASES), "keep_allowlist"),
            (_any_of(t.contains, BAD_SUBSTRINGS), "reject_bad_substring"),
            (~t.rlike(r"\p{L}"), "reject_no_letters"),
            (digit_share(t) >= 0.20, "reject_numeric_heavy"),
            (punct_share(t) >= 0.25, "reject_punct_heavy"),
            (n == 0, "reject_no_words"),
            (n > 2, "reject_too_many_words"),
            ((n == 1) & ~t.rlike(f"^{_WORD}$"), "reject_non_clean_single"),
            ((n == 1) & (F.char_length(t) < 3), "reject_too_short_single"),
            (n == 1, "keep_single_word"),
            (~t.rlike(f"^{_WORD} {_WORD}$"), "reject_non_clean_phrase"),
            (one.isin(BOUNDARY_LETTERS) | two.isin(BOUNDARY_LETTERS), "reject_boundary_artifact"),
            ((F.char_length(one) == 1) | (F.char_length(two) == 1), "reject_single_char_word"),
        ],
        "keep_phrase",
    )


def trigram_class(text: Column) -> Column:
    """Label of a candidate of three tokens (its text trimmed, not normalized)."""
    t = F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")
    n, safe = word_count(t), t.rlike(r"^[A-Za-z .'\-’]+$")
    return _cascade(
        [
            (F.char_length(t) == 0, "reject_empty"),
            (t.isin(CONTRACTIONS), "keep_contraction"),
            (_any_of(t.contains, BAD_SUBSTRINGS), "reject_bad_substring"),
            (~t.rlike(r"\p{L}"), "reject_no_letters"),
            (digit_share(t) >= 0.25, "reject_numeric_heavy"),
            (punct_share(t) >= 0.30, "reject_punct_heavy"),
            (F.char_length(t) < 3, "reject_too_short"),
            (F.regexp_count(t, F.lit(f"[^{WHITESPACE}]+")) >= 4, "reject_too_many_words"),
            (_any_of(t.startswith, PUNCTUATION_LED), "reject_punct_led_phrase"),
            (t.rlike(f"^{_WORD}$"), "keep_full_word"),
            (t.rlike(f"^{_WORD}(?: {_WORD}){{1,2}}$"), "keep_short_phrase"),
            (safe & (n == 1) & (alpha_share(t) >= 0.75), "keep_subword"),
            (safe & n.isin(2, 3) & (alpha_share(t) >= 0.70), "keep_phrase_like"),
        ],
        "reject_other",
    )


def bucket(t: Column) -> Column:
    """contractions, phrases or subwords of a normalized text, or null."""
    phrase, word = t.rlike(rf"^{_WORD}(?: {_WORD}){{1,2}}$"), t.rlike("^[A-Za-z]+(?:['’][A-Za-z]+)+$")
    return F.when(t.contains("'") & (phrase | word), "contractions").when(t.contains(" "), F.when(phrase, "phrases")).when(t.rlike("^[A-Za-z]+$"), "subwords")


def subword_score(t: Column) -> tuple[Column, Column]:
    """(score, reasons) of a normalized text; -999 where it cannot be a subword at all."""
    low, n = F.lower(t), F.char_length(t)
    vowels = F.char_length(F.regexp_replace(low, "[^aeiou]+", "")) / F.char_length(F.regexp_replace(low, r"[^\p{L}]+", ""))
    prefix = n.between(4, 9) & (low.isin(PREFIX_STEMS) | (~_any_of(low.startswith, BAD_STARTS) & ~F.substring(low, 1, 1).isin("h", "v") & (vowels >= 0.20)))
    never = F.when(n == 0, "empty").when(~t.rlike("^[A-Za-z]+(?:'[A-Za-z]+)?$"), "non_alpha").when(n < 4, "too_short").when(low.isin(BAD_FRAGMENTS), "explicit_bad_fragment")
    rules = [
        (low.isin(FULL_WORDS), 7, "full_word_allowlist"),
        (low.isin(PREFIX_STEMS), 6, "good_prefix_stem_allowlist"),
        (low.isin(SUFFIX_STEMS), 3, "good_suffix_stem_allowlist"),
        (alpha_share(t) >= 0.98, 2, "clean_alpha"),
        (vowels.between(0.22, 0.62), 2, "plausible_vowel_ratio"),
        (n >= 6, 1, "good_length"),
        (prefix, 3, "prefix_like"),
        (_any_of(low.endswith, SUFFIX_STEMS), 1, "suffix_like"),
        (_any_of(low.startswith, BAD_STARTS), -5, "bad_start_shape"),
        (_any_of(low.endswith, BAD_ENDS), -4, "bad_end_shape"),
        (_any_of(low.endswith, TAILS) & ~low.isin(SUFFIX_STEMS), -2, "tail_only_feel"),
        (n.between(4, 5) & ~low.isin(FULL_WORDS + PREFIX_STEMS + SUFFIX_STEMS), -1, "short_ambiguous_fragment"),
    ]
    total = reduce(lambda a, b: a + b, (F.when(test, points).otherwise(0) for test, points, _ in rules))
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, _, name in rules)))
    return F.when(never.isNotNull(), F.lit(-999)).otherwise(total), F.when(never.isNotNull(), F.array(never)).otherwise(reasons)


def action(score: Column) -> Column:
    return F.when(score >= 7, "keep").when(score >= 4, "review_keep").otherwise("drop")


def first_wins(rows: DataFrame, order: str = "ord") -> DataFrame:
    """rows(ord, ids, norm): a row is kept unless its ids or its norm belong to an earlier kept row.

    Null ids belong to no other row, an empty or null norm to none.

    A row turned away for its ids does not claim its norm, so two rounds of dropping duplicates
    would be wrong. Rows that are first in both keys are kept for good, rows that share a key with
    an earlier kept row are out for good; what is left is settled in further rounds, each of which
    settles at least the first open row of every key group.
    """
    from lexmill.cluster import keep

    rows = keep(rows.select(F.col(order).alias("ord"), F.coalesce(F.to_json("ids"), F.concat(F.lit("none "), F.col(order))).alias("k1"), F.when(F.coalesce("norm", F.lit("")) == "", F.concat(F.lit(" "), F.col(order))).otherwise(F.col("norm")).alias("k2")), "first-wins")
    kept, open_ = None, rows
    while True:
        ranked = open_.withColumns({"f1": F.min("ord").over(Window.partitionBy("k1")), "f2": F.min("ord").over(Window.partitionBy("k2"))})
        ranked = ranked.withColumn("first", (F.col("f1") == F.col("ord")) & (F.col("f2") == F.col("ord")))
        ranked = keep(ranked, "first-wins")
        new = ranked.where("first").select("ord", "k1", "k2")
        kept = new if kept is None else keep(kept.unionByName(new), "first-wins")
        claimed1, claimed2 = new.select("k1"), new.select("k2")
        open_ = keep(ranked.where("not first").select("ord", "k1", "k2").join(claimed1, "k1", "left_anti").join(claimed2, "k2", "left_anti"), "first-wins")
        if open_.isEmpty():
            return kept.select("ord")


def placeholder(text: Column) -> Column:
    return F.concat(F.lit("PHRASE_"), F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), "^_+|_+$", ""))


def forced_phrases(candidates: DataFrame, classes: list[str]) -> DataFrame:
    """The clean phrases once each: text, placeholder, freq, class."""
    t = collapse_space(F.col("text"))
    rows = candidates.where(F.col("class").isin(classes) & F.col("text").isNotNull()).select(t.alias("text"), F.coalesce("freq", F.lit(0)).alias("freq"), "class").where("length(text) >= 4")
    order = Window.partitionBy("text").orderBy(F.desc("freq"), "class")
    once = rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return once.select("text", placeholder(F.col("text")).alias("placeholder"), "freq", "class")


def boost_terms(candidates: DataFrame, most: int = 300) -> DataFrame:
    """text, freq, class of the most frequent terms of BOOST_CLASSES once each; subwords only where their score is 10 or more."""
    t = strip_space(F.col("text"))
    rows = candidates.where(F.col("class").isin(BOOST_CLASSES + BOOST_SUBWORDS)).select("cand_id", t.alias("text"), F.coalesce("freq", F.lit(0)).alias("freq"), "class")
    clean = rows.where("length(text) >= 2 and not contains(text, '  ') and (length(text) >= 4 or contains(text, ' '))")
    words_ = clean.where(F.col("class").isin(BOOST_CLASSES))
    subwords = clean.where(F.col("class").isin(BOOST_SUBWORDS)).where(subword_score(normalized(F.col("text")))[0] >= 10)
    order = Window.partitionBy("text").orderBy(F.desc("freq"), "cand_id")
    once = words_.unionByName(subwords).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return once.orderBy(F.desc("freq"), "cand_id").limit(most).select("text", "freq", "class")


def boost_corpus(terms: DataFrame, phrases: list[tuple[str, str]], times: int = 80) -> DataFrame:
    """Each term, with the phrases in it substituted, as often as it is boosted: one line per copy."""
    done = terms.select(substitution(terms.sparkSession, phrases)("text").alias("text"))
    return done.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))


def training_corpus(docs: DataFrame, terms: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """The lines to train on: the boosted terms and all lines of the documents, with the phrases substituted."""
    lines = docs.where("text is not null").select(F.explode(F.split("text", LINE_BREAK)).alias("line"))
    return boost_corpus(terms, phrases).select("text").unionByName(lines.select(substitution(docs.sparkSession, phrases)("line").alias("text")))


_SPACE = r" \t\n\x0b\f\r"
_START = re.compile(rf"(?<![^\W_])(?=([^{_SPACE}]+))[^{_SPACE}]")
_NEXT = re.compile(rf"[{_SPACE}]+([^{_SPACE}]+)")
_MARK = re.compile("PHRASE_[A-Z0-9_]*")


def _low(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Phrases:
    """Finds listed phrases in texts, whatever their case and spacing; a step costs the same for any number of phrases."""

    def __init__(self, phrases: list[tuple[str, str]]):
        self.root: tuple[dict, dict] = ({}, {})  # further words, last words
        for text, mark in phrases:
            parts = _low(text).split()
            node = self.root
            for part in parts[:-1]:
                node = node[0].setdefault(part, ({}, {}))
            if parts:
                node[1].setdefault(parts[-1], mark)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """start, stop, mark of the leftmost, then longest phrases that no letter or digit adjoins."""
        low, out, done = _low(text), [], 0
        for m in _START.finditer(low):
            if m.start() < done:
                continue
            node, word, at, hit = self.root, m[1], m.start(), None
            while node is not None:
                if node[1]:
                    hit = self._ended(node[1], word, at) or hit
                node = node[0].get(word)
                if node is not None and (n := _NEXT.match(low, at + len(word))):
                    word, at = n[1], n.start(1)
                else:
                    node = None
            if hit:
                done = hit[0]
                out.append((m.start(), *hit))
        return out

    @staticmethod
    def _ended(ends: dict, word: str, at: int) -> tuple[int, str] | None:
        if word in ends:
            return at + len(word), ends[word]
        for k in range(len(word) - 1, 0, -1):
            if not word[k].isalnum() and word[:k] in ends:
                return at + k, ends[word[:k]]
        return None

    def replace(self, text: str) -> str:
        out, done = [], 0
        for a, b, mark in self.find(text):
            out += [text[done:a], mark]
            done = b
        return "".join([*out, text[done:]])


def _restore(text: str, known: dict[str, str]) -> str:
    def back(m: re.Match) -> str:
        s = m[0]
        for k in range(len(s), 6, -1):
            if s[:k] in known:
                return known[s[:k]] + _restore(s[k:], known)
        return s[:7] + _restore(s[7:], known)

    return _MARK.sub(back, text)


def _per_text(spark: SparkSession, phrases: list[tuple[str, str]], make, kind: str):
    """A function on texts made once per task by make(phrases); null counts as an empty text."""
    shared = spark.sparkContext.broadcast(phrases)

    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make(shared.value)
        for s in texts:
            yield s.map(lambda t: f("" if t is None else t))

    return run


def substitution(spark: SparkSession, phrases: list[tuple[str, str]]):
    """text -> text with the phrases replaced by their placeholders."""
    return _per_text(spark, phrases, lambda p: Phrases(p).replace, "string")


def restoration(spark: SparkSession, phrases: list[tuple[str, str]]):
    """text -> text with the placeholders replaced by their phrases."""

    def make(p):
        known = {mark: text for text, mark in p}
        return lambda t: _restore(t, known)

    return _per_text(spark, phrases, make, "string")


def substituted(docs: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """doc_id, text with phrases (longest first) replaced by their placeholders, whatever their case."""
    return docs.select("doc_id", substitution(docs.sparkSession, phrases)(F.col("text")).alias("text"))


def restored(docs: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    return docs.select("doc_id", restoration(docs.sparkSession, phrases)(F.col("text")).alias("text"))


#: Most forced phrases: the list goes to every worker, and more than that is refused.
MOST_PHRASES = 2_000_000


def listed_phrases(phrases: DataFrame) -> list[tuple[str, str]]:
    """(text, placeholder) in order of text; the number is checked."""
    rows = phrases.select("text", "placeholder").limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return sorted((r.text, r.placeholder) for r in rows)


def distinct_marks(phrases: DataFrame) -> list[tuple[str, str]]:
    """(text, placeholder) of phrases that differ in more than case; placeholders that several share are numbered."""
    rows = listed_phrases(phrases)
    keys: dict[str, tuple[str, str]] = {}
    for text, mark in rows:
        keys.setdefault(" ".join(_low(text).split()), (text, mark))
    taken, out = {mark for _, mark in rows}, []
    first: set[str] = set()
    for text, mark in keys.values():
        name, k = mark, 2
        while name in first or (name != mark and name in taken):
            name, k = f"{mark}_{k}", k + 1
        first.add(name)
        out.append((text, name))
    return out


def round_trip(docs: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """doc_id, touched (something was substituted), restored (the text came back, up to case and spacing)."""
    spark, t = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    done = docs.select("doc_id", t.alias("t"), substitution(spark, phrases)(t).alias("done"))
    back = done.select("doc_id", "t", "done", restoration(spark, phrases)("done").alias("back"))
    return back.select("doc_id", (F.col("done") != F.col("t")).alias("touched"), (plain(F.col("t")) == plain(F.col("back"))).alias("restored"))


def phrase_usage(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """placeholder, uses, docs: occurrences of the phrases (text, placeholder) in one pass over each text, longest phrase first."""
    listed = listed_phrases(phrases)
    marks = _per_text(docs.sparkSession, listed, lambda p: (lambda index: lambda t: [m for _, _, m in index.find(t)])(Phrases(p)), "array<string>")
    found = docs.select("doc_id", F.explode(marks("text")).alias("placeholder"))
    return found.groupBy("placeholder").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs"))
