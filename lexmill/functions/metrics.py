"""Figures of one text: sizes, ratios of character classes, hits, lines; all in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import ALNUM, WHITESPACE, count_of, ratio

METRICS = [
    "decoded_chars", "decoded_words", "unique_words", "unique_word_ratio", "ascii_ratio", "whitespace_ratio", "digit_ratio", "punctuation_ratio",
    "non_printable_ratio", "url_hits", "html_hits", "repeated_char_hits", "line_count", "avg_line_length",
]


def text_metrics(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The keys and METRICS of every row's whole text; all 0 for a null or empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pieces = F.filter(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: x.rlike(f"[^{WHITESPACE}]"))
    base = rows.select(*keys, t.alias("t"), w.alias("w"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("u"), pieces.alias("lines"))
    n = F.char_length("t")

    def share(char_class: str) -> Column:
        return F.round(ratio(count_of(F.col("t"), char_class), n), 6)

    figures = [
        n,
        F.size("w"),
        F.col("u"),
        F.round(ratio(F.col("u"), F.size("w")), 6),
        share(r"\x00-\x7f"),
        share(WHITESPACE),
        share(r"\p{Nd}"),
        F.round(ratio(n - count_of(F.col("t"), ALNUM + WHITESPACE), n), 6),
        F.round(ratio(F.char_length(F.regexp_replace("t", rf"[^\p{{C}}\p{{Z}}]+|[{WHITESPACE}]+", "")), n), 6),
        F.regexp_count("t", F.lit(r"(?i)https?://|www\.")),
        F.regexp_count("t", F.lit("<[^>]+>")),
        F.regexp_count("t", F.lit("(?d)(.)\\1{4,}")),
        F.size("lines"),
        F.round(ratio(F.char_length(F.array_join("lines", "")), F.size("lines")), 6),
    ]
    return base.select(*keys, *(c.alias(name) for name, c in zip(METRICS, figures)))
