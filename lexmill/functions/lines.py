"""Previews, ratios and shape tests of texts, lines and pieces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import WHITESPACE, collapse_space, count_of, strip_space

#: Shortest and least upper-case share of a heading.
HEADING_CHARS, HEADING_LETTERS, HEADING_SHARE = 4, 4, 0.55


def preview(text: Column, chars: int = 240) -> Column:
    return F.substring(collapse_space(text), 1, chars)


def escaped_preview(text: Column, chars: int = 220) -> Column:
    """Cut first, then line feeds written as \\n."""
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit("\\n"))


def shortened(text: Column, chars: int = 80) -> Column:
    return F.when(F.char_length(text) <= chars, text).otherwise(F.concat(F.substring(text, 1, chars - 3), F.lit("...")))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lexed(line: Column) -> Column:
    """Words (with inner apostrophes and hyphens) and runs of punctuation, in order."""
    return F.regexp_extract_all(line, F.lit(r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_" + WHITESPACE + "]+"), F.lit(0))


def stripped(text: Column) -> Column:
    return strip_space(text)


def is_heading(line: Column) -> Column:
    """All capitals (caseless letters aside), or enough of its letters capitals."""
    letters, upper = count_of(line, r"\p{L}"), count_of(line, r"\p{Lu}")
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"[\p{Ll}\p{Lt}]")
    return (F.char_length(strip_space(line)) >= HEADING_CHARS) & (capitals | ((letters >= HEADING_LETTERS) & (upper >= letters * HEADING_SHARE)))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of every line with something on it; line ends of any kind."""
    each = docs.select("doc_id", F.posexplode(F.split(unix_lines(F.coalesce("text", F.lit(""))), "\n")).alias("line_no", "line"))
    return each.where(F.col("line").rlike(f"[^{WHITESPACE}]"))


def line_features(docs: DataFrame) -> DataFrame:
    rows = line_rows(docs)
    return rows.select("doc_id", "line_no", F.size(lexed(F.col("line"))).alias("tokens"), F.regexp_count("line", F.lit("[A-Za-z]+")).alias("ascii_words"), is_heading(F.col("line")).alias("is_heading"), shortened(F.col("line")).alias("shown"))


def word_spans(docs: DataFrame) -> DataFrame:
    """doc_id, span: words of three letters and more, with the space before them where there is one."""
    return docs.select("doc_id", F.explode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r" ?\p{L}{3,}"), F.lit(0))).alias("span")).where("span is not null")


def mined_additions(docs: DataFrame, vocab: DataFrame, least: int = 3) -> DataFrame:
    """Spans that the vocabulary lacks: freq, doc_freq, score; counted over all documents."""
    each = word_spans(docs).groupBy("span").agg(F.count("*").alias("freq"), F.count_distinct("doc_id").alias("doc_freq")).where(F.col("freq") >= least)
    new = each.join(vocab.select(F.col("piece").alias("span")), "span", "left_anti")
    score = 6 * F.col("freq") + 30 * F.col("doc_freq") + 3 * (F.char_length("span") - 1) + 2 * (F.octet_length("span") - 1)
    return new.select("span", "freq", "doc_freq", score.cast("bigint").alias("score"))


# Pieces that a swap leaves alone.
PROTECTED_MARKS = list(".,:;!?'\"`’“”()[]{}-–—/\\&%$#@*+=_|<>")
PROTECTED_ENDINGS = ["'s", "’s", "'t", "’t", "'re", "’re", "'ve", "’ve", "'ll", "’ll", "'m", "’m", "'d", "’d", " s", " t", " re", " ve", " ll", " m", " d", "’", "'"]


def is_protected(piece: Column) -> Column:
    """Pieces that a swap leaves alone: bytes, listed marks and endings, single letters and digits, whitespace."""
    bare = strip_space(piece)
    listed = bare.isin(PROTECTED_MARKS + PROTECTED_ENDINGS) | piece.isin(PROTECTED_ENDINGS)
    blank = (piece != "") & (bare == "")
    return (piece.startswith("<0x") & piece.endswith(">")) | listed | bare.rlike(r"^[\p{L}\p{Nd}]$") | blank
