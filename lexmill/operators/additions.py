"""Pieces that a vocabulary could gain: fallback spans, report-driven candidates, ranked phrases and words, credits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.lines import preview
from lexmill.operators.tokens import greedy_pieces, literal_pieces
from lexmill.operators.vocabulary import is_byte_piece

# Fragments, pins, premiums and patterns of the selection.
BAD_FRAGMENTS = [
    "ed to", "ing to", "ing the", "ed in", "ed by", "ed the", "es and", "es of", "ing in", "the st", "ation of", "ed with", "es to", "ing for",
    "the re", "ion of", "to re", "es in", "ed and", "er to", "ed for", "the pro", "ed on", "s of the", "ed by the", "ed in the", "umber of",
    "ording to", "a litt", "lot of",
]
BAD_PREFIXES = ["ed ", "ing ", "es ", "er ", "ion ", "ation ", "s "]
BAD_SUFFIXES = [" ed", " ing", " es", " er", " ion", " tion", " s"]
BAD_CHUNKS = ["umber ", "ording ", "ation ", "ition ", "the pro", "the re", "the st"]
PINNED = [
    "There are", "such as", "as well as", "able to", "public", "quality", "the same", "the world", "a lot", "a few", "going to", "I’m", "social",
    "success", "personal", "organiz", "govern", "profess",
]
PRIZED_PHRASES = [
    "of the", "in the", "to the", "on the", "for the", "from the", "as a", "one of", "such as", "as well as", "There are", "a lot", "a few",
    "the same", "able to", "going to",
]
PHRASE_CLASSES = ["phrase", "keep_short_phrase", "keep_allowlist"]
WORD_CLASSES = {"keep_full_word": 50_000, "keep_contraction": 30_000, "curated_subword_auto_v2": 10_000}
PRIZE, PIN, LOWER, FULL_WORD = 250_000, 500_000, 1_000, 5_000
MOST_PHRASE_WORDS = 3
WORDISH, PUNCT_CLUSTER, BLANKS = r"[A-Za-z0-9][A-Za-z0-9'._:/-]{1,}", r"[^\p{L}\p{N}_\s]{2,}", " {2,}"

#: A noncharacter that stands between the stretches of a text that no piece covers.
_GAP = "﷐"


def spaced_words(text: Column) -> Column:
    """The text split at blanks, every part but the first with one blank before it; runs of blanks count as one."""
    return F.regexp_extract_all(text, F.lit("^[^ ]+| [^ ]+"), F.lit(0))


def clean_candidate(piece: Column) -> Column:
    return F.translate(piece, "\r\n\t", "   ")


def is_valid_candidate(piece: Column, least: int, most: int) -> Column:
    return ~is_byte_piece(piece) & F.char_length(piece).between(least, most) & piece.rlike(r"\S") & ~piece.contains("\0")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def smells_cut(piece: Column) -> Column:
    """Looks cut off at a word boundary."""
    return piece.isin(BAD_FRAGMENTS) | _any([piece.startswith(x) for x in BAD_PREFIXES]) | _any([piece.endswith(x) for x in BAD_SUFFIXES]) | _any([piece.contains(x) for x in BAD_CHUNKS])


def _clean(piece: Column) -> Column:
    return (F.char_length(piece) > 0) & ~piece.contains("\0") & ~piece.rlike("^[A-Za-z]$") & ~smells_cut(piece)


def is_phrase(piece: Column) -> Column:
    return _clean(piece) & piece.rlike("^[A-Za-z]+(?: [A-Za-z]+){1,2}$") & (F.size(F.filter(F.split(piece, " "), lambda x: x != "")) <= MOST_PHRASE_WORDS)


def is_word(piece: Column, kind: Column, score: Column, least_score: int) -> Column:
    full = piece.rlike("^[A-Za-z]+$") & (F.char_length(piece) >= 3)
    contraction = piece.rlike("^[A-Za-z]+['’][A-Za-z]+$")
    subword = ~piece.contains(" ") & (F.char_length(piece) >= 3) & (score >= least_score) & piece.rlike("[A-Za-z]")
    return _clean(piece) & F.when(kind == "keep_full_word", full).when(kind == "keep_contraction", contraction).when(kind == "curated_subword_auto_v2", subword).otherwise(F.lit(False))


def _value(base: Column, premiums: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, t: a + F.when(t[0], t[1]).otherwise(0), premiums, base)


def phrase_value(freq: Column, score: Column, piece: Column, pins: list[str]) -> Column:
    lower = (F.lower(piece) == piece) & piece.rlike(r"\p{Ll}")
    return _value(freq * 1000 + score, [(piece.isin(PRIZED_PHRASES), PRIZE), (piece.isin(pins), PIN), (lower, LOWER)])


def word_value(freq: Column, score: Column, kind: Column, piece: Column, pins: list[str]) -> Column:
    return _value(freq * 1000 + score, [*((kind == k, v) for k, v in WORD_CLASSES.items()), (piece.rlike("^[A-Za-z]+$"), FULL_WORD), (piece.isin(pins), PIN)])


def ranked_candidates(rows: DataFrame, most: int, pins: list[str] = PINNED, least_score: int = 10) -> DataFrame:
    """family, mode, place, piece, value: the best phrases and words of rows(piece, freq, score, class) in the three sort modes.

    Each piece once, with its greatest value; equal values go by length, then by text.
    """
    f, s, p, k = (F.coalesce("freq", F.lit(0)).cast("double"), F.coalesce("score", F.lit(0)).cast("double"), F.col("piece"), F.col("class"))
    families = {"phrase": (k.isin(PHRASE_CLASSES) & is_phrase(p), phrase_value(f, s, p, pins)), "word": (k.isin(list(WORD_CLASSES)) & is_word(p, k, s, least_score), word_value(f, s, k, p, pins))}
    out = []
    for family, (test, combined) in families.items():
        modes = F.array(*(F.struct(F.lit(m).alias("mode"), v.alias("value")) for m, v in (("freq", f), ("score", s), ("combined", combined))))
        each = rows.where(test).select("piece", F.explode(modes).alias("m")).groupBy(F.lit(family).alias("family"), "m.mode", "piece").agg(F.max("m.value").alias("value"))
        place = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("value"), F.char_length("piece"), "piece"))
        out.append(each.withColumn("place", place).where(F.col("place") <= most))
    return out[0].unionByName(out[1]).select("family", "mode", "place", "piece", "value")


def fallback_spans(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, span: the stretches of each text that no piece covers, in order."""
    known = literal_pieces(vocab)
    marked = F.transform("m", lambda x: F.when(x.isin(known), F.lit(_GAP)).otherwise(x) if known else x)
    spans = F.regexp_extract_all(F.array_join(marked, ""), F.lit(f"[^{_GAP}]+"), F.lit(0))
    return greedy_pieces(docs, vocab).select("doc_id", F.explode(spans).alias("span"))


def top_fallback_spans(docs: DataFrame, vocab: DataFrame, most: int = 200, samples: int = 5) -> DataFrame:
    """place, span, uses, sample_doc_ids (the least of its doc_ids, one per use, up to `samples`) of the most frequent spans."""
    each = fallback_spans(docs, vocab).groupBy("span", "doc_id").agg(F.count("*").alias("c"))
    first = each.withColumn("nth", F.row_number().over(Window.partitionBy("span").orderBy("doc_id"))).where(F.col("nth") <= samples)
    ids = F.slice(F.array_sort(F.flatten(F.collect_list(F.array_repeat("doc_id", F.least("c", F.lit(samples)).cast("int"))))), 1, samples)
    top = each.groupBy("span").agg(F.sum("c").alias("uses")).orderBy(F.desc("uses"), "span").limit(most)
    rows = top.join(first.groupBy("span").agg(ids.alias("sample_doc_ids")), "span")
    return rows.select(F.row_number().over(Window.orderBy(F.desc("uses"), "span")).alias("place"), "span", "uses", "sample_doc_ids")


def report_candidates(spans: DataFrame, worst: DataFrame, fallback: DataFrame, vocab: DataFrame, least: int = 2, most: int = 24) -> DataFrame:
    """piece, source, freq, doc_count, fallback_hits, score of what the three parts of a score report suggest.

    spans: place, span, uses, sample_doc_ids; worst: place, doc_id, text, delta; fallback: place,
    doc_id, text, fallback_tokens. All are short lists. The source is that of the first suggestion.
    """
    t = preview(F.col("text"))
    kinds = {"wordish": WORDISH, "leading_space": f" {WORDISH}", "punct": PUNCT_CLUSTER, "multispace": BLANKS}

    def of_docs(docs: DataFrame, part: int, prefix: str, weight: Column, names: list[str]) -> DataFrame:
        found = F.concat(*(_found(t, kinds[n], k, f"{prefix}_{n}", F.lit(1).cast("bigint") if n == "multispace" else weight) for k, n in enumerate(names)))
        each = docs.select("place", F.explode(found).alias("x"))
        return each.select(F.struct(F.lit(part).alias("part"), "place", "x.k", "x.i").alias("ord"), "x.piece", "x.source", "x.boost", F.lit(1).alias("docs"))

    one = spans.select(F.struct(F.lit(0).alias("part"), "place", F.lit(0).alias("k"), F.lit(0).alias("i")).alias("ord"), F.col("span").alias("piece"), F.lit("fallback_span").alias("source"), F.col("uses").cast("bigint").alias("boost"), F.size(F.array_distinct("sample_doc_ids")).alias("docs"))
    two = of_docs(worst, 1, "worst_doc", F.greatest(F.col("delta"), F.lit(1)).cast("bigint"), ["wordish", "leading_space", "punct", "multispace"])
    three = of_docs(fallback, 2, "fallback_doc", F.greatest(F.col("fallback_tokens"), F.lit(1)).cast("bigint"), ["wordish", "leading_space", "punct"])
    rows = one.unionByName(two).unionByName(three).withColumn("piece", clean_candidate(F.col("piece"))).where(is_valid_candidate(F.col("piece"), least, most))
    hits = F.sum(F.when(F.col("source").startswith("fallback"), F.col("boost")).otherwise(0))
    each = rows.groupBy("piece").agg(F.min_by("source", "ord").alias("source"), F.sum("boost").alias("freq"), F.sum("docs").alias("doc_count"), hits.alias("fallback_hits"))
    new = each.join(F.broadcast(vocab.select("piece")), "piece", "left_anti")
    score = 8 * F.col("freq") + 40 * F.col("doc_count") + 20 * F.col("fallback_hits") + 4 * F.greatest(F.char_length("piece") - 1, F.lit(0)) + 2 * F.greatest(F.octet_length("piece") - 1, F.lit(0))
    return new.withColumn("score", score.cast("bigint"))


def _found(text: Column, pattern: str, k: int, source: str, weight: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x.alias("piece"), F.lit(source).alias("source"), weight.alias("boost")))


def add_families(report: DataFrame, mined: DataFrame, most: int) -> DataFrame:
    """family, place, piece: fallback, tail and general candidates, and the hybrid of the first halves of the three.

    report: piece, source, score, fallback_hits, doc_count, freq; mined: piece, score. Both are cut to `most` first.
    """
    ranked = report.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("fallback_hits"), F.desc("doc_count"), F.desc("freq"), "piece"))).where(F.col("n") <= most)
    general = mined.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "piece"))).where(F.col("n") <= most).select("piece", "n")
    parts = {"fallback": ranked.where(F.col("source").contains("fallback")), "tail": ranked.where(F.col("source").contains("worst_doc")), "general": general}
    placed = {f: df.select("piece", F.row_number().over(Window.orderBy("n")).alias("place")) for f, df in parts.items()}
    halves = reduce(DataFrame.unionByName, (df.where(F.col("place") <= most // 2).select(F.lit(i).alias("part"), "place", "piece") for i, df in enumerate(placed.values())))
    first = halves.withColumn("nth", F.row_number().over(Window.partitionBy("piece").orderBy("part", "place"))).where("nth = 1")
    hybrid = first.select("piece", F.row_number().over(Window.orderBy("part", "place")).alias("place"))
    return reduce(DataFrame.unionByName, (df.select(F.lit(f).alias("family"), "place", "piece") for f, df in {**placed, "hybrid": hybrid}.items()))


def compression_credit(arrays: DataFrame, base: DataFrame) -> DataFrame:
    """id, credit of arrays(doc_id, ids) against base(doc_id, base_tokens): what a document saves, shared out evenly among its tokens."""
    size = F.size("ids")
    rows = arrays.where(size > 0).join(base, "doc_id").select(((F.col("base_tokens") - size) / size).alias("share"), F.explode("ids").alias("id"))
    return rows.groupBy("id").agg(F.round(F.sum("share"), 4).alias("credit"))
