"""Document statistics, and natural prose against lists, tables and junk (problem 2).

All statistics come from one projection. Structural junk is told by boosted trees over them: a
bounded sample of documents is labelled weakly, by bounds looser than those of the exact
definition, the trees are fitted to it, and their probabilities are calibrated on a holdout of
documents read by eye (HOLDOUT). structural_documents() scores every document, passes those that
are not almost surely prose, and checks the exact definition on them.

Defined results for odd input
    null or blank text   all statistics 0 (those of an empty text), never structural
    null doc_id          kept as it is
    repeated rows        each row has its own result
    few rows of a kind   the anchors of the training sample stand for it
    empty table          no rows
    extra columns        ignored
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.cluster import keep
from lexmill.functions.text import INLINE_SPACE, WHITESPACE, ratio, strip_space, stripped_lines, words
from lexmill.llm import boosted
from lexmill.llm.holdout import HOLDOUT

#: Most documents of each weak class in the training sample.
SAMPLE_ROWS = 1500
#: Made-up rows of each kind of structure in the training sample (prose: four times as many).
ANCHORS = 100
#: A document below this probability of being structural is taken for prose without a further check.
GATE = 0.05
#: Most entries the list of common words may have (it is compiled into the projection).
MOST_WORDS = 10_000

FEATURES = ["symbol_share", "short_lines", "end_share", "common_share", "mean_word", "n_words", "n_lines", "mean_line", "whitespace_ratio"]


def common_word_list(common: DataFrame) -> list[str]:
    """The distinct common words; their number is checked, as they become part of the plan."""
    found = [r[0] for r in common.where("word is not null").select(F.lower("word")).distinct().limit(MOST_WORDS + 1).collect()]
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return sorted(found)


def prose_statistics(docs: DataFrame, common: list[str]) -> DataFrame:
    """doc_id and the statistics that tell prose from structure, in one projection.

    The text is gone through as seldom as can be: one pass each for words, ink, lines and line ends.
    Letters and digits are counted from the words (the only letter that lower case writes as two
    code points, U+0130, gives a letter and a mark, and the mark belongs to no word).
    """
    t = strip_space(F.coalesce(F.col("text"), F.lit("")))
    base = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), t.alias("t"), words(t).alias("w"), stripped_lines(t).alias("lines"))
    told = F.col("t") != ""
    counted = base.select(
        "doc_id",
        (~told).alias("blank"),
        "n_chars",
        F.char_length(F.regexp_replace("t", f"[{WHITESPACE}]++", "")).alias("n_ink"),
        F.size("w").alias("n_words"),
        F.size(F.filter("w", lambda x: x.isin(common) if common else F.lit(False))).alias("n_common"),
        F.char_length(F.array_join("w", "")).alias("n_word_chars"),
        F.when(told, F.size("lines")).otherwise(0).alias("n_lines"),
        F.char_length(F.array_join("lines", "")).alias("n_line_chars"),
        F.regexp_count("t", F.lit(rf"""[.!?…]["'”’)\]]*+(?=[{INLINE_SPACE}]*+(?:[\r\n]|\z))""")).alias("n_ended"),
    )
    mean_line = ratio(F.col("n_line_chars"), F.col("n_lines"))
    return counted.select(
        "doc_id",
        "blank",
        "n_words",
        "n_lines",
        ratio(F.col("n_ink") - F.col("n_word_chars"), F.col("n_ink")).alias("symbol_share"),
        mean_line.alias("mean_line"),
        ratio(F.col("n_ended"), F.col("n_lines"), 1.0).alias("end_share"),
        F.when(F.col("n_lines") >= 4, F.greatest(F.lit(0.0), 80 - mean_line)).otherwise(F.lit(0.0)).alias("short_lines"),
        ratio(F.col("n_common"), F.col("n_words"), 1.0).alias("common_share"),
        ratio(F.col("n_word_chars"), F.col("n_words")).alias("mean_word"),
        ratio(F.col("n_chars") - F.col("n_ink"), F.col("n_chars")).alias("whitespace_ratio"),
    )


def rules(symbol: float = 0.22, line: float = 45, ended: float = 0.30, common: float = 0.15, low: float = 2.5, high: float = 9.5) -> dict[str, Column]:
    """The four kinds of structure; the defaults are the exact definition."""
    c, told = F.col, ~F.col("blank")
    return {
        "symbols": told & (c("symbol_share") > symbol),
        "short_lines": told & (c("n_lines") >= 4) & (c("mean_line") < line) & (c("end_share") < ended),
        "rare_words": told & (c("n_words") >= 20) & (c("common_share") < common),
        "word_length": told & (c("n_words") >= 5) & ((c("mean_word") < low) | (c("mean_word") > high)),
    }


def _any(flags: dict[str, Column]) -> Column:
    total = F.lit(False)
    for flag in flags.values():
        total = total | flag
    return total


#: The looser bounds of the weak labels.
LOOSER = {"symbol": 0.17, "line": 54, "ended": 0.40, "common": 0.21, "low": 3.0, "high": 8.4}


def weak_label() -> Column:
    """Name of the first loose rule that holds, or 'prose'."""
    label = F.lit("prose")
    for name, flag in reversed(list(rules(**LOOSER).items())):
        label = F.when(flag, F.lit(name)).otherwise(label)
    return label


def _sampled(statistics: DataFrame) -> dict[str, list]:
    """At most SAMPLE_ROWS documents of each weak class."""
    labelled = statistics.where("not blank").select(weak_label().alias("label"), F.xxhash64("doc_id", *FEATURES).alias("h"), *(F.col(f).cast("double").alias(f) for f in FEATURES))
    # each class by its own bounded top-k, so that no class passes through one task whole
    return {n: labelled.where(F.col("label") == n).orderBy("h").select(*FEATURES).limit(SAMPLE_ROWS).collect() for n in ["prose", *rules()]}


def _anchors() -> dict[str, np.ndarray]:
    """Vectors of statistics made from the loose rules: ANCHORS of each kind and four times as many of prose.

    They stand in the training sample beside documents, so that a model that knows every kind comes
    out at any size of the corpus, also where a kind is rare or absent.
    """
    rng = np.random.default_rng(11)

    def plain(n: int) -> dict[str, np.ndarray]:
        words, lines = np.exp(rng.uniform(np.log(30), np.log(4000), n)), np.rint(np.exp(rng.uniform(0, np.log(60), n)))
        line = rng.uniform(56, 420, n)
        return {"symbol_share": rng.uniform(0, 0.14, n), "end_share": rng.uniform(0.2, 1, n), "common_share": rng.uniform(0.25, 0.6, n), "mean_word": rng.uniform(3.4, 7.5, n), "n_words": np.rint(words), "n_lines": lines, "mean_line": line, "whitespace_ratio": rng.uniform(0.1, 0.25, n)}

    def free(x: dict, n: int, *names: str) -> None:
        """What a structure of one kind may have at will."""
        wide = {"symbol_share": (0, 0.9), "end_share": (0, 1), "common_share": (0, 0.6), "mean_word": (1, 15), "mean_line": (1, 900), "whitespace_ratio": (0, 0.7)}
        odd = rng.random(n) < 0.5
        for name in names:
            x[name] = np.where(odd, rng.uniform(*wide[name], n), x[name])

    made = {"prose": plain(4 * ANCHORS)}
    for kind in rules():
        n = ANCHORS
        x = plain(n)
        x["n_words"] = np.where(rng.random(n) < 0.3, np.rint(rng.uniform(0, 30, n)), x["n_words"])
        if kind == "symbols":
            free(x, n, "end_share", "common_share", "mean_word", "mean_line", "whitespace_ratio")
            x["symbol_share"] = rng.uniform(LOOSER["symbol"], 1, n)
        elif kind == "short_lines":
            free(x, n, "common_share", "mean_word", "whitespace_ratio")
            x["n_lines"] = np.maximum(4, x["n_lines"])
            x["mean_line"], x["end_share"] = rng.uniform(1, LOOSER["line"], n), rng.uniform(0, LOOSER["ended"], n)
        elif kind == "rare_words":
            free(x, n, "end_share", "mean_line", "whitespace_ratio")
            x["common_share"], x["n_words"] = rng.uniform(0, LOOSER["common"], n), np.maximum(20, x["n_words"])
        else:
            free(x, n, "end_share", "common_share", "mean_line", "whitespace_ratio")
            x["mean_word"] = np.where(rng.random(n) < 0.5, rng.uniform(1, LOOSER["low"], n), rng.uniform(LOOSER["high"], 40, n))
            x["n_words"] = np.maximum(5, x["n_words"])
        made[kind] = x
    for x in made.values():
        x["short_lines"] = np.where(x["n_lines"] >= 4, np.maximum(0, 80 - x["mean_line"]), 0)
    return {kind: np.stack([x[f] for f in FEATURES], 1) for kind, x in made.items()}


def train(statistics: DataFrame) -> boosted.Model:
    """Trees fitted to at most SAMPLE_ROWS documents of each weak class and the anchors, calibrated on HOLDOUT."""
    sample, anchors = _sampled(statistics), _anchors()
    each = [(float(kind != "prose"), np.array([*map(tuple, rows), *anchors[kind]], dtype=float)) for kind, rows in sample.items()]
    model = boosted.fit(FEATURES, np.concatenate([x for _, x in each]), np.concatenate([np.full(len(x), y) for y, x in each]))
    return boosted.calibrated(model, np.array([h[2] for h in HOLDOUT], dtype=float), np.array([h[0] for h in HOLDOUT], dtype=float))


def scored_documents(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Statistics of every document with p_structural, the calibrated probability of structure."""
    statistics = keep(prose_statistics(docs, common_word_list(common)), "statistics")
    return statistics.withColumn("p_structural", F.when(~F.col("blank"), train(statistics).probability()).otherwise(F.lit(0.0)))


def structural_documents(docs: DataFrame, common: DataFrame) -> DataFrame:
    """The documents that are structure by the exact definition, with what of it holds."""
    passed = scored_documents(docs, common).where(F.col("p_structural") >= GATE)
    return passed.withColumns({f"is_{k}": v for k, v in rules().items()}).where(_any(rules()))
