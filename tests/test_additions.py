import pytest
from pyspark.sql import functions as F

from lexmill.operators import additions as ad
from lexmill.operators import mining
from lexmill.operators import shards as sh


def test_spaced_words_and_predicates(spark):
    rows = spark.createDataFrame([("a  b c",), ("  x",), ("",), ("one",), ("a\nb c",)], "t string")
    got = {r.t: r.w for r in rows.select("t", ad.spaced_words(F.col("t")).alias("w")).collect()}
    assert got == {"a  b c": ["a", " b", " c"], "  x": [" x"], "": [], "one": ["one"], "a\nb c": ["a\nb", " c"]}
    pieces = ["of the", "ed to", "the problem", "more than one", "a b c d", "it’s", "x", "walk ing", "Word"]
    flags = {r.p: (r.a, r.b) for r in spark.createDataFrame([(p,) for p in pieces], "p string").select("p", ad.is_phrase(F.col("p")).alias("a"), ad.smells_cut(F.col("p")).alias("b")).collect()}
    assert [p for p, (a, _) in flags.items() if a] == ["of the", "more than one"]
    assert [p for p, (_, b) in flags.items() if b] == ["ed to", "the problem", "walk ing"]


def test_candidates_are_ranked_with_pins_and_premiums(spark):
    rows = spark.createDataFrame([("of the", 5, 0, "phrase"), ("a few", 1, 0, "phrase"), ("So many", 7, 0, "keep_short_phrase"), ("public", 3, 0, "keep_full_word"), ("word", 9, 0, "keep_full_word"), ("it's", 8, None, "keep_contraction"), ("organ", 4, 12, "curated_subword_auto_v2"), ("stub", 4, 2, "curated_subword_auto_v2"), (None, 1, 1, "phrase")], "piece string, freq bigint, score int, class string")
    got = {(r.family, r.mode, r.place): (r.piece, r.value) for r in ad.ranked_candidates(rows, 9).collect()}
    assert got["phrase", "combined", 1] == ("a few", 752_000.0) and got["phrase", "freq", 1][0] == "So many"
    assert got["word", "combined", 1] == ("public", 558_000.0) and got["word", "score", 1] == ("organ", 12.0)
    assert "stub" not in {p for p, _ in got.values()}


def test_fallback_spans_and_families(spark):
    vocab = spark.createDataFrame([(i, f"<0x{i:02X}>") for i in range(256)] + [(256, "ab"), (257, " ")], "id int, piece string")
    docs = spark.createDataFrame([(1, "ab xy ab xy"), (2, "xyab€"), (3, None), (4, "ab ab")], "doc_id bigint, text string")
    top = {r.span: (r.uses, r.sample_doc_ids) for r in ad.top_fallback_spans(docs, vocab).collect()}
    assert top == {"xy": (3, [1, 1, 2]), "€": (1, [2])}
    report = spark.createDataFrame([("p", "fallback_span", 9, 1, 1, 1), ("q", "worst_doc_punct", 8, 0, 1, 1), ("r", "fallback_doc_punct", 7, 1, 1, 1)], "piece string, source string, score bigint, fallback_hits bigint, doc_count bigint, freq bigint")
    mined = spark.createDataFrame([("q", 5), ("z", 4)], "piece string, score bigint")
    got = {}
    for r in ad.add_families(report, mined, 4).orderBy("family", "place").collect():
        got.setdefault(r.family, []).append(r.piece)
    assert got == {"fallback": ["p", "r"], "tail": ["q"], "general": ["q", "z"], "hybrid": ["p", "r", "q", "z"]}


def test_longest_merges_equal_a_sequential_pass(spark):
    import random

    rnd = random.Random(4)
    arrays = [(s, d, [rnd.randrange(3) for _ in range(50)]) for s in "xy" for d in range(2)]
    cand = [[0, 1, 0], [1, 1, 1], [0, 0], [1, 2]]
    stream = mining.linked(spark.createDataFrame(arrays, "shard_name string, doc_id bigint, ids array<int>"), "shard_name")
    got = {r.scope: (r.tokens, r.merges, r.saved) for r in mining.greedy_longest_merges(stream, spark.createDataFrame([(c, 1) for c in cand], "ids array<int>, freq bigint")).collect()}
    for s in "xy":
        ids, i, merges, saved = [x for a in arrays if a[0] == s for x in a[2]], 0, 0, 0
        while i < len(ids):
            n = next((n for n in (3, 2) if ids[i : i + n] in cand), 1)
            merges, saved, i = merges + (n > 1), saved + n - 1, i + n
        assert got[s] == (len(ids), merges, saved)


def test_plans_of_training(spark):
    stats = spark.createDataFrame([("train", 25), ("val", 9)], "split string, written bigint")
    assert [(r.split, r.chunk, r.tokens) for r in sh.chunk_plan(stats, 4, 11).orderBy("split", "chunk").collect()] == [("train", 0, 8), ("train", 1, 8), ("train", 2, 8), ("val", 0, 8)]
    with pytest.raises(Exception, match="too small"):
        sh.chunk_plan(stats, 10, 11).collect()
    read = sh.rank_batches(stats.where("split = 'val'"), 1, 3, 2, 2).orderBy("step", "rank").collect()
    assert [(r.first, r.last, r.wraps) for r in read] == [(0, 3, False), (4, 7, False), (8, 2, True), (3, 6, False)]
    scales = sh.scheduled_scales(spark.range(3).withColumnRenamed("id", "step"), 2, {"byte": 0.5}, {"byte": 1.0}).collect()
    assert [r.byte_scale for r in scales] == [0.5, 0.5, 1.0]
