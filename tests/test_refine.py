from lexmill.operators import refine


def _flags(spark, pieces):
    rows = refine.piece_predicates(spark.createDataFrame([(p,) for p in pieces], "piece string")).collect()
    return {r.piece: r for r in rows}


def test_predicates(spark):
    got = _flags(spark, ["\nChapter 1", "\nNEWS of", "\nNO go", "There are", "Berlin", "THE", "ab cd", "these", "plain words", "one two three four", "ONE TWO THREE FOUR", "a1b2", "12345", "x  yzab", "\nChapter one two three"])
    assert [p for p, r in got.items() if r.is_structural_break] == ["\nChapter 1", "\nNEWS of", "\nChapter one two three"]
    assert got["There are"].is_sentence_start and got["Berlin"].is_proper_noun and not got["THE"].is_proper_noun
    little = {p for p, r in got.items() if r.says_little}
    assert little == {"There are", "Berlin", "THE", "ab cd", "these", "one two three four", "12345", "x  yzab"}
    assert got["a1b2"].has_signal and not got["12345"].has_signal


def test_all_five_kinds_of_candidates(spark):
    docs = spark.createDataFrame([(i, "of the long story went on, but then came rain\nTable of short", 9) for i in range(4)], "doc_id bigint, text string, delta bigint")
    rows = refine.line_candidates(docs).where("doc_id = 0").collect()
    weights = {}
    for r in rows:
        weights[r.piece] = weights.get(r.piece, 0) + r.weight
    assert weights["of the"] == 5 + 2 + 6 and weights["of the long story went"] == 5
    assert weights[", but then came"] == 4 + 2 and weights["\nTable of"] == 8 and "\nof the" not in weights
    vocab = spark.createDataFrame([(0, "long story")], "id int, piece string")
    got = {r.piece: (r.doc_hits, r.raw_count) for r in refine.scored_candidates(docs, vocab).collect()}
    assert got[", but then"] == (4, 2 * 3 * 4) and ", but then came" not in got and got["\nTable of"] == (4, 8 * 3 * 4)
    assert "long story" not in got and got["of the"] == (4, 13 * 3 * 4)


def test_scores_and_swaps(spark):
    vocab = spark.createDataFrame([(0, "<0x41>"), (1, " of the"), (2, "abcd"), (3, "longer piece"), (4, "Longword"), (5, "ab")], "id int, piece string")
    gone = {r.piece: r.score for r in refine.removal_candidates(vocab).collect()}
    assert gone == {"longer piece": 23.2, "Longword": 10.8}
    scored = spark.createDataFrame([("new piece", 10, 4, 8, 30.0), ("other one", 9, 4, 8, 20.0)], "piece string, raw_count bigint, doc_hits bigint, est_savings bigint, weighted_score double")
    made = {r.id: (r.piece, r.replaced) for r in refine.repaired(vocab, refine.swaps(scored, refine.removal_candidates(vocab), 2)).collect()}
    assert made[3] == ("new piece", "longer piece") and made[4] == ("other one", "Longword") and made[2] == ("abcd", None)
    try:
        refine.swaps(scored, refine.removal_candidates(vocab), 3)
        raise AssertionError
    except ValueError as e:
        assert "3 needed" in str(e)


def test_the_query_takes_all_kinds(spark, tmp_path):
    from lexmill import plans  # noqa: F401  (registers the queries)
    from lexmill.catalog import QUERIES

    spark.createDataFrame([(i, "plain words of a line, then others") for i in range(3)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vocab = [(i, f"<0x{i:02X}>", "byte") for i in range(256)] + [(256, "plain words", "word")]
    spark.createDataFrame(vocab, "id int, piece string, kind string").write.parquet(f"{tmp_path}/vocab.parquet")
    got = {r.piece for r in QUERIES["worst_doc_candidates"](spark, str(tmp_path)).collect()}
    assert {"plain", "plain words of", ", then others"} <= got, got


def test_safe_swaps(spark):
    from lexmill.operators.building import safe_swaps

    rows = [
        ("sp", 5, "the", 1, 0, 900, 300, 0, 0.0), ("sp", 6, "rare", 1, 0, 9, 3, 0, 0.0), ("sp", 7, "rarer", 1, 0, 1, 1, 4, -5.0), ("sp", 2, "special", 1, 0, 0, 0, 0, 0.0), ("sp", 8, "'s", 1, 0, 0, 0, 0, 0.0),
        ("custom", 1, " good", 0, 1, 900, 400, 9, 0.5), ("custom", 2, "better", 0, 1, 90_000, 400, 0, None), ("custom", 3, "seldom", 0, 1, 900, 100, 0, 0.0), ("custom", 4, "the", 1, 1, 900, 900, 0, 0.0), ("custom", 5, "rare", 0, 1, 9000, 900, 0, 0.0),
    ]
    stats = spark.createDataFrame(rows, "source string, token_id int, piece string, in_sp int, in_custom int, freq bigint, doc_freq bigint, context_diversity int, compression_credit double")
    got = {r.place: (r.remove_id, r.add_piece) for r in safe_swaps(stats, 10).collect()}
    assert got == {1: (7, "better"), 2: (6, " good")}
