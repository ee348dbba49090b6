from pyspark.sql import functions as F

from lexmill import plans  # noqa: F401  (registers the queries)
from lexmill.catalog import QUERIES

SCHEMA = "cand_id bigint, n int, ids array<int>, freq bigint, text string, normalized_text string, class string, record string, source_file string"
ROWS = [
    (1, 2, [1, 2], 9, "of the", None, "keep_short_phrase", None, "a"),
    (2, None, None, None, None, None, None, '{"n" : 2, "ids": [3, 4], "freq": 7, "text": "one of", "class": "keep_short_phrase"}', "a"),
    (3, None, None, None, None, None, None, '{"n":1,"ids":[5],"freq":5,"text":"different","class":"keep_subword"}', None),
    (4, None, None, None, None, None, None, '{"n":2,"ids":[9],"freq":2,"text":"One  of","class":"keep_long_phrase"}', "b"),
    (5, 2, [1, 2], 1, None, None, "keep_short_phrase", None, "b"),
    (6, None, None, None, None, None, None, "{broken", "b"),
]


def _tables(spark, folder, rows, docs):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/merge_candidates_final_v1.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_raw_records_are_candidates(spark, tmp_path):
    d = _tables(spark, tmp_path, ROWS, [(1, "One of the best, one of many"), (2, None)])
    run = lambda name: QUERIES[name](spark, d)
    for name in ("bigram_classes", "trigram_classes", "candidate_buckets", "subword_scores"):
        assert sorted(r.cand_id for r in run(name).collect()) == [1, 2, 3, 4], name
    assert {r.cand_id: r.score for r in run("subword_scores").collect()}[3] == 15
    assert sum(r.candidates for r in run("subword_reasons").where("reason = 'full_word_allowlist'").collect()) == 1
    assert sorted(r.ord for r in run("candidate_dedupe").collect()) == [1, 2, 3]
    assert run("candidate_merge").count() == 3
    assert [(r.text, r.freq) for r in run("forced_phrases").orderBy(F.desc("freq"), "text").collect()] == [("of the", 9), ("one of", 7), ("One of", 2)]
    assert {r.placeholder: r.uses for r in run("phrase_usage").collect()}["PHRASE_ONE_OF"] == 2


def test_round_trip_takes_the_whole_forced_list(spark, tmp_path):
    rows = [(i, 1, [i], 1000 - i, f"filler phrase {i}", None, "keep_short_phrase", None, "a") for i in range(40)]
    rows += [(50, 2, [1, 50], 3, "(red barn)", None, "keep_long_phrase", None, "a"), (51, 2, [1, 51], 2, "red barn", None, "keep_short_phrase", None, "a"), (52, 2, [1, 52], 1, "barn door", None, "keep_short_phrase", None, "a")]
    docs = [(1, "A Red  barn (red barn), red barn_x; barn door."), (2, "redbarn only"), (3, None), (4, "see filler\nphrase 39!")]
    d = _tables(spark, tmp_path, rows, docs)
    assert tuple(QUERIES["phrase_round_trip"](spark, d).first()) == (4, 4)
    assert tuple(QUERIES["phrase_round_trip_touched"](spark, d).first()) == (4, 2, 2)


def test_found_phrases_equal_the_pattern():
    import random
    import re

    from lexmill.operators.curation import Phrases

    rnd = random.Random(3)
    listed = ["a b", "a b c", "(a", "b", "c's d", "a.b c", "é d", "d-a"]
    either = "|".join(r"\s+".join(re.escape(w) for w in t.split()) for t in sorted(listed, key=lambda t: (-len(t), t)))
    pattern = re.compile(rf"(?i)(?<![^\W_])(?:{either})(?![^\W_])")
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "b", "c", "d", "É", "'s", " ", " ", "\n", ".", "(", "-", "_", "A"]) for _ in range(14))
        assert [(a, b) for a, b, _ in Phrases([(t, t) for t in listed]).find(text)] == [m.span() for m in pattern.finditer(text)], text


def test_forced_phrases_have_no_cap_and_boost_terms_their_own(spark, tmp_path):
    raw = lambda i, text, kind, freq: (i, None, None, None, None, None, None, f'{{"n":2,"ids":[{i}],"freq":{freq},"text":"{text}","class":"{kind}"}}', "a")
    rows = [raw(i, f"filler phrase {i}", "keep_long_phrase", 10) for i in range(350)]
    rows += [raw(400 + i, f"boosted{i}", "keep_full_word", 20) for i in range(320)]
    rows += [raw(800, "different", "keep_subword", 90), raw(801, "somet", "keep_subword", 91), raw(802, "it's", "keep_contraction", 92), raw(803, "so red", "keep_short_phrase", 93), raw(804, "abc", "keep_full_word", 94), raw(805, "so red", "keep_full_word", 95)]
    d = _tables(spark, tmp_path, rows, [(1, "Filler phrase 349\r\nand so  red."), (2, None)])
    assert QUERIES["forced_phrases"](spark, d).count() == 351
    assert QUERIES["phrase_usage"](spark, d).where("placeholder = 'PHRASE_FILLER_PHRASE_349'").first().uses == 1
    terms = {r.text: r.freq for r in QUERIES["boost_terms"](spark, d).collect()}
    assert len(terms) == 300 and terms["so red"] == 95 and {"different", "it's", "boosted0", "boosted296"} <= set(terms)
    assert not {"somet", "abc", "boosted297", "filler phrase 1"} & set(terms)
    corpus = QUERIES["boost_corpus"](spark, d)
    assert corpus.count() == 300 * 80 and corpus.where("text = 'PHRASE_SO_RED'").count() == 80 and corpus.where("text = 'so red'").count() == 0
    lines = QUERIES["training_corpus"](spark, d)
    assert lines.count() == 300 * 80 + 2 and lines.where("text in ('PHRASE_FILLER_PHRASE_349', 'and PHRASE_SO_RED.')").count() == 2


def test_null_ids_and_empty_norms_stand_for_themselves(spark):
    from lexmill.operators.curation import first_wins

    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, [1], ""), (4, [2], None), (5, [1], "c"), (6, [3], "a")], "ord bigint, ids array<int>, norm string")
    assert sorted(r.ord for r in first_wins(rows).collect()) == [1, 2, 3, 4]


def test_one_apostrophe_is_no_bar_to_a_subword(spark):
    from lexmill.operators.curation import subword_score

    rows = spark.createDataFrame([("don't",), ("o'clock",), ("a'b'c",), ("x-ray",)], "t string")
    got = {r.t: r.s for r in rows.select("t", subword_score(F.col("t"))[0].alias("s")).collect()}
    assert got["a'b'c"] == got["x-ray"] == -999 and got["don't"] > -999 and got["o'clock"] > -999
