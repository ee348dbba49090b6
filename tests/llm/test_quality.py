import numpy as np
from pyspark.sql import functions as F

from lexmill.functions.metrics import text_metrics
from lexmill.llm import boosted, quality
from lexmill.llm.holdout import HOLDOUT


def test_gate_loses_no_structural_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    common = spark.read.parquet("/root/testdata/sf0.1/common_words.parquet")
    scored = quality.scored_documents(docs, common).withColumn("is", quality._any(quality.rules()))
    lost = scored.where("is").where(F.col("p_structural") < quality.GATE).count()
    assert lost == 0
    told = scored.where((F.col("p_structural") >= 0.5) != F.col("is")).count()
    assert told < 0.1 * scored.count()


def test_holdout_is_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    common = spark.read.parquet("/root/testdata/sf0.1/common_words.parquet")
    model = quality.train(quality.prose_statistics(docs, quality.common_word_list(common)).cache())
    x, y = np.array([h[2] for h in HOLDOUT], dtype=float), np.array([h[0] for h in HOLDOUT])
    assert model.scale > 0
    p = 1 / (1 + np.exp(-(model.margins(x) * model.scale + model.shift)))
    assert ((p > 0.5) == (y == 1)).mean() >= 0.9
    raw = 1 / (1 + np.exp(-model.margins(x)))
    assert ((p - y) ** 2).mean() < 0.06 < ((raw - y) ** 2).mean()  # calibration makes the probabilities honest


def test_statistics_against_a_plain_pass(make):
    import re

    space = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    texts = ["a. b.\r\n\u2003c!” \t\r\r\nd\u2028e?)\x0b\nÀb1²\x85\nx", " .\n. \n!!", "one", "\n\n", "a\u3000\n\u00a0\nb...", "İstanbul ﬀ\x1c\n…'\n"]
    got = {r.doc_id: r for r in quality.prose_statistics(make(list(enumerate(texts)), "doc_id bigint, text string"), ["one"]).collect()}
    for i, t in enumerate(texts):
        lines = [x for x in (re.sub(f"^[{space}]+|[{space}]+$", "", x) for x in re.split("\r\n|\r|\n", t)) if x]
        ink = re.sub(f"[{space}]", "", t)
        alnum = [c for c in ink if c.isalpha() or c.isnumeric()]
        assert got[i].n_lines == len(lines) and got[i].blank == (not lines)
        if lines:
            assert abs(got[i].mean_line - sum(map(len, lines)) / len(lines)) < 1e-9
            assert abs(got[i].end_share - sum(bool(re.search("[.!?…][\"'”’)\\]]*$", x)) for x in lines) / len(lines)) < 1e-9
            assert abs(got[i].symbol_share - (len(ink) - len(alnum)) / len(ink)) < 1e-9


def test_spark_score_equals_numpy_score(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    model = boosted.fit(["a", "b"], x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double")
    got = [r[0] for r in df.select(model.margin()).collect()]
    assert np.allclose(got, model.margins(x[:50])) and ((model.margins(x) > 0) == (x[:, 0] + x[:, 1] ** 2 > 0.5)).mean() > 0.95


def test_odd_rows(make):
    common = make([("the",), (None,)], "word string")
    rows = [(1, None), (2, " \r\n"), (3, "%% @@ ★ ★ ab"), (None, "a\rb\r\nc\nd"), (5, "The end."), (5, "The end."), (6, "x" * 200_000)]
    docs = make(rows, "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in quality.structural_documents(docs, common).collect()) == ["3", "None"]
    out = text_metrics(docs, "doc_id").collect()
    assert len(out) == 7 and {r.decoded_chars for r in out if r.doc_id == 1} == {0}
    assert quality.structural_documents(make([], "doc_id bigint, text string"), common).count() == 0
    assert quality.structural_documents(docs, make([], "word string")).count() == 2
