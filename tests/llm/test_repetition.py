import itertools
import re

from pyspark.sql import functions as F

from lexmill.llm.repetition import repetition_profile, repetitive_documents


def brute(text):
    if text is None or not text.strip():
        return False
    w = re.findall(r"[^\W_]+", text.lower())
    grams = list(zip(*(w[i:] for i in range(5))))
    runs = sum(n for c, g in itertools.groupby(text) if not c.isspace() and (n := len(list(g))) >= 5)
    return (len(w) >= 30 and len(grams) - len(set(grams)) >= 0.25 * len(grams)) or runs >= 0.15 * len(text)


def test_against_brute_force(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = make([(-1, None), (-2, ""), (-3, " \n"), (-4, "aaaaa b"), (-5, "a" * 100_000), (-6, "x y z u v " * 20_000), (-7, "aaaa " * 10), (-8, "Ab " * 40)], "doc_id bigint, text string", extra=None)
    every = docs.union(extra)
    want = {r.doc_id for r in every.collect() if brute(r.text)}
    got = [r.doc_id for r in repetitive_documents(every.withColumn("w", F.lit(1)).withColumn("p", F.lit(2))).collect()]
    assert sorted(got) == sorted(want) and {-4, -5, -6} <= want


def test_profile_of_odd_rows(make):
    rows = [(1, None), (2, ""), (3, "one line\none line\none line\none line"), (None, "The sun. The sun."), (3, "again")]
    out = repetition_profile(make(rows, "doc_id bigint, text string"), ["the"]).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out if r.n_chars > 10}
    assert by[3].line_repeat == 0.75 and by[3].is_lines and not by[3].repetitive
    assert by[None].content_ratio == 0.5
    assert all(r.phrase_repeat == 0 and not r.repetitive for r in out if r.n_chars == 0)
    assert repetition_profile(make([], "doc_id bigint, text string"), []).count() == 0
