import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexmill.llm import term_counts as tc
from lexmill.llm.term_counts import marked_terms, term_counts

SCHEMA = "hit_id bigint, text string, doc_id bigint, hits int"


def brute(rows):
    freq, docs, seen = defaultdict(int), defaultdict(set), set()
    for hit, text, doc, hits in rows:
        if text is None or (hit is not None and hit in seen):
            continue
        seen.add(hit)
        term = " ".join(text.lower().replace("‘", "'").replace("’", "'").split())
        freq[term] += hits or 0
        docs[term] |= {doc} - {None}
    return {t: (n, len(docs[t])) for t, n in freq.items() if t}


def test_counts_against_brute_force(make):
    rnd = random.Random(1)
    rows = [(i if i % 9 else None, rnd.choice(["Of the", "of  the", "it’s", "IT'S", " a\tb ", "x%d" % rnd.randrange(40), None, " "]), rnd.choice([None, *range(12)]), rnd.choice([1, 2, None])) for i in range(600)]
    rows += [r for r in rows[:200] if r[0] is not None]
    got = {r.term: (r.freq, r.doc_freq) for r in term_counts(make(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_one_term_holds_most_rows_and_ids_are_unique(make):
    rows = [(i, "hot" if i % 3 else f"t{i}", i % 50, 1) for i in range(900)]
    out = term_counts(make(rows, SCHEMA)).collect()
    assert len({r.term_id for r in out}) == len(out) == 301
    assert {(r.freq, r.doc_freq) for r in out if r.term == "hot"} == {(600, 50)}


def test_marks(make):
    rows = [(i, "common", i, 1) for i in range(10)] + [(100 + i, f"r{i}", 20 + i, 9) for i in range(20)] + [(200 + i, "mid", i, 2) for i in range(3)]
    marks = {r.term: r["mark"] for r in marked_terms(make(rows, SCHEMA)).collect()}
    assert marks["common"] == "common" and marks["r3"] == "rare" and marks["mid"] is None


def test_empty_table_and_very_long_text(make):
    assert marked_terms(make([], SCHEMA)).count() == 0
    long = "ab " * 50_000
    assert [(r.term, r.freq) for r in term_counts(make([(1, long, 1, 3), (2, long.upper(), 2, 4)], SCHEMA)).collect()] == [(long.strip(), 7)]


def test_conflicting_deliveries_over_several_ranges(make, monkeypatch):
    monkeypatch.setattr(tc, "RANGE", 2)
    terms = ["alpha", "three", *(f"w{i}" for i in range(60))]
    rows = [(i, t, i % 7, 1) for i, t in enumerate(terms)] + [(i, terms[(i + 1) % len(terms)], i % 5, 2) for i in range(0, 62, 3)]
    got = {r.term: (r.freq, r.doc_freq) for r in term_counts(make(rows, SCHEMA)).collect()}
    assert set(got) == set(terms) and sum(f for f, _ in got.values()) == len(terms)  # each hit_id once, with the least of its hits


def test_a_salted_term_counts_every_document_once(make, monkeypatch):
    monkeypatch.setattr(tc, "SALT_ROWS", 10)
    monkeypatch.setattr(tc, "HOT_KEYS", 100)
    rows = [(i, "hot" if i % 3 else f"t{i % 40}", i % 50 or None, 1) for i in range(900)]
    assert {r.term: (r.freq, r.doc_freq) for r in term_counts(make(rows, SCHEMA)).collect()} == brute(rows)


def test_terms_that_share_a_code_get_another_seed(make, monkeypatch):
    real = tc._codes
    monkeypatch.setattr(tc, "_codes", lambda term, seed: {"h1": F.length(term).cast("bigint"), "h2": F.lit(0).cast("bigint")} if seed == 42 else real(term, seed))
    rows = [(i, f"t{i % 7}", i, 1) for i in range(30)]
    assert {r.term: (r.freq, r.doc_freq) for r in term_counts(make(rows, SCHEMA)).collect()} == brute(rows)
