from lexmill.llm import copies

SCHEMA = "cand_id bigint, n int, ids array<int>, freq bigint, text string, class string, record string"


def test_copies(make):
    rows = [
        (1, 2, [1, 2], 10, "Of The", "keep", None),
        (2, 2, [1, 2], 10, " of-the!", "keep", None),
        (3, None, None, None, None, None, '{"class": "keep", "ids": [1, 2], "text": "OF the", "freq": 10, "n": 2, "normalized_text": "zzz"}'),
        (4, 2, [2, 1], 10, "of the", "keep", None),
        (5, 2, [1, 2], 11, "of the", "keep", None),
        (6, None, None, None, None, None, "not json"),
        (7, None, None, None, None, None, None),
        (8, 2, [1, 2], 10, "", "keep", None),
        (9, 2, [1, 2], 10, None, "keep", None),
        (10, 2, [1, 2], 10, "straße", "keep", None),
        (11, 2, [1, 2], 10, "STRASSE", "keep", None),
        (11, 2, [1, 2], 10, "STRASSE", "keep", None),
        (12, 2, [1, 2], 10, "x" * 100_000, None, None),
    ]
    df = make(rows, SCHEMA)
    assert sorted(tuple(r) for r in copies.candidate_copies(df).collect()) == [(1, 2), (1, 3), (6, 7), (10, 11)]
    kept = {r.keep_id: r.n_copies for r in copies.kept_candidates(df).collect()}
    assert kept == {1: 3, 4: 1, 5: 1, 6: 2, 8: 1, 9: 1, 10: 3, 12: 1}
    assert copies.candidate_copies(make([], SCHEMA)).count() == 0


def test_hot_group(make):
    rows = [(i, 1, [1], 1, "a b" if i % 3 else f"t{i}", "k", None) for i in range(6000)]
    got = copies.candidate_copies(make(rows, SCHEMA))
    assert got.count() == 3999 and {r.keep_id for r in got.select("keep_id").distinct().collect()} == {1}
