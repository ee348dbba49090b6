import random

import pytest

from lexmill.functions import lines
from lexmill.operators import inspection, segmentation

BYTES = [(i, f"<0x{i:02X}>") for i in range(256)]


def test_differing_blocks():
    f = inspection.differing_blocks
    assert f([], []) == [] and f([b"ab", b"c"], [b"ab", b"c"]) == []
    assert f([b"ab", b"c", b"d"], [b"a", b"bc", b"d"]) == [([b"ab", b"c"], [b"a", b"bc"])]
    rnd = random.Random(1)
    for _ in range(100):
        text = bytes(rnd.randrange(97, 100) for _ in range(30))
        x, y = ([text[i:j] for i, j in zip([0, *c], [*c, 30])] for c in (sorted(rnd.sample(range(1, 30), 9)), sorted(rnd.sample(range(1, 30), 12))))
        for left, right in f(x, y):
            assert b"".join(left) == b"".join(right) and left != right


def test_modes_restore_every_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab = spark.read.parquet("/root/testdata/sf0.001/vocab.parquet")
    rows = {r["mode"]: r for r in inspection.mode_totals(docs, vocab).collect()}
    assert set(rows) == set(segmentation.MODES) and all(r.restored == r.docs for r in rows.values())
    assert rows["boundary"].tokens == rows["min_tokens"].tokens <= rows["greedy"].tokens
    assert rows["boundary"].fallback_tokens <= rows["min_tokens"].fallback_tokens
    diff = inspection.differences(docs, vocab, "min_tokens", "min_tokens")
    assert diff.count() == 0 and inspection.differences(docs, vocab).count() > 0


def test_decomposition(spark):
    vocab = spark.createDataFrame(BYTES + [(256, "ab"), (257, "abc"), (258, "c")], "id int, piece string")
    got = {r.piece: r.parts for r in inspection.decomposed(vocab).collect()}
    assert got["abc"] == ["ab", "c"] and got["ab"] == ["<0x61>", "<0x62>"] and got["<0x41>"] == ["<0x41>"]
    assert {r.piece: r.parts for r in inspection.decomposed(vocab, most=1).collect()}["abc"] is None


def test_vocabulary_changes(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "id int, piece string")
    b = spark.createDataFrame([(0, "x"), (1, "z")], "id int, piece string")
    assert [tuple(r) for r in inspection.vocabulary_changes(a, b).collect()] == [(1, "y", "z")]
    with pytest.raises(Exception, match="has id 1"):
        inspection.vocabulary_changes(a, b.limit(1)).collect()


def test_line_features_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "ABC DEF\r\n\r\n  \nsome text"), (2, None), (3, "")], "doc_id bigint, text string")
    got = [(r.doc_id, r.line_no, r.tokens, r.is_heading) for r in lines.line_features(docs).orderBy("line_no").collect()]
    assert got == [(1, 0, 2, True), (1, 3, 2, False)]
