from lexmill.llm.pii_shapes import mentions

NONE = frozenset()


def _ids(text):
    return [text[a:b] for kind, a, b, *_ in mentions(text, NONE, NONE, NONE) if kind == "id_number"]


def test_labelled_numbers_of_mostly_letters():
    assert _ids("Her passport no. CXKTR478 was renewed.") == ["CXKTR478"]
    assert _ids("Die Ausweisnummer: LZX6R3TN4 ist neu.") == ["LZX6R3TN4"]
    assert _ids("Ausweisnummer: LZXRTN4 ist kurz.") == []


def test_no_shape_is_cut_where_a_stretch_ends():
    filler = "lorem ipsum dolor amet " * 8
    for k in range(30, 110):
        lead = "Batch 10482 " + filler[:k].rstrip() + " "
        for mention in ("K15439387", "903 60 7878"):
            assert _ids(f"{lead}passport no. {mention} then") == [mention], (k, mention)
        text = f"{lead}at 183 Harrowgate Street then"
        assert [text[a:b] for kind, a, b, *_ in mentions(text, NONE, NONE, NONE) if kind == "address"] == ["183 Harrowgate Street"], k


def test_stretches_do_not_overlap():
    from lexmill.llm.pii_shapes import _numbers

    text = "a1" * 3000 + " 12 " + "word " * 60 + "7 x"
    spans = _numbers(text)
    assert len(spans) == 2 and spans[0][1] <= spans[1][0] and all(text[b : b + 1] in ("", " ") for _, b, _ in spans)
