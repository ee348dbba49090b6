from lexmill.llm import quality


def test_a_kind_the_corpus_hardly_has_is_found(make):
    words = "river valley bread morning window garden people little market open"
    rows = [(i, f"The {words} {i} and the {words}.") for i in range(60)]
    rows += [(200 + i, "a b c d e f g h") for i in range(3)]  # word_length only: three documents
    rows += [(300, "%% @@ ## !! ab"), (301, "\n".join(f"the {w}" for w in words.split())), (302, "zug qab " * 20)]  # one of each other kind
    common = make([(w,) for w in f"the and {words}".split()], "word string")
    docs = make(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in quality.structural_documents(docs, common).collect()} == {200, 201, 202, 300, 301, 302}


def test_a_single_document_is_scored_like_any(make):
    common = make([("the",)], "word string")
    one = make([(1, "%% @@ ## !! ab")], "doc_id bigint, text string")
    assert [r.doc_id for r in quality.structural_documents(one, common).collect()] == [1]
