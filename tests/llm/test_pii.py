import re

from lexmill.llm import pii

LEXICON = [("Rose", "given"), ("Jörg", "given"), ("Will", "given"), ("Thornquist", "family"), ("O'Fallowen", "family"), ("Lindqvarn", "family"), (None, "given")]
COMMON = [("the",), ("will",), ("then",), ("of",)]


def found(make, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = make(rows, "doc_id bigint, text string", extra="start")
    out = pii.found_mentions(docs, make(LEXICON, "name string, name_part string"), make(COMMON, "word string"))
    spans = {}
    for r in out.collect():
        spans.setdefault(r.doc_id, set()).add((r.pii_kind, texts[r.doc_id][r.start_char : r.stop_char]))
    redacted = {r.doc_id: r.text for r in pii.redacted(docs, out).collect()}
    return spans, redacted


def test_kinds(make):
    texts = [
        "Write to mailto:a.b+c@mail.example.test, or z [at] post [dot] example; (415) 555-0190.",
        "SSN: 903 60 7878; passport no. K15439387. Order number 2383094522 was refunded, ticket 50492-085, ISBN 978-0-07-215655-6.",
        "We moved to Flat 4, 183 Harrowgate Court, Oxlinton. Das Paket ging an Amselhainer Straße 28. P.O. Box 272, Ashgrave.",
        "Thanks to Rose K. Thornquist, O'Fallowen, Jörg and R. Lindqvarn. The Thornquist corpus. Then Rose said no. @rose77",
        "Nous habitons 225 bis, rue des Sablons-Verts. Vivimos en Calle del Molino Seco, 190. Appeler le +33 1 99 00 21 73.",
        "🔥🔥 name: Jörg\nLindqvarn, 2125550190",
        None,
        " \n",
        "no one here " * 20_000 + "a@b.example",
    ]
    spans, redacted = found(make, texts)
    assert spans[0] == {("email", "a.b+c@mail.example.test"), ("email", "z [at] post [dot] example"), ("phone", "(415) 555-0190")}
    assert spans[1] == {("id_number", "903 60 7878"), ("id_number", "K15439387")}
    assert {(k, v.split(",")[0]) for k, v in spans[2]} == {("address", "Flat 4"), ("address", "Amselhainer Straße 28"), ("address", "P.O. Box 272")}
    assert spans[3] == {("name", "Rose K. Thornquist"), ("name", "O'Fallowen, Jörg"), ("name", "R. Lindqvarn")}
    assert {k for k, _ in spans[4]} == {"address", "phone"} and len(spans[4]) == 3
    assert spans[5] == {("name", "Jörg\nLindqvarn"), ("phone", "2125550190")}
    assert redacted[0] == "Write to mailto:[EMAIL], or [EMAIL]; [PHONE]."
    assert redacted[5] == "🔥🔥 name: [NAME], [PHONE]" and redacted[6] is None and redacted[7] == " \n"
    assert redacted[8].endswith("here [EMAIL]") and len(redacted) == len(texts)


def test_contexts_admit_names_no_list_knows(make):
    texts = [f"Minutes taken by {g} {f}. Done." for g in ("Rose", "Jörg", "Will") for f in ("Thornquist", "Lindqvarn")]
    texts += ["Minutes taken by Vesdra Korovar. Done.", "Minutes taken by Mister Tordra Belwend. Done.", "Ladder School. The rest."]
    spans, _ = found(make, texts)
    assert spans[6] == {("name", "Vesdra Korovar")} and spans[7] == {("name", "Tordra Belwend")} and 8 not in spans


def test_redaction_keeps_the_rest(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lexicon, common = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("name_lexicon", "common_words"))
    out = pii.found_mentions(docs, lexicon, common).cache()
    new = {r.doc_id: r for r in pii.redacted(docs, out).collect()}
    marks = {}
    for r in out.collect():
        marks.setdefault(r.doc_id, []).append((r.start_char, r.stop_char, r.pii_kind))
    for r in docs.collect():
        text, at, want = r.text, 0, ""
        for a, b, k in sorted(marks.get(r.doc_id, [])):
            assert a >= at
            want, at = want + text[at:a] + f"[{k.upper()}]", b
        assert new[r.doc_id].text == (None if text is None else want + text[at:])
    assert marks and not any(re.search(r"\w@\w+\.\w", t.text or "") for t in new.values())


def test_empty(make):
    docs = make([], "doc_id bigint, text string")
    assert found(make, []) == ({}, {}) and docs.count() == 0


def test_broken_and_spaced_out_mentions(make):
    texts = ["Passport: 108\n18. Tokenizer: 49", "Ausweisnummer 83 194\n466 429.", "Gracias    a    Rose    Thornquist    por", "passport no - K95182612 into"]
    spans, _ = found(make, texts)
    assert 0 not in spans and spans[1] == {("id_number", "83 194\n466 429")}
    assert spans[2] == {("name", "Rose    Thornquist")} and spans[3] == {("id_number", "K95182612")}
