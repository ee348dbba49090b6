"""Formats that no shape knows, in contexts that the corpus uses for known ones, and the same digits elsewhere."""

import random

from lexmill.llm import pii

SEEN = {"phone": ["(212) 555-0147", "+1 305 555 0112", "020 7946 0182", "+33 1 42 68 53 00", "+34 912 345 678"], "address": ["65 Harrowgate Lane", "12 Mill Road", "Calle Mayor 8", "18 rue de la Paix", "Gartenstraße 5"]}
UNSEEN = {"phone": ["0161 496 0000", "+44 161 496 0000", "07700 900123", "+39 06 6982 1234", "+81 3-1234-5678", "0471 97 31 02"], "address": ["221 Elm Hill", "Via Roma 12, 20121", "7 Bishops Walk", "40 Old Quay", "Corso Vittorio 19, 10121"]}
SAID = {"phone": ["Please call me on {} before noon.", "Reach the desk at {} any day.", "My mobile is {} since May.", "Her number: {} until Friday."], "address": ["We moved to {}, near the park.", "Letters go to {}, second floor.", "They live at {}, by the river.", "Visit us at {}, any morning."]}
OTHER = ["The ticket {} was closed again.", "Order {} has been shipped twice.", "Build {} passed all tests.", "We counted {} in the ledger."]


def _corpus(seed):
    rnd = random.Random(seed)
    rows, truth = [], set()
    for i in range(400):
        kind = rnd.choice(["phone", "address"])
        pool = UNSEEN if i % 4 == 0 else SEEN
        said, value = rnd.choice(SAID[kind]), rnd.choice(pool[kind])
        text = "So it goes. " + said.format(value)
        if pool is UNSEEN:
            truth.add((i, kind, text.index(value)))
        rows.append((i, text))
    for i in range(400, 600):
        value = rnd.choice(["0161 496 0000", "0045-22178-9", "+7 2201 3344 5", "14 Quarter Reports", "3 Harbour Cranes"])
        rows.append((i, "So it goes. " + rnd.choice(OTHER).format(value)))
    return rows, truth


def test_unseen_formats_are_found_by_their_contexts(make):
    rows, truth = _corpus(3)
    found = pii.found_mentions(make(rows, "doc_id bigint, text string"), make([("Ada", "given")], "name string, name_part string"), make([("the",)], "word string"))
    got = {(r.doc_id, r.pii_kind, r.start_char) for r in found.collect()}
    of_unseen = {g for g in got if g[0] % 4 == 0 or g[0] >= 400}
    assert len(of_unseen & truth) >= 0.95 * len(truth), sorted(truth - of_unseen)[:10]
    assert len(of_unseen & truth) >= 0.95 * len(of_unseen), sorted(of_unseen - truth)[:10]
