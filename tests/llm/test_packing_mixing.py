import random
from collections import defaultdict

import numpy as np
import pytest

from lexmill.llm import mixing, packing
from lexmill.llm.sizes import TOKENIZER, encoder

DOCS = "doc_id bigint, source string, text string"


def check(layout, hist, capacity):
    load, used = np.zeros(layout.n_bins, int), np.zeros(capacity + 1, int)
    for length, start, each, base, nxt in zip(layout.length, layout.start, layout.each, layout.base, [*zip(layout.length[1:], layout.start[1:]), (None, None)]):
        stop = nxt[1] if nxt[0] == length else hist[length]
        assert start == used[length]
        for rank in range(start, stop):
            load[base + (rank - start) // each] += length
        used[length] = stop
    assert (used[1:] == hist[1:]).all() and (load <= capacity).all() and (load > 0).all()
    return load


@pytest.mark.parametrize("capacity,n,seed", [(7, 40, 1), (64, 900, 2), (512, 3000, 3), (100, 0, 4), (33, 1, 5), (1000, 500, 6)])
def test_layout_holds_every_item_once(capacity, n, seed):
    rnd = random.Random(seed)
    hist = np.zeros(capacity + 1, int)
    for _ in range(n):
        hist[min(capacity, max(1, int(rnd.expovariate(3 / capacity))))] += 1
    load = check(packing.layout(hist, capacity), hist, capacity)
    if n > 500:
        assert load.sum() / (len(load) * capacity) > 0.97


def test_packing_places_whole_texts(make):
    rnd = random.Random(7)
    docs = [(i, rnd.choice(["forum", "FORUM ", "web", None]), "word " * rnd.randrange(0, 60)) for i in range(300)] + [(300, "web", None), (301, "forum", "deep sea " * 3000), (301, "forum", "twice")]
    df = make(docs, DOCS, extra="length")
    plans = make([(1, 64, None), (2, 100, "forum"), (3, None, None), (4, 10, "absent")], "plan_id int, capacity_tokens int, src_filter string")
    rows = packing.packed_documents(df, plans).collect()
    load, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.plan_id, r.seq_id] += r.n_tokens
        parts[r.plan_id, r.doc_id].append((r.part_no, r.start_token, r.n_tokens))
        assert (r.seq_id is None) == (r.n_tokens == 0)
    size = {1: 64, 2: 100}
    assert all(v <= size[p] for (p, s), v in load.items())
    count = {i: len(encoder(TOKENIZER).encode_ordinary(t or "")) for i, _, t in docs[:300]}
    for i, n in count.items():
        assert sum(p[2] for p in parts[1, i]) == n and len(parts[1, i]) == max(1, -(-n // 64))
    assert len({d for p, d in parts if p == 1}) == 302 and {p for p, _ in parts} == {1, 2}
    report = {r.plan_id: r for r in packing.packing_report(df, plans).collect()}
    assert report[1].sequences == len({s for p, s in load if p == 1 and s is not None}) and report[1].fill > 0.95 and report[4].sequences == 0


def test_ranks_over_blocks(make, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCS", 20)
    docs = make([(i, "a", "same text") for i in range(100)], DOCS)
    rows = packing.packed_documents(docs, make([(1, 6, None)], "plan_id int, capacity_tokens int, src_filter string")).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.seq_id] += r.n_tokens
    assert len(rows) == 100 and set(load.values()) <= {6, 4, 2} and sum(load.values()) == 200 and len(load) == 34


def test_cut_poisson():
    assert mixing.cut_poisson(float("inf"), 3) == [0.0] * 3
    for rate, most in ((0.3, 1), (1.7, 2), (2.5, 8), (0.01, 4)):
        mean = mixing.mean_for(rate, most)
        assert abs(sum(1 - p for p in mixing.cut_poisson(mean, most)) - rate) < 1e-6


def test_shares_are_reached(make):
    rnd = random.Random(9)
    docs = [(i, s, "token " * rnd.randrange(1, 80)) for i, s in enumerate(["a"] * 900 + ["b"] * 200 + ["C "] * 60 + [None] * 20)]
    targets = make([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "c", 0.2, 4), (2, "a", 0.6, 1), (2, "absent", 0.4, 3), (3, "b", None, 2)], "mix_id int, source string, target_share double, max_repeats int")
    df = make(docs, DOCS, extra="copies")
    report = {(r.mix_id, r.source): r for r in mixing.mixture_report(df, targets).collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[1, s].reached_share - w) < 0.01 and report[1, s].most_copies <= report[1, s].max_repeats
    assert report[2, "a"].reached_share == 1 and report[2, "absent"].reached_share == 0 and report[3, "b"].copies == 0
    rows = mixing.mixed_documents(df, targets).collect()
    assert len(rows) == sum(r.copies for r in report.values()) == len({(r.mix_id, r.doc_id, r.copy_no) for r in rows})
    keys = [r.order_key for r in rows]
    assert keys == sorted(keys)


def test_empty(make):
    plans = make([], "plan_id int, capacity_tokens int, src_filter string")
    targets = make([], "mix_id int, source string, target_share double, max_repeats int")
    docs, none = make([(1, "a", "x")], DOCS), make([], DOCS)
    assert packing.packed_documents(docs, plans).count() == 0 == packing.packing_report(docs, plans).count()
    assert mixing.mixed_documents(docs, targets).count() == 0 == mixing.mixture_report(docs, targets).count()
    assert packing.packed_documents(none, make([(1, 8, None)], plans.drop("h1").schema)).count() == 0
    assert mixing.mixed_documents(none, make([(1, "a", 1.0, 1)], targets.drop("h1").schema)).count() == 0


def test_large_repeats_and_drawn_sizes_against_a_plain_sum(make):
    import numpy as np

    from lexmill.llm import mixing

    for rate, most in ((900.0, 2000), (0.3, 1), (2.5, 3), (1499.0, 1500)):
        mean = mixing.mean_for(rate, most)
        assert abs(mixing._cut_mean(mean, most) - rate) < 1e-3 * rate
    rows = make([(m, s, i, 1 + i % 5, (i * 37 % 100) / 100) for i in range(200) for m, s in ((1, "a"), (1, "b"), (2, "a"))], "mix_id int, source string, doc_id bigint, n_tokens bigint, u double")
    tries = {(1, "a"): [[0.2, 0.5], [0.0, 0.99]], (2, "a"): [[0.37, 0.37], [1.0, 1.0]]}
    got = mixing._drawn(rows, tries)
    for k, cuts in tries.items():
        assert got[k].tolist() == [sum(1 + i % 5 for i in range(200) for c in cut if (i * 37 % 100) / 100 >= c) for cut in cuts]
    assert isinstance(got[(1, "a")], np.ndarray)
