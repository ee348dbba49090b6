import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import cluster
from lexmill.operators import building, curation, evaluation, mining, segmentation, shards, tokens, vocabulary
from lexmill.sources import readers, token_shards

BYTES = [(i, f"<0x{i:02X}>") for i in range(256)]


def naive(pieces, text, mode):
    """The recurrences written plainly: one state per place, tuples compared in order."""
    ids = {}
    for t, p in pieces:
        if not p.startswith("<0x"):
            ids.setdefault(p, t)
    best = [None] * (len(text) + 1)
    best[len(text)] = ((0, 0, 0, 0, 0), "end", ())
    for i in reversed(range(len(text))):
        options = []
        for p, t in ids.items():
            if text.startswith(p, i):
                s, _, rest = best[i + len(p)]
                options.append(((1 + s[0], *((s[1], s[2], s[3]) if mode == "boundary" else (0, 0, 0)), -len(p)), 0, "piece", (t, *rest)))
        s, kind, rest = best[i + 1]
        n = len(text[i].encode())
        if mode != "pieces_first" or not options:
            extra = (s[1] + n, s[2] + (kind != "bytes"), s[3] + segmentation.penalty(text[i])) if mode == "boundary" else (0, 0, 0)
            options.append(((n + s[0], *extra, -1), 1, "bytes", (*text[i].encode(), *rest)))
        choice = min(options, key=lambda o: (o[0][:4], o[1], o[0][4]) if mode != "boundary" else (o[0], o[1]))
        best[i] = (choice[0], choice[2], choice[3])
    return best[0][0][:4], list(best[0][2])


def random_case(rnd):
    letters = " ab.cdäß🔥\n"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 12))}
    pieces = BYTES + [(256 + i, p) for i, p in enumerate(sorted(words))]
    return pieces, "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30)))


def test_segmentations_equal_the_plain_recurrence():
    rnd = random.Random(5)
    for _ in range(400):
        pieces, text = random_case(rnd)
        for mode in ("boundary", "min_tokens", "pieces_first"):
            s = segmentation.Segmenter(pieces, mode)
            score, ids = naive(pieces, text, mode)
            got = s.encode(text)
            assert s.decode(got) == text and len(got) == score[0]
            if mode == "boundary":
                assert got == ids and s.packed(text) == score
        greedy = segmentation.Segmenter(pieces, "greedy").encode(text)
        assert segmentation.Segmenter(pieces).decode(greedy) == text
        assert len(greedy) >= len(segmentation.Segmenter(pieces, "min_tokens").encode(text)) == len(segmentation.Segmenter(pieces, "boundary").encode(text))


def test_one_state_per_place_is_kept():
    pieces = BYTES + [(256 + i, p) for i, p in enumerate([" c", ".a", "ab", "b ", "c "])]
    assert segmentation.Segmenter(pieces).packed(".c c") == (3, 2, 2, 2)


def test_greedy_in_the_jvm_equals_greedy_in_python(spark):
    rnd = random.Random(6)
    for _ in range(6):
        pieces, _ = random_case(rnd)
        texts = ["".join(rnd.choice(" ab.cdäß🔥\n") for _ in range(40)) for _ in range(40)] + ["", None, "<0x41>"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        vocab = spark.createDataFrame(pieces, "id int, piece string")
        s = segmentation.Segmenter(pieces, "greedy")
        got = {r.doc_id: (r.n_tokens, r.fallback_tokens, r.fallback_runs) for r in tokens.greedy_counts(docs, vocab).collect()}
        rows = {}
        for r in tokens.token_rows(docs, vocab).orderBy("doc_id", "at", "byte_no").collect():
            rows.setdefault(r.doc_id, []).append(r.id)
        for i, t in enumerate(texts):
            ids = s.encode(t)
            # a run of lost characters is one run in the JVM too
            assert rows.get(i, []) == ids and got[i] == s.counts(ids)


def test_compared_summary_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab = spark.read.parquet("/root/testdata/sf0.001/vocab.parquet")
    out = evaluation.summary(segmentation.compared(docs, vocab)).first()
    pieces = vocabulary.collected(vocab)
    a, b = segmentation.Segmenter(pieces, "greedy"), segmentation.Segmenter(pieces)
    texts = [r.text or "" for r in docs.collect()]
    assert (out.docs, out.n_bytes, out.base_tokens, out.custom_tokens) == (len(texts), sum(len(t.encode()) for t in texts), sum(len(a.encode(t)) for t in texts), sum(len(b.encode(t)) for t in texts))
    assert [r.n_tokens for r in segmentation.encoded(docs, vocab).orderBy("doc_id").limit(5).collect()] == [len(b.encode(r.text)) for r in docs.orderBy("doc_id").limit(5).collect()]


def test_vocabulary_checks(spark):
    good = spark.createDataFrame(BYTES + [(256, "a")], "id int, piece string")
    assert vocabulary.validated(good).count() == 257
    for bad in (BYTES[:-1] + [(255, "a")], BYTES + [(300, "a")], BYTES + [(0, "a")]):
        with pytest.raises(Exception, match="vocabulary"):
            vocabulary.validated(spark.createDataFrame(bad, "id int, piece string")).collect()
    with pytest.raises(ValueError):
        segmentation.Segmenter(BYTES[1:])


def test_greedy_merges_equal_a_sequential_pass(spark):
    rnd = random.Random(7)
    stream = [(s, d, k, 0, rnd.randrange(3)) for s in "xy" for d in range(3) for k in range(60)]
    cand = [[0, 1, 0], [1, 1, 1], [0, 0, 1]]
    arrays = spark.createDataFrame([(s, d, [r[4] for r in stream if r[:2] == (s, d)]) for s in "xy" for d in range(3)] + [("x", 9, []), ("z", 1, [])], "shard_name string, doc_id bigint, ids array<int>")
    df = mining.linked(arrays, "shard_name")
    candidates = spark.createDataFrame([(c, 5) for c in cand] + [(None, 1), ([1, 2], 3)], "ids array<int>, freq bigint")
    got = {r.scope: (r.tokens, r.merges) for r in mining.greedy_merges(df, candidates).collect()}
    for s in "xy":
        ids, i, n = [r[4] for r in stream if r[0] == s], 0, 0
        while i < len(ids):
            if ids[i : i + 3] in cand:
                n, i = n + 1, i + 3
            else:
                i += 1
        assert got[s] == (len(ids), n)


def test_grams_run_over_documents_not_over_streams(spark):
    arrays = spark.createDataFrame([("x", 1, [1, 2]), ("x", 2, [3]), ("x", 3, []), ("x", 4, [1, 2, 3]), ("y", 5, [1, 2]), (None, 6, [7])], "shard_name string, doc_id bigint, ids array<int>")
    stream = mining.linked(arrays, "shard_name")
    two = {r.gram: (r.freq, r.shard_count, r.before_contexts, r.after_contexts) for r in mining.gram_counts(stream, 2).collect()}
    assert two == {"1 2": (3, 2, 1, 1), "2 3": (2, 1, 1, 1), "3 1": (1, 1, 1, 1)}
    three = {r.gram: r.freq for r in mining.gram_counts(stream, 3, 2).collect()}
    assert three == {"1 2 3": 2}
    alone = {r.gram: r.freq for r in mining.gram_counts(mining.linked(arrays), 2).collect()}
    assert alone == {"1 2": 3, "2 3": 1}


def test_first_wins_equals_a_sequential_pass(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.randrange(4), rnd.randrange(3)], rnd.choice(["a", "b", "c", "d", "e", "", None])) for i in range(60)]
    ids, norms, kept = set(), set(), []
    for i, k, t in rows:
        if tuple(k) in ids or (t and t in norms):
            continue
        ids.add(tuple(k))
        norms |= {t} if t else set()
        kept.append(i)
    got = curation.first_wins(spark.createDataFrame(rows, "ord bigint, ids array<int>, norm string"))
    assert sorted(r.ord for r in got.collect()) == kept


def test_subword_scores(spark):
    df = spark.createDataFrame([("different",), ("somet",), ("ab",), ("x1",), ("",)], "t string")
    score, reasons = curation.subword_score(F.col("t"))
    got = {r.t: (r.s, r.a, r.r) for r in df.select("t", score.alias("s"), curation.action(score).alias("a"), reasons.alias("r")).collect()}
    assert got["different"][:2] == (15, "keep") and got["somet"][:2] == (-999, "drop")
    assert got["ab"][2] == ["too_short"] and got["x1"][2] == ["non_alpha"] and got[""][2] == ["empty"]


def test_normalization_and_phrases(spark):
    df = spark.createDataFrame([(1, "ﬁne  day… it’s"), (2, None), (3, "")], "doc_id bigint, text string")
    assert df.select(curation.normalized(F.col("text"))).first()[0] == "fine day... it's"
    docs = spark.createDataFrame([(1, "One of  the best, one OF the rest; oneof the."), (2, None)], "doc_id bigint, text string")
    phrases = spark.createDataFrame([("one of the", "PHRASE_ONE_OF_THE", 3, "k"), ("of the", "PHRASE_OF_THE", 2, "k")], "text string, placeholder string, freq bigint, class string")
    assert {tuple(r) for r in curation.phrase_usage(docs, phrases).collect()} == {("PHRASE_ONE_OF_THE", 2, 1)}
    done = curation.substituted(docs, [("one of the", "PHRASE_ONE_OF_THE")]).collect()
    assert done[0].text == "PHRASE_ONE_OF_THE best, PHRASE_ONE_OF_THE rest; oneof the." and done[1].text == ""
    assert curation.phrase_usage(docs, phrases.limit(0)).count() == 0


def test_swap_needs_equal_numbers(spark):
    vocab = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id int, piece string")
    add = spark.createDataFrame([("n1", 1), ("n2", 2)], "piece string, place int")
    got = {r.id: r.piece for r in building.swapped(vocab, vocab.where("id in (4, 1)"), add).collect()}
    assert got == {0: "p0", 1: "n1", 2: "p2", 3: "p3", 4: "n2", 5: "p5"}
    with pytest.raises(Exception, match="as many"):
        building.swapped(vocab, vocab.where("id = 1"), add).collect()


def test_running_total_and_export_layout(spark):
    rnd = random.Random(9)
    counts = [(i, 1000 + i, rnd.randrange(0, 30)) for i in range(200)]
    df = spark.createDataFrame(counts, "ord bigint, doc_id bigint, n_tokens bigint").repartition(7)
    got = {r.ord: r.t for r in cluster.running_total(df, ["ord"], "n_tokens", "t").collect()}
    assert [got[i] for i in range(200)] == [0, *itertools.accumulate(c[2] for c in counts)][:200]
    rows = {r.ord: r for r in shards.export_layout(df, 20, 50, 10).collect()}
    val = sum(c[2] for c in counts[:20])
    written = sum(r.written for r in rows.values() if r.split == "train")
    assert rows[19].split == "val" and rows[20].offset == 0
    assert written == min(sum(c[2] for c in counts[20:]), 50 * (10 - -(-val // 50)))
    for r in rows.values():
        if r.written:
            assert r.first_shard == r.offset // 50 and r.last_shard == (r.offset + r.written - 1) // 50


def test_z_scores_and_percentile(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    rows = shards.z_scores(df, ["a", "b"]).orderBy("a").collect()
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose([r.z_a for r in rows], (x - x.mean()) / x.std()) and {r.z_b for r in rows} == {0.0}
    assert df.select(F.percentile("a", F.lit(0.95))).first()[0] == pytest.approx(3.8)


def test_token_shards_round_trip(spark, tmp_path):
    rows = [(f"train_{s}", k, (k * 7 + s) % 65_536) for s in range(3) for k in range(1000 * s + 5)]
    token_shards.register(spark)
    folder = str(tmp_path / "shards")
    token_shards.write(spark.createDataFrame(rows, "shard string, pos bigint, token_id int").repartition(5), folder)
    back = token_shards.read(spark, folder).orderBy("shard", "pos").collect()
    assert [(r.shard, r.pos, r.token_id) for r in back] == sorted(rows)
    with open(os.path.join(folder, "train_0.bin"), "rb") as f:
        raw = f.read()
    assert np.frombuffer(raw[:12], "<i4").tolist() == [20240520, 1, 5] and len(raw) == 1024 + 10
    with open(os.path.join(folder, "bad.bin"), "wb") as f:
        f.write(b"\x01\x00\x02\x00")
    with pytest.raises(Exception, match="no token shard"):
        token_shards.read(spark, folder).count()
    assert token_shards.read(spark, folder, strict=False).where("shard = 'bad'").count() == 2
    with pytest.raises(ValueError):
        token_shards.write_file(os.path.join(folder, "x.bin"), np.array([70_000]))


def test_readers(spark, tmp_path):
    p = tmp_path / "docs.jsonl"
    p.write_text('{"text": "one"}\n"bare"\n\n{"content": "two", "text": ""}\n{"text": "  "}\n{"other": 1}\n')
    assert sorted(r.text for r in readers.documents_jsonl(spark, str(p)).collect()) == ["bare", "one", "two"]
    v = tmp_path / "vocab.jsonl"
    v.write_text('{"id": 0, "piece": " a", "kind": "word", "note": {"replaced": "b", "doc_hits": 3}}\n')
    row = readers.vocab_jsonl(spark, str(v)).first()
    assert (row.id, row.piece, row.note.doc_hits, row.freq) == (0, " a", 3, None)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    assert readers.documents_by_id(docs, docs.limit(1)).count() == 1
    with pytest.raises(Exception, match="no document 7"):
        readers.documents_by_id(docs, spark.createDataFrame([(7,)], "doc_id bigint")).collect()
    readers.write_csv(docs, str(tmp_path / "c"), ["text", "doc_id"])
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "c"), "text string, doc_id bigint").collect())) == [("a", 1), ("b", 2)]
    readers.write_order(docs, str(tmp_path / "o"), "text", F.desc("doc_id"))
    assert [r.line for r in readers.lines(spark, str(tmp_path / "o")).collect()] == ["b", "a"]
    r = tmp_path / "r.json"
    r.write_text('{"summary": {"token_ratio": 1.5}}')
    assert readers.score_reports(spark, str(r)).first().token_ratio == 1.5
    t = tmp_path / "p.tsv"
    t.write_text("▁the\t-1.5\n<s>\t0\n")
    assert [(x.piece, x.is_special_or_byte) for x in readers.piece_scores_tsv(spark, str(t)).collect()] == [(" the", False), ("<s>", True)]
    assert [x.ord for x in readers.numbered(docs, "doc_id").orderBy("doc_id").collect()] == [0, 1]


def test_hot_lookup_keeps_all_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = cluster.hot_lookup(rows, lookup, ["k"], "n")
    assert out.count() == 5000 and out.where("k = 0 and n <> 1667").count() == 0
    assert cluster.hot_lookup(rows.limit(0), lookup.limit(0), ["k"], "n").count() == 0


def test_kept_tables_can_be_cleaned(spark):
    import os

    folder = f"{cluster.shared_dir(spark).removeprefix('file://')}/{spark.sparkContext.applicationId}"
    assert cluster.keep(spark.range(3), "few").count() == 3 and os.path.isdir(folder)
    cluster.clean(spark)
    assert not os.path.exists(folder)


def test_salted_rows_join_like_plain_ones(spark):
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(200)] + [(None, 999)], "k string, i int")
    marked, spread = cluster.salted(rows, ["k"], ["i"], 10)
    assert marked.where("k = 'hot'").select("__salt").distinct().count() > 1
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "k string, v int")
    got = sorted((r.k, r.i, r.v) for r in marked.join(spread(lookup), ["k", "__salt"]).collect())
    assert got == sorted((r.k, r.i, r.v) for r in rows.join(lookup, "k").collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string, shard_name string")
    vocab = spark.createDataFrame(BYTES, "id int, piece string")
    assert tokens.token_rows(docs, vocab).count() == 0 and tokens.greedy_counts(docs, vocab).count() == 0
    assert segmentation.encoded(docs, vocab).count() == 0
    assert evaluation.summary(segmentation.compared(docs, vocab)).first().docs == 0
    assert evaluation.score_card(segmentation.compared(docs, vocab)).first().docs == 0
