import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from lexmill.cluster import shared_dir
from lexmill.llm import overlap

SCHEMA = "shard_id bigint, shard_name string, source string, loaded_at timestamp, sample_previews array<string>"


def brute(shards):
    items, seen = [], set()
    for i, name, _, _, texts in shards:
        if i in seen or name is None:
            continue
        seen.add(i)
        for k, t in enumerate(texts or []):
            w = re.findall(r"[^\W_]+", (t or "").lower())
            if len(w) >= 8:
                items.append((i * 1000 + k, "train" in name, set(zip(w, w[1:], w[2:]))))
    return {(min(a, b), max(a, b)) for a, at, x in items for b, bt, y in items if at and not bt and 2 * len(x & y) >= len(x | y)}


def shards(rnd, n=24):
    words = "red blue green old new big small cat dog fox hen owl runs sleeps eats near far over under tree".split()
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(4, 30))) for _ in range(12)]
    out = []
    for i in range(n):
        split = rnd.choice(["train", "train", "val", "test"])
        texts = []
        for _ in range(8):
            w = rnd.choice(base).split()
            for _ in range(rnd.choice([0, 0, 1, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(rnd.choice([" ".join(w), " ".join(w).upper() + "!", "please sign in to read this page now " + " ".join(w), None, ""]))
        out.append((i, f"mix_{split}_{i:08d}.bin", " Forum", None, texts))
    return out + out[:5] + [(99, None, None, None, ["a b c d e f g h i"]), (98, "mix_val_1.bin", None, None, None)]


def test_pairs_against_brute_force(make):
    for seed in (1, 2):
        rows = shards(random.Random(seed))
        got = [tuple(r) for r in overlap.overlapping_pairs(make(rows, SCHEMA, extra="n_g")).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_salted_probes_give_the_same(make, monkeypatch):
    monkeypatch.setattr(overlap, "SALT_ROWS", 2)
    rows = shards(random.Random(3))
    assert {tuple(r) for r in overlap.overlapping_pairs(make(rows, SCHEMA)).collect()} == brute(rows)


def test_a_hot_evaluation_shingle_and_a_hot_class(make, monkeypatch):
    """One opening in all evaluation previews and in a third of the training ones, and one text copied often on both sides."""
    monkeypatch.setattr(overlap, "SALT_ROWS", 3)
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 4)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    copied = " ".join(word() for _ in range(12))
    rows = []
    for i in range(30):
        split = "train" if i < 18 else "val"
        texts = [("sign in to read on " if split == "val" or rnd.random() < 0.33 else "") + " ".join(word() for _ in range(rnd.choice([4, 9]))) for _ in range(4)]
        rows.append((i, f"m_{split}_{i}.bin", "web", None, [*texts, copied if i % 2 else copied.upper()]))
    got = [tuple(r) for r in overlap.overlapping_pairs(make(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) >= 18 * 12


def test_report_and_empty(make):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, "m_train_1.bin", "Web", None, [text]), (2, "m_val_2.bin", "web ", None, [text, "other words that do not stand in train at all today"]), (3, "m_test_3.bin", None, None, [text.upper()])]
    got = {(r.split, r.source): (r.previews, r.found, r.identical) for r in overlap.overlap_report(make(rows, SCHEMA)).collect()}
    assert got == {("val", "web"): (2, 1, 1), ("test", "unknown"): (1, 1, 1)}
    assert overlap.overlapping_pairs(make([], SCHEMA)).count() == 0


def test_rounds_and_slices_give_the_same(make, monkeypatch):
    for name, value in (("FEW_WORDS", 1), ("SAMPLED", 1), ("ROUND_SHARE", 0.05), ("SALT_ROWS", 2), ("BATCH_ENTRIES", 7), ("CELL_BITS", 6), ("BLOCK_BITS", 4), ("FILTER_BITS", 15)):
        monkeypatch.setattr(overlap, name, value)
    made, maker = [], overlap._entry_maker
    monkeypatch.setattr(overlap, "_entry_maker", lambda *a: made.append(a[-2:]) or maker(*a))
    rows = shards(random.Random(4))
    assert {tuple(r) for r in overlap.overlapping_pairs(make(rows, SCHEMA)).collect()} == brute(rows)
    assert len(set(made)) > 3 and max(nth for _, nth in made) > 1


def test_disk_follows_the_input(spark, tmp_path):
    """Kept tables and shuffle files that stay, against the table as it is stored."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(600)]
    text = lambda: " ".join(rnd.choice(vocabulary) for _ in range(36))
    rows = [(i, f"m_{'val' if i % 5 == 0 else 'train'}_{i}.bin", "web", None, [text() for _ in range(50)]) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "shards"))
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    kept = Path(shared_dir(spark).removeprefix("file:"))
    shards_read = spark.read.parquet(str(tmp_path / "shards"))
    at = shuffled() + size(kept)
    members, links = overlap.cross_split(shards_read)
    assert links.count() == 0 and members.count() == 10_000
    assert shuffled() + size(kept) - at < 3 * size(tmp_path / "shards")


def test_copies_make_no_entries(spark, make):
    """Of a text that stands often on both sides, one member of each side meets the other."""
    text = "one two three four five six seven eight nine ten"
    rows = [(i, f"m_{'val' if i % 3 == 0 else 'train'}_{i}.bin", "web", None, [text, f"{text} item {i} of its own kind and place"]) for i in range(60)]
    words = overlap.word_codes(overlap.previews(make(rows, SCHEMA)), 3, 8)
    classes = overlap._coded(words, 3).groupBy("c1", "c2", "is_train").agg(F.min("key").alias("set_id"), F.count("*").alias("n_members"))
    known = spark.sparkContext.broadcast(overlap._repeated(classes))
    counts = overlap._cell_counts(words, 3, 16, known)
    make_entries = overlap._entry_maker(3, 16, 0.5, spark.sparkContext.broadcast(counts), known, 2_000, 1, 0)
    entries = words.select("key", "is_train", "w").mapInArrow(make_entries, overlap._ENTRIES).groupBy("c1").count()
    assert max(r["count"] for r in entries.collect()) <= 16  # the shingles of one set, on two sides
    assert {tuple(r) for r in overlap.overlapping_pairs(make(rows, SCHEMA)).collect()} == brute(rows)
