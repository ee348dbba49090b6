"""Vocabulary construction and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.operators import building as bd
from lexmill.operators import tokens as tk
from lexmill.plans.common import TOKENS, docs_of

_BYTE = "regexp_matches(piece, '^<0x[0-9A-Fa-f]{2}>$')"
_ADD = "(SELECT piece, row_number() OVER (ORDER BY freq DESC, piece) AS place FROM (SELECT text AS piece, max(freq) AS freq FROM filtered_trigram_candidates_v2 WHERE text IS NOT NULL AND freq IS NOT NULL AND text NOT IN (SELECT piece FROM vocab) GROUP BY text))"


def additions(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pieces that the vocabulary lacks, with their place by frequency."""
    best = table(spark, d, "filtered_trigram_candidates_v2").where("text is not null and freq is not null").groupBy(F.col("text").alias("piece")).agg(F.max("freq").alias("freq"))
    new = best.join(table(spark, d, "vocab").select("piece"), "piece", "left_anti")
    return bd._numbered(new, F.desc("freq"), "piece").select("piece", F.col("nth").alias("place"))


def _build(budgets: tuple[int, int, int]) -> str:
    stages = [
        ("baseline", f"SELECT piece, priority FROM vocab WHERE NOT {_BYTE}"),
        ("phrase", "SELECT text AS piece, freq AS priority FROM filtered_trigram_candidates_v2 WHERE class LIKE '%phrase%'"),
        ("word", "SELECT text AS piece, freq AS priority FROM filtered_trigram_candidates_v2 WHERE class LIKE '%word%' OR class LIKE '%subword%'"),
    ]
    parts = " UNION ALL ".join(f"SELECT piece, max(priority)::DOUBLE AS priority, '{kind}' AS kind, {k} AS stage, {budgets[k]} AS budget FROM ({sql}) WHERE piece IS NOT NULL AND piece <> '' GROUP BY piece" for k, (kind, sql) in enumerate(stages))
    return f"""WITH e AS ({parts}), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY piece ORDER BY stage) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY priority DESC NULLS LAST, length(piece), piece) AS n FROM f QUALIFY n <= budget),
l AS (SELECT row_number() OVER (ORDER BY stage, n) AS slot, piece, kind, priority FROM c QUALIFY slot <= 768),
r AS (SELECT i AS slot, '<RESERVED_' || i || '>' AS piece, 'reserved' AS kind, NULL::DOUBLE AS priority FROM range(1, 769) t(i) WHERE i NOT IN (SELECT slot FROM l)),
v AS (SELECT * FROM l UNION ALL SELECT * FROM r UNION ALL SELECT 769 + i, printf('<0x%02X>', i), 'byte', NULL FROM range(256) t(i)) SELECT (slot - 1)::INT AS id, piece, kind, priority FROM v"""


def built(spark: SparkSession, d: str, budgets: tuple[int, int, int]) -> DataFrame:
    vocab, cand = table(spark, d, "vocab"), table(spark, d, "filtered_trigram_candidates_v2")
    scored = cand.select(F.col("text").alias("piece"), F.col("freq").alias("priority"), "class")
    return bd.staged([
        (vocab.where(~F.col("piece").rlike("^<0x[0-9A-Fa-f]{2}>$")), "baseline", budgets[0]),
        (scored.where("class like '%phrase%'"), "phrase", budgets[1]),
        (scored.where("class like '%word%' or class like '%subword%'"), "word", budgets[2]),
    ])


@query("vocab_build", _build((500, 60, 120)))
def vocab_build(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d, (500, 60, 120))


@query("vocab_build_kinds", f"SELECT kind, count(*) AS pieces, round(coalesce(sum(priority), 0), 3) AS priority FROM ({_build((620, 80, 60))}) GROUP BY kind")
def vocab_build_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = built(spark, d, (620, 80, 60))
    return rows.groupBy("kind").agg(F.count("*").alias("pieces"), F.round(F.coalesce(F.sum("priority"), F.lit(0.0)), 3).alias("priority"))


_OPTIONS = {"baseline": [600, 640, 680], "phrases": [20, 40, 60], "words": [40, 60, 80], "sort": ["freq", "value", "length"]}


def _values(name: str, values: list) -> str:
    return "(VALUES " + ", ".join(f"({v!r})" for v in values) + f") AS {name}_t({name})"


@query("grid_configs", "SELECT *, (baseline + phrases + words) AS used FROM " + ", ".join(_values(k, v) for k, v in _OPTIONS.items()) + " WHERE baseline + phrases + words <= 768")
def grid_configs(spark: SparkSession, d: str) -> DataFrame:
    rows = bd.configurations(spark, _OPTIONS)
    return rows.withColumn("used", F.col("baseline") + F.col("phrases") + F.col("words")).where("used <= 768")


_DELTAS = [(a, b, c) for a in (-20, -10, 0, 10, 20) for b in (-8, 0, 8) for c in (-8, 0, 8)]
_BOUNDS = {"baseline": (600, 760), "phrases": (8, 80), "words": (8, 80)}
_SEEDS = [(1, 640, 40, 60), (2, 680, 20, 60), (3, 600, 60, 80), (4, 650, 40, 60)]


@query(
    "local_search_configs",
    f"""WITH s(seed_rank, baseline, phrases, words) AS (VALUES {", ".join(map(str, _SEEDS))}), g(gen, d1, d2, d3) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(_DELTAS))})
SELECT seed_rank, gen, baseline + d1 AS baseline, phrases + d2 AS phrases, words + d3 AS words FROM s, g WHERE baseline + d1 BETWEEN 600 AND 760 AND phrases + d2 BETWEEN 8 AND 80 AND words + d3 BETWEEN 8 AND 80 AND baseline + d1 + phrases + d2 + words + d3 <= 768
QUALIFY row_number() OVER (PARTITION BY baseline + d1, phrases + d2, words + d3 ORDER BY seed_rank, gen) = 1""",
)
def local_search_configs(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame(_SEEDS, "seed_rank int, baseline int, phrases int, words int")
    deltas = spark.createDataFrame([(i, *x) for i, x in enumerate(_DELTAS)], "gen int, d_baseline int, d_phrases int, d_words int")
    return bd.neighbours(seeds, deltas, _BOUNDS, 768)


_USAGE = f"WITH {TOKENS}, us AS (SELECT id, piece, use_count, doc_count, 5 * use_count + 50 * doc_count + 10 * greatest(0, length(piece) - 1) + 5 * greatest(0, octet_length(encode(piece)) - 1) AS removal_score FROM (SELECT v.id, v.piece, count(t.doc_id) AS use_count, count(DISTINCT t.doc_id) AS doc_count FROM vocab v LEFT JOIN tok t ON v.id = t.id GROUP BY v.id, v.piece) WHERE id >= 64 AND NOT {_BYTE})"
_FAMILIES = f"""{_USAGE}, fam AS (SELECT 'low_usage' AS family, row_number() OVER (ORDER BY use_count, doc_count, id) AS place, id, piece FROM us UNION ALL SELECT 'low_coverage', row_number() OVER (ORDER BY doc_count, use_count, id), id, piece FROM us
UNION ALL SELECT 'weak_overall', row_number() OVER (ORDER BY removal_score, use_count, id), id, piece FROM us)"""


def _families(spark: SparkSession, d: str) -> DataFrame:
    vocab = table(spark, d, "vocab")
    return bd.removal_families(keep(tk.usage(keep(tk.token_arrays(docs_of(spark, d), vocab), "arrays"), vocab), "usage"))


@query("removal_families", f"{_FAMILIES} SELECT * FROM fam")
def removal_families(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d)


@query("removal_windows", f"{_FAMILIES} SELECT family, ((place - 1) // 50)::INT AS variant, place, id, piece FROM fam QUALIFY count(*) OVER (PARTITION BY family, (place - 1) // 50) = 50")
def removal_windows(spark: SparkSession, d: str) -> DataFrame:
    return bd.windows_of(_families(spark, d), 50)


@query(
    "vocab_swap",
    f"""{_FAMILIES}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS nth FROM fam WHERE family = 'low_usage' AND place <= 20), n AS (SELECT piece AS new_piece, place AS nth FROM {_ADD} WHERE place <= 20)
SELECT v.id, coalesce(new_piece, piece) AS piece, CASE WHEN new_piece IS NOT NULL THEN piece END AS replaced FROM vocab v LEFT JOIN (SELECT id, new_piece FROM o JOIN n USING (nth)) USING (id)""",
)
def vocab_swap(spark: SparkSession, d: str) -> DataFrame:
    remove = _families(spark, d).where("family = 'low_usage' and place <= 20")
    return bd.swapped(table(spark, d, "vocab"), remove, additions(spark, d).where("place <= 20"))


_SHORT = _build((500, 60, 120))


@query(
    "reserved_fill",
    f"""WITH b AS ({_SHORT}), free AS (SELECT id, row_number() OVER (ORDER BY id) AS nth FROM b WHERE piece LIKE '<RESERVED!_%' ESCAPE '!'), n AS (SELECT piece AS new_piece, row_number() OVER (ORDER BY place) AS nth FROM {_ADD} WHERE piece NOT IN (SELECT piece FROM b))
SELECT b.id, coalesce(new_piece, piece) AS piece, CASE WHEN new_piece IS NOT NULL THEN 'filled' ELSE kind END AS kind FROM b LEFT JOIN (SELECT id, new_piece FROM free JOIN n USING (nth)) USING (id)""",
)
def reserved_fill(spark: SparkSession, d: str) -> DataFrame:
    return bd.fill_reserved(keep(built(spark, d, (500, 60, 120)), "built"), additions(spark, d))
