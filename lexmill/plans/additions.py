"""What a vocabulary could gain, over all documents and candidates; the SQL states rules in literals of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.functions.lines import mined_additions
from lexmill.operators import additions as ad
from lexmill.operators import mining
from lexmill.operators.curation import parsed
from lexmill.operators.tokens import greedy_counts, token_arrays
from lexmill.plans.common import TOKENS, counts, docs_of, matches, variant
from lexmill.plans.mining import _grams, stream


@query("spaced_words", "WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS p FROM documents), w AS (SELECT doc_id, list_concat(CASE WHEN p[1] <> '' THEN [p[1]] ELSE [] END, list_transform(list_filter(p[2:], lambda x: x <> ''), lambda x: ' ' || x)) AS w FROM p) SELECT doc_id, len(w) AS parts, len(list_distinct(w)) AS distinct_parts FROM w")
def spaced_words(spark: SparkSession, d: str) -> DataFrame:
    w = ad.spaced_words(F.coalesce("text", F.lit("")))
    return docs_of(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("parts"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_parts"))


_SPANS = f"""{matches("short")}, fb AS (SELECT doc_id, ix, x, ix - row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS run FROM m WHERE id IS NULL),
sp AS (SELECT doc_id, string_agg(x, '' ORDER BY ix) AS span FROM fb GROUP BY doc_id, run),
top AS (SELECT span, count(*) AS uses, list(doc_id ORDER BY doc_id)[1:5] AS sample_doc_ids FROM sp GROUP BY span),
spans AS (SELECT row_number() OVER (ORDER BY uses DESC, span) AS place, * FROM top ORDER BY place LIMIT 200)"""


@query("fallback_spans", f"WITH {_SPANS} SELECT place::INT AS place, span, uses, array_to_string(sample_doc_ids, ' ') AS sample_doc_ids FROM spans")
def fallback_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches that the shorter vocabulary covers least, with up to five documents each."""
    rows = ad.top_fallback_spans(docs_of(spark, d), variant(spark, d, "short"))
    return rows.withColumn("sample_doc_ids", F.array_join(F.col("sample_doc_ids").cast("array<string>"), " "))


def _report(spark: SparkSession, d: str) -> DataFrame:
    docs, short = docs_of(spark, d), variant(spark, d, "short")
    full = greedy_counts(docs, variant(spark, d, "full")).select("doc_id", F.col("n_tokens").alias("full_tokens"))
    both = keep(greedy_counts(docs, short).join(full, "doc_id").select("doc_id", (F.col("n_tokens") - F.col("full_tokens")).alias("delta"), "fallback_tokens"), "report")

    def listed(column: str) -> DataFrame:
        top = both.where(F.col(column) > 0).orderBy(F.desc(column), "doc_id").limit(50)
        placed = top.select(F.row_number().over(mining.Window.orderBy(F.desc(column), "doc_id")).alias("place"), "doc_id", column)
        return placed.join(docs.select("doc_id", "text"), "doc_id")

    spans = ad.top_fallback_spans(docs, short).select("place", "span", "uses", "sample_doc_ids")
    return ad.report_candidates(keep(spans, "spans"), keep(listed("delta"), "by-delta"), keep(listed("fallback_tokens"), "by-fallback"), short)


_WSX = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PV = f"substr(trim(regexp_replace(text, '[{_WSX}]+', ' ', 'g')), 1, 240)"


def _each(part: int, source: str, place: int, pattern: str, boost: str, name: str) -> str:
    return f"SELECT {part} AS part, place, {place} AS k, unnest(regexp_extract_all(pv, '{pattern}')) AS p, '{source}_{name}' AS source, {boost} AS boost, 1 AS docs FROM d{part}"


_PARTS = " UNION ALL ".join(
    _each(part, source, k, pattern, "1" if name == "multispace" else "greatest(v, 1)", name)
    for part, source, last in ((1, "worst_doc", 4), (2, "fallback_doc", 3))
    for k, (name, pattern) in enumerate([("wordish", "[A-Za-z0-9][A-Za-z0-9''._:/-]{1,}"), ("leading_space", " [A-Za-z0-9][A-Za-z0-9''._:/-]{1,}"), ("punct", r"[^\p{L}\p{N}_\s]{2,}"), ("multispace", " {2,}")][:last])
)
_REPORT = rf"""{_SPANS}, {counts("full", "a_")}, {counts("short", "b_")}, nn AS (SELECT doc_id, b_n.n_tokens - a_n.n_tokens AS delta, b_n.fallback_tokens FROM a_n JOIN b_n USING (doc_id)),
d1 AS (SELECT row_number() OVER (ORDER BY delta DESC, doc_id) AS place, delta AS v, {_PV} AS pv FROM nn JOIN documents USING (doc_id) WHERE delta > 0 ORDER BY place LIMIT 50),
d2 AS (SELECT row_number() OVER (ORDER BY fallback_tokens DESC, doc_id) AS place, fallback_tokens AS v, {_PV} AS pv FROM nn JOIN documents USING (doc_id) WHERE fallback_tokens > 0 ORDER BY place LIMIT 50),
ac AS (SELECT 0 AS part, place, 0 AS k, span AS p, 'fallback_span' AS source, uses AS boost, len(list_distinct(sample_doc_ids)) AS docs FROM spans UNION ALL {_PARTS}),
cl AS (SELECT *, translate(p, chr(13) || chr(10) || chr(9), '   ') AS piece FROM ac),
rc AS (SELECT piece, arg_min(source, part * 1000000 + place * 10 + k) AS source, sum(boost)::BIGINT AS freq, sum(docs)::BIGINT AS doc_count, coalesce(sum(boost) FILTER (starts_with(source, 'fallback')), 0)::BIGINT AS fallback_hits FROM cl
  WHERE length(piece) BETWEEN 2 AND 24 AND regexp_matches(piece, '\S') AND NOT regexp_matches(piece, '^<0x[0-9A-Fa-f]{{2}}>$') AND piece NOT IN (SELECT piece FROM vocab WHERE kind = 'byte' OR length(piece) <= 3) GROUP BY piece),
rp AS (SELECT *, (8 * freq + 40 * doc_count + 20 * fallback_hits + 4 * greatest(length(piece) - 1, 0) + 2 * greatest(octet_length(encode(piece)) - 1, 0))::BIGINT AS score FROM rc)"""


@query("report_additions", f"WITH {_REPORT} SELECT * FROM rp")
def report_additions(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that a score report suggests: fallback spans, and words of the documents that lose or fall back most."""
    return _report(spark, d)


@query(
    "add_families",
    rf"""WITH {_REPORT}, mi AS (SELECT span AS piece, 6 * freq + 30 * doc_freq + 3 * (length(span) - 1) + 2 * (octet_length(encode(span)) - 1) AS score FROM (SELECT span, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), ' ?\p{{L}}{{3,}}')) AS span FROM documents) GROUP BY span HAVING count(*) >= 3)
  WHERE span NOT IN (SELECT piece FROM vocab WHERE kind = 'byte' OR length(piece) <= 3)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, fallback_hits DESC, doc_count DESC, freq DESC, piece) AS n FROM rp QUALIFY n <= 200), g AS (SELECT piece, row_number() OVER (ORDER BY score DESC, piece) AS place FROM mi QUALIFY place <= 200),
f AS (SELECT 'fallback' AS family, piece, row_number() OVER (ORDER BY n) AS place FROM r WHERE contains(source, 'fallback') UNION ALL SELECT 'tail', piece, row_number() OVER (ORDER BY n) FROM r WHERE contains(source, 'worst_doc') UNION ALL SELECT 'general', piece, place FROM g),
h AS (SELECT piece, part, place FROM (SELECT piece, place, CASE family WHEN 'fallback' THEN 0 WHEN 'tail' THEN 1 ELSE 2 END AS part FROM f WHERE place <= 100) QUALIFY row_number() OVER (PARTITION BY piece ORDER BY part, place) = 1)
SELECT family, place::INT AS place, piece FROM f UNION ALL SELECT 'hybrid', (row_number() OVER (ORDER BY part, place))::INT, piece FROM h""",
)
def add_families(spark: SparkSession, d: str) -> DataFrame:
    """The additions of the report and the mined ones as four ordered families."""
    mined = mined_additions(docs_of(spark, d), variant(spark, d, "short")).select(F.col("span").alias("piece"), "score")
    return ad.add_families(keep(_report(spark, d), "report-additions"), keep(mined, "mined"), 200)


@query(
    "compression_credit",
    f"WITH {counts('short', 'a_')}, {TOKENS.strip()}, z AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT tok.id, round(sum((a_n.n_tokens - z.n) / z.n), 4) AS credit FROM tok JOIN z USING (doc_id) JOIN a_n USING (doc_id) GROUP BY tok.id",
)
def compression_credit(spark: SparkSession, d: str) -> DataFrame:
    """What the full vocabulary saves against the shorter one in each document, shared out among its tokens."""
    docs = docs_of(spark, d)
    base = greedy_counts(docs, variant(spark, d, "short")).select("doc_id", F.col("n_tokens").alias("base_tokens"))
    return ad.compression_credit(token_arrays(docs, table(spark, d, "vocab")), base)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return parsed(table(spark, d, "merge_candidates_final_v1"))


_RAW = "SELECT cand_id, coalesce(try_cast(record AS JSON)->>'$.text', text) AS text, coalesce(try_cast(try_cast(record AS JSON)->>'$.n' AS INT), n) AS n, coalesce(try_cast(try_cast(record AS JSON)->>'$.freq' AS BIGINT), freq) AS freq, coalesce(try_cast(record AS JSON)->>'$.class', class) AS class, coalesce(CAST(try_cast(record AS JSON)->'$.ids' AS INT[]), ids) AS ids FROM merge_candidates_final_v1"


@query(
    "merge_savings_longest",
    f"""WITH {TOKENS}, s AS (SELECT *, coalesce(shard_name, '') AS scope FROM tok), {_grams(2)}, {_grams(3)}, cc AS (SELECT DISTINCT array_to_string(ids, ' ') AS gram FROM ({_RAW}) WHERE len(ids) IN (2, 3)),
pos AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY doc_id, ix, byte_no) AS pos FROM s),
mk AS (SELECT scope, pos, max(sz) AS sz FROM (SELECT p.scope, p.pos, 3 AS sz FROM pos p JOIN g3 USING (scope, doc_id, ix, byte_no) JOIN cc USING (gram) UNION ALL SELECT p.scope, p.pos, 2 FROM pos p JOIN g2 USING (scope, doc_id, ix, byte_no) JOIN cc USING (gram)) GROUP BY ALL),
st AS (SELECT scope, list((pos * 10 + sz)::HUGEINT ORDER BY pos) AS starts FROM mk GROUP BY scope),
mg AS (SELECT scope, list_reduce(starts, lambda a, p: CASE WHEN p // 10 >= a % 1000000000000 THEN (a // 1000000000000) * 1000000000000 + 1000000000000000000000000 + 1000000000000 * (p % 10 - 1) + p // 10 + p % 10 ELSE a END, 0::HUGEINT) AS v FROM st)
SELECT scope, tokens, coalesce(v // 1000000000000000000000000, 0)::BIGINT AS merges, coalesce(v // 1000000000000 % 1000000000000, 0)::BIGINT AS saved FROM (SELECT scope, count(*) AS tokens FROM s GROUP BY scope) LEFT JOIN mg USING (scope)""",
)
def merge_savings_longest(spark: SparkSession, d: str) -> DataFrame:
    """One pass over each stream that takes a candidate of three tokens where it can, else one of two."""
    return mining.greedy_longest_merges(stream(spark, d), _candidates(spark, d))


_BAD = "('ed to','ing to','ing the','ed in','ed by','ed the','es and','es of','ing in','the st','ation of','ed with','es to','ing for','the re','ion of','to re','es in','ed and','er to','ed for','the pro','ed on','s of the','ed by the','ed in the','umber of','ording to','a litt','lot of')"
_PIN = "('There are','such as','as well as','able to','public','quality','the same','the world','a lot','a few','going to','I’m','social','success','personal','organiz','govern','profess')"
_PRIZED = "('of the','in the','to the','on the','for the','from the','as a','one of','such as','as well as','There are','a lot','a few','the same','able to','going to')"


@query(
    "ranked_candidates",
    rf"""WITH c AS (SELECT text AS piece, coalesce(freq, 0)::DOUBLE AS f, 0::DOUBLE AS s, class FROM ({_RAW}) WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[A-Za-z]?$') AND text NOT IN {_BAD} AND NOT regexp_matches(text, '^(ed|ing|es|er|ion|ation|s) |( ed| ing| es| er| ion| tion| s)$|umber |ording |ation |ition |the pro|the re|the st')),
p AS (SELECT 'phrase' AS family, piece, f, s, f * 1000 + s + CASE WHEN piece IN {_PRIZED} THEN 250000 ELSE 0 END + CASE WHEN piece IN {_PIN} THEN 500000 ELSE 0 END + CASE WHEN lower(piece) = piece THEN 1000 ELSE 0 END AS v FROM c WHERE class IN ('phrase', 'keep_short_phrase', 'keep_allowlist') AND regexp_matches(piece, '^[A-Za-z]+(?: [A-Za-z]+){{1,2}}$')),
w AS (SELECT 'word' AS family, piece, f, s, f * 1000 + s + CASE class WHEN 'keep_full_word' THEN 50000 WHEN 'keep_contraction' THEN 30000 ELSE 10000 END + CASE WHEN regexp_matches(piece, '^[A-Za-z]+$') THEN 5000 ELSE 0 END + CASE WHEN piece IN {_PIN} THEN 500000 ELSE 0 END AS v FROM c
  WHERE (class = 'keep_full_word' AND regexp_matches(piece, '^[A-Za-z]{{3,}}$')) OR (class = 'keep_contraction' AND regexp_matches(piece, '^[A-Za-z]+[''’][A-Za-z]+$')) OR (class = 'curated_subword_auto_v2' AND length(piece) >= 3 AND NOT contains(piece, ' ') AND s >= 10)),
a AS (SELECT * FROM p UNION ALL SELECT * FROM w), m AS (SELECT family, 'freq' AS mode, piece, f AS value FROM a UNION ALL SELECT family, 'score', piece, s FROM a UNION ALL SELECT family, 'combined', piece, v FROM a),
o AS (SELECT family, mode, piece, max(value)::DOUBLE AS value FROM m GROUP BY ALL)
SELECT family, mode, (row_number() OVER (PARTITION BY family, mode ORDER BY value DESC, length(piece), piece))::INT AS place, piece, value FROM o QUALIFY place <= 200""",
)
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Phrases and words for the slots of a vocabulary, in the three sort modes and with pins; the candidates have no score."""
    rows = _candidates(spark, d).where("text is not null").select(F.col("text").alias("piece"), "freq", F.lit(0).alias("score"), "class")
    return ad.ranked_candidates(rows, 200)
