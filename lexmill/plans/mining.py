"""N-gram mining and merge savings over the greedy tokens of all documents, one stream per shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.operators import mining
from lexmill.operators.tokens import token_arrays, unigrams
from lexmill.plans.common import TOKENS, docs_of


def stream(spark: SparkSession, d: str, scope: str | None = "shard_name") -> DataFrame:
    """The greedy tokens of all documents as streams (kept: n-grams of several lengths read it)."""
    more = [scope] if scope else []
    return keep(mining.linked(token_arrays(docs_of(spark, d), table(spark, d, "vocab"), *more), scope), "stream")


def _grams(n: int) -> str:
    leads = ", ".join(f"lead(id, {k}) OVER w AS i{k}" for k in range(1, n))
    key = " || ' ' || ".join(["id", *(f"i{k}" for k in range(1, n))])
    return f"g{n} AS (SELECT scope, doc_id, ix, byte_no, before, after, {key} AS gram FROM (SELECT *, {leads}, lag(id) OVER w AS before, lead(id, {n}) OVER w AS after FROM s WINDOW w AS (PARTITION BY scope ORDER BY doc_id, ix, byte_no)) WHERE i{n - 1} IS NOT NULL)"


_S = f"WITH {TOKENS}, s AS (SELECT *, coalesce(shard_name, '') AS scope FROM tok), {_grams(2)}, {_grams(3)}"


def _counts(n: int, least: int) -> str:
    return f"SELECT {n} AS n, gram, count(*) AS freq, count(DISTINCT scope) AS shard_count, least(count(DISTINCT before), 256) AS before_contexts, least(count(DISTINCT after), 256) AS after_contexts FROM g{n} GROUP BY gram HAVING count(*) >= {least}"


@query("unigram_counts", f"WITH {TOKENS} SELECT id, count(*) AS freq FROM tok GROUP BY id")
def unigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return unigrams(token_arrays(docs_of(spark, d), table(spark, d, "vocab")))


@query("bigram_counts", f"{_S} {_counts(2, 1)}")
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return mining.gram_counts(stream(spark, d), 2)


@query("trigram_counts", f"{_S} {_counts(3, 2)}")
def trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return mining.gram_counts(stream(spark, d), 3, 2)


def _values(n: int) -> str:
    joins = " ".join(f"JOIN u u{k} ON u{k}.id = split_part(gram, ' ', {k + 1})::INT" for k in range(n))
    product = " * ".join(f"(u{k}.f / total)" for k in range(n))
    return f"""SELECT n, gram, freq, shard_count, before_contexts, after_contexts, freq * {n - 1} AS tokens_saved, round(pmi, 6) AS pmi, round(freq * {n - 1} * greatest(pmi, 0) * (1 + ln(1 + before_contexts + after_contexts)), 3) AS merge_value
  FROM (SELECT c.*, ln(greatest(freq / (total - {n - 1}) / greatest({product}, 1e-18), 1e-12)) AS pmi FROM ({_counts(n, 20)}) c {joins}, tot)"""


@query("ngram_merge_values", f"{_S}, u AS (SELECT id, count(*) AS f FROM s GROUP BY id), tot AS (SELECT count(*) AS total FROM s) {_values(2)} UNION ALL {_values(3)}")
def ngram_merge_values(spark: SparkSession, d: str) -> DataFrame:
    return mining.merge_values(stream(spark, d))


@query(
    "best_ngrams_decoded",
    f"""{_S}, u AS (SELECT id, count(*) AS f FROM s GROUP BY id), tot AS (SELECT count(*) AS total FROM s), v AS ({_values(2)} UNION ALL {_values(3)}), b AS (SELECT * FROM v ORDER BY merge_value DESC, n, gram LIMIT 2000),
w AS (SELECT n, gram, string_agg(piece, '' ORDER BY k) AS text FROM (SELECT n, gram, unnest(string_split(gram, ' '))::INT AS id, generate_subscripts(string_split(gram, ' '), 1) AS k FROM b) JOIN vocab USING (id) GROUP BY n, gram) SELECT b.*, w.text FROM b JOIN w USING (n, gram)""",
)
def best_ngrams_decoded(spark: SparkSession, d: str) -> DataFrame:
    return mining.decoded(keep(mining.merge_values(stream(spark, d)), "values"), table(spark, d, "vocab"), 2000)


_CAND = "c3 AS (SELECT array_to_string(ids, ' ') AS gram, max(freq) AS recorded_freq FROM filtered_trigram_candidates_v2 WHERE len(ids) = 3 GROUP BY 1)"


@query("merge_savings_naive", f"{_S}, {_CAND} SELECT gram, recorded_freq, occurrences, occurrences * 2 AS naive_saved FROM c3 JOIN (SELECT gram, count(*) AS occurrences FROM g3 GROUP BY gram) USING (gram)")
def merge_savings_naive(spark: SparkSession, d: str) -> DataFrame:
    return mining.naive_savings(stream(spark, d), table(spark, d, "filtered_trigram_candidates_v2"))


def _greedy(scope: str) -> str:
    return f"""WITH {TOKENS}, s AS (SELECT *, coalesce({scope}::VARCHAR, '') AS scope FROM tok), {_grams(3)}, {_CAND},
pos AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY doc_id, ix, byte_no) AS pos FROM s),
st AS (SELECT scope, list(pos::HUGEINT ORDER BY pos) AS starts FROM (SELECT p.scope, p.pos FROM pos p JOIN g3 USING (scope, doc_id, ix, byte_no) JOIN c3 USING (gram)) GROUP BY scope),
mg AS (SELECT scope, (list_reduce(starts, lambda a, p: CASE WHEN p >= a % 1000000000000 THEN (a // 1000000000000 + 1) * 1000000000000 + p + 3 ELSE a END, 0::HUGEINT) // 1000000000000)::BIGINT AS merges FROM st),
r AS (SELECT scope, tokens, coalesce(merges, 0) AS merges, coalesce(merges, 0) * 2 AS saved FROM (SELECT scope, count(*) AS tokens FROM s GROUP BY scope) LEFT JOIN mg USING (scope))"""


@query("merge_savings_greedy", _greedy("shard_name") + " SELECT * FROM r")
def merge_savings_greedy(spark: SparkSession, d: str) -> DataFrame:
    return mining.greedy_merges(stream(spark, d), table(spark, d, "filtered_trigram_candidates_v2"))


@query("merge_simulation", _greedy("doc_id") + " SELECT sum(tokens)::BIGINT AS tokens, sum(merges)::BIGINT AS merges, sum(saved)::BIGINT AS saved, count(*) FILTER (saved > 0) AS streams_with_merges, round(sum(saved) * 100.0 / sum(tokens), 6) AS percent_saved FROM r")
def merge_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Merges within each document on its own: lengths before and after, over all documents."""
    return mining.savings_report(mining.greedy_merges(stream(spark, d, None), table(spark, d, "filtered_trigram_candidates_v2")))
