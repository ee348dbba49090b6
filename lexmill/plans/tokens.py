"""Relations over the greedy tokens of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.catalog import query
from lexmill.cluster import keep, table
from lexmill.operators import tokens as tk
from lexmill.operators import vocabulary as vo
from lexmill.plans.common import TOKENS, docs_of

_BYTE = "regexp_matches(piece, '^<0x[0-9A-Fa-f]{2}>$')"
_SIZE = f"CASE WHEN {_BYTE} THEN 1 ELSE octet_length(encode(piece)) END"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return tk.token_rows(docs_of(spark, d), table(spark, d, "vocab"))


def arrays(spark: SparkSession, d: str) -> DataFrame:
    """The greedy tokens of each document (kept: several counts read them)."""
    return keep(tk.token_arrays(docs_of(spark, d), table(spark, d, "vocab")), "arrays")


@query("token_rows", f'WITH {TOKENS} SELECT doc_id, ix - 1 AS "at", byte_no, id, piece, is_byte FROM tok')
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d)


@query("vocabulary_usage", f"WITH {TOKENS} SELECT id, piece, use_count, doc_count, (5 * use_count + 50 * doc_count + 10 * greatest(0, length(piece) - 1) + 5 * greatest(0, {_SIZE} - 1))::BIGINT AS removal_score FROM (SELECT v.id, v.piece, count(t.doc_id) AS use_count, count(DISTINCT t.doc_id) AS doc_count FROM vocab v LEFT JOIN tok t ON v.id = t.id GROUP BY v.id, v.piece)")
def vocabulary_usage(spark: SparkSession, d: str) -> DataFrame:
    return tk.usage(arrays(spark, d), table(spark, d, "vocab"))


@query(
    "token_inventory",
    f"""WITH {TOKENS}, n AS (SELECT *, lag(id) OVER w AS before, lead(id) OVER w AS after FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY ix, byte_no)),
a AS (SELECT id, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq, count(DISTINCT before) AS left_diversity, count(DISTINCT after) AS right_diversity FROM n GROUP BY id)
SELECT v.id, v.piece, coalesce(a.freq, 0) AS freq, coalesce(doc_freq, 0) AS doc_freq, coalesce(left_diversity, 0) AS left_diversity, coalesce(right_diversity, 0) AS right_diversity, ({_SIZE})::BIGINT AS piece_bytes FROM vocab v LEFT JOIN a USING (id)""",
)
def token_inventory(spark: SparkSession, d: str) -> DataFrame:
    return tk.inventory(arrays(spark, d), table(spark, d, "vocab"))


@query("fallback_characters", f"WITH {TOKENS} SELECT x AS character, unicode(x)::INT AS code_point, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM m WHERE id IS NULL GROUP BY x")
def fallback_characters(spark: SparkSession, d: str) -> DataFrame:
    """Characters that fall back to bytes, with how often and in how many documents."""
    lost = rows(spark, d).where("is_byte").groupBy("doc_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte_no", "piece"))), lambda x: F.substring(x["piece"], 4, 2)), "").alias("h"))
    text = F.decode(F.unhex("h"), "utf-8")
    return lost.groupBy(text.alias("character")).agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs")).select("character", F.ascii("character").alias("code_point"), "uses", "docs")


@query("bigram_buckets", f"WITH {TOKENS}, b AS (SELECT (xor(coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY ix, byte_no), 0)::BIGINT * 1315423911, id::BIGINT * 2654435761)) AS h FROM tok) SELECT ((h % 4096) + 4096) % 4096 AS bucket, count(*) AS pairs FROM b GROUP BY 1")
def bigram_buckets(spark: SparkSession, d: str) -> DataFrame:
    return tk.bigram_buckets(tk.token_arrays(docs_of(spark, d), table(spark, d, "vocab")))


@query("token_class_masks", f"SELECT id, piece, {_BYTE} AS is_byte, NOT {_BYTE} AND piece LIKE ' %' AS is_space_led, NOT {_BYTE} AND contains(trim(piece), ' ') AS is_phrase, NOT {_BYTE} AND (contains(piece, chr(10)) OR len(list_filter(regexp_extract_all(piece, '[A-Za-z0-9]+(?:[''’\\-][A-Za-z0-9]+)*'), lambda x: x IN ('Chapter','Section','Volume','Act','Scene','Article','Part','Book','Page','Terms','Conditions','Summary','Introduction','Appendix','Table','Figure','Transcript','Episode','NEWS','THE','Text'))) > 0) AS is_structural FROM vocab")
def token_class_masks(spark: SparkSession, d: str) -> DataFrame:
    return vo.token_classes(table(spark, d, "vocab"))


_LOOKUP = f"SELECT id, CASE WHEN {_BYTE} THEN 1 WHEN piece LIKE ' %' THEN octet_length(encode(substr(piece, 2))) ELSE octet_length(encode(piece)) END::INT AS base_bytes, NOT {_BYTE} AND piece LIKE ' %' AS has_leading_space, false AS is_boundary FROM vocab"


@query("byte_lookup", _LOOKUP)
def byte_lookup(spark: SparkSession, d: str) -> DataFrame:
    return vo.byte_lookup(table(spark, d, "vocab"))


@query(
    "byte_accounting",
    f"""WITH {TOKENS}, lu AS ({_LOOKUP}), p AS (SELECT doc_id, id, lag(id) OVER (PARTITION BY doc_id ORDER BY ix, byte_no) AS prev FROM tok)
SELECT doc_id, count(*) AS n_tokens, sum(base_bytes + CASE WHEN has_leading_space AND prev IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS counted_bytes FROM p JOIN lu USING (id) GROUP BY doc_id""",
)
def byte_accounting(spark: SparkSession, d: str) -> DataFrame:
    return tk.byte_accounting(tk.token_arrays(docs_of(spark, d), table(spark, d, "vocab")), vo.byte_lookup(table(spark, d, "vocab")))


@query(
    "context_windows",
    f"""WITH {TOKENS}, a AS (SELECT piece, doc_id, ix, byte_no, is_byte, coalesce(string_agg(piece, '') OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') || '[' || piece || ']' || coalesce(string_agg(piece, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS context
  FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY ix, byte_no))
SELECT piece, hit::INT AS hit, doc_id, context FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY doc_id, ix, byte_no) AS hit FROM a WHERE NOT is_byte AND length(piece) >= 6) WHERE hit <= 5""",
)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return tk.context_windows(arrays(spark, d), table(spark, d, "vocab"), ~vo.is_byte_piece(F.col("piece")) & (F.char_length("piece") >= 6))


@query("vocabulary_validated", "SELECT id, piece FROM vocab")
def vocabulary_validated(spark: SparkSession, d: str) -> DataFrame:
    return vo.validated(table(spark, d, "vocab")).select("id", "piece")
