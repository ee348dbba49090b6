"""Readers and writers of the text formats: JSON lines, CSV, plain lines, reports, logs, order files.

Every reader takes an explicit schema or names its columns, so that nothing is inferred from data.
Files are read in parallel; where the place of a row matters, it must be a column of the file or be
given by a key, since a distributed file has no line numbers of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which a text may stand, in order of preference.
TEXT_KEYS = ["text", "content", "body", "document", "raw_text", "article", "passage"]
VOCAB = "id int, piece string, kind string, priority double, source_id int, class string, freq bigint, score int, pinned boolean, source string, note struct<replaced:string,candidate_score:double,doc_hits:int,raw_count:bigint,est_savings:bigint>"
WORST_DOCS = "doc_idx bigint, delta_tokens bigint, bytes bigint, sp_tokens bigint, custom_tokens bigint, text_preview string"


def documents_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """text of JSON lines, in whichever of TEXT_KEYS it stands; bare strings count, blank texts do not."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    found = [F.get_json_object("value", f"$.{k}") for k in TEXT_KEYS]
    bare = F.when(F.col("value").rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"t":'), F.col("value"), F.lit("}")), "$.t"))
    text = F.coalesce(*(F.when(F.trim(t) != "", t) for t in [*found, bare]))
    return rows.select(text.alias("text")).where("text is not null")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with ord, from 0, in a given order (unique), counted without one task seeing all rows."""
    from lexmill.cluster import running_total

    return running_total(rows.withColumn("__one", F.lit(1)), list(order), "__one", "ord").drop("__one")


def documents_by_id(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted documents (doc_id, distinct); fails on reading where one is missing."""
    joined = wanted.select("doc_id").distinct().join(docs.withColumn("__there", F.lit(True)), "doc_id", "left")
    lost = F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("__there").isNull(), lost).otherwise(F.lit(True))).drop("__there")


def vocab_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def worst_documents_csv(spark: SparkSession, path: str, most: int) -> DataFrame:
    return csv(spark, path, WORST_DOCS).orderBy(F.desc("delta_tokens"), F.desc("custom_tokens"), "doc_idx").limit(most)


def piece_scores_tsv(spark: SparkSession, path: str) -> DataFrame:
    """piece and score of a piece list: the word mark becomes a space, special and byte pieces are flagged."""
    rows = spark.read.csv(path, sep="\t", schema="raw_piece string, score double", quote="")
    return rows.select("raw_piece", F.replace("raw_piece", F.lit("▁"), F.lit(" ")).alias("piece"), "score", F.col("raw_piece").rlike("^<.*>$").alias("is_special_or_byte"))


def lines(spark: SparkSession, path: str, least_chars: int = 0) -> DataFrame:
    """Trimmed lines of at least least_chars characters, with the name of their file."""
    return spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file")).where(F.char_length("line") >= least_chars)


def score_reports(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of score reports, one JSON file each; files that are none are left out, missing figures are null."""
    schema = "summary struct<token_ratio:double,fallback_token_share:double,mean_delta:double,p95_delta:double,p99_delta:double,score:double>"
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE").where("summary is not null").select("summary.*", F.col("_metadata.file_name").alias("file"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").csv(path, header=True, escape='"')


def write_order(df: DataFrame, path: str, name: str, *order) -> None:
    """Names in an order, one per line, in one file; for lists of shards, not for documents."""
    df.orderBy(*order).select(F.col(name).cast("string")).coalesce(1).write.mode("overwrite").text(path)
