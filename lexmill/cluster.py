"""Session-level helpers shared by all operators: tables, kept intermediates, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys of a lookup that are ever broadcast, whatever the size of the data.
HOT_KEYS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: number of partitions the documents are spread over after reading; unset, they are read as they lie.
SPREAD = "spark.lexmill.documents.partitions"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as their files are split, or spread over as many partitions as SPREAD says.

    The setting is for files of one row group each, which Spark cannot split; it costs a shuffle of
    the texts and depends on nothing but the setting.
    """
    docs, spread = table(spark, sf_dir, "documents"), spark.conf.get(SPREAD, None)
    return docs.repartition(int(spread)) if spread else docs


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session."""
    if getattr(spark, "_lexmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    spark._lexmill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only a local session may go without the setting; it then gets a folder of its own. A cluster
    without one is refused, since a folder on one machine would be lost with that machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_lexmill_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="lexmill-")
        spark._lexmill_dir = own
    return own


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage: what reads the result twice computes it once, and a lost executor costs no
    recomputation of what lies before. The folder is per application and call, so that no two
    calls meet.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has kept; what still reads kept tables must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over all earlier rows in a global order, without one task seeing all rows.

    Rows are range partitioned and sorted; sums per partition, then within partitions. `order` has
    to be unique.
    """
    from pyspark.sql import Window

    ranged = keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select("__part", before.alias("__shift"))  # one row per partition
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(shifts), "__part").withColumn(name, within + F.col("__shift")).drop("__part", "__shift")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), with the columns of df computed once, before the filter.

    A plain filter over computed columns is pushed below the projection that computes them, with
    their expressions written out again; an array that a lambda refers to is then computed anew
    for each element. The row number keeps the filter above the projection.
    """
    return df.withColumn("__row", F.monotonically_increasing_id()).where(condition & (F.col("__row") >= 0)).drop("__row")


def null_safe_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def hot_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], n_rows: str, how: str = "inner") -> DataFrame:
    """rows joined with lookup (one row per key; n_rows: how many of `rows` have that key).

    A key with at least total / HOT_KEYS rows is hot. There can be at most HOT_KEYS of them, so
    their lookup rows are broadcast and their rows stay where they are; all other keys go through
    a shuffle join, in which no key then holds more than total / HOT_KEYS rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("how: inner or left")
    keys = list(keys)
    total = lookup.agg(F.sum(n_rows)).first()[0] or 0
    limit = max(1000, -(-total // HOT_KEYS))
    hot = lookup.where(F.col(n_rows) >= limit)
    names = [r[:-1] for r in hot.select(*keys, n_rows).limit(HOT_KEYS + 1).collect()]
    if not names:
        return rows.join(lookup, keys, how)
    marks = rows.sparkSession.createDataFrame(names, rows.select(*keys).schema).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(marks), keys, "left")
    warm = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys, how)
    cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(lookup.where(F.col(n_rows) < limit), keys, how)
    return warm.unionByName(cold)


def attached(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with lookup (one row per key), safe where many rows share a key; counts the rows per key first."""
    keys = list(keys)
    counted = lookup.join(rows.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    return hot_lookup(rows, counted, keys, "__n", how).drop("__n")


def salted(rows: DataFrame, keys: Sequence[str], by: Sequence[str], most: int = 20_000) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(rows with __salt, spread), for rows that are joined to small lookups on the same keys again and again.

    spread(lookup) repeats the lookup's row of a hot key for each of its salts; joined on the keys and
    __salt, no more than about `most` rows meet under one key. Hot keys are those with more rows than
    that, or more than total / HOT_KEYS, so that there are at most HOT_KEYS, which are broadcast.
    """
    keys = list(keys)
    limit = max(most, -(-rows.count() // HOT_KEYS))
    hot = keep(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__salts")).limit(HOT_KEYS), "hot")
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__salts"))).cast("int")

    def spread(lookup: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))
        return lookup.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(salts)).drop("__salts")

    return rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__salts"), spread
