import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows with a schema, plus an extra column whose name clashes with internal ones."""

    def build(rows, schema, extra="h1"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumn(extra, F.lit("clash")) if extra else df

    return build
