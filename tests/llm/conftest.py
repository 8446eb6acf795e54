import os

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows to a DataFrame, with two extra columns whose names clash with inner ones."""
    def build(rows, schema, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumn("shard", F.lit("x")).withColumn("epoch", F.lit("y")) if extra else df

    return build


@pytest.fixture(scope="session")
def small(sf):
    return os.path.join(os.path.dirname(sf), "sf0.001")
