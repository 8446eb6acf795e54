"""Ordered document scan.

``doc_id`` is the order key of the token stream. Batch reads are parquet scans
(filters and column pruning reach the reader); the streaming variant reads the
same layout with a fixed schema and Spark's offset log as the resume cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
])


def _check_nulls(df: DataFrame, id_col: str, text_col: str, on_null: str) -> DataFrame:
    if on_null == "error":
        text = F.when(F.col(text_col).isNull(),
                      F.raise_error(F.concat(F.lit("null text in document "), F.col(id_col).cast("string"))))
        return df.withColumn(text_col, text.otherwise(F.col(text_col)))
    if on_null == "skip":
        return df.filter(F.col(text_col).isNotNull())
    if on_null == "empty":
        return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    raise ValueError("on_null must be 'error', 'skip' or 'empty'")


def balance(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over the cluster when it has fewer input splits than cores.

    Encoding and word splitting are CPU-bound per row; a corpus stored as a few
    large row groups would otherwise run them in a handful of tasks. A large
    corpus has far more splits than cores, so there this is a no-op. Hash
    partitioning by ``key`` keeps retries deterministic.
    """
    spark = df.sparkSession
    want = min_partitions or 2 * spark.sparkContext.defaultParallelism
    # after a shuffle the partition count is already the cluster's; counting
    # partitions of such a plan under AQE would run its shuffle stages
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    if df._jdf.rdd().getNumPartitions() >= want:
        return df
    return df.repartition(want, key)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                   on_null: str = "error", min_partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"),
                                         F.col(text_col).alias("text"))
    if min_partitions:
        df = balance(df, "doc_id", min_partitions)
    return _check_nulls(df, "doc_id", "text", on_null)


def stream_documents(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                     max_files_per_trigger: int = 1, on_null: str = "error",
                     schema: T.StructType | None = None) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if schema is None:
        schema = spark.read.parquet(path).schema
    df = reader.schema(schema).parquet(path).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _check_nulls(df, "doc_id", "text", on_null)
