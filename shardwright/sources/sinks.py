"""Sinks: run summaries (S9), metric rows (S10), training-order export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row result as JSON. Float columns are written as text
    ("NaN", "Infinity" stay readable and the file stays valid JSON); Spark's
    output committer makes the write atomic."""
    cols = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("double", "float")
            else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).coalesce(1).write.mode("overwrite").json(path)


METRIC_BUCKETS = 64


def append_metrics(metrics: DataFrame, path: str, run_col: str = "run_id", step_col: str = "step",
                   map_col: str = "metrics") -> None:
    """``(run, step, us, MAP<name, value>)`` → long rows appended to parquet, in folders by a hash
    of the run: as many files as buckets and tasks, however many runs there are."""
    long = metrics.select(run_col, step_col, "us", F.explode(map_col).alias("name", "value"))
    bucket = F.pmod(F.xxhash64(run_col), F.lit(METRIC_BUCKETS))
    long.withColumn("run_bucket", bucket).write.mode("append").partitionBy("run_bucket").parquet(path)


def read_metrics(spark: SparkSession, path: str, run_col: str = "run_id") -> DataFrame:
    """The appended rows; a filter on one run is best joined with its bucket."""
    return spark.read.parquet(path).drop("run_bucket")


def export_batches(plan: DataFrame, path: str, batches_per_file: int = 1024) -> DataFrame:
    """Windows in training order, in files that hold ``batches_per_file`` batches of one rank and epoch
    each, and an index of them: ``(epoch, rank, part, file, first_batch, last_batch, rows)``. Rows are dealt by (epoch,
    rank, part), which the plan fixes, and sorted inside; a plan without ranks is that of rank 0."""
    if batches_per_file <= 0:
        raise ValueError("a file needs at least one batch")
    ranked = plan if "rank" in plan.columns else plan.withColumn("rank", F.lit(0))
    part = F.floor(F.col("batch") / batches_per_file).cast("long")
    keys = ["epoch", "rank", "part"]
    n = max(1, ranked.select("epoch", "rank", part.alias("part")).distinct().count())
    (ranked.withColumn("part", part).repartition(n, *keys).sortWithinPartitions(*keys, "batch", "position")
     .write.mode("overwrite").partitionBy(*keys).parquet(f"{path.rstrip('/')}/batches"))
    spark = plan.sparkSession
    index = (spark.read.parquet(f"{path.rstrip('/')}/batches").groupBy(*keys, F.input_file_name().alias("file"))
             .agg(F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"), F.count(F.lit(1)).alias("rows")))
    index.write.mode("overwrite").parquet(f"{path.rstrip('/')}/index")
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def read_batches(spark: SparkSession, path: str, rank: int, epoch: int, first_batch: int = 0, end_batch: int | None = None) -> DataFrame:
    """The batches ``[first_batch, end_batch)`` of one rank and epoch: the index names the files that hold
    them, and no other is opened."""
    index = spark.read.parquet(f"{path.rstrip('/')}/index").where((F.col("rank") == rank) & (F.col("epoch") == epoch))
    asked = F.col("batch") >= first_batch if end_batch is None else (F.col("batch") >= first_batch) & (F.col("batch") < end_batch)
    held = F.col("last_batch") >= first_batch if end_batch is None else (F.col("last_batch") >= first_batch) & (F.col("first_batch") < end_batch)
    files = [r["file"] for r in index.where(held).select("file").orderBy("file").collect()]      # of one rank's epoch
    root = f"{path.rstrip('/')}/batches"
    schema = spark.read.parquet(root).schema
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*files).where(asked)
